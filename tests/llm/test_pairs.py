"""SimHash, decontamination, exact search and line dedup against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import decontaminate, linededup, simhash, topk
from lexloom.llm.common import Scratch
from lexloom.llm.components import connected_components

DOCS = "doc_id long, text string"


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(n)]


def edge_docs(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "word"), (6, "x " * 30000)], DOCS)


# ---- components


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# ---- simhash


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def slow_components(keys, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict[int, object] = {}
    for i, k in enumerate(keys):
        r = find(i)
        if k is not None and (least.get(r) is None or k < least[r]):
            least[r] = k
    return [least.get(find(i)) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    rng = random.Random(1)
    words = vocabulary(rng)
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 200))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append(" ".join(copy))
    rows = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [slow_fingerprint(t) for _, t in rows]
    expected = slow_components([k for k, _ in rows], fps)
    assert got == {k: (f"{f:016x}", c) for (k, _), f, c in zip(rows, fps, expected, strict=True)}


@pytest.mark.parametrize("tile", [8, 2048])
def test_links_within_any_group(spark, monkeypatch, tile):
    """A dense cluster, with keys split into tiles and not: all within three bits of each other are connected."""
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {center}
    for _ in range(150):
        f = center
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    scratch = Scratch(spark, "t")
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), scratch)
    got = {r.node: r.root for r in connected_components(links, scratch).collect()}
    expected = slow_components(signed, [f & (1 << 64) - 1 for f in signed])
    assert {f: got.get(f, f) for f in signed} == dict(zip(signed, expected, strict=True))
    assert links.count() < 40 * len(fps)


def test_simhash_edges(spark):
    docs = edge_docs(spark).withColumn("fingerprint", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("key", F.lit(1))
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == 8
    zero = [g for g in got if g[1] == "0" * 16]
    assert sorted(g[0] for g in zero) == [1, 2, 3] and {g[2] for g in zero} == {1}
    assert {g[2] for g in got if g[0] in (None, 4)} == {4}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]


def test_near_dedup_keeps_rows_not_keys(spark):
    """Different texts under null keys or under one key are different documents."""
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(vocabulary(rng)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a, 1), (None, b, 2), (None, c, 3), (7, d, 4), (7, e, 5), (7, e, 6), (9, a, 7), (None, c, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, who int").withColumn("k", F.lit("x")).withColumn("u", F.lit(0)).withColumn("row", F.lit(None).cast("string"))
    kept = simhash.drop_near_duplicates(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == sorted([(False, 9, a), (True, 0, b), (True, 0, c), (False, 7, d), (False, 7, e)])
    many = docs.limit(0).unionByName(docs.filter("who = 4").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("n"))
    assert simhash.drop_near_duplicates(many).count() == 1


# ---- decontamination


def slow_contamination(text, items, window=10):
    pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda t: re.findall(pattern, (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    words, hit, names = lower(text), set(), set()
    for name, item in items:
        w = lower(item)
        span = min(window, len(w))
        for i in range(len(w) - span + 1 if w else 0):
            for p in range(len(words) - span + 1):
                if words[p : p + span] == w[i : i + span]:
                    hit.update(range(p, p + span))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_contamination_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rng = random.Random(4)
    words = vocabulary(rng, 12)
    items = [(i, ", ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 4, 9, 10, 11, 25])))) for i in range(25)] + [(3, "also number three and then some more words here now")]
    docs = []
    for i in range(60):
        parts = [" ".join(rng.choice(words).upper() for _ in range(rng.randint(0, 12)))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(len(items))][1].split(", ")
            at = rng.randrange(len(w))
            parts.append("; ".join(w[at : at + rng.randint(1, 14)]))
        docs.append((i, "\n".join(parts)))
    got = {r[0]: tuple(r[1:]) for r in decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: slow_contamination(t, items) for k, t in docs}


def test_contamination_edges(spark):
    items = spark.createDataFrame([(1, None), (2, "!!"), (3, "word"), (None, "a b c"), (3, "word")], "item_id long, text string")
    docs = edge_docs(spark).withColumn("n_hit", F.lit(1)).withColumn("t", F.lit("x")).withColumn("item_id", F.lit(1))
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in decontaminate.contamination(docs, items).collect())
    assert got == [(0, 3, 3, 1), (1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0), (4, 3, 3, 1), (4, 3, 3, 1), (5, 1, 1, 1), (6, 30000, 0, 0)]
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 6]
    spans = decontaminate.contamination(docs.filter("doc_id = 5"), items, spans=True).first().spans
    assert spans == [[0, 1]]


# ---- top k


def slow_top_k(rows, k, every):
    scaled = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, v in rows}
    out = set()
    for q in (i for i in scaled if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(scaled[q], v, strict=True)), i) for i, v in scaled.items() if i != q)
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)}
    return out


@pytest.mark.parametrize(("shard", "block", "wave"), [(4096, 1024, 1 << 24), (7, 3, 500)])
def test_top_k_matches_brute_force(spark, monkeypatch, shard, block, wave):
    monkeypatch.setattr(topk, "SHARD", shard)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "WAVE_BYTES", wave)
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(90)] + [(i, [0.5, 0.25, 0.0, 0.0, 0.0, -0.5]) for i in range(90, 130)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    assert got == slow_top_k(rows, 5, 10)


def test_top_k_tree(spark, monkeypatch):
    monkeypatch.setattr(topk, "FAN_IN", 2)
    monkeypatch.setattr(topk, "SHARD", 4)
    rows = [(i, [float(i % 7), 1.0]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(df.repartition(9), F.col("vec_id") % 10 == 0).collect()} == slow_top_k(rows, 5, 10)


@pytest.mark.parametrize("scale", [1e4, 1e6, 1e15])
def test_top_k_large_components(spark, scale):
    rows = [(i, [scale * (i % 5), -scale * (i % 3), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()}
    clip = lambda s: max(min(s, 2**63 - 1), -(2**63) + 1)
    if scale < 1e15:
        assert got == slow_top_k(rows, 5, 10)
    else:
        assert all(s == clip(s) for *_, s in got) and len(got) == 15


@pytest.mark.parametrize("scale", [1.0, 1e4, 1e5])
@pytest.mark.parametrize("copies", [2, 40])
def test_top_k_repeated_query_rows(spark, copies, scale):
    rows = [(i, [scale * (i % 50 + 1), scale]) for i in range(1, 60)]
    own = [(0, [scale * 90, scale])] * copies
    df = spark.createDataFrame(rows + own, "vec_id long, embedding array<double>").coalesce(1)  # one tile of over 24 rows
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).collect())
    assert got == sorted(slow_top_k([(0, own[0][1]), *rows], 5, 100))


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0]), (7, [0.5, 0.5]), (7, [0.5, 0.5]), (50, []), (100, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1, 65536), (0, 2, 7, 32768), (0, 3, 7, 32768), (100, 1, 6, 65536)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 9).count() == 0


# ---- line dedup


def spans_in(a, b, least):
    """Lines of ``a`` in common blocks of at least ``least`` words with ``b``."""
    found = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(len(x.split()) for x in a[i : i + n]) >= least:
                found.update(range(i, i + n))
    return found


@pytest.mark.parametrize("seed", range(2))
def test_line_dedup_matches_brute_force(spark, seed):
    """Passages in any order, and lines that occur again and again: the very lines that common blocks hold go."""
    rng = random.Random(9 + seed)
    words = vocabulary(rng, 200)
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [[line(rng.randint(1, 25)) for _ in range(rng.randint(1, 5))] for _ in range(12)]
    common = [line(2) for _ in range(3)]
    docs = []
    for i in range(50):
        body = []
        for _ in range(rng.randint(1, 5)):
            body += rng.choice(passages) if rng.random() < 0.6 else [line(rng.randint(1, 30))]
            body.append(rng.choice(common))
        docs.append((i, body))
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(i, "\n".join(b)) for i, b in docs], DOCS), min_words=20).collect()}
    for i, body in docs:
        gone = {x for _, earlier in docs[:i] for x in spans_in(body, earlier, 20)}
        assert (got[i].n_deleted, got[i].text) == (len(gone), "\n".join(t for x, t in enumerate(body) if x not in gone))


def test_line_dedup_hot_groups(spark):
    """A run in thousands of texts, a text in thousands of rows, and a very long text of one line again and again."""
    long = [" ".join(f"{c}{i}" for i in range(30)) for c in "ab"]
    rows = [(i, f"head {i}\n" + "\n".join(long) + f"\ntail {i}") for i in range(3000)] + [(3000 + i, "x\n" + "\n".join(long)) for i in range(2000)]
    rows += [(9000, "\n".join([long[0]] * 4000)), (9001, "\n".join([long[0]] * 3000 + ["other"]))]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].n_deleted == 0 and all(got[i].text == f"head {i}\ntail {i}" for i in range(1, 3000))
    assert got[3000].text == "x" and all(got[i].text == "" and got[i].n_deleted == 3 for i in range(3001, 5000))
    assert got[9000].n_deleted == 0 and got[9001].text == "other"


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_every_earlier_document(spark, seed):
    rng = random.Random(seed)
    words = vocabulary(rng, 200)
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(0, [line(82), line(10)]), (1, [line(30)])]  # a copy of 2 shares its long line with 0, the rest with 2 only
    docs.append((2, [docs[0][1][0], *(line(n) for n in (10, 9, 1, 10))]))
    docs += [(3, list(docs[2][1])), (4, [line(5), "", *docs[2][1][1:]]), (5, [line(40), *docs[2][1]])]
    passages = [[line(rng.randint(1, 25)) for _ in range(rng.randint(2, 8))] for _ in range(5)]
    for i in range(6, 50):
        body = list(rng.choice(docs)[1])  # near copies of near copies: a run has many holders with other tails
        at = rng.randint(0, len(body))
        body[at : at + rng.randint(0, 2)] = rng.choice([[line(rng.randint(1, 30))], rng.choice(passages), []])
        docs.append((i, body or [line(3)]))
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(i, "\n".join(b)) for i, b in docs], DOCS), min_words=50).collect()}
    assert got[3].n_deleted == 5
    for i, body in docs:
        solid = [x for x, t in enumerate(body) if t]
        gone = {solid[x] for _, earlier in docs[:i] for x in spans_in([body[x] for x in solid], [t for t in earlier if t], 50)}
        assert (got[i].n_deleted, got[i].text) == (len(gone), "\n".join(t for x, t in enumerate(body) if x not in gone))


def test_patience_blocks_in_other_order():
    a, sizes = [1, 2, 3, 9, 4, 5, 6], [10] * 7
    b = [4, 5, 6, 8, 1, 2, 3]
    assert linededup.aligned_lines(a, sizes, b, [10] * 7, 25) == [0, 1, 2, 4, 5, 6]
    assert linededup.aligned_lines(a, sizes, b, [10] * 7, 35) == []
    assert linededup.aligned_lines([1, 7, 2], [10, 0, 10], [1, 2], [10, 10], 20) == [0, 2]
    assert linededup.aligned_lines([1, 1, 1], [10] * 3, [1, 1], [10] * 2, 20) == [0, 1, 2]


def test_line_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (4, long), (5, f"own line\n  {long.upper()}  \nlast"), (None, long), (6, long)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text").cast("long")).withColumn("k", F.lit(1)).withColumn("lines", F.lit("x")).withColumn("row", F.lit(2))
    got = sorted(((r.doc_id or 0), r.text, r.n_lines, r.n_deleted) for r in linededup.dedup_lines(docs).filter("doc_id is null or doc_id <> 1").collect())
    assert got == [(0, long, 1, 0), (2, "", 1, 0), (3, "\n\n", 3, 0), (4, "", 1, 1), (4, "", 1, 1), (5, "own line\nlast", 3, 1), (6, "", 1, 1)]
    assert linededup.dedup_lines(docs).filter("doc_id = 1").first()[1:] == (None, 0, 0)
    kept = linededup.strip_shared(docs, count="n_chars")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r.doc_id or 0, r.n_chars) for r in kept.filter("text is not null").collect()) == [(0, len(long)), (2, 0), (3, 2), (5, 13)]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(7, long), (7, long)], DOCS)
    assert [r.text for r in linededup.dedup_lines(twice).collect()] == [long, long]
