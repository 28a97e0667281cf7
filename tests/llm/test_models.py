"""Classifier, archives, language model, packing, licences, attribution and the pipeline."""

from __future__ import annotations

import base64
import collections
import hashlib
import io
import math
import random
import re
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lexloom.llm import attribution, katz, licenses, packing, queries, rules, warc
from lexloom.llm.common import fold_of
from tests.llm.test_pairs import slow_components, slow_contamination, slow_fingerprint, spans_in

DOCS = "doc_id long, text string"
WORD_BPE, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c"), (4, "a b c"), (4, "a b c"), (5, "word"), (6, "x " * 30000)]


def edge_docs(spark):
    df = spark.createDataFrame(EDGE, DOCS)
    for name in ("score", "k", "t", "w", "row", "piece", "length", "p", "held_out"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."


# ---- classifier


def labelled(spark, n=600):
    rng = random.Random(0)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(5, 80))
        if not good:
            text = [text.upper(), " ".join(w + "$$%" for w in text.split()), " ".join(text.split()[:2] * 40)][i % 3]
        rows.append((i, text, int(good)))
    df = spark.createDataFrame(rows, DOCS + ", quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality")


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = rules.train(docs, labels, usable=fold_of("doc_id", 4) != 2)
    assert 0 < len(model.rules) < 200
    assert rules.train(docs.repartition(7), labels.repartition(3), usable=fold_of("doc_id", 4) != 2) == model
    got = rules.quality_scores(docs, model).join(labels, "doc_id").filter(fold_of("doc_id", 4) == 2).collect()
    assert len(got) > 100 and sum(r.predicted == r.quality for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = rules.keep_quality(docs.withColumn("row", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "row"]
    assert kept.count() == rules.quality_scores(docs, model).filter("predicted = 1").count()


def test_compiled_rules_say_what_rules_say(spark):
    model = rules.RuleModel(0.5, [((("n_words", "<=", 2.0),), -1.5), ((("n_words", ">", 1.0), ("capitals", "<=", 0.1)), 2.0)])
    got = [r.score for r in rules.quality_scores(spark.createDataFrame([(1, "a"), (2, "a b"), (3, "A B C")], DOCS), model).orderBy("doc_id").collect()]
    assert got == pytest.approx([1 / (1 + math.exp(1.0)), 1 / (1 + math.exp(-1.0)), 1 / (1 + math.exp(-0.5))])


def test_lasso_is_optimal():
    """The subgradient conditions of the penalised logistic loss hold at the weights found."""
    rng = np.random.default_rng(2)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + 0.5)))).astype(float)
    for penalty in (0.05, 0.01, 0.002):
        b, w = rules._lasso(r, y, penalty, rounds=3000)
        e = 1 / (1 + np.exp(-(r @ w + b))) - y
        slope = r.T @ e / len(y)
        assert abs(e.mean()) < 1e-5
        assert np.abs(slope[w != 0] + penalty * np.sign(w[w != 0])).max(initial=0) < 1e-5 and np.abs(slope[w == 0]).max(initial=0) <= penalty + 1e-6


def slow_statistics(text):
    words = [w for w in re.split("[ \t\n\r]+", text) if w]
    share = lambda pattern: len(re.findall(pattern, text)) / max(len(text), 1)
    lines = text.split("\n")
    return {
        "n_words": len(words), "mean_word": len(text) / max(len(words), 1), "distinct_words": len(set(words)) / max(len(words), 1),
        "symbols": share(r"[#$%&*!@^~|<>{}\[\]=+_/]"), "capitals": share("[A-Z]"), "digits": share("[0-9]"), "stops": share("[.,;:?]"), "distinct_lines": len(set(lines)) / len(lines),
    }


def test_scores_match_a_slow_interpreter(spark):
    """A trained ensemble gives each text the score that its rules, read one by one, give."""
    docs, labels = labelled(spark)
    model = rules.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.unionByName(edge_docs(spark).select("doc_id", "text").filter("doc_id IN (1, 2, 3, 6)").withColumn("doc_id", -F.col("doc_id"))).collect()}
    got = rules.quality_scores(spark.createDataFrame(list(texts.items()), DOCS), model).collect()
    for r in got:
        s = slow_statistics(texts[r.doc_id])
        total = model.intercept + sum(w for rule, w in model.rules if all(s[n] <= v if sign == "<=" else s[n] > v for n, sign, v in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total))), r.doc_id
    assert model.rules and len(got) == len(texts)


def test_penalty_is_chosen_on_unseen_rows(monkeypatch):
    """Trees for the choice are grown without the rows that judge it."""
    rng = np.random.default_rng(3)
    x, y = rng.random((200, 3)), (rng.random(200) < 0.5).astype(float)
    grown = []
    monkeypatch.setattr(rules, "grow_rules", lambda x, y, f=rules.grow_rules: grown.append(len(y)) or f(x, y))
    assert rules.choose_penalty(x, y) in rules.PENALTIES and grown == [160]


def test_classifier_edges(spark):
    docs, labels = labelled(spark, 200)
    model = rules.train(docs, labels.unionByName(labels).unionByName(spark.createDataFrame([(1, None), (None, 1), (10**9, 0)], labels.schema)))
    got = rules.quality_scores(edge_docs(spark), model).collect()
    assert len(got) == len(EDGE) and all(r.score is not None for r in got)
    assert rules.train(docs, labels.limit(0)) == rules.RuleModel(0.0, [])
    clash = docs
    for name in ("k", "y", "row", "t", "id", "w", "l", "quality", "n_words"):
        clash = clash.withColumn(name, F.lit("clash"))
    assert rules.train(clash, labels) == rules.train(docs, labels)
    assert rules.train(docs, labels.withColumn("quality", F.lit(1))).rules == []
    assert rules.quality_scores(docs.limit(0), model).count() == 0 and rules.keep_quality(edge_docs(spark), model).columns == edge_docs(spark).columns


# ---- archives


def test_archive_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rng = random.Random(1)
    bodies = [f"<html><head><title>{prose(rng, 5)}</title></head><body class='x'>{prose(rng, rng.randint(1, 120))}é</body></html>" for _ in range(60)]
    rows = [(i, f"http://h/{i}\r\nX: y", rng.choice(bodies) if i % 3 else bodies[i % 60]) for i in range(150)] + [(150, None, None), (151, "u", ""), (152, "u", "x" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {int(r.id): r for r in warc.archive(spark, df, root=f"file://{tmp_path}/out").collect()}
    first: dict[str, int] = {}
    for i, _, html in rows:
        first[html or ""] = max(first.get(html or "", -1), i)
    assert len(got) == len(rows)
    for i, url, html in rows:
        body, r = (html or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", str(first[html or ""])))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
        assert r.uri == " ".join((url or "").split())
    files = sorted((tmp_path / "out").glob("*.warc.zst"))
    assert len(files) > 3 and not list((tmp_path / "out").glob(".*"))
    made, names = set(), []
    for f in files:
        data = f.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and size and data[8 + size : 12 + size] == zstandard.FRAME_HEADER
        records = list(warc.decode_archive(io.BytesIO(data), chunk=7))
        assert records == list(warc.decode_archive(io.BytesIO(data)))
        head, _, info = warc.parse_record(records[0])
        assert head["warc-type"] == "warcinfo"
        made |= {how for how in ("trained", "raw") if f"dictionary: {how}".encode() in records[0]}
        names += [warc.parse_record(r)[0]["warc-record-id"] for r in records]
    assert "trained" in made and len(names) == len(set(names)) == len(rows) + len(files)


def test_dictionary_is_of_whole_records():
    """Records that cannot be trained on are the dictionary themselves; long ones are not cut."""
    rng = random.Random(2)
    few = [prose(rng, 400).encode() for _ in range(2)]
    assert warc.build_dictionary(few) == (b"".join(few), "raw")
    long = [prose(rng, 60_000).encode() for _ in range(30)]
    dictionary, how = warc.build_dictionary(long)
    assert how == "trained" and len(dictionary) <= warc.DICTIONARY_BYTES
    for records in (few, long, [b""], [b"x"]):
        assert list(warc.decode_archive(io.BytesIO(b"".join(warc.encode_archive(records)))))[1:] == records


def test_archive_hot_payload(spark):
    """One payload in thousands of pages, and another of 3 MB."""
    rows = [(i, "u", "same page" if i % 3 else f"page {i}") for i in range(6000)] + [(6000, "u", "long " * 600_000)]
    got = {int(r.id): r for r in warc.archive(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 6001 and got[6000].payload_bytes == 3_000_000 and len(got[6000].payload) == 3_000_000
    assert all((got[i].record_type, got[i].refers_to) == (("response", None) if i % 3 == 0 or i == 5999 else ("revisit", "5999")) for i in range(6000))


def test_archive_minimum_and_edges(spark):
    df = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "long enough"), (4, "u", "long enough"), (None, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    df = df.withColumn("digest", F.lit(1)).withColumn("k", F.lit("x")).withColumn("body", F.lit(2))
    got = sorted((r.id or "", r.record_type, r.refers_to or "") for r in warc.archive(spark, df, minimum=3).collect())
    assert got == [("", "revisit", "4"), ("1", "response", ""), ("2", "response", ""), ("3", "revisit", "4"), ("4", "response", ""), ("4", "response", "")]
    assert warc.archive(spark, df.limit(0)).count() == 0


def test_truncated_archive():
    records = [warc._record("response", "1", "u", b"<html>" + bytes(500), "D", None, 506) for _ in range(20)]
    data = b"".join(warc.encode_archive(records))
    assert list(warc.decode_archive(io.BytesIO(data)))[1:] == records
    with pytest.raises(ValueError):
        list(warc.decode_archive(io.BytesIO(data[:-4])))


# ---- language model


def slow_katz(docs, order=3, cut=5, reserve=0.5):
    """Scores by dictionaries, word for word from the formulas; checks that contexts sum to 1."""
    end, start = "\0e", "\0s"
    tokens = [[w.decode() for w in (t or "").encode().lower().split()] + [end] for _, t, _ in docs]
    train = [t for t, (_, _, f) in zip(tokens, docs, strict=True) if f]
    counts = [collections.Counter() for _ in range(order)]
    context = [collections.Counter() for _ in range(order)]
    for t in train:
        padded = [start] * (order - 1) + t
        for i in range(order - 1, len(padded)):
            for n in range(order):
                counts[n][tuple(padded[i - n : i + 1])] += 1
                context[n][tuple(padded[i - n : i])] += 1
    total = sum(counts[0].values())

    def discount(counts):
        of = collections.Counter(counts.values())
        q = (cut + 1) * of[cut + 1] / of[1] if of[1] else 1
        d = {}
        for r in range(1, cut + 1):
            x = ((r + 1) * of[r + 1] / (r * of[r]) - q) / (1 - q) if of[r] and q < 1 else 1
            d[r] = x if 0 < x <= 1 else 1
        return d

    d = [discount(c) for c in counts]
    left = sum(c * (1 - d[0].get(c, 1)) for c in counts[0].values())
    scale, unknown = (1, left / total) if left > 0 else (total / (total + 1), 1 / (total + 1))
    after = [collections.defaultdict(list) for _ in range(order)]
    for n in range(1, order):
        for g in counts[n]:
            after[n][g[:-1]].append(g[-1])
    memo = {}

    def divisor(n, h):
        spare = all(d[n].get(counts[n][(*h, w)], 1) == 1 for w in after[n][h])
        return context[n][h] + (reserve if spare else 0)

    def alpha(n, h):
        if (n, h) not in memo:
            seen = sum(p(n, h, w) for w in after[n][h])
            memo[n, h] = (1 - seen) / (1 - sum(p(n - 1, h[1:], w) for w in after[n][h]))
        return memo[n, h]

    def p(n, h, w):
        c = counts[n][(*h, w)]
        if n == 0:
            return scale * d[0].get(c, 1) * c / total if c else unknown
        if c:
            return d[n].get(c, 1) * c / divisor(n, h)
        return (alpha(n, h) if context[n][h] else 1) * p(n - 1, h[1:], w)

    for n in range(1, order):
        for h in [*list(after[n])[:4], *list(after[n])[-4:]]:
            assert sum(p(n, h, w) for (w,) in counts[0]) + p(n, h, "never seen") == pytest.approx(1)
    out = {}
    for t, (key, _, f) in zip(tokens, docs, strict=True):
        padded = [start] * (order - 1) + t
        score = sum(math.log10(p(order - 1, tuple(padded[i - order + 1 : i]), padded[i])) for i in range(order - 1, len(padded)))
        base = sum(math.log10((counts[0][(w,)] + 1) / (total + len(counts[0]) + 1)) for w in t)
        out[key] = (not f, len(t), sum((w,) in counts[0] for w in t), total, base, score)
    return out


@pytest.mark.parametrize(("order", "chunk"), [(1, 100), (2, 100), (3, 60), (3, 10**6), (4, 100)])
def test_katz_matches_brute_force(spark, monkeypatch, order, chunk):
    """With small chunks contexts that occur more often than a chunk has tokens are dealt out to many buckets."""
    monkeypatch.setattr(katz, "CHUNK", chunk)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)] + ["É", "A", "</s>", "<s>"] + ["the"] * 300
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) if i % 11 else None, i % 4 != 1) for i in range(90)]
    docs += [(90 + i, "the same words again and again", True) for i in range(8)] + [(99, "the same words never", False)]
    df = spark.createDataFrame(docs, DOCS + ", train boolean").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in katz.katz_scores(df, F.col("train"), order=order).collect()}
    expected = slow_katz(docs, order)
    assert got.keys() == expected.keys()
    for k, e in expected.items():
        assert got[k][:4] == e[:4] and got[k][4:] == pytest.approx(e[4:]), k


def test_katz_query_keeps_all_counts(spark, tmp_path):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 40)))) for i in range(90)]
    df = spark.createDataFrame(texts, DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    train = {r.doc_id: r.train for r in df.select("doc_id", (fold_of("doc_id", 7) != 2).alias("train")).collect()}
    expected = slow_katz([(i, t, train[i]) for i, t in texts])
    got = {r.doc_id: tuple(r)[1:] for r in queries.op3_katz_backoff(spark, str(tmp_path)).collect()}
    assert got.keys() == expected.keys()
    for k, e in expected.items():
        assert got[k][:4] == e[:4] and got[k][4:] == pytest.approx(e[4:])


def test_katz_edges(spark):
    docs = edge_docs(spark)
    got = katz.katz_scores(docs, F.lit(True)).collect()
    assert len(got) == len(EDGE) and {r.n_tokens for r in got} == {1, 2, 4, 30001} and all(math.isfinite(r.score) for r in got)
    none = katz.katz_scores(docs, F.lit(None).cast("boolean")).collect()
    assert all(r.held_out and (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0, 0) for r in none)
    assert katz.katz_scores(docs.limit(0), F.lit(True)).count() == 0


def test_keys_pack():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all() and len(katz.unpack_keys(b"")) == 0


# ---- packing


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    h = collections.Counter(min(4096, int(rng.lognormvariate(5.5 + seed / 3, 1)) + 1) for _ in range(5000))
    plan = packing.plan_packing(dict(h))
    got = collections.Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 4096 and n > 0
        for k in lengths:
            got[k] += n
    assert got == h
    first_fit = []  # a plain packing to compare with
    for k in sorted(h.elements(), reverse=True):
        for i, room in enumerate(first_fit):
            if room >= k:
                first_fit[i] -= k
                break
        else:
            first_fit.append(4096 - k)
    assert sum(n for _, n in plan) <= len(first_fit) * 1.003 + 1


def test_plan_edges():
    assert packing.plan_packing({}) == []
    assert packing.plan_packing({4096: 3}) == [((4096,), 3)]
    assert packing.plan_packing({1: 3}, capacity=2) and sum(n for _, n in packing.plan_packing({1: 3}, capacity=2)) == 2
    assert packing.plan_packing({2049: 5}) == [((2049,), 5)]


def test_encoder_is_the_tokenizer():
    t = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(2)
    texts = ["", "it's I'LL ''s", "a<|endoftext|>b", "É ß ẞ × ª\x1cq\xa0z", "日本語 🙂", "İx ΑΣ", "12ab3...!", "≮ x"] + ["".join(rng.choice("ab'sST .,1é\n\x1c<|>-_ß×Ř") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    assert [e.tolist() for e in packing.Encoder.of(WORD_BPE).encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check_packed(rows, texts, capacity):
    t = Tokenizer.from_file(WORD_BPE)
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    expected = collections.Counter()
    for key, text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for n, s in enumerate(range(0, len(ids), capacity)):
            own = ids[s : s + capacity]
            expected[key, n, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert pieces == expected
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(spark):
    rng = random.Random(5)
    texts = [(i, prose(rng, rng.randint(0, 60))) for i in range(150)]
    rows = packing.pack(spark.createDataFrame(texts, DOCS).repartition(3), WORD_BPE, capacity=100).collect()
    n = check_packed(rows, texts, 100)
    assert n <= math.ceil(sum(r.length for r in rows) / 100) * 1.05 + 1


def test_pack_edges(spark):
    check_packed(packing.pack(edge_docs(spark), WORD_BPE).collect(), EDGE, 4096)
    assert packing.pack(edge_docs(spark).limit(0), WORD_BPE).count() == 0


# ---- licences


def slow_scan(text, threshold=0.8):
    words = lambda t: re.findall("[a-z0-9]+", t.translate({c: c + 32 for c in range(65, 91)}))
    pairs = lambda w: set(zip(w, w[1:], strict=False))
    lines = [words(x) for x in (text or "").split("\n")]
    whole = [w for x in lines for w in x]
    full = [j for j, x in enumerate(lines) if x]
    found = []
    for i, (name, body) in enumerate(licenses.TEMPLATES):
        y = pairs(words(body))
        units = [(j, 1, x) for j, x in enumerate(lines)] + ([(-1, len(lines), whole)] if len(lines) > 1 else [])
        for k, j in enumerate(full if len(words(body)) > licenses.RUN_WORDS else []):
            if pairs(lines[j]) & y:
                reach = next((m for m in range(1, len(full) - k) if sum(len(lines[x]) for x in full[k : k + m]) >= len(words(body))), len(full) - k)
                units += [(j, full[k + m - 1] - j + 1, [w for x in full[k : k + m] for w in lines[x]]) for m in (reach, reach - 1) if m > 1]
        for u, n, w in units:
            x = pairs(w)
            dice = 2 * len(x & y) / (len(x) + len(y)) if x else 0
            if dice >= threshold:
                found.append((-dice, i, len(lines) if u == -1 else u, n, name, u))
    best = min(found, default=None)
    return (best[4], -best[0], best[5], best[3], len(found)) if best else (None, None, None, None, 0)


def test_licenses(spark):
    rng = random.Random(6)
    texts = [None, "", "one", "a b c"]
    for _ in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            body = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 9])):
                body[rng.randrange(len(body))] = rng.choice(["x", "THE", "License", ""])
            lines.append(rng.choice([" ".join(body), prose(rng, 9), "", " ".join(body).upper()]))
        texts.append("\n".join(lines))
    whole = licenses.TEMPLATES[1][1].split()
    texts += [" ".join(whole[:30]) + "\n" + " ".join(whole[30:])]
    split = len(texts) - 1
    wrapped = {}
    for name, body in {n: t for n, t in licenses.TEMPLATES if len(t) > 400}.items():  # each licence's longest text
        for width in (60, 78):
            notice = textwrap.wrap("Copyright 2020 Some One " + body, width)
            for head, mark in (([], ""), ([prose(rng, 12) for _ in range(40)], "# "), (["import os"], " * ")):
                at = len(head)
                wrapped[len(texts)] = name, at, len(notice)
                texts.append("\n".join([*head, *(mark + x for x in notice[:4]), mark, *(mark + x for x in notice[4:]), *(prose(rng, 12) for _ in range(30))]))
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {i: slow_scan(t) for i, t in enumerate(texts)}
    assert got[split][:4] == ("Apache-2.0", 1.0, 0, 2)
    for i, (name, at, n) in wrapped.items():
        license, dice, unit, n_lines, _ = got[i]
        assert license == name and dice > 0.9 and at <= unit <= at + 1 and n - 2 <= n_lines <= n + 2


def test_licenses_edges(spark):
    got = licenses.license_scan(edge_docs(spark)).collect()
    assert len(got) == len(EDGE) and all(r.license is None and r.n_matches == 0 for r in got)
    assert licenses.license_scan(edge_docs(spark).limit(0)).count() == 0
    plan = licenses.license_scan(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


# ---- attribution


@pytest.mark.parametrize("rule", attribution.RULES)
def test_attribution_matches_offsets(spark, rule):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(8)
    docs = [(i, "".join(rng.choice(["word", " ", "\n", "\n\n", "é", "日", " the", "1", "  "]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows = attribution.section_tokens(spark.createDataFrame(docs, DOCS), RANKS, public_tokenizers.PATTERN, rule=rule).collect()
    got = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens, r.n_crossing) for r in rows}
    expected = {}
    sizes = attribution.Spans(RANKS, public_tokenizers.PATTERN).sizes
    for key, text in docs:
        data = text.encode()
        bounds = [0, *(i + 1 for i, c in enumerate(data) if c == 10)]
        ends = [*bounds[1:], len(data)]
        n, crossing, at = [0] * len(bounds), [0] * len(bounds), 0
        for token in t.encode(text, add_special_tokens=False).ids:
            s, e = at, at + int(sizes[token])
            at = e
            share = [max(0, min(e, y) - max(s, x)) for x, y in zip(bounds, ends, strict=True)]
            touched = [i for i, v in enumerate(share) if v]
            i = {"start": touched[0], "end": touched[-1], "majority": share.index(max(share))}[rule]
            n[i] += 1
            crossing[i] += len(touched) > 1
        assert at == len(data)
        for i, (x, y) in enumerate(zip(bounds, ends, strict=True)):
            expected[key, i] = (len(data[:x].decode()), len(data[:y].decode()), n[i], crossing[i])
    assert got == expected


def test_attribution_fields_and_edges(spark):
    df = spark.createDataFrame([(1, "A title", "two\nlines"), (2, None, "")], "doc_id long, title string, body string")
    rows = attribution.section_tokens(df, RANKS, public_tokenizers.PATTERN, fields=("title", "body"), by_line=False).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.field, r.start, r.end) for r in rows if r.doc_id == 1] == [(1, "title", 0, 8), (1, "body", 8, 17)]
    assert {(r.field, r.n_tokens) for r in rows if r.doc_id == 2} == {("title", 1), ("body", 0)}
    with pytest.raises(ValueError):
        attribution.section_tokens(df, RANKS, public_tokenizers.PATTERN, rule="other")
    got = attribution.section_tokens(edge_docs(spark), RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r.n_tokens for r in got if r.doc_id in (1, 2)) == 0 and len([r for r in got if r.doc_id == 3]) == 2
    assert attribution.section_tokens(edge_docs(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    spans = attribution.Spans(RANKS, public_tokenizers.PATTERN)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in ("a" + " " * 5000 + "b", " " * 5000, "x\n" + "\n" * 5000 + " y"):
        assert spans.ids(x) == t.encode(x, add_special_tokens=False).ids


# ---- pipeline


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = [], []
    for i in range(300):
        good = rng.random() < 0.75
        text = prose(rng, rng.randint(10, 60))
        docs.append((i, text if good else text.upper() + "$$$"))
        labels.append((i, int(good)))
    passage, item = prose(rng, 70), prose(rng, 14)
    docs += [(300, "head words here\n" + passage), (301, "other words there\n" + passage), (302, docs[0][1]), (303, prose(rng, 20) + "\n" + item), (304, "a b"), (305, "a b"), (None, "null key words"), (306, None), (307, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([(i, t, "en", None, len(t or ""), "e") for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, str(tmp_path))
        assert out.columns == before.columns and out.dtypes == before.dtypes
        texts[name] = {r.doc_id: r.text for r in out.collect()}
        assert corpus_pipeline.STAGES and stage(spark, before.limit(0), str(tmp_path)).count() == 0
    bad = {i for i, q in labels if not q}
    assert not bad & texts["quality_classifier"].keys()
    assert texts["line_dedup"][300].endswith(passage) and texts["line_dedup"][301] == "other words there"
    assert 304 in texts["simhash_near_dedup"] and 305 not in texts["simhash_near_dedup"]
    assert 303 not in texts["benchmark_decontamination"]
    good = [i for i, q in labels if q and i != 0]
    assert sum(i in texts["benchmark_decontamination"] for i in good) >= 0.98 * len(good)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(rows, list(texts["benchmark_decontamination"].items()), 4096)


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Each stage against a slow version of it, on what the stage before kept."""
    rng = random.Random(13)
    docs, labels = [], []
    passages = [[prose(rng, rng.randint(5, 30)) for _ in range(rng.randint(3, 6))] for _ in range(6)]
    items = [(0, prose(rng, 14)), (1, prose(rng, 6)), (2, None)]
    for i in range(250):
        good = rng.random() < 0.75
        lines = [prose(rng, rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(lines))
            lines[at:at] = rng.choice(passages)
        if rng.random() < 0.05:
            lines.append("so " + rng.choice(items[:2])[1])
        text = "\n".join(lines)
        docs.append((i, text if good else text.upper() + " $$$ ###"))
        labels.append((i, int(good)))
    docs += [(250 + n, docs[n * 7][1]) for n in range(15)] + [(270 + n, docs[n * 5][1].replace(" a", " b", 1)) for n in range(15)]
    docs += [(None, "some words under a null key"), (290, None), (291, ""), (292, "a b"), (293, "A  B")]
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    order = lambda r: (r[0] is not None, r[0] or 0)
    rows_of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=order)

    def quality(rows):
        d = spark.createDataFrame(rows, DOCS)
        model = rules.train(d, spark.createDataFrame(labels, "doc_id long, quality int"), usable=fold_of("doc_id", 4) != 2)
        score = lambda t: model.intercept + sum(w for rule, w in model.rules if all(slow_statistics(t or "")[n] <= v if sign == "<=" else slow_statistics(t or "")[n] > v for n, sign, v in rule))
        return [(i, t) for i, t in rows if 1 / (1 + math.exp(-score(t))) >= 0.7]

    def lines(rows):
        plain = [[" ".join(x.lower().split()) for x in (t or "").split("\n")] for _, t in rows]
        out = []
        for n, (i, t) in enumerate(rows):
            solid = [x for x, line in enumerate(plain[n]) if line]
            gone = {solid[x] for m in range(n) for x in spans_in([plain[n][x] for x in solid], [x for x in plain[m] if x], 50)}
            left = t if not gone else "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone)
            if not gone or left.strip():
                out.append((i, left))
        return out

    def near(rows):
        fps = [slow_fingerprint(t) for _, t in rows]
        keys = [n if i is None else i - 10**6 for n, (i, _) in enumerate(rows)]  # null keys last
        least = slow_components(keys, fps)
        return [r for r, k, x in zip(rows, keys, least, strict=True) if k == x]

    def clean(rows):
        return [(i, t) for i, t in rows if not slow_contamination(t, items)[-1]]

    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for (_, stage), slow in zip(corpus_pipeline.STAGES[:-1], (quality, lines, near, clean), strict=True):
        before = rows_of(out)
        out = spark.createDataFrame(stage(spark, out, str(tmp_path)).collect(), out.schema)
        assert rows_of(out) == sorted(slow(before), key=order)
        sizes.append(out.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 100
    assert all(r.n_chars == len(r.text or "") for r in out.collect())
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), rows_of(out), 4096)
