"""Line dedup: passages that a document shares with an earlier one are found by patience diff and deleted from it.

Which documents to compare follows from hashes of lines: from each line on, and from each line back, lines are joined
until they have ``min_words`` words, and the hash of such a run is rare, while single short lines are not. How many
texts hold a run is counted; those that one text holds alone are left out. Of the texts that share a run the earliest
owns it, and every later one is paired with the owner: a run in n texts gives n - 1 pairs. That is as good as all
earlier texts: each line of a block of ``min_words`` words is in a run from it on or, at the block's end, in the run back
from the last line; whoever has the block has the run, and so has its owner.

All of it works on distinct texts: the earliest row stands for its exact copies, and a later copy is one block with it,
so a text that very many rows share is hashed and aligned once.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, packed, raw, tune, unpacked

MIN_WORDS = 50


def line_hashes(text: bytes) -> tuple[list[int], list[int]]:
    """Of each line of a text its hash and its number of words; case of A-Z and white space do not count."""
    hashes, sizes = [], []
    for line in text.split(b"\n"):
        words = line.lower().split()
        hashes.append(xxhash.xxh64_intdigest(b" ".join(words), 7) >> 1)
        sizes.append(len(words))
    return hashes, sizes


def _spans(sizes: list[int], min_words: int) -> Iterator[tuple[int, int]]:
    """(first line, end) of the shortest run of at least ``min_words`` words from each line that has words."""
    end = total = 0
    for first, size in enumerate(sizes):
        while total < min_words and end < len(sizes):
            total += sizes[end]
            end += 1
        if total < min_words:
            return
        if size:
            yield first, end
        total -= size


def runs(hashes: list[int], sizes: list[int], min_words: int) -> Iterator[tuple[int, int, int]]:
    """(hash, first line, end) of the shortest runs of at least ``min_words`` words from each line with words on and back."""
    n = len(sizes)
    spans = {*_spans(sizes, min_words), *((n - end, n - first) for first, end in _spans(sizes[::-1], min_words))}
    for first, end in sorted(spans):
        yield xxhash.xxh64_intdigest(np.array([h for h, n in zip(hashes[first:end], sizes[first:end], strict=True) if n], np.int64).tobytes(), 9) >> 1, first, end


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest increasing chain of (i, j) pairs given by ascending i: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = []
    for n, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(j)
            piles.append(n)
        else:
            tops[at], piles[at] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _anchors(a: list, b: list, weak: set[int]) -> list[tuple[int, int]]:
    """Lines that occur once in both; where there are none, the nth occurrence of a line in each."""
    na, nb = Counter(a), Counter(b)
    where = {h: j for j, h in enumerate(b) if nb[h] == 1}
    pairs = [(i, where[h]) for i, h in enumerate(a) if h is not None and i not in weak and na[h] == 1 and h in where]
    if pairs:
        return pairs
    places: dict[int, list[int]] = {}
    for j, h in enumerate(b):
        places.setdefault(h, []).append(j)
    turn: Counter = Counter()
    for i, h in enumerate(a):
        if h is not None and i not in weak and turn[h] < len(places.get(h, ())):
            pairs.append((i, places[h][turn[h]]))
            turn[h] += 1
    return pairs


def aligned_lines(a: list[int], sizes: list[int], b: list[int], b_sizes: list[int], min_words: int) -> list[int]:
    """Lines of ``a`` in blocks that align with ``b``, each block of at least ``min_words`` words.

    Lines without words are passed over: they neither break a block nor anchor one. Alignment is repeated without what
    was deleted, so blocks that stand in another order are found too. Lines that occur often may have been aligned with
    the wrong one of their places; so last, the runs that both texts hold are anchors, and blocks grow from them.
    """
    ia = [i for i, n in enumerate(sizes) if n]
    b = [h for h, n in zip(b, b_sizes, strict=True) if n]
    left: list[int | None] = [a[i] for i in ia]
    words = [sizes[i] for i in ia]
    gone: set[int] = set()
    weak: set[int] = set()
    while chain := _chain(_anchors(left, b, weak)):
        done = -1
        for i, j in chain:
            if i <= done:
                continue
            lo, hi = 0, 1
            while i - lo - 1 >= 0 and j - lo - 1 >= 0 and left[i - lo - 1] is not None and left[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            while i + hi < len(left) and j + hi < len(b) and left[i + hi] is not None and left[i + hi] == b[j + hi]:
                hi += 1
            block = range(i - lo, i + hi)
            done = i + hi - 1
            if sum(words[x] for x in block) >= min_words:
                gone.update(block)
                for x in block:
                    left[x] = None
            else:
                weak.update(block)
    kept_sizes = [n for n in b_sizes if n]
    where: dict[int, int] = {}
    for h, j, _ in runs(b, kept_sizes, min_words):
        where.setdefault(h, j)
    mine = [a[i] for i in ia]
    for h, i, end in runs(mine, words, min_words):
        if h in where and not gone.issuperset(range(i, end)):
            lo, j = 0, where[h]
            while i - lo and j - lo and mine[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            hi = 0
            while i + hi < len(mine) and j + hi < len(b) and mine[i + hi] == b[j + hi]:
                hi += 1
            if sum(words[i - lo : i + hi]) >= min_words:
                gone.update(range(i - lo, i + hi))
    return [ia[x] for x in sorted(gone)]


def _digest(text: str) -> Column:
    """A text's name: 128 bits, so that no two texts of a corpus are taken for one."""
    return F.unhex(F.md5(F.col(text).cast("string").cast("binary")))


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(u, k, copied, hashes, sizes) of each distinct text but the empty one: its digest, the least key of its rows (null
    first), whether rows of other keys have it too, and its lines."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), _digest(text).alias("u"), F.col(text).cast("string").alias("t")).filter("t <> ''")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_hashes(t) for t in raw(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([s for _, s in found], pa.list_(pa.int32()))], names=["k", "u", "hashes", "sizes"])

    lines = rows.mapInArrow(run, f"k {kind}, u binary, hashes array<long>, sizes array<int>")
    least, most = F.min(F.struct("k")), F.max(F.struct("k"))
    by = lines.groupBy("u").agg(least.alias("least"), most.alias("most"), F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))
    return by.select("u", F.col("least.k").alias("k"), (F.col("least") < F.col("most")).alias("copied"), "hashes", "sizes")


def shared_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(u, k, lines, every_line) for each distinct text that shares passages with an earlier one, or has later copies.

    u is the text's digest and k the key of its earliest row; that is also the order of texts, null keys first. The rows
    of that key lose ``lines`` (numbers from 0, or null), rows of other keys ``every_line`` that has words (or null).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    texts = scratch.save(distinct_texts(docs, key, text), "texts")
    kind = texts.schema["k"].dataType.simpleString()

    def each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, h = [], []
            for i, (hashes, sizes) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                mine = {x for x, _, _ in runs(hashes, sizes, min_words)}
                at += [i] * len(mine)
                h += mine
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(0).take(take), b.column(1).take(take)], names=["h", "k", "u"])

    every = scratch.save(texts.select("k", "u", "hashes", "sizes").mapInArrow(each_run, f"h long, k {kind}, u binary"), "runs")
    shared = every.groupBy("h").agg(F.min(F.struct("k", "u")).alias("own"), F.count("*").alias("holders")).filter("holders > 1")
    pairs = every.join(shared.select("h", F.col("own.u").alias("ou")), "h").filter("u <> ou").select("u", "ou").distinct()
    theirs = texts.select(F.col("u").alias("ou"), F.col("hashes").alias("theirs"), F.col("sizes").alias("their_sizes"))
    both = pairs.join(theirs, "ou").join(texts.select("u", "hashes", "sizes"), "u").select("u", "hashes", "sizes", "theirs", "their_sizes")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [aligned_lines(*(c for c in r), min_words) for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["u", "lines"])

    found = both.mapInArrow(align, "u binary, lines array<int>").filter("size(lines) > 0")
    found = found.groupBy("u").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"))
    whole = F.expr(f"if(copied AND aggregate(sizes, 0L, (n, x) -> n + x) >= {min_words}, filter(sequence(0, size(sizes) - 1), i -> sizes[i] > 0), NULL)")
    marked = texts.select("u", "k", whole.alias("every_line")).join(found, "u", "left").filter("lines IS NOT NULL OR every_line IS NOT NULL")
    return scratch.save(marked.select("u", "k", "lines", "every_line"), "found")


def _deduped(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """Each row of ``docs`` packed in ``row``, with t (text), lines (to delete, or null) and kept (the text without them)."""
    found = shared_lines(docs, key, text, min_words).select(F.col("u").alias("fu"), F.col("k").alias("fk"), F.col("lines").alias("own"), "every_line").hint("merge")
    rows = packed(docs, k=F.col(key), t=F.col(text).cast("string"), u=_digest(text)).join(found, F.col("u") == F.col("fu"), "left")
    lines = F.when(F.col("k").eqNullSafe(F.col("fk")), F.col("own")).otherwise(F.col("every_line"))
    split = rows.select("row", "k", "t", lines.alias("lines"), F.split("t", "\n").alias("every"))
    places = split.select("*", F.expr("array_except(sequence(0, size(every) - 1), lines)").alias("places"))
    return places.select("row", "k", "t", "lines", F.expr("if(lines IS NULL, t, array_join(transform(places, i -> every[i]), '\\n'))").alias("kept"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, text, n_lines, n_deleted) for each row of ``docs``: its text without lines in passages of earlier documents.

    A passage is a block of consecutive lines, aligned with a block of an earlier document and of at least ``min_words``
    words together; lines are equal if they are but for case of A-Z and white space, and lines without words are passed
    over. Documents come in the order of their keys, null keys first, and of equal keys by a hash of the text. Rows equal
    in both are one document, so both keep their text. A null text stays null and has no lines; an empty one has one
    line. An empty table gives an empty one. Other columns are not read.
    """
    out = _deduped(docs.select(key, text), key, text, min_words)
    n = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n"))).cast("long")
    return out.select(F.col("k").alias(key), F.col("kept").alias(text), n.alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_deleted"))


def strip_shared(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its columns, texts without shared passages; ``count`` names a column of text lengths to renew.

    A document of which nothing but white space is left goes; one that was so before stays.
    """
    out = _deduped(docs, key, text, min_words).filter("lines IS NULL OR trim(BOTH ' \\t\\n\\r' FROM kept) <> ''")
    kinds = dict(docs.dtypes)
    changed = {text: F.col("kept")} | ({count: F.when(F.col("lines").isNull(), F.col("row")[count]).otherwise(F.length("kept")).cast(kinds[count])} if count else {})
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
