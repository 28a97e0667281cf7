"""Benchmark decontamination: a prefix-filtered set join of item windows with whole documents.

A window of w words is the set of its word shingles. Since the whole window must occur, one shingle is a sufficient
prefix: with shingles in the order of their rarity over all documents, a document that holds the window holds the
window's rarest shingle. So documents are joined on those prefix shingles alone; a hit at some position fixes where the
window would start (positional bound) and end (length bound), and the words there are then compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import Scratch, packed, raw, tune, unpacked
from lexloom.llm.words import alnum_words

SHINGLE = 5
#: Bytes of item text in one block. A larger benchmark is handled in blocks of this size, each broadcast by itself.
BLOCK_BYTES = 2 << 20
#: Bytes of documents for which each of several blocks is loaded once.
GROUP_BYTES = 32 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Block:
    """Windows of some items, over a vocabulary of their own words (ids from 1; 0 is any other word)."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: list[tuple[int, ...]] = field(default_factory=list)
    owners: list[list[str]] = field(default_factory=list)
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by width: sorted hashes of all shingles
    prefixes: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)  # width: hash: (window, offset)


def _roll(ids: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` ids, by position."""
    n = len(ids) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        h = (h ^ ids[j : j + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def build_block(items: list[tuple[str, bytes]], window: int) -> Block:
    block, seen = Block(), {}
    for item, text in items:
        words = alnum_words(text)
        ids = tuple(block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for w in words)
        span = min(window, len(ids))
        for i in range(len(ids) - span + 1 if ids else 0):
            w = ids[i : i + span]
            if w not in seen:
                seen[w] = len(block.windows)
                block.windows.append(w)
                block.owners.append([])
            if item not in block.owners[seen[w]]:
                block.owners[seen[w]].append(item)
    for w in block.windows:
        width = min(SHINGLE, len(w))
        block.shingles.setdefault(width, []).append(_roll(np.array(w, np.uint64), width))
    block.shingles = {k: np.unique(np.concatenate(v)) for k, v in block.shingles.items()}
    return block


def order_by_rarity(block: Block, counts: dict[tuple[int, int], int]) -> None:
    """Choose each window's prefix: its rarest shingle, the first of those that are equally rare."""
    for n, w in enumerate(block.windows):
        width = min(SHINGLE, len(w))
        hashes = _roll(np.array(w, np.uint64), width).tolist()
        at = min(range(len(hashes)), key=lambda i: (counts.get((width, hashes[i]), 0), i))
        block.prefixes.setdefault(width, {}).setdefault(hashes[at], []).append((n, at))


def _ids(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    get = vocabulary.get
    return np.fromiter((get(w, 0) for w in words), np.uint64, len(words))


def _meets(ids: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``width`` known words stand whose shingle is in the sorted ``table``, and the shingles."""
    known = np.concatenate([[0], np.cumsum(ids > 0)])
    at = np.flatnonzero(known[width:] - known[:-width] == width) if len(ids) >= width else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    h = np.zeros(len(at), np.uint64)
    for j in range(width):
        h = (h ^ ids[at + j]) * _MIX
        h ^= h >> np.uint64(29)
    ok = np.searchsorted(table, h)
    ok[ok == len(table)] = 0
    found = table[ok] == h
    return at[found], h[found]


def _gathered(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """Batches as they come, or of GROUP_BYTES if ``several`` blocks have to be loaded for each."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if not several or sum(x.nbytes for x in held) >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def count_shingles(texts: DataFrame, blocks: list[Broadcast]) -> DataFrame:
    """(block, w, h, n): in how many places of all the texts each shingle of each block stands, found in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in _gathered(batches, len(blocks) > 1):
            words = [alnum_words(t) for t in raw(batch.column(0))]
            for n, sent in enumerate(blocks):
                b: Block = sent.value
                for w, t in b.shingles.items():
                    tables[n, w] = t
                    total.setdefault((n, w), np.zeros(len(t), np.int64))
                for own in words:
                    ids = _ids(own, b.vocabulary)
                    for w, t in b.shingles.items():
                        np.add.at(total[n, w], np.searchsorted(t, _meets(ids, w, t)[1]), 1)
                if len(blocks) > 1:
                    sent.__dict__.pop("_value", None)
        for (n, w), t in tables.items():
            yes = total[n, w] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(yes.sum(), x, np.int32)) for x in (n, w)] + [pa.array(t[yes].view(np.int64)), pa.array(total[n, w][yes])], names=["block", "w", "h", "n"])

    return texts.mapInArrow(run, "block int, w int, h long, n long").groupBy("block", "w", "h").agg(F.sum("n").alias("n"))


class Matcher:
    """Exact occurrences of one block's windows in a document."""

    def __init__(self, block: Block):
        self.b = block
        self.tables = {w: np.array(sorted(p), np.uint64) for w, p in block.prefixes.items()}
        self.arrays = [np.array(w, np.uint64) for w in block.windows]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) word spans of the windows that occur, and the items that they belong to."""
        spans, items = [], set()
        ids = _ids(words, self.b.vocabulary)
        for width, t in self.tables.items():
            at, hashes = _meets(ids, width, t)
            for p, h in zip(at.tolist(), hashes.tolist(), strict=True):
                for n, offset in self.b.prefixes[width][h]:
                    start, w = p - offset, self.arrays[n]
                    if start >= 0 and start + len(w) <= len(ids) and (ids[start : start + len(w)] == w).all():
                        spans.append((start, start + len(w)))
                        items.update(self.b.owners[n])
        return spans, items


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Block]:
    held, size = [], 0
    for r in benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("string").alias("t")).filter("t is not null").toLocalIterator():
        held.append((r.i if r.i is not None else "", r.t.encode()))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield build_block(held, window)
            held, size = [], 0
    if held:
        yield build_block(held, window)


class _Finder:
    """Finds the windows of all blocks in documents; it is sent to executors with references to the blocks only."""

    def __init__(self, blocks: list[Broadcast]):
        self.blocks = blocks

    def matchers(self) -> Matcher | None:
        return Matcher(self.blocks[0].value) if len(self.blocks) == 1 else None

    def __call__(self, matcher: Matcher | None, documents: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Spans and items of each document. Of several blocks one is in memory at a time."""
        found: list[tuple[list, set]] = [([], set()) for _ in documents]
        for block in self.blocks:
            m = matcher or Matcher(block.value)
            for (spans, names), words in zip(found, documents, strict=True):
                new, more = m.hits(words)
                spans += new
                names |= more
            if matcher is None:
                block.__dict__.pop("_value", None)
        return found


def _finder(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, window: int) -> _Finder:
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col(text).cast("string").alias("t"))
    sent = [spark.sparkContext.broadcast(block) for block in _blocks(benchmark, item, item_text, window)]
    if not sent:
        return _Finder([])
    found = count_shingles(texts, sent)
    if len(sent) > 1:
        found = Scratch(spark, "decontaminate").save(found, "counts")
    ready: list[Broadcast] = []
    for n, old in enumerate(sent):
        block: Block = old.value
        order_by_rarity(block, {(r.w, r.h & (2**64 - 1)): r.n for r in found.filter(F.col("block") == n).toLocalIterator()})
        ready.append(spark.sparkContext.broadcast(block))
        old.__dict__.pop("_value", None)
        old.unpersist()
    return _Finder(ready)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, spans: bool = False) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated[, spans]) for each row of ``docs``.

    Words: A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is ``window`` consecutive words of an item; an
    item of fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.
    ``spans`` adds the merged hit spans as [first word, end) pairs.

    A null or empty text has no words and no hit; items without words match nothing; a null item id counts as an empty
    name. Repeated rows come out as often as they come in. With an empty benchmark nothing is hit. Other columns are not
    read. Items are handled in blocks of BLOCK_BYTES of text, so no broadcast grows with the benchmark.
    """
    find = _finder(docs, benchmark, text, item, item_text, window)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = find.matchers()
        for b in _gathered(batches, len(find.blocks) > 1):
            words = [alnum_words(t) for t in raw(b.column(1))]
            found = find(matchers, words)
            hit, merged, digests = [], [], []
            for where, names in found:
                joined: list[list[int]] = []
                for s, e in sorted(where):
                    if joined and s <= joined[-1][1]:
                        joined[-1][1] = max(e, joined[-1][1])
                    else:
                        joined.append([s, e])
                merged.append(joined)
                hit.append(sum(e - s for s, e in joined))
                digests.append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
            cols = [b.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(hit, pa.int64()), pa.array([len(n) for _, n in found], pa.int64()), pa.array(digests), pa.array([h > 0 for h in hit]), pa.array(merged, pa.list_(pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    out = rows.mapInArrow(run, f"k {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<int>>")
    out = out.withColumnRenamed("k", key)
    return out if spans else out.drop("spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs (see ``contamination``), with their columns as they are."""
    find = _finder(docs, benchmark, text, item, item_text, window)
    rows = packed(docs, t=F.col(text).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = find.matchers()
        for b in _gathered(batches, len(find.blocks) > 1):
            clean = [not spans for spans, _ in find(matchers, [alnum_words(t) for t in raw(b.column(1))])]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(clean, pa.bool_()))], names=["row"])

    return unpacked(rows.mapInArrow(run, T.StructType([rows.schema["row"]])), docs.columns)
