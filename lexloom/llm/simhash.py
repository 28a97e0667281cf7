"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming radius by pigeonring filtering.

The 64 bits are a ring of segments. If two fingerprints differ in at most r bits, some segment starts a chain along
the ring whose first l segments differ in at most l * r / m bits together, for every l (the pigeonring principle; the
pigeonhole principle is its case l = 1). With m = 4 and r = 3 the budgets are 0, 1, 2 and 3 bits. The first two links
of the chain are the join key: one segment equal and the next one equal but for at most one bit, so a key has 32 bits
and candidates stay few where 16-bit buckets would not. The rest of the chain prunes before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, packed, raw, tune, unpacked
from lexloom.llm.components import connected_components
from lexloom.llm.words import shingle_hashes, space_words

SEGMENTS, WIDTH, RADIUS = 4, 16, 3
#: Budgets of the chain's first 1 to 4 segments.
BUDGETS = tuple(l * RADIUS // SEGMENTS for l in range(1, SEGMENTS + 1))
#: A key with more indexed fingerprints than this is dealt out in tiles; pairs compared at once.
TILE, AT_ONCE = 2048, 1 << 18


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)])
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fp long) for each row: the SimHash of its word shingles, repeats included.

    Null, empty and blank texts have fingerprint 0; a text of fewer than ``width`` words is one shingle. Repeated rows
    and null keys stay as they are.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint_of(shingle_hashes(space_words(t), width, seed)) for t in raw(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["k", "fp"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, fp long").withColumnRenamed("k", key)


def _segment(fp: np.ndarray, i: int) -> np.ndarray:
    return (fp >> np.uint64(WIDTH * (i % SEGMENTS))) & np.uint64((1 << WIDTH) - 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Role 0: a fingerprint under its own key of each chain start; role 1: under each key its chain may meet."""
    flips = np.concatenate([[0], 1 << np.arange(WIDTH)]).astype(np.uint64)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(SEGMENTS):
            head = (np.uint64(i) << np.uint64(2 * WIDTH)) | (_segment(fp, i) << np.uint64(WIDTH))
            own = head | _segment(fp, i + 1)
            probe = (head[:, None] | (_segment(fp, i + 1)[:, None] ^ flips[None, :])).ravel()
            key = np.concatenate([own, probe]).view(np.int64)
            fps = np.concatenate([fp, np.repeat(fp, len(flips))]).view(np.int64)
            role = np.concatenate([np.zeros(len(fp), np.int8), np.ones(len(probe), np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps), pa.array(role)], names=["key", "fp", "role"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links a-b, so a dense group gives as many rows as it has members."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _links(group: np.ndarray, key: np.ndarray, fp: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among the rows of whole groups, sorted by (group, role)."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    indexed = np.add.reduceat((role == 0).astype(np.int64), first)
    at = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(group)]])))
    probes = np.flatnonzero((role == 1) & (indexed[at] > 0))
    pairs = np.cumsum(indexed[at[probes]])
    done = 0
    while done < len(probes):
        base = pairs[done - 1] if done else 0
        end = max(done + 1, int(np.searchsorted(pairs, base + AT_ONCE, "right")))
        p = probes[done:end]
        n = indexed[at[p]]
        x = fp[np.repeat(p, n)]
        y = fp[np.repeat(first[at[p]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        turn = np.repeat(key[p] >> np.uint64(2 * WIDTH), n) * np.uint64(WIDTH)
        later = x < y
        x, y, turn = x[later], y[later], turn[later]
        differ = x ^ y
        ring = (differ >> turn) | (differ << ((np.uint64(64) - turn) % np.uint64(64)))  # the chain's start comes lowest
        keep = np.ones(len(x), bool)
        for length in range(1, SEGMENTS):
            keep &= np.bitwise_count(ring & np.uint64((1 << (WIDTH * length)) - 1)) <= BUDGETS[length - 1]
        x, y, differ = x[keep], y[keep], differ[keep]
        near = np.bitwise_count(differ) <= RADIUS
        if near.any():
            yield x[near], y[near]
        done = end


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star links of each (key, s, t) group; rows come sorted, so a group is held no longer than it lasts."""
    held: list[np.ndarray] = []
    rows = 0

    def flush(a: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, s, t, role, fp = a
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])]))
        for x, y in _links(group, key.view(np.uint64), fp.view(np.uint64), role):
            u, v = _forest(x, y)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for b in batches:
        held.append(np.stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in b.columns]))
        rows += b.num_rows
        if rows >= 1 << 16:
            a = np.concatenate(held, axis=1)
            last = a[:3, -1:]
            whole = int(np.argmax((a[:3] == last).all(axis=0)))  # the last group may go on
            if whole:
                yield from flush(a[:, :whole])
            held, rows = [a[:, whole:]], a.shape[1] - whole if whole else 0
    if held:
        yield from flush(np.concatenate(held, axis=1))


def near_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v) of fingerprints, enough to connect all in ``fps`` (fp long, distinct) that link within RADIUS bits.

    A key that many fingerprints share is split into tiles of about TILE by TILE rows, and each task returns a star for
    each component that it finds, never the pairs of a group. Empty input gives no links.
    """
    fps = fps.filter("fp is not null").select("fp")
    keyed = fps.mapInArrow(_keys, "key long, fp long, role byte")
    sizes = keyed.filter("role = 0").groupBy("key").count().filter(F.col("count") > TILE)
    hot = scratch.save(sizes.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("n")), "hot")
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("s"), F.lit(0).alias("t"), "role", "fp")
    else:
        n, own = F.coalesce("n", F.lit(1)), F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1)))
        dealt = keyed.join(hot, "key", "left").select("key", "role", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
        index = F.col("role") == 0
        dealt = dealt.select("key", F.when(index, F.col("own")).otherwise(F.col("other")).cast("int").alias("s"), F.when(index, F.col("other")).otherwise(F.col("own")).cast("int").alias("t"), "role", "fp")
    parts = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key", "s", "t").sortWithinPartitions("key", "s", "t", "role").mapInArrow(_link_groups, "u long, v long")


def _components(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, root) of each distinct fingerprint: the smallest fingerprint that links reach, in no order of documents."""
    roots = connected_components(near_links(nodes, scratch), scratch)
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``.

    Fingerprints that differ in at most 3 bits link; component_id is the smallest key that links reach, the row's own
    included. Equal fingerprints link whatever their number: they are one node. Null, empty and blank texts have
    fingerprint 0 and link like any other. A null key never names a component unless all its members have null keys.
    Repeated rows come out as often as they come in; an empty table gives an empty one. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.save(fingerprints(docs, key, text, width, seed).select(F.col(key).alias("k"), "fp"), "fp")
    nodes = scratch.save(each.groupBy("fp").agg(F.min("k").alias("least")), "nodes")
    placed = _components(nodes, scratch).select("fp", "least", "root")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = scratch.save(placed.join(ids, "root").select("fp", "component_id"), "known")
    out = each.join(known, "fp")
    return out.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each near-duplicate component stays: that with the smallest key.

    Rows are documents, whatever their keys: two texts under one key, or under null keys, both stay unless their
    fingerprints link. Null keys come last, equal keys are told apart by a hash of the text, and of rows equal in both
    one stays. Columns come out as they are; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "simhash-drop")
    digest = F.xxhash64(F.col(text).cast("string"))
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType
    named = docs.select(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), digest.alias("u")).alias("who"), F.col(text).alias("t"))
    each = fingerprints(named, "who", "t", width).select(F.col("who"), "fp")
    nodes = scratch.save(each.groupBy("fp").agg(F.min("who").alias("who")), "nodes")
    keep = _components(nodes, scratch).groupBy("root").agg(F.min("who").alias("who"))
    keep = scratch.save(keep.select(F.col("who.k").cast(kind).alias("keep_k"), F.col("who.u").alias("keep_u")), "keep")
    rows = packed(docs, k=F.col(key), u=digest)
    kept = rows.join(keep.hint("merge"), F.col("k").eqNullSafe(F.col("keep_k")) & (F.col("u") == F.col("keep_u")), "left_semi")
    return unpacked(kept.groupBy("k", "u").agg(F.min_by("row", F.xxhash64("row")).alias("row")), docs.columns)
