"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging of the lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

#: Vectors in a shard tile and in a query block; bytes of queries and of tiles that meet in one task; lists merged at a
#: node.
SHARD, BLOCK, WAVE_BYTES, PART_BYTES, FAN_IN = 4096, 1024, 16 << 20, 32 << 20, 32


def _pack(rows: int):
    """Pack vectors of equal length into rows (dim, ids, scaled components), ids ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            ids, m = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(ids, kind="stable")
            cols = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([np.ascontiguousarray(m[order]).tobytes()]), pa.array([float(np.abs(m).max(initial=0))])]
            return pa.RecordBatch.from_arrays(cols, names=["dim", "n", "ids", "m", "peak"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                m = flat[(ends[at] - dim)[:, None] + np.arange(dim)[None, :]] if dim else np.zeros((len(at), 0))
                for i in range(0, len(at), rows):
                    held.setdefault(dim, []).append((ids[at[i : i + rows]], m[i : i + rows]))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        yield flush(dim)
        for dim in list(held):
            yield flush(dim)

    return run


SHARD_SCHEMA = "dim int, n int, ids binary, m binary, peak double"


def _scores(q: np.ndarray, m: np.ndarray, peak: float) -> np.ndarray:
    """Inner products, exact: by floats while they hold every partial sum, else by 64-bit or unbounded integers."""
    bound = peak * q.shape[1]
    if bound < 2**53:
        return q @ m.T
    if bound < 2**62:
        return q.astype(np.int64) @ m.astype(np.int64).T
    whole = np.vectorize(int, otypes=[object])
    s = whole(q) @ whole(m).T
    return np.clip(s, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among the k first of their row by (score descending, id ascending)."""
    order = np.lexsort((ids, -scores, rows))
    r = rows[order]
    start = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    place = np.arange(len(r)) - np.repeat(start, np.diff(np.concatenate([start, [len(r)]])))
    return order[place < k]


def _select(s: np.ndarray, ids: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries of one tile that may be among the k best; ids ascend along the columns, so early ties come first."""
    ok = s >= kth[:, None]
    many = np.flatnonzero(ok.sum(axis=1) > 4 * k)
    if len(many):
        part = s[many]
        cut = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k][:, None]
        tied = part == cut
        ok[many] &= (part > cut) | tied & (np.cumsum(tied, axis=1) <= k)
    return np.nonzero(ok)


def _search(k: int):
    """One cell of the grid: a part of the shard tiles against a wave of query blocks, with a list of each query."""

    def run(shards: pa.Table, wave: pa.Table) -> pa.Table:
        blocks = [(r["dim"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["m"], np.float64).reshape(r["n"], r["dim"]), r["peak"]) for r in wave.to_pylist()]
        part = wave.column("part")[0].as_py() if len(blocks) else 0
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)) for _ in blocks]
        kth = [np.full(len(b[1]), -np.inf) for b in blocks]
        for batch in shards.to_batches(max_chunksize=1):
            for shard in batch.to_pylist():
                ids = np.frombuffer(shard["ids"], np.int64)
                m = np.frombuffer(shard["m"], np.float64).reshape(shard["n"], shard["dim"])
                for i, (dim, qids, q, peak) in enumerate(blocks):
                    if dim != shard["dim"]:
                        continue
                    s = _scores(q, m, peak * shard["peak"])
                    if s.dtype != np.float64:
                        kth[i], best[i] = kth[i] if kth[i].dtype != np.float64 else np.where(np.isfinite(kth[i]), kth[i], -(2.0**63)).astype(np.int64), (best[i][0], best[i][1].astype(np.int64), best[i][2])
                    place = np.minimum(np.searchsorted(qids, ids), len(qids) - 1)
                    own = np.flatnonzero(qids[place] == ids)  # rows of a query's own key, however many, take no place
                    s[place[own], own] = -np.inf if s.dtype == np.float64 else -(2**63)
                    r, c = _select(s, ids, kth[i], k)
                    other = ids[c] != qids[r]
                    r, c = r[other], c[other]
                    r, v, x = (np.concatenate(p) for p in zip(best[i], (r, s[r, c], ids[c]), strict=True))
                    keep = _best(r, v, x, k)
                    r, v, x = r[keep], v[keep], x[keep]
                    best[i] = (r, v, x)
                    full = np.bincount(r, minlength=len(qids)) >= k
                    low = np.full(len(qids), np.inf if v.dtype == np.float64 else 2**63 - 1, v.dtype)
                    np.minimum.at(low, r, v)
                    kth[i] = np.where(full, low, -np.inf if v.dtype == np.float64 else -(2**63) + 1)
        lists = [(np.full(len(r), part), qids[r], x, v.astype(np.int64)) for (_, qids, _, _), (r, v, x) in zip(blocks, best, strict=True)]
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*lists, strict=True)] if lists else [np.zeros(0, np.int64)] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["node", "query_id", "vec_id", "score"])

    return run


def _merge(lists: DataFrame, keys: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest inner product with each query row.

    Components become floor(scale * x) in double precision. The candidates of a query are all rows but those of its own
    key; ties go to the smaller key. Null vectors, vectors with a null or non-finite component (before or after scaling)
    and rows with a null key take no part; vectors are compared with those of their own length only. Repeated candidate
    rows count each; a repeated query key is one query, with the least of its vectors. Scores beyond 64 bits saturate.
    An empty table gives an empty one. Tiles and query blocks meet as the cells of a grid, dealt out by a shuffle: no
    query passes through the driver, and the plan is the same whatever their number.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    base = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), is_query.alias("q"), scaled.alias("v"))
    base = base.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    shards = scratch.save(base.select("id", "v").mapInArrow(_floored(_pack(SHARD)), SHARD_SCHEMA), "shards")
    queries = base.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    blocks = scratch.save(queries.mapInArrow(_floored(_pack(BLOCK)), SHARD_SCHEMA), "blocks")
    held = lambda t: t.agg(F.coalesce(F.sum(F.octet_length("m") + F.octet_length("ids")), F.lit(0))).first()[0]
    waves = max(1, -(-held(blocks) // WAVE_BYTES))
    nodes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held(shards) // PART_BYTES))
    dealt = lambda t, own, n, other, m: t.select("*", F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    cells = dealt(shards, "part", nodes, "wave", waves).groupBy("part", "wave").cogroup(dealt(blocks, "wave", waves, "part", nodes).groupBy("part", "wave"))
    lists = cells.applyInArrow(_search(k), "node long, query_id long, vec_id long, score long")
    while nodes > FAN_IN:
        lists = lists.withColumn("node", F.floor(F.col("node") / FAN_IN))
        lists, nodes = _merge(lists, [F.col("query_id"), F.col("node")], k).drop("rank"), nodes // FAN_IN + 1
    return _merge(lists, [F.col("query_id")], k).select("query_id", "rank", "vec_id", "score")


def _floored(pack):
    """Floor the components in numpy, where doubles of any size keep their value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(1)
                flat = pa.array(np.floor(v.flatten().to_numpy(zero_copy_only=False)))
                sizes = v.value_lengths().to_numpy(zero_copy_only=False)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "v"])

        yield from pack(each())

    return run
