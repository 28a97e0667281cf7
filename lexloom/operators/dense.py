"""Exact vector search for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import vectors as V

#: Queries that are broadcast at once; more are searched in blocks of this many.
QUERY_BLOCK = 2048


def best_per_query(hits: DataFrame, k: int, *keys: str, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each query, ranked from 1; ties go to the smaller id. Each task first keeps k of its own."""
    w = Window.partitionBy(*(keys or ("query_id",))).orderBy(F.desc(score), tie)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def scope(queries: DataFrame, chunks: DataFrame) -> Column | None:
    """What a query may see: its user's chunks, and of these its documents if it names any. None: all."""
    conditions = []
    if "user_id" in queries.columns and "user_id" in chunks.columns:
        conditions.append(F.col("q.user_id") == F.col("c.user_id"))
    if "document_ids" in queries.columns:
        ids = F.col("q.document_ids")
        conditions.append(ids.isNull() | (F.size(ids) == 0) | F.array_contains(ids, F.col("c.document_id")))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of an Arrow column of lists that all have ``dim`` items."""
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _search(sent, k: int, own: bool, named: bool, digits: int | None):
    """For each batch of chunks the k best of each query: one matrix product, then a selection in which early ids win."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, users, documents = sent.value
        for b in batches:
            b = b.take(pc.sort_indices(b.column(0)))
            size = b.column(1).value_lengths()
            for dim in pc.unique(size).to_pylist():
                q = np.array([i for i, v in enumerate(queries) if len(v) == dim], np.int64)
                rows = b.filter(pc.equal(size, dim))
                if not len(q):
                    continue
                s = np.array([queries[i] for i in q]) @ _matrix(rows.column(1), dim).T
                s = s if digits is None else np.round(s, digits)
                if own:
                    theirs = np.array([x if x is not None else object() for x in rows.column(2).to_pylist()], object)
                    s[np.array([users[i] for i in q], object)[:, None] != theirs[None, :]] = -np.inf
                if named:
                    docs = np.array(rows.column(3).to_pylist(), object)
                    for n, i in enumerate(q.tolist()):
                        if documents[i]:
                            s[n, ~np.isin(docs, documents[i])] = -np.inf
                keep = s > -np.inf
                if s.shape[1] > k:
                    cut = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
                    tied = s == cut
                    keep &= (s > cut) | tied & (np.cumsum(tied, axis=1) <= k)
                r, c = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[r])), rows.column(0).take(pa.array(c)), pa.array(s[r, c])], names=["query_id", "chunk_id", "score"])

    return run


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = 20, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k chunks of highest cosine similarity with each query's vector.

    queries: query_id, vector, and optionally user_id and document_ids; chunks: chunk_id, vector, and the columns that
    those need. Zero and missing vectors take no part, and vectors are compared with those of their length. All chunks
    are compared, so recall is exact. Queries are sent to the chunks in blocks of QUERY_BLOCK. With ``digits`` scores are
    rounded before ranks are given.
    """
    spark = chunks.sparkSession
    own = "user_id" in queries.columns and "user_id" in chunks.columns
    named = "document_ids" in queries.columns
    none = F.lit(None).cast("string")
    double = F.col("vector").cast("array<double>")
    q = queries.filter(V.norm(F.col("vector")) > 0).select("query_id", double.alias("vector"), F.col("user_id") if own else none.alias("user_id"), F.col("document_ids") if named else none.alias("document_ids"))
    c = chunks.filter(V.norm(F.col("vector")) > 0).select("chunk_id", double.alias("vector"), F.col("user_id") if own else none.alias("user_id"), F.col("document_id") if named else none.alias("document_id"))
    schema = f"query_id {q.schema['query_id'].dataType.simpleString()}, chunk_id {c.schema['chunk_id'].dataType.simpleString()}, score double"
    found: DataFrame | None = None
    for rows in _blocks(q):
        table = pa.Table.from_pylist([{"id": r.query_id} for r in rows])
        unit = [np.array(r.vector) / np.linalg.norm(r.vector) for r in rows]
        sent = spark.sparkContext.broadcast((table.column("id").combine_chunks(), unit, [r.user_id for r in rows], [r.document_ids for r in rows]))
        part = c.mapInArrow(_search(sent, k, own, named, digits), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    if digits is not None:
        found = found.withColumn("score", F.round("score", digits))
    return best_per_query(found, k).select("query_id", "chunk_id", "score", "rank")


def _blocks(queries: DataFrame) -> Iterator[list]:
    held = []
    for r in queries.toLocalIterator():
        held.append(r)
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held
