"""Fusion, diversity and reranking of candidates. Each stage adds columns and leaves those of earlier stages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig, or_default
from lexloom.functions import text as X
from lexloom.operators.dense import best_per_query


def rrf(lists: list[DataFrame], top_k: int | None = None, k: int | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, score, list_ix, list_rank, rank) from lists of (query_id, chunk_id, rank), best first.

    A chunk's score sums 1 / (k + rank) over the lists that have it. Equal scores keep the order in which the lists show
    them: by list, then by rank. list_ix names the first list that has the chunk.
    """
    n = or_default(k, config.rrf_k)
    rows = [x.select("query_id", "chunk_id", F.lit(i).alias("list_ix"), F.col("rank").alias("list_rank")) for i, x in enumerate(lists)]
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    first = F.min(F.struct("list_ix", "list_rank"))
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (F.lit(n) + F.col("list_rank"))).alias("score"), first.alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= or_default(top_k, config.rrf_top_k))
    return ranked.select("query_id", "chunk_id", "score", F.col("first.list_ix").alias("list_ix"), F.col("first.list_rank").alias("list_rank"), "rank")


def _select(scores: list[float], sets: list[set[str]], k: int, weight: float) -> list[int]:
    """Indices by maximal marginal relevance; the earliest of equals, and none once all are at -1 or below."""
    if len(scores) <= k:
        return list(range(len(scores)))
    top = max(scores) or 1.0
    nearest = [0.0] * len(scores)
    left, out = list(range(len(scores))), []
    while left and len(out) < k:
        best, value = None, -1.0
        for i in left:
            v = weight * (scores[i] / top) - (1 - weight) * nearest[i]
            if v > value:
                best, value = i, v
        if best is None:
            break
        left.remove(best)
        out.append(best)
        for i in left:
            a, b = sets[i], sets[best]
            nearest[i] = max(nearest[i], len(a & b) / len(a | b) if a and b else 0.0)
    return out


def mmr(candidates: DataFrame, top_k: int | None = None, weight: float | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """``candidates`` (query_id, chunk_id, text, score, rank, ...) chosen for relevance and diversity, with mmr_rank.

    Queries of no more than top_k candidates keep theirs as they are. Similarity is that of the sets of lower-cased words.
    """
    k, lam = or_default(top_k, config.mmr_top_k), config.mmr_lambda if weight is None else weight
    columns = candidates.columns
    with_sets = candidates.withColumn("_set", X.token_set("text"))

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        chosen = rows.iloc[_select(rows["score"].tolist(), [set(s) for s in rows["_set"]], k, lam)]
        return chosen[columns].assign(mmr_rank=range(1, len(chosen) + 1))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", mmr_rank int"
    return with_sets.groupBy("query_id").applyInPandas(choose, schema)


def lexical_relevance(query: Column | str, text: Column | str) -> Column:
    """The offline reranker's score: the Jaccard similarity of the sets of words."""
    return X.jaccard(X.token_set(query), X.token_set(text))


def rerank(candidates: DataFrame, top_k: int | None = None, score: Column | None = None, order: str = "rank", config: EngineConfig = DEFAULT) -> DataFrame:
    """The best ``top_k`` candidates of each query by ``score`` of (query, text), with rerank_score and rerank_rank.

    Ties keep the order of the column ``order``. The default score needs columns query and text.
    """
    scored = candidates.withColumn("rerank_score", lexical_relevance("query", "text") if score is None else score)
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), order, "chunk_id")
    return scored.withColumn("rerank_rank", F.row_number().over(w)).filter(F.col("rerank_rank") <= or_default(top_k, config.rerank_top_k))


__all__ = ["best_per_query", "lexical_relevance", "mmr", "rerank", "rrf"]
