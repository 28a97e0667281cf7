"""The retrieval plan for a batch of queries: clean, dense and lexical search, fusion, diversity, reranking, context."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.functions import text as X
from lexloom.operators import bm25, context, dense, logs, ranking
from lexloom.sources.connectors import Embedder, with_embeddings


@dataclass
class Retrieved:
    dense: DataFrame
    lexical: DataFrame
    fused: DataFrame
    diverse: DataFrame
    reranked: DataFrame
    contexts: DataFrame

    def trace(self) -> DataFrame:
        ranked = self.reranked.withColumn("score", F.col("rerank_score")).withColumn("rank", F.col("rerank_rank"))
        return logs.trace({"dense": self.dense, "bm25": self.lexical, "fused": self.fused, "mmr": self.diverse.withColumn("rank", F.col("mmr_rank")), "reranked": ranked})


def retrieve(queries: DataFrame, chunks: DataFrame, index: bm25.LexicalIndex, make: Callable[[], Embedder] | None = None, score: Column | None = None, config: EngineConfig = DEFAULT) -> Retrieved:
    """Contexts for queries (query_id, text[, vector, user_id, document_ids]); a query that nothing matches has none.

    Without a vector column ``make`` gives the embedder. ``score`` rates (query, text) for reranking.
    """
    asked = queries.withColumn("text", X.clean_text("text"))
    if "vector" not in asked.columns:
        asked = with_embeddings(asked, make, batch=config.embedding_batch)
    near = dense.dense_search(asked, chunks, config.dense_top_k)
    lexical = bm25.bm25_search(asked, index, chunks, config.bm25_top_k, config.bm25_k1, config.bm25_b)
    fused = ranking.rrf([near, lexical], config=config)
    payload = chunks.drop("vector", "user_id")
    rows = fused.join(payload, "chunk_id").join(asked.select("query_id", F.col("text").alias("query")), "query_id")
    diverse = ranking.mmr(rows, config=config)
    best = ranking.rerank(diverse.filter(F.col("mmr_rank") <= config.rerank_input), score=score, order="mmr_rank", config=config)
    return Retrieved(near, lexical, fused, diverse, best, context.build_context(best, config))
