"""Retrieval metrics over labelled cases."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.files import eval_cases


def case_metrics(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, recall_at_5, recall_at_10, mrr, hit) of each case (case_id, expected_chunk_ids).

    hits: case_id, chunk_id, rank from 1. Recall is over distinct expected ids, 0 if none are expected; mrr has no cut.
    """
    wanted = cases.select("case_id", F.array_distinct(F.coalesce("expected_chunk_ids", F.array().cast("array<string>"))).alias("expected"))
    found = hits.join(wanted, "case_id").filter(F.expr("array_contains(expected, chunk_id)"))
    within = lambda k: F.size(F.collect_set(F.when(F.col("rank") <= k, F.col("chunk_id"))))
    by = found.groupBy("case_id").agg(within(5).alias("n5"), within(10).alias("n10"), F.min("rank").alias("first"))
    share = lambda c: F.when(F.size("expected") == 0, F.lit(0.0)).otherwise(F.coalesce(F.col(c), F.lit(0)) / F.size("expected"))
    joined = wanted.join(by, "case_id", "left")
    return joined.select("case_id", share("n5").alias("recall_at_5"), share("n10").alias("recall_at_10"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"), (F.coalesce("first", F.lit(11)) <= 10).cast("double").alias("hit"))


def evaluate(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: recall_at_5, recall_at_10, mrr and hit_rate, means over all cases; zeros for none."""
    m = case_metrics(cases, hits)
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return m.agg(mean("recall_at_5", "recall_at_5"), mean("recall_at_10", "recall_at_10"), mean("mrr", "mrr"), mean("hit", "hit_rate"), F.count("*").alias("n_cases"))


def run_benchmark(spark: SparkSession, path: str, retrieve: Callable[[DataFrame], DataFrame]) -> dict[str, float]:
    """Metrics of the cases in a file by a function from cases to hits, and the mean latency of a case in milliseconds.

    All cases are asked in one batch, so the latency is the batch's over the number of cases.
    """
    cases = eval_cases(spark, path)
    began = time.perf_counter()
    row = evaluate(cases, retrieve(cases)).first().asDict()
    return row | {"latency_ms": 1000 * (time.perf_counter() - began) / max(row["n_cases"], 1)}
