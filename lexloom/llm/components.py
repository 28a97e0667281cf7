"""Connected components by alternating large-star and small-star steps, each step one join and one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

#: Edges in one file of a round.
ROWS = 250_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's larger (large star) or smaller (small star) neighbours on the smallest node beside it."""
    arcs = edges.select("u", "v")
    if large:
        arcs = arcs.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = arcs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = arcs.join(least, "u").select("u", "v", "m")
    if large:
        out = hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v; longs): root is the smallest node that can be reached.

    Null ends and loops are ignored. The edges are written after each round, so the plan stays short and a lost
    executor costs one round at most; the rounds needed are logarithmic in the longest path. A round writes files of
    about ROWS edges, by the count of the round before.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current = scratch.save(edges, f"{label}-0")
    mark, i = None, 0
    while True:
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark, i = now, i + 1
        stars = _star(_star(current, True), False)
        current = scratch.save(stars.coalesce(1 + int(now[0]) // ROWS), f"{label}-{i}")
        scratch.drop(f"{label}-{i - 1}")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
