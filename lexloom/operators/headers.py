"""Page furniture: lines that repeat on many pages of a document, and page numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X


def repeated_lines(pages: DataFrame, min_pages: int = 3) -> DataFrame:
    """(doc_id, line): normalised lines of 3 to 120 characters on at least max(2, 40 %) of a document's pages.

    Documents of fewer than ``min_pages`` pages have none. A line counts once for a page.
    """
    lines = pages.select("doc_id", "page_number", F.explode(F.array_distinct(F.transform(F.split(X.text_of("text"), "\n"), X.normalize_line))).alias("line"))
    lines = lines.filter(F.length("line").between(3, 120)).distinct()
    total = pages.groupBy("doc_id").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    counted = lines.groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 2")
    return counted.join(total, "doc_id").filter(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * 0.4))).select("doc_id", "line")


def strip_headers(pages: DataFrame, min_pages: int = 3, strip_blocks: bool = False) -> DataFrame:
    """``pages`` without lines that repeat or are page numbers. Blocks keep theirs unless ``strip_blocks``."""
    by = repeated_lines(pages, min_pages).groupBy("doc_id").agg(F.collect_set("line").alias("_furniture"))
    joined = pages.join(by, "doc_id", "left").withColumn("_furniture", F.coalesce("_furniture", F.array().cast("array<string>")))
    drop = lambda x: F.when(F.size("_furniture") > 0, F.array_contains(F.col("_furniture"), X.normalize_line(x))).otherwise(False) | X.is_page_number(X.strip(x))
    kept = F.filter(F.split(X.text_of("text"), "\n"), lambda x: ~drop(x))
    out = joined.withColumn("text", X.strip(F.array_join(kept, "\n")))
    if strip_blocks:
        out = out.withColumn("blocks", F.filter("blocks", lambda b: ~drop(b["text"])))
    return out.select(*pages.columns)
