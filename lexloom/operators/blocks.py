"""Typed blocks of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators.pages import line_blocks


def block_type(text: Column, given: Column) -> Column:
    """list or qa by the text's form, whatever was given; else as given."""
    return F.when(X.is_list_item(text), "list").when(X.is_question(text), "qa").otherwise(given)


def classify_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` with each block stripped and typed; a page without blocks gets one for each line that is not blank."""
    blocks = F.when(F.size(F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType))) > 0, F.col("blocks")).otherwise(line_blocks(F.col("text"), F.col("page_number"), F.col("confidence")).cast(pages.schema["blocks"].dataType))
    typed = F.transform(blocks, lambda b: b.withField("text", X.strip(b["text"])).withField("block_type", block_type(X.strip(b["text"]), b["block_type"])))
    return pages.withColumn("blocks", typed)


def explode_blocks(pages: DataFrame) -> DataFrame:
    """A row for each block, with its place ``block_ord`` on its page."""
    rows = pages.select("doc_id", "page_number", F.posexplode("blocks").alias("block_ord", "b"))
    return rows.select("doc_id", "page_number", "block_ord", "b.*")


def flat_text(blocks: Column) -> Column:
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")
