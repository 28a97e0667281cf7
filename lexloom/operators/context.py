"""Contexts for prompts: chunks in reading order, without repeats, within a budget, neighbours joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.functions import text as X


def build_context(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(query_id, context_rank, chunk_id, document_id, section_id, section_title, page_number, chunk_index, expanded_text,
    n_chunks, token_total) of each query's chunks.

    chunks: query_id, chunk_id, document_id, section_id, section_title, page_start, page_number, chunk_index, text,
    token_count. They are read by page, index and section; blank and repeated texts go; the first that would pass the
    budget ends the context. A chunk joins the one before it in its section if their indices follow; strictly a joined
    pair takes no third, otherwise whole runs are joined.
    """
    page = F.coalesce(F.nullif(F.col("page_start"), F.lit(0)), F.nullif(F.col("page_number"), F.lit(0)), F.lit(0))
    rows = chunks.withColumn("t", X.strip(X.text_of("text"))).filter("t <> ''")
    rows = rows.withColumn("tok", F.coalesce(F.nullif(F.col("token_count"), F.lit(0)), F.size(X.words("t"))).cast("long"))
    rows = rows.withColumn("place", F.struct(page.alias("p"), F.coalesce("chunk_index", F.lit(0)).alias("i"), F.coalesce(F.col("section_id").cast("string"), F.lit("")).alias("s"), F.col("chunk_id")))
    once = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_id", "t").orderBy("place"))).filter("nth = 1")
    order = Window.partitionBy("query_id").orderBy("place")
    kept = once.withColumn("total", F.sum("tok").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("total") <= config.context_tokens)
    last = lambda c: F.lag(c).over(order)
    follows = last("section_id").eqNullSafe(F.col("section_id")) & last("document_id").eqNullSafe(F.col("document_id")) & (F.col("chunk_index") == last("chunk_index") + 1) & last("chunk_id").isNotNull()
    kept = kept.withColumn("island", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("query_id", "island").orderBy("place")
    group = F.floor((F.row_number().over(run) - 1) / 2) if config.strict else F.lit(0)
    kept = kept.withColumn("pair", group.cast("long"))
    item = F.struct("place", "chunk_id", "document_id", "section_id", "section_title", "page_number", "chunk_index", F.col("t").alias("text"))
    by = kept.groupBy("query_id", "island", "pair").agg(F.array_sort(F.collect_list(item)).alias("items"), F.max("total").alias("token_total"))
    head = F.element_at("items", 1)
    out = by.select(
        "query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("island", "pair")).alias("context_rank"), *[head[c].alias(c) for c in ("chunk_id", "document_id", "section_id", "section_title", "page_number", "chunk_index")],
        F.array_join(F.transform("items", lambda x: x["text"]), "\n").alias("expanded_text"), F.size("items").cast("long").alias("n_chunks"), "token_total",
    )
    return out


def context_block(contexts: DataFrame) -> DataFrame:
    """(query_id, context): each query's chunks under headers ``[S1] title (p.1)``, set apart by blank lines."""
    title = F.when(X.text_of("section_title") != "", F.concat(F.lit(" "), F.col("section_title"))).otherwise("")
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit(" (p."), F.col("page_number").cast("string"), F.lit(")"))).otherwise("")
    part = F.concat(F.lit("[S"), F.col("context_rank").cast("string"), F.lit("]"), title, page, F.lit("\n"), F.col("expanded_text"))
    parts = contexts.select("query_id", F.struct("context_rank", part.alias("part")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return parts.select("query_id", F.array_join(F.transform("xs", lambda x: x["part"]), "\n\n").alias("context"))


def expand_neighbours(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` with expanded_text: the text of the chunk before, its own and that of the chunk after, those that exist."""
    side = lambda name: chunks.select(F.col("chunk_id").alias(f"{name}_chunk_id"), F.col("text").alias(f"_{name}"))
    out = hits.join(side("prev"), "prev_chunk_id", "left").join(side("next"), "next_chunk_id", "left")
    return out.select(*hits.columns, F.concat_ws("\n", "_prev", "text", "_next").alias("expanded_text"))


def sources(contexts: DataFrame, names: DataFrame) -> DataFrame:
    """Contexts with the names of their documents (id, display_name), a preview and a rounded score."""
    named = contexts.join(names.select(F.col("id").alias("document_id"), "display_name"), "document_id", "left")
    score = F.bround("score", 4) if "score" in contexts.columns else F.lit(None).cast("double")
    return named.withColumn("preview", X.preview("expanded_text")).withColumn("score", score)
