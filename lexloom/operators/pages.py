"""Pages of documents: profiles, tables, OCR gates, and the merge of parsed and recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.functions import text as X
from lexloom.operators.units import counted

#: A page with at least so many characters has text of its own; least share of a script in real text.
MIN_TEXT, MIN_SHARE, LAYER_SHARE = 20, 0.15, 0.20


def table_markdown(rows: Column) -> Column:
    """An array of rows (arrays of cells) as markdown lines, null cells empty; there is no line below the header."""
    cell = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " ")
    return F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))), "\n")


def text_layer_confidence(c: Column | str) -> Column:
    return F.when(X.indic_ratio(c) >= MIN_SHARE, F.lit(0.98)).otherwise(F.lit(0.5))


def heading_level_of_font(size: Column, text: Column) -> Column:
    """1 from 18 points, 2 from 15, 3 from 14, for texts of at most 15 words; else null: no heading."""
    level = F.when(size >= 18, 1).when(size >= 15, 2).when(size >= 14, 3)
    return F.when(F.size(X.words(text)) <= 15, level)


def use_text_layer(c: Column | str) -> Column:
    """Whether a page's own text is real content, so that it needs no OCR."""
    t = X.strip(X.text_of(c))
    return (F.length(t) >= MIN_TEXT) & ((X.indic_ratio(t) >= LAYER_SHARE) | (X.latin_ratio(t) >= LAYER_SHARE))


def needs_fallback(confidence: Column, text: Column, config: EngineConfig = DEFAULT) -> Column:
    """Whether a recognised page is doubtful: low confidence, or over 40 characters in neither script."""
    garbled = (F.length(X.strip(X.text_of(text))) > 40) & (X.indic_ratio(text) < MIN_SHARE) & (X.latin_ratio(text) < MIN_SHARE)
    return F.coalesce(confidence < config.ocr_threshold, F.lit(False)) | garbled


def ocr_language(native: Column, document: Column, config: EngineConfig = DEFAULT) -> Column:
    """The OCR language by the page's text, else the document's, else Indic; texts under 20 characters don't decide."""

    def by(c: Column) -> Column:
        t = X.strip(X.text_of(c))
        latin, indic = X.latin_ratio(t), X.indic_ratio(t)
        pick = F.when((latin >= LAYER_SHARE) & (latin >= indic), config.ocr_language_latin).when(indic >= MIN_SHARE, config.ocr_language_indic)
        return F.when(F.length(t) >= MIN_TEXT, pick)

    return F.coalesce(by(native), by(document), F.lit(config.ocr_language_indic))


def prefer_fallback(text: Column, confidence: Column, other: Column, other_confidence: Column) -> Column:
    """Whether the fallback's page is taken: more of some script, or at least the confidence."""
    best = lambda t: F.greatest(X.indic_ratio(t), X.latin_ratio(t))
    return (best(other) > best(text)) | (other_confidence >= confidence)


def profile(pages: DataFrame, tables: DataFrame | None = None, bookmarks: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(doc_id, document_type, has_bookmarks, has_tables, avg_indic_ratio, page_count) of each document.

    Digital pages are those of at least 20 characters; with all or none of them a document is digital_pdf or scanned_pdf,
    else mixed; digital ones with tables are table_heavy. Documents of ``documents`` without pages are scanned_pdf.
    """
    stripped = X.strip(X.text_of("text"))
    by = pages.groupBy("doc_id").agg(
        F.count("*").alias("page_count"),
        F.sum((F.length(stripped) >= MIN_TEXT).cast("long")).alias("digital"),
        F.coalesce(F.avg(F.when(stripped != "", X.indic_ratio("text"))), F.lit(0.0)).alias("avg_indic_ratio"),
    )
    if documents is not None:
        by = documents.select("doc_id").distinct().join(by, "doc_id", "left").fillna({"page_count": 0, "digital": 0, "avg_indic_ratio": 0.0})
    for name, found in (("has_tables", tables), ("has_bookmarks", bookmarks)):
        if found is None:
            by = by.withColumn(name, F.lit(False))
        else:
            by = by.join(found.select("doc_id").distinct().withColumn(name, F.lit(True)), "doc_id", "left").fillna({name: False})
    kind = F.when((F.col("page_count") == 0) | (F.col("digital") == 0), "scanned_pdf").when(F.col("digital") < F.col("page_count"), "mixed").when(F.col("has_tables"), "table_heavy").otherwise("digital_pdf")
    return by.select("doc_id", kind.alias("document_type"), "has_bookmarks", "has_tables", "avg_indic_ratio", "page_count")


def merge_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """``pages`` with the table texts (doc_id, page_number, table_ord, text) of each page as blocks and below its text."""
    block = F.struct(F.lit("table").alias("block_type"), F.col("text"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.lit(0.9).alias("confidence"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("double").alias("font_size"))
    by = tables.groupBy("doc_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_ord", block.alias("b")))), lambda x: x["b"]).alias("more"))
    joined = pages.join(by, ["doc_id", "page_number"], "left")
    text = F.when(F.col("more").isNull(), F.col("text")).otherwise(F.concat(X.text_of("text"), F.lit("\n\n"), F.array_join(F.transform("more", lambda b: b["text"]), "\n\n")))
    blocks = F.when(F.col("more").isNull(), F.col("blocks")).otherwise(F.concat(F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType)), F.col("more").cast(pages.schema["blocks"].dataType)))
    return joined.withColumn("blocks", blocks).withColumn("text", text).withColumn("indic_ratio", F.when(F.col("more").isNull(), F.col("indic_ratio")).otherwise(X.indic_ratio("text"))).select(*pages.columns)


def route_tables(pages: DataFrame, tables: DataFrame, profiles: DataFrame) -> DataFrame:
    """Merge tables but for scanned or mixed documents that are hardly Indic, whose pages stay as they are."""
    skip = profiles.filter(F.col("document_type").isin("scanned_pdf", "mixed") & (F.col("avg_indic_ratio") < MIN_SHARE)).select("doc_id")
    return merge_tables(pages, tables.join(skip, "doc_id", "left_anti"))


def line_blocks(text: Column, page: Column, confidence: Column) -> Column:
    """An array of paragraph blocks, one for each line that is not blank."""
    lines = F.filter(F.transform(F.split(X.text_of(text), "\n"), X.strip), lambda x: x != "")
    return F.transform(
        lines,
        lambda x: F.struct(F.lit("paragraph").alias("block_type"), x.alias("text"), page.cast("int").alias("page_start"), page.cast("int").alias("page_end"), confidence.cast("double").alias("confidence"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("double").alias("font_size")),
    )


def pages_from_ocr(ocr: DataFrame, engine: str = "ocr") -> DataFrame:
    """Pages of recognised texts (doc_id, page_number, text, confidence)."""
    return ocr.select("doc_id", "page_number", "text", "confidence", F.lit(engine).alias("engine"), X.indic_ratio("text").alias("indic_ratio"), line_blocks(F.col("text"), F.col("page_number"), F.col("confidence")).alias("blocks"))


def merge_parsed_with_ocr(parsed: DataFrame, ocr: DataFrame, composed: bool = False) -> DataFrame:
    """One page each of parsed and recognised pages, by document and number, with lines kept.

    A parsed page gives way to a recognised text that is not blank if it has little of both scripts or under 20
    characters. Recognised pages alone count if they are not blank.
    """
    r = ocr.select("doc_id", "page_number", F.col("text").alias("ocr_text"), F.col("confidence").alias("ocr_confidence"))
    p = parsed.withColumn("has", F.lit(True))
    both = p.join(r, ["doc_id", "page_number"], "full_outer")
    good = F.coalesce(X.strip("ocr_text") != "", F.lit(False))
    poor = (F.col("indic_ratio") < MIN_SHARE) & (X.latin_ratio("text") < MIN_SHARE) | (F.length(X.strip(X.text_of("text"))) < MIN_TEXT)
    use = F.when(F.col("has").isNull(), good).otherwise(good & F.coalesce(poor, F.lit(False)))
    both = both.withColumn("use", use).filter("has IS NOT NULL OR use")
    both = both.withColumn("text", X.clean_text(F.when(F.col("use"), F.col("ocr_text")).otherwise(F.col("text")), lines=True, composed=composed))
    both = both.withColumn("confidence", F.when(F.col("use"), F.col("ocr_confidence")).otherwise(F.col("confidence")))
    blocks = F.when(F.col("use"), line_blocks(F.col("text"), F.col("page_number"), F.col("confidence"))).otherwise(F.col("blocks"))
    return both.select("doc_id", "page_number", "text", "confidence", F.when(F.col("use"), F.lit("ocr")).otherwise(F.col("engine")).alias("engine"), X.indic_ratio("text").alias("indic_ratio"), blocks.alias("blocks"))


def document_language(pages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_id, language) by script shares of all pages together; counts are summed, texts never joined."""
    X.bound_batches(pages.sparkSession)
    shapes = pages.select("doc_id", counted(F.col("text")).alias("m"))
    sums = shapes.groupBy("doc_id").agg(F.sum("m.indic").alias("i"), F.sum("m.latin").alias("a"), F.sum("m.solid").alias("n"))
    share = lambda c: F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col(c) / F.col("n"))
    i, a = share("i") >= MIN_SHARE, share("a") >= MIN_SHARE
    return sums.select("doc_id", F.when(i & a, "mixed").when(i, "as").when(a, "en").otherwise(config.default_language).alias("language"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """``pages`` cleaned the older way: lines are kept in all pages of a document of which one looks like questions."""
    keep = F.max(X.looks_like_questions("text")).over(Window.partitionBy("doc_id"))
    return pages.withColumn("_keep", keep).withColumn("text", X.clean_text_simple("text", lines=F.col("_keep"))).select(*pages.columns)
