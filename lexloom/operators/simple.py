"""The older, simpler sections and chunks: of texts alone, without blocks, filters or merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.functions import text as X
from lexloom.operators import units as U

#: Where a text without questions parts: after a sentence, and at blank lines.
_BREAK = X.SENTENCE_GAP + r"|\n{2,}"
#: A heading: a line of at most 90 characters and 12 words that does not end a sentence.
HEADING_CHARS, HEADING_WORDS, HEADING_LINE = 90, 12, r"^(?:\p{Nd}+[.)] +)?[^\n]{1,81}$"


def simple_sections(pages: DataFrame) -> DataFrame:
    """(doc_id, section_no, section_id, section_title, text, page_number) of pages (doc_id, page_number, text).

    A paragraph (parted by blank lines) whose first line is a heading starts a section; paragraphs before the first make
    an untitled one. A document of blank pages is one untitled section.
    """
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split(X.text_of("text"), "\n\n")).alias("n", "para"))
    rows = rows.withColumn("lines", F.filter(F.split("para", "\n"), lambda x: X.strip(x) != "")).filter(F.size("lines") > 0)
    first = X.strip(F.element_at("lines", 1))
    heading = (F.length(first) <= HEADING_CHARS) & ~first.rlike(X.SENTENCE_END) & (F.size(X.words(first)) <= HEADING_WORDS) & first.rlike(HEADING_LINE)
    rows = rows.withColumn("heading", heading).withColumn("first", first)
    order = Window.partitionBy("doc_id").orderBy("page_number", "n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section_no", (F.sum(F.col("heading").cast("int")).over(order) - F.first("heading").over(order).cast("int")).cast("int"))
    rest = X.strip(F.array_join(F.slice("lines", F.lit(2), F.size("lines")), "\n"))
    part = F.when(F.col("heading"), rest).otherwise(F.col("para"))
    by = rows.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("page_number", "n", "heading", "first", part.alias("part")))).alias("items"))
    head = F.element_at("items", 1)
    parts = F.filter(F.transform("items", lambda x: F.rtrim(x["part"], F.lit(X.WHITE_CHARS))), lambda x: x != "")
    text = X.strip(F.array_join(parts, "\n\n"))
    made = by.select("doc_id", "section_no", F.when(head["heading"], head["first"]).alias("section_title"), text.alias("text"), head["page_number"].alias("page_number"))
    blank = pages.groupBy("doc_id").agg(F.max(X.strip(X.text_of("text")) != "").alias("some"), F.min("page_number").alias("page_number")).filter("NOT some")
    blank = blank.select("doc_id", F.lit(0).alias("section_no"), F.lit(None).cast("string").alias("section_title"), F.lit("").alias("text"), "page_number")
    return made.unionByName(blank).withColumn("section_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":s:"), F.col("section_no").cast("string")), 256))


def simple_units(text: Column) -> Column:
    """Questions with the line below that is no question, where at least two lines ask; else sentences and paragraphs."""
    lines = U.lines_of(text)
    plain = F.filter(F.transform(F.split(text, _BREAK), X.strip), lambda x: x != "")
    return F.when(U.asking(lines) >= 2, F.transform(U.question_units(lines), lambda u: u["text"])).otherwise(plain)


def simple_chunks(sections: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_id, chunk_index, section_id, section_title, page_number, text, token_count) of sections, titles put before
    their texts. A unit of the target size stands alone; every chunk stays."""
    keep = ["doc_id", "section_no", "section_id", "section_title", "page_number"]
    body = F.when(X.text_of("section_title") != "", X.strip(F.concat("section_title", F.lit("\n"), X.text_of("text")))).otherwise(X.text_of("text"))
    rows = sections.select(*keep, simple_units(body).alias("units"))
    rows = rows.withColumn("sizes", F.transform("units", X.token_count))
    ranges = U.pack_ranges(F.col("sizes"), config.chunk_target, config.chunk_target, config.chunk_overlap, config.chunk_max, config.strict)

    def chunk(r: Column) -> Column:
        texts = F.slice("units", r["first"] + 1, r["end"] - r["first"])
        apart = U.asking(F.flatten(F.transform(texts, U.lines_of))) >= 2
        return X.strip(F.when(apart, F.array_join(texts, "\n\n")).otherwise(F.array_join(texts, " ")))

    rows = rows.withColumn("ranges", ranges).select(*keep, F.posexplode(F.transform("ranges", chunk)).alias("n", "text"))
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no", "n")) - 1).cast("int")
    return rows.select("doc_id", index.alias("chunk_index"), "section_id", "section_title", "page_number", "text", X.token_count("text").alias("token_count"))
