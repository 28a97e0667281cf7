"""Sections of documents: runs of blocks from one heading to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators.blocks import flat_text


def heading_path(headings: Column, strict: bool = True) -> Column:
    """The path after an array of headings (title, level) in order: the first level - 1 titles so far, then the title.

    Strictly that is by place in the path; otherwise entries of the heading's level or deeper are dropped by their level.
    """
    empty = F.array().cast("array<struct<title:string,level:int>>")
    level = lambda h: F.coalesce(F.nullif(h["level"], F.lit(0)), F.lit(1))
    entry = lambda h: F.array(F.struct(h["title"].alias("title"), level(h).cast("int").alias("level")))
    if strict:
        step = lambda p, h: F.concat(F.slice(p, F.lit(1), F.greatest(F.lit(0), level(h) - 1)), entry(h))
    else:
        step = lambda p, h: F.concat(F.filter(p, lambda e: e["level"] < level(h)), entry(h))
    return F.transform(F.aggregate(headings, empty, step), lambda e: e["title"])


#: Places of a path that are followed as columns; documents with deeper headings fold theirs one by one.
DEPTH = 12


def with_paths(sections: DataFrame, strict: bool = True) -> DataFrame:
    """``sections`` (doc_id, section_no, title, level, ...) with heading_path; untitled ones have an empty path.

    Strictly a heading goes to the place after the first level - 1 of the path so far, which therefore is as long as the
    least, over headings j up to it, of level(j) + the number of headings from j to it; a running minimum gives each
    heading's place, and what stands at place p of a path is the last heading put there. That takes one pass whatever
    the number of headings. Paths that are not strict, and those deeper than DEPTH, are folded from all titles before.
    """
    order = Window.partitionBy("doc_id").orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    titled = F.col("title").isNotNull()
    level = F.when(titled, F.greatest(F.coalesce(F.nullif("level", F.lit(0)), F.lit(1)), F.lit(1)))
    columns = sections.columns
    rows = sections.withColumn("_n", F.sum(titled.cast("int")).over(order)).withColumn("_level", level)
    rows = rows.withColumn("_place", F.col("_n") + F.least(F.lit(0), F.min(F.col("_level") - F.col("_n")).over(order)))
    deep = F.max("_level").over(Window.partitionBy("doc_id")) > DEPTH if strict else F.lit(True)
    rows = rows.withColumn("_deep", F.coalesce(deep, F.lit(False)))
    folded = heading_path(F.collect_list(F.when(F.col("_deep") & titled, F.struct("title", "level"))).over(order), strict)
    path = folded
    if strict:
        there = F.array(*[F.last(F.when(F.col("_place") == p, F.col("title")), ignorenulls=True).over(order) for p in range(1, DEPTH + 1)])
        path = F.when(F.col("_deep"), folded).otherwise(F.slice(there, F.lit(1), F.coalesce("_place", F.lit(0))))
    return rows.select(*columns, F.when(titled, path).otherwise(F.array().cast("array<string>")).alias("heading_path"))


def _lines(b: Column) -> Column:
    return X.strip(b["text"])


def _is_heading(b: Column) -> Column:
    return X.is_heading(_lines(b), b["block_type"], b["heading_level"])


def number_pages(pages: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, page_number, at, empty, heads) of ``pages`` (doc_id, page_number, bare, first, heads): at is the number
    of the section that a page begins in, empty whether its document has bare pages only; heads get their paths.

    Only headings are gathered by document, not texts.
    """
    kind = pages.schema["heads"].dataType
    heads = F.flatten(F.collect_list(F.coalesce("heads", F.array().cast(kind))))
    by = pages.groupBy("doc_id", "page_number").agg(F.min("bare").alias("bare"), F.max("first").alias("first"), heads.alias("heads"))
    # bare pages last: whether a document begins with a heading is told by its first other page
    order = Window.partitionBy("doc_id").orderBy("bare", "page_number")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    n = F.size("heads")
    by = by.withColumn("at", (F.sum(n).over(upto) - n - F.first("first").over(upto).cast("int")).cast("int")).withColumn("empty", F.min("bare").over(upto))
    # a row for the page's beginning, without title, and one for each heading
    rows = by.select("doc_id", "page_number", "at", "empty", F.posexplode(F.concat(F.array(F.lit(None).cast(kind.elementType)), "heads")).alias("n", "h"))
    rows = rows.select("doc_id", "page_number", "at", "empty", (F.col("at") + F.col("n")).alias("section_no"), F.col("h.ord").alias("ord"), F.col("h.title").alias("title"), F.col("h.level").alias("level"))
    rows = with_paths(rows, strict)
    found = F.array_sort(F.collect_list(F.when(F.col("title").isNotNull(), F.struct("ord", F.col("heading_path").alias("path")))))
    return rows.groupBy("doc_id", "page_number").agg(F.min("at").alias("at"), F.min("empty").alias("empty"), found.alias("heads"))


def section_blocks(pages: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, section_no, page_number, block_ord, heading, path, bare, page, b): the blocks of ``pages``, numbered by sections.

    A bare page, which has no text in its blocks, is one row that stands for it, if its document has no other pages.
    """
    kind = pages.schema["blocks"].dataType
    text = X.text_of("text")
    blocks = F.when(F.size("blocks") > 0, F.col("blocks")).otherwise(F.array(F.struct(F.lit("paragraph").alias("block_type"), F.col("text"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.lit(1.0).alias("confidence"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("double").alias("font_size"))).cast(kind))
    parts = F.filter(F.transform(blocks, lambda b, i: F.struct(i.alias("ord"), b.alias("b"))), lambda x: _lines(x["b"]) != "")
    page = F.struct(F.when(X.strip(text) != "", text).alias("text"), F.nullif(flat_text(F.coalesce("blocks", F.array().cast(kind))), F.lit("")).alias("flat"))
    heads = F.transform(F.filter("parts", lambda x: _is_heading(x["b"])), lambda x: F.struct(x["ord"].alias("ord"), _lines(x["b"]).alias("title"), x["b"]["heading_level"].alias("level")))
    slim = pages.select("doc_id", "page_number", parts.alias("parts")).select("doc_id", "page_number", (F.size("parts") == 0).alias("bare"), F.get("parts", F.lit(0))["ord"].alias("begin"), heads.alias("heads"))
    first = F.coalesce(F.get("heads", F.lit(0))["ord"] == F.col("begin"), F.lit(False))
    numbers = number_pages(slim.select("doc_id", "page_number", "bare", first.alias("first"), "heads"), strict)
    numbers = numbers.select(F.col("doc_id").alias("_doc"), F.col("page_number").alias("_page"), "at", "empty", "heads").hint("shuffle_hash")
    # texts meet the numbers once, in their parts, or whole for bare pages
    of = pages.select("doc_id", "page_number", parts.alias("parts"), page.alias("page")).withColumn("bare", F.size("parts") == 0).withColumn("page", F.when(F.col("bare"), F.col("page")))
    rows = of.join(numbers, of["doc_id"].eqNullSafe(F.col("_doc")) & of["page_number"].eqNullSafe(F.col("_page")))
    rows = rows.select("doc_id", "page_number", "at", "empty", "heads", "parts", "page", "bare").filter("empty OR NOT bare")
    one = F.when(F.col("bare"), F.array(F.lit(None).cast(rows.schema["parts"].dataType.elementType))).otherwise(F.col("parts"))
    rows = rows.select("doc_id", "page_number", "at", "heads", "bare", "page", F.explode(one).alias("x"))
    n = F.size(F.filter("heads", lambda h: h["ord"] <= F.col("x.ord")))
    rows = rows.withColumn("n", F.when(F.col("bare") | (F.size("heads") == 0), 0).otherwise(n)).withColumn("last", F.get("heads", F.col("n") - 1))
    heading = F.coalesce(F.col("last.ord") == F.col("x.ord"), F.lit(False))
    return rows.select("doc_id", (F.col("at") + F.col("n")).alias("section_no"), "page_number", F.col("x.ord").alias("block_ord"), heading.alias("heading"), F.when(heading, F.col("last.path")).alias("path"), "bare", "page", F.col("x.b").alias("b"))


def detect_sections(pages: DataFrame, strict: bool = True) -> DataFrame:
    """(doc_id, section_no, section_id, section_title, heading_path, text, page_start, page_end, blocks) of each document.

    ``pages`` have classified blocks. A heading starts a section, and blocks before the first make an untitled one. The
    text leaves the heading out; tables are set off by a blank line. A document without any block that has text is one
    untitled section of no blocks over its pages. section_id depends on the document and the section's number only.
    Texts are gathered by section, never by document.
    """
    item = F.struct("page_number", "block_ord", "heading", "path", "b")
    whole = F.struct("page_number", "page.flat", "page.text")
    rows = section_blocks(pages, strict)
    by = rows.groupBy("doc_id", "section_no").agg(F.array_sort(F.collect_list(F.when(~F.col("bare"), item))).alias("items"), F.array_sort(F.collect_list(F.when(F.col("bare"), whole))).alias("whole"))
    head = F.get("items", F.lit(0))
    body = F.filter("items", lambda x: ~x["heading"])
    gap = lambda x, i: F.when(i == 0, "").when(x["b"]["block_type"] == "table", "\n\n").otherwise("\n")
    join = F.array_join(F.transform(body, lambda x, i: F.concat(gap(x, i), _lines(x["b"]))), "")
    of_pages = lambda name: F.array_join(F.transform("whole", lambda x: x[name]), "\n\n")
    none = F.size("items") == 0
    numbers = F.transform("whole", lambda x: x["page_number"])
    section_id = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":s:"), F.col("section_no").cast("string")), 256)
    return by.select(
        "doc_id", "section_no", section_id.alias("section_id"), F.when(head["heading"], _lines(head["b"])).alias("section_title"), F.coalesce(head["path"], F.array().cast("array<string>")).alias("heading_path"),
        F.when(none, F.coalesce(F.nullif(of_pages("flat"), F.lit("")), of_pages("text"))).otherwise(join).alias("text"),
        F.when(none, F.array_min(numbers)).otherwise(head["b"]["page_start"]).cast("int").alias("page_start"),
        F.when(none, F.array_max(numbers)).otherwise(F.greatest(head["b"]["page_end"], F.array_max(F.transform(body, lambda x: x["b"]["page_end"])))).cast("int").alias("page_end"),
        F.transform("items", lambda x: x["b"]).alias("blocks"),
    )
