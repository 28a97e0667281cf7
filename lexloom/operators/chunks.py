"""Chunks of sections within token budgets, and what is done to them before they are indexed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.functions import text as X
from lexloom.operators import units as U


def clean_units(units: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Units cleaned by their types, without those that are not worth a vector; long ones in pieces, with their tokens
    and their ``shape`` m."""
    X.bound_batches(units.sparkSession)
    pieces = U.worth_pieces(X.text_of("text"), F.col("kind").isin(*U.KEEP_LINES), config.min_quality, config.chunk_max)
    rows = units.select(*U.SECTION, "of", "unit_no", "kind", F.posexplode(pieces).alias("piece_no", "m"))
    return rows.select(*U.SECTION, "of", "unit_no", "kind", "piece_no", F.col("m.text").alias("text"), F.col("m").dropFields("text").alias("m"), X.tokens_of(F.col("m")).alias("size"))


def _packed(units: DataFrame, config: EngineConfig) -> DataFrame:
    """(doc_id, section_no, of, chunks): each section's chunks, with the sum m of their units' shapes if units have them."""
    more = ["m"] if "m" in units.columns else []
    by = units.groupBy(*U.SECTION).agg(F.first("of").alias("of"), F.array_sort(F.collect_list(F.struct("unit_no", "piece_no", "kind", "text", "size", *more))).alias("units"))
    sizes = F.transform("units", lambda u: u["size"])
    ranges = U.pack_ranges(F.col("sizes"), config.chunk_max, config.chunk_target, config.chunk_overlap, config.chunk_max, config.strict)

    def chunk(r: Column) -> Column:
        kind = lambda place: F.get("units", place)["kind"]
        carried = F.when(r["own"] > r["first"], kind(r["own"] - 1))
        own = F.slice("units", r["own"] + 1, r["end"] - r["own"])
        apart = F.coalesce(carried.isin(*U.KEEP_LINES), F.lit(False)) | F.exists(own, lambda u: u["kind"].isin(*U.KEEP_LINES))
        held = F.slice("units", r["first"] + 1, r["end"] - r["first"])
        texts = F.transform(held, lambda u: u["text"])
        text = F.when(apart, F.array_join(texts, "\n\n")).otherwise(F.array_join(texts, " "))
        total = lambda name: F.aggregate(held, F.lit(0), lambda s, u: s + u["m"][name])
        gaps = (r["end"] - r["first"] - 1) * F.when(apart, 2).otherwise(1)
        m = F.struct((total("n") + gaps).alias("n"), *[total(c).alias(c) for c in ("solid", "indic", "latin")]) if more else None
        return F.struct(F.coalesce(carried, kind(r["first"])).alias("block_type"), X.strip(text).alias("text"), *([m.alias("m")] if more else []))

    # chunks are made before they are dealt out, so that no row carries its section's units along
    rows = by.withColumn("sizes", sizes).withColumn("ranges", ranges)
    return rows.select(*U.SECTION, "of", F.transform("ranges", chunk).alias("chunks"))


def pack_units(units: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_id, section_no, of, draft_no, block_type, text): units of each section packed in order.

    Units that a chunk carries over take the type of the last. A chunk's type is that of its first unit; blank lines part
    its units if any of them is a list, a question or a table.
    """
    rows = _packed(units.drop("m"), config).select(*U.SECTION, "of", F.posexplode("chunks").alias("draft_no", "c"))
    return rows.select(*U.SECTION, "of", "draft_no", "c.*")


def draft_chunks(sections: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunk drafts of each section: (doc_id, section_no, draft_no, block_type, text, and the section's columns)."""
    made = pack_units(clean_units(U.section_units(sections, config.strict), config), config)
    return made.select(*U.SECTION, "of.*", "draft_no", "block_type", "text")


def measure(drafts: DataFrame, languages: DataFrame, confidences: DataFrame | None = None) -> DataFrame:
    """Drafts with token_count, quality_score, language, text_hash and the OCR confidence of their first page."""
    out = drafts.join(languages.withColumnRenamed("language", "_default"), "doc_id", "left")
    if confidences is None:
        out = out.withColumn("ocr_confidence", F.lit(None).cast("double"))
    else:
        of = confidences.select(F.col("doc_id"), F.col("page_number").alias("page_start"), F.col("confidence").alias("ocr_confidence"))
        out = out.join(of, ["doc_id", "page_start"], "left")
    measured = X.let(X.shape("text"), lambda m: F.struct(X.tokens_of(m).alias("token_count"), X.quality_of(m, "text").alias("quality_score"), X.language_of(m, F.col("_default")).alias("language")))
    return out.select(*drafts.columns, measured.alias("_m"), X.content_hash("text").alias("text_hash"), "ocr_confidence").select(*drafts.columns, "_m.*", "text_hash", "ocr_confidence")


def exact_dedup(chunks: DataFrame, order: list[str | Column], key: str = "doc_id", hash_column: str = "text_hash") -> DataFrame:
    """The first chunk of each text within a document."""
    w = Window.partitionBy(key, hash_column).orderBy(*order)
    return chunks.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def _heads(sizes: Column, config: EngineConfig) -> Column:
    """The places, from 0, of those that begin a chunk when tiny ones join the one before; sizes are token counts."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("heads"))

    def step(s: Column, size: Column) -> Column:
        joins = (F.size(s["heads"]) > 0) & (size < config.chunk_min) & (s["total"] + size <= config.chunk_max)
        return F.struct((s["at"] + 1).alias("at"), F.when(joins, s["total"] + size).otherwise(size).alias("total"), F.when(joins, s["heads"]).otherwise(F.concat(s["heads"], F.array(s["at"]))).alias("heads"))

    return F.aggregate(sizes, start, step, lambda s: s["heads"])


def merge_tiny(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks under the least size joined to the one before in their section, as long as the sum is within the most.

    Which chunks join is a fold over their token counts. The first of those joined gives all other columns; quality is
    the least of theirs and page_end the greatest, a missing one counting as 0.
    """
    columns = chunks.columns
    by = chunks.groupBy(*U.SECTION).agg(F.array_sort(F.collect_list(F.struct("draft_no", F.struct(*columns).alias("c")))).alias("held"))
    heads = _heads(F.transform("held", lambda x: x["c"]["token_count"]), config)

    def join(at: Column, n: Column) -> Column:
        end = F.coalesce(F.get("heads", n + 1), F.size("held"))
        return X.let(F.transform(F.slice("held", at + 1, end - at), lambda x: x["c"]), merged)

    def merged(g: Column) -> Column:
        each = lambda name: F.transform(g, lambda c: c[name])
        first = F.element_at(g, 1)
        changed = {
            "text": F.array_join(each("text"), "\n\n"),
            "token_count": F.aggregate(each("token_count"), F.lit(0), lambda s, x: s + x),
            "quality_score": F.array_min(each("quality_score")),
            "page_end": F.when(F.size(g) == 1, first["page_end"]).otherwise(F.array_max(F.transform(g, lambda c: F.coalesce(c["page_end"], F.lit(0))))),
        }
        return F.struct(*[changed.get(c, first[c]).alias(c) for c in columns])

    out = by.withColumn("heads", heads).select(F.explode(F.transform("heads", join)).alias("c")).select("c.*")
    return out.withColumn("text_hash", X.content_hash("text"))


def noise_filter(chunks: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of at least 10 characters, of the least quality, of no more than the most tokens."""
    return chunks.filter((F.length(X.strip("text")) >= 10) & (F.col("quality_score") >= config.min_quality) & (F.col("token_count") <= config.chunk_max))


def chunk_id(doc_id: Column, index: Column) -> Column:
    """An id that depends on the document and the chunk's index only, so that a task run again gives the same."""
    return F.sha2(F.concat(doc_id.cast("string"), F.lit(":"), index.cast("string")), 256)


def reindex(chunks: DataFrame, order: list[str]) -> DataFrame:
    """Chunks numbered from 0 in each document, with ids."""
    n = (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("int")
    return chunks.withColumn("chunk_index", n).withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index")))


def neighbour_links(chunks: DataFrame, doc: str = "doc_id", index: str = "chunk_index", key: str = "chunk_id") -> DataFrame:
    w = Window.partitionBy(doc).orderBy(index)
    return chunks.withColumn("prev_chunk_id", F.lag(key).over(w)).withColumn("next_chunk_id", F.lead(key).over(w))


def _groups(drafts: DataFrame, config: EngineConfig) -> DataFrame:
    """(doc_id, section_no, page_start, groups): the drafts of each chunk that is kept, by measures alone."""
    m = drafts.select(*U.SECTION, "page_start", F.posexplode("measures").alias("draft_no", "m"))
    first = F.min(F.struct("section_no", "draft_no", "page_start", F.col("m").dropFields("text_hash").alias("m")))
    kept = m.groupBy("doc_id", F.col("m.text_hash").alias("text_hash")).agg(first.alias("d")).select("doc_id", "d.*")
    by = kept.groupBy(*U.SECTION).agg(F.first("page_start").alias("page_start"), F.array_sort(F.collect_list(F.struct("draft_no", "m"))).alias("held"))
    by = by.withColumn("heads", _heads(F.transform("held", lambda x: x["m"]["token_count"]), config))

    def group(at: Column, n: Column) -> Column:
        g = F.slice("held", at + 1, F.coalesce(F.get("heads", n + 1), F.size("held")) - at)
        total = lambda name: F.aggregate(g, F.lit(0), lambda s, x: s + x["m"][name])
        return F.struct(F.transform(g, lambda x: x["draft_no"]).alias("drafts"), total("token_count").alias("token_count"), F.array_min(F.transform(g, lambda x: x["m"]["quality_score"])).alias("quality_score"), (total("n") + 2 * (F.size(g) - 1)).alias("n"))

    good = lambda g: (g["n"] >= 10) & (g["quality_score"] >= config.min_quality) & (g["token_count"] <= config.chunk_max)
    return by.select(*U.SECTION, "page_start", F.filter(F.transform("heads", group), good).alias("groups"))  # no filter of these: pushed down, it would fold anew for each group


def chunk_counts(drafts: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_id, n_chunks) of documents that keep chunks of ``measured_drafts``, without reading a text."""
    return _groups(drafts, config).groupBy("doc_id").agg(F.sum(F.size("groups")).alias("n_chunks")).filter("n_chunks > 0")


def _plan(drafts: DataFrame, languages: DataFrame, confidences: DataFrame | None, config: EngineConfig) -> DataFrame:
    """(_doc, _section, groups, base, total, _default, ocr_confidence) of sections.

    Exact dedup, merge of tiny ones, noise filter and numbers, by measures alone: groups are the drafts of each chunk,
    base the number of its section's first chunk, total the count of its document's. No text is read.
    """
    by = _groups(drafts, config)
    n, whole = F.size("groups"), Window.partitionBy("doc_id")
    upto = whole.orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    by = by.select(*U.SECTION, "page_start", "groups", (F.sum(n).over(upto) - n).cast("int").alias("base"), F.sum(n).over(whole).cast("int").alias("total"))
    by = by.join(languages.withColumnRenamed("language", "_default"), "doc_id", "left")
    if confidences is None:
        by = by.withColumn("ocr_confidence", F.lit(None).cast("double"))
    else:
        of = confidences.select(F.col("doc_id"), F.col("page_number").alias("page_start"), F.col("confidence").alias("ocr_confidence"))
        by = by.join(of, ["doc_id", "page_start"], "left")
    return by.select(F.col("doc_id").alias("_doc"), F.col("section_no").alias("_section"), "groups", "base", "total", "_default", "ocr_confidence")


def measured_drafts(sections: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """(the section's columns, kinds, texts, measures): a row for each section with its drafts, what they measure apart.

    Measures of a draft are those of its text; they follow from the sums over its units, which are stripped and without
    garbage. A null language is the document's.
    """
    rows = _packed(clean_units(U.section_units(sections, config.strict), config), config)

    def measures(c: Column) -> Column:
        m = c["m"]
        i, a = X.share_of(m, "indic"), X.share_of(m, "latin")
        score = F.lit(0.5) * F.greatest(i, a) + F.lit(0.3) + F.lit(0.2) * F.least(a + i, F.lit(1.0))
        quality = F.when(m["n"] < 5, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        return F.struct(X.tokens_of(m).alias("token_count"), quality.alias("quality_score"), X.language_of(m, F.lit(None).cast("string")).alias("language"), m["n"].alias("n"), X.content_hash(c["text"]).alias("text_hash"))

    each = lambda name: F.transform("chunks", lambda c: c[name])
    return rows.select(*U.SECTION, "of.*", each("block_type").alias("kinds"), each("text").alias("texts"), F.transform("chunks", measures).alias("measures"))


def chunk_sections(sections: DataFrame, languages: DataFrame, confidences: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Sections to chunks: drafts, measures, exact dedup, merge of tiny ones, noise filter, numbers and links."""
    return finished_chunks(measured_drafts(sections, config), languages, confidences, config)


def finished_chunks(drafts: DataFrame, languages: DataFrame, confidences: DataFrame | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """Chunks of ``measured_drafts``, which are read twice.

    Which drafts make up which chunk follows from their measures, and only then do texts meet it, by section.
    """
    plan = _plan(drafts, languages, confidences, config).hint("shuffle_hash")
    rows = drafts.join(plan, drafts["doc_id"].eqNullSafe(F.col("_doc")) & (drafts["section_no"] == F.col("_section")))
    of = [c for c in drafts.columns if c not in (*U.SECTION, "kinds", "texts", "measures")]
    rows = rows.select("doc_id", *of, "kinds", "texts", "measures", "_default", "ocr_confidence", "base", "total", "groups")

    def chunk(g: Column, n: Column) -> Column:
        place = F.get(g["drafts"], F.lit(0))
        text = F.array_join(F.transform(g["drafts"], lambda d: F.get("texts", d)), "\n\n")
        return F.struct(F.get("kinds", place).alias("block_type"), text.alias("text"), g["token_count"].alias("token_count"), g["quality_score"].alias("quality_score"), F.coalesce(F.get("measures", place)["language"], "_default").alias("language"), (F.size(g["drafts"]) > 1).alias("joined"), (F.col("base") + n).alias("chunk_index"))

    rows = rows.select("doc_id", *of, "ocr_confidence", "total", F.explode(F.transform("groups", chunk)).alias("c")).select("doc_id", *of, "c.*", "ocr_confidence", "total")
    changed = {"page_end": F.when(F.col("joined"), F.coalesce("page_end", F.lit(0))).otherwise(F.col("page_end")).alias("page_end")}
    at = F.col("chunk_index")
    return rows.select(
        "doc_id", *[changed.get(c, c) for c in of], "block_type", "text", "token_count", "quality_score", "language", X.content_hash("text").alias("text_hash"), "ocr_confidence", "chunk_index", chunk_id(F.col("doc_id"), at).alias("chunk_id"),
        F.when(at > 0, chunk_id(F.col("doc_id"), at - 1)).alias("prev_chunk_id"), F.when(at + 1 < F.col("total"), chunk_id(F.col("doc_id"), at + 1)).alias("next_chunk_id"),
    )
