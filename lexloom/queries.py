"""Queries by name over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.config import DEFAULT
from lexloom.functions import parsing, prompts
from lexloom.functions import text as X
from lexloom.functions import vectors as V
from lexloom.operators import blocks, bm25, chunks, context, dense, evaluation, headers, pages, ranking, relational, sections
from lexloom.plans.ingest import ingest
from lexloom.schema import PAGES

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts and vectors that come in fewer parts than there are cores are dealt out, others stay as files are."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name in ("documents", "embeddings") and rows.rdd.getNumPartitions() < cores else rows


#: Another script's text beside each document's own (variant 0), so that rules for scripts, garbage, lists and questions
#: decide both ways.
INDIC = "concat('- ', translate(text, 'aeiounst', 'অআইঈউকখগ'), ' ŁłʢˤŁł ?')"


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text t, and beside it the variant."""
    forms = F.array(F.struct(F.lit(0).alias("variant"), F.col("text").alias("t")), F.struct(F.lit(1).alias("variant"), F.expr(INDIC).alias("t")))
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(forms).alias("form"))
    return d.select("doc_id", "source", "lang", "form.variant", "form.t")


_T = f"WITH v AS (SELECT doc_id, source, lang, 0 AS variant, text AS t FROM documents UNION ALL SELECT doc_id, source, lang, 1, {INDIC} FROM documents)"
# White space, as one RE2 class.
_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_GARBAGE = r"[\x{141}\x{142}\x{2a2}\x{2e4}\x{34b}-\x{34e}\x{350}-\x{361}]"


def _n(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))"


def _solid(t: str) -> str:
    return f"length(regexp_replace({t}, '{_W}', '', 'g'))"


def _share(t: str, pattern: str) -> str:
    return f"CASE WHEN {_solid(t)} = 0 THEN 0.0::DOUBLE ELSE {_n(t, pattern)}::DOUBLE / {_solid(t)} END"


def _indic(t: str) -> str:
    return _share(t, r"[\x{980}-\x{9ff}]")


def _latin(t: str) -> str:
    return _share(t, "[A-Za-z]")


def _garbage(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0.0::DOUBLE ELSE {_n(t, _GARBAGE)}::DOUBLE / length({t}) END"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^{_W}+|{_W}+$', '', 'g')"


def _quality(t: str) -> str:
    i, a = f"({_indic(t)})", f"({_latin(t)})"
    return f"""CASE WHEN length({_strip(t)}) < 5 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE * greatest({i}, {a})
        + 0.3::DOUBLE * (1.0::DOUBLE - ({_garbage(t)}) * 10) + 0.2::DOUBLE * least({a} + {i}, 1.0::DOUBLE))) END"""


def _language(t: str, default: str = "'as'") -> str:
    i, a = f"({_indic(t)}) >= 0.15", f"({_latin(t)}) >= 0.15"
    return f"CASE WHEN {i} AND {a} THEN 'mixed' WHEN {i} THEN 'as' WHEN {a} THEN 'en' ELSE {default} END"


def _tokens(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN 0 ELSE greatest(1, floor(length({t}) / CASE WHEN ({_indic(t)}) >= ({_latin(t)}) THEN 2.5::DOUBLE ELSE 4.0::DOUBLE END)::INTEGER) END"


def _normal(t: str) -> str:
    dropped = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{feff}\x{fffe}\x{ffff}" + _GARBAGE[1:]
    plain = f"regexp_replace(regexp_replace(nfc_normalize({t}), '{dropped}', '', 'g'), '\\r\\n?', chr(10), 'g')"
    return rf"regexp_replace({plain}, '([\p{{L}}\p{{N}}_])[-\x{{ad}}]\n([\p{{L}}\p{{N}}_])', '\1\2', 'g')"


def _flat(t: str) -> str:
    # RE2 has no lookaround: runs of line ends are marked, single ones become spaces, marks become blank lines.
    marked = rf"regexp_replace({_normal(t)}, '\n{{2,}}', chr(1), 'g')"
    joined = f"replace(replace({marked}, chr(10), ' '), chr(1), chr(10) || chr(10))"
    return _strip(f"regexp_replace({joined}, '[ \\t]{{2,}}', ' ', 'g')")


def _lines(t: str) -> str:
    one = _strip("regexp_replace(x, '[ \\t]{2,}', ' ', 'g')")
    return _strip(f"array_to_string(list_filter(list_transform(string_split({_normal(t)}, chr(10)), lambda x: {one}), lambda y: y <> ''), chr(10))")


def _words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_W}+'), lambda x: x <> '')"


# ---- text functions


@query(f"{_T} SELECT doc_id, variant, {_indic('t')} AS indic, {_latin('t')} AS latin, {_garbage('t')} AS garbage FROM v")
def script_ratios(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.indic_ratio("t").alias("indic"), X.latin_ratio("t").alias("latin"), X.garbage_ratio("t").alias("garbage"))


@query(f"{_T} SELECT doc_id, variant, {_language('t')} AS language, CASE WHEN ({_latin('t')}) > ({_indic('t')}) THEN 'en' ELSE 'as' END AS query_language FROM v")
def detect_language(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.detect_language("t").alias("language"), X.detect_query_language("t").alias("query_language"))


@query(f"{_T} SELECT doc_id, variant, round({_quality('t')}, 9) AS quality FROM v")
def quality_score(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", F.round(X.quality_score("t"), 9).alias("quality"))


@query(f"{_T} SELECT doc_id, variant, {_normal('t')} AS normal FROM v")
def normalize_text(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.normalize("t").alias("normal"))


@query(f"{_T} SELECT doc_id, variant, {_flat('t')} AS cleaned FROM v")
def clean_text_flat(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.clean_text("t").alias("cleaned"))


@query(f"{_T} SELECT doc_id, variant, {_lines('t')} AS cleaned FROM v")
def clean_text_lines(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.clean_text("t", lines=True).alias("cleaned"))


@query(f"{_T}, c AS (SELECT doc_id, variant, t, {_flat('t')} AS c FROM v) SELECT doc_id, variant, length({_strip('t')}) >= 10 AND ({_quality('c')}) >= 0.45 AS embeddable FROM c")
def embeddable(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.is_embeddable("t", DEFAULT.min_quality).alias("embeddable"))


@query(f"{_T} SELECT doc_id, variant, {_tokens('t')} AS tokens FROM v")
def token_count(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.token_count("t").alias("tokens"))


@query(f"{_T} SELECT doc_id, variant, sha256(t) AS text_hash, length(t)::INTEGER AS len, substr(sha1(t), 1, 12) AS sha1, substr(t, 1, 120) AS preview FROM v")
def content_digest(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.content_hash("t").alias("text_hash"), X.summary("t").alias("s")).select("doc_id", "variant", "text_hash", "s.*")


@query(f"""{_T}, s AS (SELECT doc_id, variant, list_filter(list_transform(string_split(regexp_replace(t, '([।.?!]){_W}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda y: y <> '') AS s FROM v)
        SELECT doc_id, variant, len(s)::INTEGER AS n_sentences, sha256(array_to_string(s, chr(10))) AS sentences FROM s""")
def sentence_split(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.sentences("t").alias("s")).select("doc_id", "variant", F.size("s").alias("n_sentences"), F.sha2(F.array_join("s", "\n"), 256).alias("sentences"))


@query(f"""{_T}, l AS (SELECT doc_id, variant, posn, line FROM (SELECT doc_id, variant, string_split(t, chr(10)) AS ls FROM v), LATERAL (SELECT unnest(ls) AS line, unnest(range(len(ls))) AS posn)),
        s AS (SELECT doc_id, variant, posn::INTEGER AS line_no, {_strip('line')} AS line FROM l)
        SELECT doc_id, variant, line_no, regexp_matches(line, '^(?:[-•*]|\\p{{Nd}}+[.)]|[(][a-zA-Z০-৯][)]|\\([ivx]+\\)){_W}+') AS is_list, regexp_matches(line, '^[^\\n]*\\?{_W}*$') AS is_question,
               regexp_matches(line, '(?i)^(?:পৃষ্ঠা|পৃ\\.|Page|P\\.?){_W}*\\p{{Nd}}+(?:{_W}|[./-])*$') OR regexp_matches(line, '^(?:[\\p{{Nd}}./-]|{_W}){{1,12}}$') AS is_page FROM s""")
def line_tests(spark, sf_dir):
    rows = varied(spark, sf_dir).select("doc_id", "variant", F.posexplode(F.split("t", "\n")).alias("line_no", "line")).withColumn("line", X.strip("line"))
    return rows.select("doc_id", "variant", "line_no", X.is_list_item("line").alias("is_list"), X.is_question("line").alias("is_question"), X.is_page_number("line").alias("is_page"))


@query(f"""WITH b AS (SELECT item_id, list_distinct({_words('lower(text)')}) AS s FROM benchmark), p AS (SELECT a.item_id AS a, b.item_id AS b, a.s AS x, b.s AS y FROM b a JOIN b ON a.item_id < b.item_id)
        SELECT a, b, len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) AS similarity FROM p WHERE len(list_intersect(x, y)) > 0""")
def jaccard_items(spark, sf_dir):
    s = read(spark, sf_dir, "benchmark").select("item_id", X.token_set("text").alias("s"))
    w = s.select("item_id", F.explode("s").alias("w"))
    met = w.select(F.col("item_id").alias("a"), "w").join(w.select(F.col("item_id").alias("b"), "w"), "w").filter("a < b").select("a", "b").distinct()
    both = met.join(s.select(F.col("item_id").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("item_id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", X.jaccard(F.col("x"), F.col("y")).alias("similarity"))


@query(f"""{_T}, n AS (SELECT doc_id, variant, regexp_replace(regexp_replace(nfc_normalize(t), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '\\r\\n?', chr(10), 'g') AS t FROM v),
        j AS (SELECT doc_id, variant, regexp_replace(t, '([\\p{{L}}\\p{{N}}_])[-\\x{{ad}}]\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g') AS t FROM n),
        f AS (SELECT doc_id, variant, replace(replace(regexp_replace(t, '\\n{{2,}}', chr(1), 'g'), chr(10), ' '), chr(1), chr(10) || chr(10)) AS t FROM j)
        SELECT doc_id, variant, {_strip("regexp_replace(t, '[ \\t]{{2,}}', ' ', 'g')")} AS cleaned FROM f""".replace("{{2,}}", "{2,}"))
def clean_text_older(spark, sf_dir):
    return varied(spark, sf_dir).select("doc_id", "variant", X.clean_text_simple("t", lines=False).alias("cleaned"))


@query(f"""{_T}, p AS (SELECT a.doc_id, a.t AS t, b.t AS u, (a.doc_id % 7) / 7.0::DOUBLE AS c FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.variant = 0 AND b.variant = 1)
        SELECT doc_id, greatest({_indic('u')}, {_latin('u')}) > greatest({_indic('t')}, {_latin('t')}) OR 0.5::DOUBLE >= c AS takes FROM p""")
def page_fallback(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.expr(INDIC).alias("u"))
    return d.select("doc_id", pages.prefer_fallback(F.col("text"), F.col("doc_id") % 7 / F.lit(7.0), F.col("u"), F.lit(0.5)).alias("takes"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || '-' || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12) END AS id,
        CASE WHEN c_nationkey = 0 THEN c_custkey ELSE c_nationkey END AS page FROM customer""")
def parsed_ids(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    given = F.when(F.col("c_custkey") % 5 == 0, "not an id").otherwise(F.concat(F.lit(" {"), F.upper(F.md5(F.col("c_name").cast("binary"))), F.lit("} ")))
    return c.select("c_custkey", X.uuid_or_null(given).alias("id"), X.default_if_unset("c_nationkey", F.col("c_custkey")).cast("long").alias("page"))


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM e GROUP BY label, i)
        SELECT label, round(sqrt(sum(x * x)), 6) AS before, round(max(CASE WHEN i = 0 THEN x END) / sqrt(sum(x * x)), 6) AS first FROM m GROUP BY label""")
def mean_pooling(spark, sf_dir):
    by = read(spark, sf_dir, "embeddings").groupBy("label").agg(F.collect_list("embedding").alias("rows"))
    pooled = by.select("label", V.mean_pool(F.col("rows")).alias("v"), F.element_at("rows", 1).alias("r"), F.size("rows").alias("n"), F.aggregate(F.slice("rows", 2, F.size("rows")), F.element_at("rows", 1).cast("array<double>"), lambda s, r: F.zip_with(s, r.cast("array<double>"), lambda x, y: x + y)).alias("sum"))
    return pooled.select("label", F.round(V.norm(F.col("sum")) / F.col("n"), 6).alias("before"), F.round(F.col("v")[0], 6).alias("first"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round(e[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS first
        FROM (SELECT vec_id, embedding, embedding AS e FROM embeddings)""")
def vector_norms(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(V.l2_normalize(F.col("embedding"))[0], 6).alias("first"))


# ---- pages

#: Sources as documents, documents as their pages.
PAGED = "SELECT source AS doc_id, doc_id::INTEGER AS page_number, text FROM documents"


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), "text")
    p = p.withColumn("confidence", F.lit(0.98)).withColumn("engine", F.lit("text_layer")).withColumn("indic_ratio", X.indic_ratio("text"))
    return p.withColumn("blocks", F.lit(None).cast(PAGES["blocks"].dataType))


_LINE = "CASE WHEN regexp_matches(x, '^(?:[-•*]|\\p{Nd}+[.)]|[(][a-zA-Z০-৯][)]|\\([ivx]+\\))" + _W + "+') THEN 'list' WHEN regexp_matches(x, '^[^\\n]*\\?" + _W + "*$') THEN 'qa' ELSE 'paragraph' END"
_NORMAL_LINE = f"regexp_replace(lower({_strip('x')}), '{_W}+', ' ', 'g')"
_REPEATED = f"""l AS (SELECT DISTINCT doc_id, page_number, {_NORMAL_LINE} AS line FROM (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS x FROM p)),
        n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY doc_id HAVING count(*) >= 3),
        r AS (SELECT l.doc_id, line FROM l JOIN n USING (doc_id) WHERE length(line) BETWEEN 3 AND 120 GROUP BY l.doc_id, line, pages HAVING count(*) >= greatest(2, floor(pages * 0.4)))"""
_IS_PAGE = f"(regexp_matches({_strip('x')}, '(?i)^(?:পৃষ্ঠা|পৃ\\.|Page|P\\.?){_W}*\\p{{Nd}}+(?:{_W}|[./-])*$') OR regexp_matches({_strip('x')}, '^(?:[\\p{{Nd}}./-]|{_W}){{1,12}}$'))"


#: Each text between a head and a foot: the head is on every page of a source, the foot is a page number.
FRAMED = "SELECT source AS doc_id, doc_id::INTEGER AS page_number, concat('Report of ', source, chr(10), text, chr(10), 'Page ', CAST(doc_id AS VARCHAR(20))) AS text FROM documents"


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    text = F.concat(F.lit("Report of "), "source", F.lit("\n"), "text", F.lit("\nPage "), F.col("doc_id").cast("string"))
    p = d.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), text.alias("text"))
    return p.withColumn("confidence", F.lit(0.98)).withColumn("engine", F.lit("text_layer")).withColumn("indic_ratio", F.lit(0.0)).withColumn("blocks", F.lit(None).cast(PAGES["blocks"].dataType))


@query(f"WITH p AS ({FRAMED}), {_REPEATED} SELECT doc_id, line FROM r")
def repeated_lines(spark, sf_dir):
    return headers.repeated_lines(framed(spark, sf_dir))


@query(f"""WITH p AS ({FRAMED}), {_REPEATED}, x AS (SELECT doc_id, page_number, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM p),
        k AS (SELECT x.doc_id, page_number, string_agg(x, chr(10) ORDER BY i) AS text FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND r.line = {_NORMAL_LINE} WHERE r.line IS NULL AND NOT {_IS_PAGE} GROUP BY x.doc_id, page_number)
        SELECT p.doc_id, p.page_number, {_strip("coalesce(k.text, '')")} AS text FROM p LEFT JOIN k USING (doc_id, page_number)""")
def strip_headers(spark, sf_dir):
    return headers.strip_headers(framed(spark, sf_dir)).select("doc_id", "page_number", "text")


@query(f"""WITH p AS ({PAGED}), l AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda y: {_strip('y')}), lambda z: z <> '') AS ls FROM p),
        u AS (SELECT doc_id, page_number, unnest(range(len(ls)))::INTEGER AS block_ord, unnest(ls) AS x FROM l)
        SELECT doc_id, page_number, block_ord, {_LINE} AS block_type, x AS text FROM u""")
def line_blocks(spark, sf_dir):
    return blocks.explode_blocks(blocks.classify_blocks(paged(spark, sf_dir))).select("doc_id", "page_number", "block_ord", "block_type", "text")


@query(f"""WITH p AS ({PAGED}), s AS (SELECT doc_id, {_strip('text')} AS s, text FROM p)
        SELECT doc_id, CASE WHEN sum((length(s) >= 20)::INT) = 0 THEN 'scanned_pdf' WHEN sum((length(s) >= 20)::INT) < count(*) THEN 'mixed' ELSE 'digital_pdf' END AS document_type,
               false AS has_bookmarks, false AS has_tables, round(coalesce(avg(CASE WHEN s <> '' THEN {_indic('text')} END), 0), 9) AS avg_indic_ratio, count(*) AS page_count FROM s GROUP BY doc_id""")
def doc_profile(spark, sf_dir):
    return pages.profile(paged(spark, sf_dir)).withColumn("avg_indic_ratio", F.round("avg_indic_ratio", 9))


@query(f"""WITH p AS ({PAGED}), c AS (SELECT doc_id, sum({_n('text', '[A-Za-z]')})::DOUBLE / sum({_solid('text')}) AS a, sum({_n('text', r"[\x{980}-\x{9ff}]")})::DOUBLE / sum({_solid('text')}) AS i FROM p GROUP BY doc_id)
        SELECT doc_id, CASE WHEN i >= 0.15 AND a >= 0.15 THEN 'mixed' WHEN i >= 0.15 THEN 'as' WHEN a >= 0.15 THEN 'en' ELSE 'as' END AS language FROM c""")
def doc_language(spark, sf_dir):
    return pages.document_language(paged(spark, sf_dir))


_GATE = f"length({_strip('t')}) >= 20 AND (({_indic(_strip('t'))}) >= 0.2 OR ({_latin(_strip('t'))}) >= 0.2)"


def _ocr_pick(t: str, other: str) -> str:
    x = _strip(t)
    return f"CASE WHEN length({x}) < 20 THEN {other} WHEN ({_latin(x)}) >= 0.2 AND ({_latin(x)}) >= ({_indic(x)}) THEN 'en' WHEN ({_indic(x)}) >= 0.15 THEN 'devanagari' ELSE {other} END"


@query(f"""{_T}, c AS (SELECT doc_id, variant, t, concat(source, ' ', lang, ' ', source, ' ', lang, ' page') AS hint, (doc_id % 10) / 10.0::DOUBLE AS conf FROM v)
        SELECT doc_id, variant, {_GATE} AS text_layer, conf < 0.6 OR (length({_strip('t')}) > 40 AND ({_indic('t')}) < 0.15 AND ({_latin('t')}) < 0.15) AS fallback,
               {_ocr_pick('t', "'devanagari'")} AS by_text, {_ocr_pick("''", _ocr_pick('hint', "'devanagari'"))} AS by_hint FROM c""")
def ocr_gates(spark, sf_dir):
    v = varied(spark, sf_dir).withColumn("conf", F.col("doc_id") % 10 / 10.0).withColumn("hint", F.concat_ws(" ", "source", "lang", "source", "lang", F.lit("page")))
    by_text, by_hint = pages.ocr_language(F.col("t"), F.lit(None).cast("string")), pages.ocr_language(F.lit(""), F.col("hint"))
    return v.select("doc_id", "variant", pages.use_text_layer("t").alias("text_layer"), pages.needs_fallback(F.col("conf"), F.col("t")).alias("fallback"), by_text.alias("by_text"), by_hint.alias("by_hint"))


@query("""SELECT o_custkey AS doc_id, string_agg('| ' || o_orderkey::VARCHAR || ' | ' || o_orderstatus || ' | ' || replace(o_orderpriority, chr(10), ' ') || ' |', chr(10) ORDER BY o_orderkey) AS markdown FROM orders GROUP BY o_custkey""")
def table_markdown(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus").cast("string"), F.col("o_orderpriority").cast("string"))
    by = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("r")))).alias("rows"))
    return by.select(F.col("o_custkey").alias("doc_id"), pages.table_markdown(F.transform("rows", lambda x: x["r"])).alias("markdown"))


_OCR = "SELECT source AS doc_id, (doc_id + 1)::INTEGER AS page_number, CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END AS text FROM documents"


@query(f"""WITH p AS ({PAGED}), o AS ({_OCR}), j AS (SELECT coalesce(p.doc_id, o.doc_id) AS doc_id, coalesce(p.page_number, o.page_number) AS page_number, p.text AS t, o.text AS u FROM p FULL JOIN o ON p.doc_id = o.doc_id AND p.page_number = o.page_number),
        c AS (SELECT *, CASE WHEN t IS NULL THEN {_strip("coalesce(u, '')")} <> '' ELSE {_strip("coalesce(u, '')")} <> '' AND ((({_indic('t')}) < 0.15 AND ({_latin('t')}) < 0.15) OR length({_strip('t')}) < 20) END AS use_ocr FROM j)
        SELECT doc_id, page_number, CASE WHEN use_ocr THEN 'ocr' ELSE 'text_layer' END AS engine, {_lines('(CASE WHEN use_ocr THEN u ELSE t END)')} AS text FROM c WHERE t IS NOT NULL OR use_ocr""")
def page_merge(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    ocr = d.select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).cast("int").alias("page_number"), F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.col("text")).alias("text"), F.lit(0.7).alias("confidence"))
    return pages.merge_parsed_with_ocr(paged(spark, sf_dir), ocr).select("doc_id", "page_number", "engine", "text")


# ---- sections and chunks

_BLOCKS = f"""p AS ({PAGED}), l AS (SELECT doc_id, page_number, list_filter(list_transform(string_split(text, chr(10)), lambda y: {_strip('y')}), lambda z: z <> '') AS ls FROM p),
        u AS (SELECT doc_id, page_number, unnest(range(len(ls))) AS ord, unnest(ls) AS x FROM l),
        h AS (SELECT *, length(x) <= 120 AND NOT regexp_matches(x, '[।.?!:;]$') AND len({_words('x')}) <= 15 AND regexp_matches(x, '^[^\\n]{{1,101}}$') AS heading FROM u),
        s AS (SELECT *, (sum(heading::INT) OVER w - first_value(heading::INT) OVER w)::INTEGER AS section_no FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, ord ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH {_BLOCKS} SELECT doc_id, section_no, max(CASE WHEN heading THEN x END) AS section_title, coalesce(string_agg(x, chr(10) ORDER BY page_number, ord) FILTER (NOT heading), '') AS text,
        min(page_number)::INTEGER AS page_start, max(page_number)::INTEGER AS page_end, count(*)::INTEGER AS n_blocks FROM s GROUP BY doc_id, section_no""")
def detect_sections(spark, sf_dir):
    s = sections.detect_sections(blocks.classify_blocks(paged(spark, sf_dir)))
    return s.select("doc_id", "section_no", "section_title", "text", "page_start", "page_end", F.size("blocks").alias("n_blocks"))


@query("""WITH RECURSIVE t AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey::VARCHAR AS title, (1 + o_orderkey % 4)::INTEGER AS level FROM orders),
        f AS (SELECT doc_id, n, [title] AS path FROM t WHERE n = 1 UNION ALL SELECT t.doc_id, t.n, list_append(f.path[1:least(len(f.path), t.level - 1)], t.title) FROM f JOIN t ON t.doc_id = f.doc_id AND t.n = f.n + 1)
        SELECT doc_id, array_to_string(path, '/') AS path FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS last FROM f) WHERE n = last""")
def heading_path(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("title"), (1 + F.col("o_orderkey") % 4).cast("int").alias("level")).alias("h"))
    by = o.groupBy("doc_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    path = sections.heading_path(F.transform("hs", lambda h: F.struct(h["title"].alias("title"), h["level"].alias("level"))))
    return by.select("doc_id", F.array_join(path, "/").alias("path"))


def _sectioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.detect_sections(blocks.classify_blocks(paged(spark, sf_dir)))


@query()
def chunk_drafts(spark, sf_dir):
    return chunks.draft_chunks(_sectioned(spark, sf_dir)).drop("heading_path")


@query()
def chunks_full(spark, sf_dir):
    return ingest(paged(spark, sf_dir)).chunks.withColumn("heading_path", F.array_join("heading_path", "/"))


@query()
def ingest_status(spark, sf_dir):
    return ingest(paged(spark, sf_dir)).statuses


_CHUNKS = "c AS (SELECT source AS doc_id, doc_id AS n, text FROM documents)"


@query(f"WITH {_CHUNKS} SELECT doc_id, min(n) AS n, sha256(text) AS text_hash FROM c GROUP BY doc_id, text")
def exact_dedup(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("n"), X.content_hash("text").alias("text_hash"))
    return chunks.exact_dedup(c, ["n"]).select("doc_id", "n", "text_hash")


@query(f"{_T} SELECT doc_id, variant FROM v WHERE length({_strip('t')}) >= 10 AND ({_quality('t')}) >= 0.45 AND ({_tokens('t')}) <= 512")
def noise_filter(spark, sf_dir):
    c = varied(spark, sf_dir).select("doc_id", "variant", F.col("t").alias("text"), X.quality_score("t").alias("quality_score"), X.token_count("t").alias("token_count"))
    return chunks.noise_filter(c).select("doc_id", "variant")


@query("SELECT source AS doc_id, doc_id AS chunk_id, lag(doc_id) OVER w AS prev_chunk_id, lead(doc_id) OVER w AS next_chunk_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def neighbour_links(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"))
    return chunks.neighbour_links(c, index="chunk_id")


@query("""WITH l AS (SELECT doc_id AS chunk_id, text, lag(text) OVER w AS p, lead(text) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
        SELECT chunk_id, concat_ws(chr(10), p, text, n) AS expanded_text FROM l""")
def neighbour_expand(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "text")
    return context.expand_neighbours(chunks.neighbour_links(c, index="chunk_id"), c).select("chunk_id", "expanded_text")


# ---- retrieval: benchmark items ask, documents answer

_DENSE = "d AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings c ON true {})"
_RANKED = "SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {}) WHERE rank <= 20"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").alias("user_id"), F.col("vec_id").alias("document_id"))


def _dense(spark: SparkSession, sf_dir: str, own: bool) -> DataFrame:
    """Every vector asks; scores are rounded before ranks are given, as in the SQL."""
    c = _vectors(spark, sf_dir)
    q = c.select(F.col("chunk_id").alias("query_id"), "vector", *(["user_id"] if own else []))
    c = c if own else c.drop("user_id")
    return dense.dense_search(q, c, 20, digits=6)


@query(f"WITH {_DENSE.format('')} {_RANKED.format('d')}")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, False).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_DENSE.format('AND q.label = c.label')} {_RANKED.format('d')}")
def dense_topk_filtered(spark, sf_dir):
    return _dense(spark, sf_dir, True).select("query_id", "chunk_id", "score", "rank")


_BM25 = """w AS (SELECT doc_id AS chunk_id, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
        len AS (SELECT doc_id AS chunk_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS length FROM documents),
        post AS (SELECT term, chunk_id, any_value(source) AS source, count(*) AS tf FROM w GROUP BY term, chunk_id), df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
        st AS (SELECT count(*) AS n, avg(length) AS average FROM len),
        q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY item_id, term),
        b AS (SELECT query_id, post.chunk_id, any_value(post.source) AS source, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score
              FROM q JOIN df USING (term) JOIN post USING (term) JOIN len USING (chunk_id), st GROUP BY query_id, post.chunk_id)"""


def _index(spark: SparkSession, sf_dir: str) -> bm25.LexicalIndex:
    d = read(spark, sf_dir, "documents")
    return bm25.build_index(d.select(F.col("doc_id").alias("chunk_id"), "text"), bm25.ASCII_WORDS)


def _bm25(spark: SparkSession, sf_dir: str, own: bool = False) -> DataFrame:
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    c = None
    if own:
        q = q.withColumn("user_id", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
        c = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("user_id"))
    return bm25.bm25_search(q, _index(spark, sf_dir), c, 20, digits=6)


@query(f"WITH {_BM25} {_RANKED.format('b')}")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_BM25}, o AS (SELECT * FROM b WHERE source = 'src' || (query_id % 20)::VARCHAR) {_RANKED.format('o')}")
def bm25_filtered(spark, sf_dir):
    return _bm25(spark, sf_dir, True).select("query_id", "chunk_id", "score", "rank")


_FOLDED = _BM25.replace("'[a-z0-9]+'", r"'[\p{L}\p{N}\p{M}_]+'").replace("lower(text)", "strip_accents(replace(lower(text), 'ß', 'ss'))")


@query(f"WITH {_FOLDED} {_RANKED.format('b')}")
def bm25_folded(spark, sf_dir):
    """The default analyzer: words of any script, folded."""
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = bm25.build_index(d.select(F.col("doc_id").alias("chunk_id"), "text"))
    return bm25.bm25_search(q, index, None, 20, digits=6).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_DENSE.format('AND c.vec_id BETWEEN q.vec_id - 20 AND q.vec_id + 20')} {_RANKED.format('d')}")
def dense_topk_documents(spark, sf_dir):
    """Every vector asks among the documents that it names."""
    c = _vectors(spark, sf_dir).drop("user_id")
    q = c.select(F.col("chunk_id").alias("query_id"), "vector", F.sequence(F.col("chunk_id") - 20, F.col("chunk_id") + 20).alias("document_ids"))
    return dense.dense_search(q, c, 20, digits=6).select("query_id", "chunk_id", "score", "rank")


#: Vectors that stand for items: that of the same number among the embeddings.
_HYBRID = f"""{_BM25}, lx AS ({_RANKED.format('b')}),
        dn AS (SELECT query_id, chunk_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM
               (SELECT item_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score FROM benchmark JOIN embeddings e ON e.vec_id = item_id, embeddings c)) WHERE rank <= 20),
        al AS (SELECT query_id, chunk_id, 0 AS l, rank FROM dn UNION ALL SELECT query_id, chunk_id, 1, rank FROM lx),
        fu AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(l * 1000 + rank) AS f FROM al GROUP BY query_id, chunk_id),
        rf AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f, chunk_id)::INTEGER AS rank FROM fu)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = read(spark, sf_dir, "benchmark").join(e, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ranking.rrf([dense.dense_search(q, _vectors(spark, sf_dir).drop("user_id"), 20, digits=6), _bm25(spark, sf_dir)])


@query(f"WITH {_HYBRID} SELECT query_id, chunk_id, score, rank FROM rf WHERE rank <= 20")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text")
    q = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _fused(spark, sf_dir).join(d, "chunk_id").join(q, "query_id")


_RERANK = f"""{_HYBRID}, ca AS (SELECT rf.query_id, rf.chunk_id, rf.rank, d.source, d.text, list_distinct({_words('lower(d.text)')}) AS x, list_distinct({_words('lower(i.text)')}) AS y
              FROM rf JOIN documents d ON d.doc_id = rf.chunk_id JOIN benchmark i ON i.item_id = rf.query_id WHERE rank <= 20),
        sc AS (SELECT *, len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) AS rerank_score FROM ca),
        rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id)::INTEGER AS rerank_rank FROM sc)"""


@query(f"WITH {_RERANK} SELECT query_id, chunk_id, rerank_score, rerank_rank FROM rr WHERE rerank_rank <= 5")
def rerank_topk(spark, sf_dir):
    return ranking.rerank(_candidates(spark, sf_dir)).select("query_id", "chunk_id", "rerank_score", "rerank_rank")


_MMR = f"""{_RERANK}, mx AS (SELECT query_id, max(1.0::DOUBLE * score) AS top FROM rf WHERE rank <= 20 GROUP BY query_id),
        cs AS (SELECT ca.query_id, ca.chunk_id, ca.rank, ca.x, rf.score / top AS rel FROM ca JOIN rf USING (query_id, chunk_id) JOIN mx ON mx.query_id = ca.query_id),
        js AS (SELECT a.query_id, a.chunk_id AS a, b.chunk_id AS b, CASE WHEN len(a.x) = 0 OR len(b.x) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.x, b.x))::DOUBLE / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) END AS j FROM cs a JOIN cs b USING (query_id)),
        ch AS (SELECT query_id, 1 AS n, [arg_min(chunk_id, rank)] AS sel FROM cs GROUP BY query_id
               UNION ALL
               SELECT query_id, n + 1, list_append(sel, chunk_id) FROM
                 (SELECT ch.query_id, ch.n, ch.sel, cs.chunk_id, row_number() OVER (PARTITION BY ch.query_id ORDER BY round(0.7::DOUBLE * cs.rel - 0.3::DOUBLE * (SELECT max(js.j) FROM js WHERE js.query_id = ch.query_id AND js.a = cs.chunk_id AND list_contains(ch.sel, js.b)), 7) DESC, cs.rank) AS place
                  FROM ch JOIN cs ON cs.query_id = ch.query_id AND NOT list_contains(ch.sel, cs.chunk_id) WHERE ch.n < 5) WHERE place = 1)"""


@query(f"WITH RECURSIVE {_MMR} SELECT query_id, sel[n] AS chunk_id, n AS mmr_rank FROM ch")
def mmr_select(spark, sf_dir):
    return ranking.mmr(_candidates(spark, sf_dir), top_k=5).select("query_id", "chunk_id", "mmr_rank")


@query(f"""WITH {_HYBRID} SELECT rf.query_id, rf.rank, rf.chunk_id, rf.score, substr(d.text, 1, 180) AS preview FROM rf JOIN documents d ON d.doc_id = rf.chunk_id WHERE rank <= 20""")
def hybrid_search(spark, sf_dir):
    return _candidates(spark, sf_dir).select("query_id", "rank", "chunk_id", F.round("score", 9).alias("score"), X.preview("text").alias("preview"))


#: The chunks of a query are the documents of a source; pages are tens of ids.
_CONTEXT = f"""k AS (SELECT source AS query_id, doc_id AS chunk_id, (doc_id // 10)::INTEGER AS page, doc_id::INTEGER AS idx, (doc_id // 100)::VARCHAR AS section_id, {_strip('text')} AS t FROM documents WHERE {_strip('text')} <> ''),
        o AS (SELECT *, len({_words('t')}) AS tok, row_number() OVER (PARTITION BY query_id, t ORDER BY page, idx, section_id, chunk_id) AS nth FROM k),
        r AS (SELECT *, sum(tok) OVER (PARTITION BY query_id ORDER BY page, idx, section_id, chunk_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM o WHERE nth = 1),
        g AS (SELECT *, CASE WHEN lag(section_id) OVER w = section_id AND lag(idx) OVER w + 1 = idx THEN 0 ELSE 1 END AS fresh FROM r WHERE total <= 3000 WINDOW w AS (PARTITION BY query_id ORDER BY page, idx, section_id, chunk_id)),
        i AS (SELECT *, sum(fresh) OVER (PARTITION BY query_id ORDER BY page, idx, section_id, chunk_id ROWS UNBOUNDED PRECEDING) AS island FROM g),
        n AS (SELECT *, (row_number() OVER (PARTITION BY query_id, island ORDER BY page, idx, section_id, chunk_id) - 1) // 2 AS pair FROM i),
        cx AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY island, pair)::INTEGER AS context_rank, min(chunk_id) AS chunk_id, string_agg(t, chr(10) ORDER BY page, idx, section_id, chunk_id) AS expanded_text, count(*) AS n_chunks, max(total) AS token_total, min(page) AS page
               FROM n GROUP BY query_id, island, pair)"""


def _contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    page = F.floor(F.col("doc_id") / 10).cast("int")
    c = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit("d").alias("document_id"), F.floor(F.col("doc_id") / 100).cast("string").alias("section_id"), F.lit(None).cast("string").alias("section_title"), page.alias("page_start"), page.alias("page_number"), F.col("doc_id").cast("int").alias("chunk_index"), "text", F.lit(None).cast("int").alias("token_count"))
    return context.build_context(c)


@query(f"WITH {_CONTEXT} SELECT query_id, context_rank, chunk_id, expanded_text, n_chunks, token_total FROM cx")
def build_context(spark, sf_dir):
    return _contexts(spark, sf_dir).select("query_id", "context_rank", "chunk_id", "expanded_text", "n_chunks", "token_total")


@query(f"WITH {_CONTEXT} SELECT query_id, string_agg('[S' || context_rank::VARCHAR || '] (p.' || page::VARCHAR || ')' || chr(10) || expanded_text, chr(10) || chr(10) ORDER BY context_rank) AS context FROM cx GROUP BY query_id")
def context_block(spark, sf_dir):
    return context.context_block(_contexts(spark, sf_dir))


def _turn(language: str) -> str:
    head, middle, tail = (x.replace("'", "''") for x in prompts.TURN[language])
    return f"'{head}' || lang || '{middle}' || t || '{tail}'"


@query(f"""{_T}, m AS (SELECT doc_id, variant, 0 AS place, 'system' AS role, '{prompts.SYSTEM_PROMPT.replace("'", "''")}' AS content FROM v
        UNION ALL SELECT doc_id, variant, 1, 'assistant', source FROM v
        UNION ALL SELECT doc_id, variant, 2, 'user', CASE WHEN ({_latin('t')}) > ({_indic('t')}) THEN {_turn('en')} ELSE {_turn('as')} END FROM v)
        SELECT doc_id, variant, place::INTEGER AS place, role, content FROM m""")
def prompt_messages(spark, sf_dir):
    past = F.array(F.struct(F.lit("assistant").alias("role"), F.col("source").alias("content")))
    rows = varied(spark, sf_dir).select("doc_id", "variant", F.posexplode(prompts.messages(F.col("t"), F.col("lang"), past)).alias("place", "m"))
    return rows.select("doc_id", "variant", "place", "m.role", "m.content")


# ---- evaluation: items look for documents of numbers made from theirs


@query(f"""WITH {_BM25}, r AS ({_RANKED.format('b')}), ca AS (SELECT item_id AS case_id, [item_id * 3, item_id * 5 + 1, item_id * 7 + 2] AS ex FROM benchmark), x AS (SELECT case_id, list_distinct(ex) AS ex FROM ca),
        m AS (SELECT case_id, len(ex) AS n, count(*) FILTER (r.rank <= 5) AS a, count(*) FILTER (r.rank <= 10) AS b, min(r.rank) AS f FROM x LEFT JOIN r ON r.query_id = x.case_id AND list_contains(ex, r.chunk_id) GROUP BY case_id, len(ex))
        SELECT round(avg(a / n), 9) AS recall_at_5, round(avg(b / n), 9) AS recall_at_10, round(avg(coalesce(1.0::DOUBLE / f, 0)), 9) AS mrr, round(avg((coalesce(f, 11) <= 10)::INT), 9) AS hit_rate, count(*) AS n_cases FROM m""")
def eval_metrics(spark, sf_dir):
    i = F.col("item_id")
    cases = read(spark, sf_dir, "benchmark").select(i.alias("case_id"), F.array(i * 3, i * 5 + 1, i * 7 + 2).cast("array<string>").alias("expected_chunk_ids"))
    hits = _bm25(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.col("chunk_id").cast("string").alias("chunk_id"), "rank")
    return evaluation.evaluate(cases, hits).select(*[F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_10", "mrr", "hit_rate")], "n_cases")


# ---- relational: orders are documents of their customers, conversations are conversations, events are logs


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    gone = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("display_name"), F.col("o_orderdate").cast("timestamp").alias("created_at"), gone.alias("deleted_at"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created, count(*) OVER () AS total FROM orders WHERE o_custkey = 1 AND o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def list_documents(spark, sf_dir):
    total, rows = relational.list_documents(_documents(spark, sf_dir), 1)
    return rows.select("id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.lit(total).cast("long").alias("total"))


@query("""WITH c AS (SELECT conv_id AS id, conv_id % 3 AS user_id, max(turn) AS last FROM conversations GROUP BY conv_id)
        SELECT id, last, count(*) OVER () AS total FROM c WHERE user_id = 1 ORDER BY last DESC, id LIMIT 20""")
def list_conversations(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("last_message_at"))
    c = c.select("id", (F.col("id") % 3).alias("user_id"), "last_message_at", F.lit(0).cast("long").alias("created_at"))
    total, rows = relational.list_conversations(c, 1)
    return rows.select("id", F.col("last_message_at").alias("last"), F.lit(total).cast("long").alias("total"))


@query("SELECT turn, role, text, count(*) OVER () AS total FROM conversations WHERE conv_id = 1 ORDER BY turn LIMIT 50")
def list_messages(spark, sf_dir):
    m = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("created_at"), "role", "text", F.col("turn").alias("id"))
    total, rows = relational.list_messages(m, 1)
    return rows.select(F.col("created_at").alias("turn"), "role", "text", F.lit(total).cast("long").alias("total"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS n FROM conversations)
        SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS position FROM r WHERE n <= 6""")
def last_turns(spark, sf_dir):
    return relational.last_turns(read(spark, sf_dir, "conversations"), 3, ["turn", "role", "text"], "conv_id").select("conv_id", "turn", "role", "position")


@query("SELECT l_orderkey AS document_id, l_linenumber, o_orderpriority AS display_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def doc_names(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    return relational.names_of(rows, _documents(spark, sf_dir))


@query("SELECT o_orderkey AS id, o_orderstatus = 'F' OR o_orderkey IN (1, 2, 3, 4, 5, 6, 7) AS deleted FROM orders")
def soft_delete(spark, sf_dir):
    d = relational.soft_delete(_documents(spark, sf_dir), [1, 2, 3, 4, 5, 6, 7], F.lit("2024-01-01").cast("timestamp"))
    return d.select("id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("SELECT doc_id, source, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE -quality END AS n_chars FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)")
def upsert(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    fresh = d.join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", (-F.col("quality")).cast("long").alias("n_chars"))
    return relational.upsert(d, fresh, "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_document(spark, sf_dir):
    gone = read(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return relational.delete_by_document(read(spark, sf_dir, "documents").select("doc_id", "source"), gone, "doc_id")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT user_id, event_type, event_id, value FROM r WHERE n = 1""")
def latest_stage_status(spark, sf_dir):
    return relational.latest_status(read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, shape, round(value, 6) AS score FROM events, (SELECT unnest(range(7))::INTEGER AS shape)")
def rerank_response(spark, sf_dir):
    """Each event's value as an answer of every shape that a reranker may give."""
    shapes = ('[{"score":%s}]', "[%s]", '[[{"score":%s}]]', "[[%s]]", '{"scores":[%s]}', '{"logits":[%s]}', '{"scores":[{"score":%s}]}')
    raw = F.array(*[F.struct(F.lit(i).alias("shape"), F.concat(F.lit(x.split("%s")[0]), F.col("value").cast("string"), F.lit(x.split("%s")[1])).alias("raw")) for i, x in enumerate(shapes)])
    e = read(spark, sf_dir, "events").select("event_id", F.explode(raw).alias("r"))
    return e.select("event_id", "r.shape", F.round(parsing.rerank_scores(F.col("r.raw"), 1)[0], 6).alias("score"))


@query("""SELECT event_id, nullif(trim(event_type), '') AS said, event_type AS delta FROM events""")
def chat_response(spark, sf_dir):
    """Answers and stream events that say an event's type."""
    said, quoted = F.concat(F.lit("  "), "event_type", F.lit(" ")), lambda c: F.to_json(F.struct(c.alias("content")))
    raw = F.concat(F.lit('{"choices":[{"message":'), quoted(said), F.lit("}]}"))
    line = F.concat(F.lit('data: {"choices":[{"delta":'), quoted(F.col("event_type")), F.lit("}]}"))
    return read(spark, sf_dir, "events").select("event_id", parsing.chat_answer(raw).alias("said"), parsing.stream_delta(line).alias("delta"))


@query("""WITH t AS (SELECT conv_id, max(turn) AS last, count(*) AS n FROM conversations GROUP BY conv_id)
        SELECT conv_id::VARCHAR AS id, (last + 5)::BIGINT AS last_message_at, (n + 2)::BIGINT AS messages FROM t""")
def persist_turn(spark, sf_dir):
    """One more turn of every conversation: its messages and the time of its last one."""
    c = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), F.concat_ws("-", "conv_id", "turn", "role").alias("id"), "role", F.col("text").alias("content_text"), F.timestamp_seconds("turn").alias("created_at"))
    conversations = c.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("last_message_at"))
    now = F.col("last_message_at") + F.expr("interval 5 seconds")
    turn = conversations.select(F.col("id").alias("conversation_id"), F.lit("u").alias("user_id"), F.concat("id", F.lit("-q")).alias("user_message_id"), F.concat("id", F.lit("-a")).alias("assistant_message_id"), F.lit("why?").alias("question"), F.lit("so").alias("answer"), F.lit("text").alias("input_type"), F.array(F.lit("x")).alias("retrieved_chunk_ids"), F.lit("m").alias("model_used"), F.lit(3).alias("latency_ms"), now.alias("created_at"))
    rows, touched = relational.persist_turn(c, conversations, turn)
    n = rows.groupBy("conversation_id").agg(F.count("*").alias("messages"))
    return touched.join(n, F.col("id") == F.col("conversation_id")).select("id", F.col("last_message_at").cast("long").alias("last_message_at"), "messages")
