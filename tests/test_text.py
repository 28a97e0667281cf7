"""Text rules on hand-made strings, and against plain Python on random ones."""

from __future__ import annotations

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexloom import queries as Q
from lexloom.functions import text as X
from lexloom.functions.register import register


def one(spark, text, *columns):
    return tuple(spark.createDataFrame([(text,)], "t string").select(*columns).first())


def test_ratios(spark):
    assert one(spark, "অসমীয়া ভাষা", X.indic_ratio("t"))[0] > 0.8
    assert one(spark, "An English paper on rivers.", X.latin_ratio("t"))[0] > 0.8
    assert one(spark, "  \n", X.indic_ratio("t"), X.latin_ratio("t"), X.garbage_ratio("t")) == (0.0, 0.0, 0.0)
    assert one(spark, None, X.indic_ratio("t"), X.quality_score("t"), X.token_count("t")) == (0.0, 0.0, 0)


@pytest.mark.parametrize(("text", "language", "query"), [("অসমীয়া প্ৰশ্ন", "as", "as"), ("Which river is longest?", "en", "en"), ("অসমীয়া text with some English words", "mixed", "en"), ("12345", "as", "as"), ("", "as", "as")])
def test_language(spark, text, language, query):
    assert one(spark, text, X.detect_language("t"), X.detect_query_language("t")) == (language, query)


def test_quality(spark):
    assert one(spark, "A clean English paragraph to embed.", X.quality_score("t"))[0] >= 0.45
    assert one(spark, "Łłʢˤ͋͌ mess", X.quality_score("t"))[0] < 0.45


def test_clean(spark):
    assert one(spark, "exam-\nple", X.clean_text("t"))[0] == "example"
    assert one(spark, "কা-\nখ", X.clean_text("t", lines=True))[0] == "কা-\nখ"
    assert one(spark, "Łabc ok", X.normalize("t"))[0] == "abc ok"
    assert one(spark, "প্ৰশ্ন?\nউত্তৰ", X.clean_text("t", lines=True))[0] == "প্ৰশ্ন?\nউত্তৰ"
    assert one(spark, "a\nb\n\n\n\nc  d\r\ne", X.clean_text("t"))[0] == "a b\n\nc d e"


@pytest.mark.parametrize(("text", "least", "expected"), [("অসমীয়া প্ৰশ্নোত্তৰ ডাটাছেট", 0.2, True), ("Quite enough English text to embed.", 0.45, True), ("x", 0.45, False), (None, 0.45, False)])
def test_embeddable(spark, text, least, expected):
    assert one(spark, text, X.is_embeddable("t", least))[0] is expected


@pytest.mark.parametrize(("line", "expected"), [("Page 12", True), ("পৃষ্ঠা ১২", True), ("- 3 -", True), ("123456789012", True), ("1234567890123", False), ("Chapter 1", False)])
def test_page_numbers(spark, line, expected):
    assert one(spark, line, X.is_page_number("t"))[0] is expected


@pytest.mark.parametrize(("line", "item", "question"), [("- a", True, False), ("1) b", True, False), ("(ক) c", False, False), ("(ix) d", True, False), ("Why?", False, True), ("Why?\nno", False, False), ("-a", False, False)])
def test_line_kinds(spark, line, item, question):
    assert one(spark, line, X.is_list_item("t"), X.is_question("t")) == (item, question)


def test_headings(spark):
    none = F.lit(None).cast("int")
    heading = lambda t, kind="paragraph": one(spark, t, X.is_heading("t", F.lit(kind), none))[0]
    assert heading("Rivers of the east")
    assert not heading("It ends here.")
    assert heading("It ends here.", "heading")
    assert not heading("x" * 121, "heading")
    assert not heading(" ".join("w" for _ in range(16)))


def test_sets_and_ids(spark):
    assert one(spark, "A a b", F.sort_array(X.token_set("t")))[0] == ["a", "b"]
    assert one(spark, "", X.jaccard(X.token_set("t"), X.token_set("t")))[0] == 0.0
    assert one(spark, "{12345678-1234-1234-1234-123456789ABC}", X.uuid_or_null("t"))[0] == "12345678-1234-1234-1234-123456789abc"
    assert one(spark, '["12345678123412341234123456789abc"]', X.document_id_list("t"))[0] == ["12345678-1234-1234-1234-123456789abc"]
    assert one(spark, '["x"]', X.document_id_list("t"))[0] is None
    assert one(spark, None, X.summary("t"))[0].asDict() == {"len": 0, "sha1": None, "preview": ""}


def test_sentences(spark):
    assert one(spark, "One. Two?  Three। চাৰি!", X.sentences("t"))[0] == ["One.", "Two?", "Three।", "চাৰি!"]


def test_agrees_with_sql(spark):
    """The same rules as SQL of another engine, on texts of characters that rules care about."""
    rng = random.Random(7)
    letters = "abcXYZ অআকখ12\t\n\r -\u00ad\u200b\u0301éŁł\u034b \u3000?.।-\x1c\x0b"
    texts = pd.DataFrame({"n": range(1500), "t": ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]})
    quality = Q._quality("c")
    sql = f"""WITH v AS (SELECT n, t, {Q._flat("t")} AS c FROM texts)
        SELECT n, c AS flat, {Q._lines("t")} AS lines, {Q._quality("t")} AS q, {Q._tokens("t")} AS tokens, length({Q._strip("t")}) >= 10 AND ({quality}) >= 0.45 AS e FROM v ORDER BY n"""
    expected = duckdb.sql(sql).fetchall()
    rows = spark.createDataFrame(texts).select("n", X.clean_text("t").alias("flat"), X.clean_text("t", lines=True).alias("lines"), X.quality_score("t").alias("q"), X.token_count("t").alias("tokens"), X.is_embeddable("t", 0.45).alias("e"))
    for r, (n, flat, lines, q, tokens, e) in zip(rows.orderBy("n").collect(), expected, strict=True):
        assert (r.n, r.flat, r.lines, r.tokens, r.e) == (n, flat, lines, tokens, e), texts.t[n]
        assert r.q == pytest.approx(q)


def test_sql_functions(spark):
    register(spark)
    text = "অসমীয়া text, with Łł and words"
    row = spark.createDataFrame([(text,)], "t string").selectExpr("lx_language(t)", "lx_token_count(t)", "lx_quality(t)", "lx_content_hash(t)").first()
    assert tuple(row) == one(spark, text, X.detect_language("t"), X.token_count("t"), X.quality_score("t"), X.content_hash("t"))
