"""Pages, sections and chunks: hand-computed cases, random ones against a plain model, and invariants of the plan."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from lexloom.config import EngineConfig
from lexloom.functions import text as X
from lexloom.operators import blocks, chunks, headers, ocr, pages, sections, simple, units
from lexloom.plans.ingest import index_rows, ingest
from lexloom.schema import PAGES
from lexloom.sources.connectors import HashingEmbedder
from lexloom.sources.files import IndexTable, delete_object, eval_cases, pdf_pages, put_object, raw_documents, text_pages
from lexloom.streaming.ingest import ingest_stream, stream_pages


def block(kind, text, page=1, level=None):
    return {"block_type": kind, "text": text, "page_start": page, "page_end": page, "confidence": 1.0, "heading_level": level, "font_size": None}


def make(spark, rows):
    """rows: (doc, page, text, blocks)"""
    return spark.createDataFrame([(d, p, t, 0.98, "text_layer", 0.0, b) for d, p, t, b in rows], PAGES).withColumn("indic_ratio", F.lit(0.0))


def test_repeated_lines(spark):
    p = make(spark, [("d", i, f"Head\nbody {i}" + ("\ntwice" if i < 3 else "") + ("\nonce" if i == 1 else ""), None) for i in range(1, 6)])
    assert {r.line for r in headers.repeated_lines(p).collect()} == {"head", "twice"}
    two = make(spark, [("d", i, "Head\nbody", None) for i in (1, 2)])
    assert headers.repeated_lines(two).count() == 0


def test_strip_headers_keeps_blocks(spark):
    p = make(spark, [("d", i, f"Head\nbody {i}\nPage {i}", [block("paragraph", "Head", i)]) for i in range(1, 4)])
    rows = headers.strip_headers(p).orderBy("page_number").collect()
    assert [r.text for r in rows] == ["body 1", "body 2", "body 3"]
    assert all(r.blocks[0].text == "Head" for r in rows)
    assert all(not r.blocks for r in headers.strip_headers(p, strip_blocks=True).collect())


def test_heading_path_is_by_place(spark):
    hs = [("h3", 3), ("h2", 2), ("h1", 1)]
    p = make(spark, [("d", 1, "", [b for t, n in hs for b in (block("heading", t, level=n), block("paragraph", "Some text ends here."))])])
    got = [tuple(r.heading_path) for r in sections.detect_sections(p).orderBy("section_no").collect()]
    assert got == [("h3",), ("h3", "h2"), ("h1",)]
    mended = [tuple(r.heading_path) for r in sections.detect_sections(p, strict=False).orderBy("section_no").collect()]
    assert mended == [("h3",), ("h2",), ("h1",)]


@pytest.mark.parametrize("depth", [3, 20])
def test_heading_paths_of_any_depth(spark, depth):
    """Paths followed by place are those that a fold over all titles gives, some of them deeper than the columns."""
    rng = random.Random(depth)
    rows, expected = [], {}
    for d in range(6):
        path = []
        for n in range(40):
            level = rng.choice([None, 0, *range(1, depth + 1)])
            rows.append((d, n, f"t{n}" if n else None, level))
            path = [*path[: max((level or 1) - 1, 0)], f"t{n}"] if n else []
            expected[d, n] = path
    df = spark.createDataFrame(rows, "doc_id int, section_no int, title string, level int")
    assert {(r.doc_id, r.section_no): r.heading_path for r in sections.with_paths(df).collect()} == expected


def test_many_headings(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("section_no"), F.concat(F.lit("t"), "id").alias("title"), (1 + F.col("id") % 5).cast("int").alias("level"))
    last = sections.with_paths(rows).orderBy(F.desc("section_no")).first()
    assert last.heading_path == [f"t{i}" for i in range(n - 5, n)]


def test_sections(spark):
    p = make(spark, [("d", 1, "", [block("paragraph", "Before all, a line."), block("heading", "Title"), block("paragraph", "First text."), block("table", "| a |.")]), ("d", 2, "", [block("paragraph", "More text.", 2)]), ("e", 3, " ", None)])
    rows = {(r.doc_id, r.section_no): r for r in sections.detect_sections(p).collect()}
    assert rows["d", 0].section_title is None and rows["d", 0].text == "Before all, a line."
    one = rows["d", 1]
    assert (one.section_title, one.text, one.page_start, one.page_end) == ("Title", "First text.\n\n| a |.\nMore text.", 1, 2)
    assert rows["e", 0].page_start == 3 and not rows["e", 0].blocks


def units_of(spark, title, text, parts, strict=True):
    from lexloom.schema import SECTIONS

    row = ("d", 0, "s", title, [], text, 1, 1, [block(k, t) for k, t in parts])
    rows = units.section_units(spark.createDataFrame([row], SECTIONS), strict).orderBy("unit_no").collect()
    return [(r.kind, r.text) for r in rows]


def test_units(spark):
    two = [("list", "a"), ("paragraph", "b")]
    assert units_of(spark, None, "", two) == [("list", "a\nb")]
    assert units_of(spark, None, "", two, strict=False) == [("list", "a"), ("paragraph", "b")]
    assert units_of(spark, None, "", [("heading", "h")]) == []
    assert units_of(spark, "T", "One. Two.\n\n- item", []) == [("paragraph", "T\nOne."), ("paragraph", "Two."), ("list", "- item")]
    mixed = [("paragraph", "a"), ("heading", "h"), ("paragraph", "b"), ("list", "1"), ("paragraph", "c"), ("table", "t"), ("paragraph", "d"), ("qa", "q"), ("paragraph", "e"), ("list", "2"), ("list", "3")]
    assert units_of(spark, None, "", mixed) == [("paragraph", "a\nb"), ("list", "1\nc"), ("table", "t"), ("list", "d"), ("qa", "q"), ("paragraph", "e"), ("list", "2\n3")]
    assert units_of(spark, None, "", mixed, strict=False) == [("paragraph", "a\nb"), ("list", "1"), ("paragraph", "c"), ("table", "t"), ("paragraph", "d"), ("qa", "q"), ("paragraph", "e"), ("list", "2\n3")]
    assert units_of(spark, None, "q1?\nq2?\na2\nq3？\na3？\nb", []) == [("qa", "q1?"), ("qa", "q2?\na2"), ("qa", "q3？\na3？"), ("paragraph", "b")]


def packed(spark, parts, config=EngineConfig()):
    rows = spark.createDataFrame([("d", 0, i, 0, k, t) for i, (k, t) in enumerate(parts)], "doc_id string, section_no int, unit_no int, piece_no int, kind string, text string")
    made = chunks.pack_units(rows.withColumn("size", X.token_count("text")).withColumn("of", F.struct(F.lit(1).alias("x"))), config).withColumn("n", X.token_count("text"))
    return [(r.block_type, r.text, r.n) for r in made.orderBy("draft_no").collect()]


def test_packing(spark):
    text = lambda n, c="a": c * (4 * n)  # noqa: E731  Latin letters: four to a token
    two = [("paragraph", text(300)), ("paragraph", text(300, "b"))]
    assert [n for _, _, n in packed(spark, two)] == [300, 600]
    assert [n for _, _, n in packed(spark, two, EngineConfig(strict=False))] == [300, 300]
    assert packed(spark, [("qa", "q"), ("paragraph", "p")]) == [("qa", "q\n\np", 1)]
    carried = packed(spark, [("paragraph", text(350)), ("list", text(40, "b")), ("paragraph", text(100, "c"))])
    assert [(k, n) for k, _, n in carried] == [("paragraph", 390), ("list", 140)]
    alone = packed(spark, [("paragraph", text(10)), ("paragraph", text(512, "b")), ("paragraph", text(20, "c"))])
    assert [n for _, _, n in alone] == [10, 512, 20]


@pytest.mark.parametrize("strict", [True, False])
def test_ranges_tell_what_the_rules_say(spark, strict):
    """Each chunk is maximal, begins where the last ended but for a tail that fits, and large units stand alone."""
    rng = random.Random(7)
    cases = [[rng.choice((1, 5, 30, 60, 120, 399, 400, 511, 512, 700)) for _ in range(rng.randint(0, 40))] for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, sizes array<int>")
    for r in rows.withColumn("got", units.pack_ranges(F.col("sizes"), 512, 400, 50, 512, strict)).collect():
        sizes, at = r.sizes, 0
        for first, own, end in r.got:
            assert own == at and first <= own < end
            at = end
            if sizes[own] >= 512:
                assert (first, end) == (own, own + 1)
                continue
            assert all(x < 512 for x in sizes[first:end])
            total = lambda i, j: sum(sizes[i:j])  # noqa: B023, E731
            assert end == own + 1 or total(first, end) <= 400
            assert end == len(sizes) or sizes[end] >= 512 or total(first, end) + sizes[end] > 400
            if own and sizes[own - 1] < 512:  # the chunk before was closed by this one's first unit
                begin = next(f for f, _, e in r.got if e == own)
                tail = max((n for n in range(own - begin + 1) if total(own - n, own) <= 50), default=0)
                expected = max(tail, 1) if strict else 0 if total(own - tail, own) + sizes[own] > 512 else tail
                assert own - first == expected
            else:
                assert first == own
        assert at == len(sizes)


@pytest.mark.parametrize("seed", range(2))
def test_split_long_by_sums(spark, seed):
    """Pieces hold all words in order; each but the last reaches the most tokens, and would not without its last word."""
    rng = random.Random(seed)
    texts = [" ".join("".join(rng.choice("abঅকZ1") for _ in range(rng.randint(1, 9))) for _ in range(n)) for n in (1, 10, 400, 1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.token_count("t").alias("n"), units.split_long(F.col("t"), 64).alias("p"))
    for r in rows.select("t", "n", "p", F.transform("p", X.token_count).alias("sizes"), F.transform("p", lambda p: X.token_count(F.regexp_replace(p, " ?[^ ]+$", ""))).alias("less")).collect():
        assert " ".join(r.p) == r.t and (len(r.p) > 1 or r.n <= 64 or r.sizes[0] >= 64)
        assert all(n >= 64 for n in r.sizes[:-1]) and all(n < 64 for n in r.less)


def drafts(spark, rows):
    schema = "doc_id string, section_no int, draft_no int, text string, token_count int, quality_score double, page_end int, text_hash string"
    return spark.createDataFrame([("d", s, n, t, k, q, 1, "") for s, n, t, k, q in rows], schema)


def test_dedup_merge_noise(spark):
    d = drafts(spark, [(0, 0, "same words here", 100, 0.9), (0, 1, "same words here", 100, 0.9), (0, 2, "others", 100, 0.9)]).withColumn("text_hash", F.sha2("text", 256))
    assert [r.draft_no for r in chunks.exact_dedup(d, ["section_no", "draft_no"]).orderBy("draft_no").collect()] == [0, 2]
    m = drafts(spark, [(0, 0, "large", 200, 0.9), (0, 1, "tiny", 10, 0.8), (0, 2, "tiny too", 10, 0.9), (1, 3, "next", 10, 0.9)])
    got = {(r.section_no, r.text, r.token_count, r.quality_score) for r in chunks.merge_tiny(m).collect()}
    assert got == {(0, "large\n\ntiny\n\ntiny too", 220, 0.8), (1, "next", 10, 0.9)}
    n = drafts(spark, [(0, 0, "অসমীয়া পাঠ এটা", 100, 0.9), (0, 1, "Łł", 5, 0.1), (0, 2, "long enough words", 600, 0.9)])
    assert [r.draft_no for r in chunks.noise_filter(n).collect()] == [0]


def test_profiles(spark):
    long = "A text of more than twenty characters."
    p = make(spark, [("all", 1, long, None), ("some", 1, long, None), ("some", 2, "x", None), ("none", 1, "x", None)])
    tables = spark.createDataFrame([("all", 1, 0, "| a | b |")], "doc_id string, page_number int, table_ord int, text string")
    got = {r.doc_id: r.document_type for r in pages.profile(p, tables, documents=spark.createDataFrame([("all",), ("some",), ("none",), ("empty",)], "doc_id string")).collect()}
    assert got == {"all": "table_heavy", "some": "mixed", "none": "scanned_pdf", "empty": "scanned_pdf"}
    merged = pages.merge_tables(p, tables).filter("doc_id = 'all'").first()
    assert merged.text == long + "\n\n| a | b |" and merged.blocks[-1].block_type == "table"


def test_page_merge(spark):
    p = make(spark, [("d", 1, "short", None), ("d", 2, "short", None)])
    ocr = spark.createDataFrame([("d", 1, "Read by a machine", 0.7), ("d", 2, "  ", 0.7), ("d", 3, "Only read", 0.7), ("d", 4, "", 0.7)], "doc_id string, page_number int, text string, confidence double")
    got = [(r.page_number, r.text, r.engine) for r in pages.merge_parsed_with_ocr(p, ocr).orderBy("page_number").collect()]
    assert got == [(1, "Read by a machine", "ocr"), (2, "short", "text_layer"), (3, "Only read", "ocr")]


def test_fallback_choice(spark):
    df = spark.createDataFrame([("??", 0.5, "words", 0.1), ("words", 0.5, "words", 0.5), ("words", 0.5, "??", 0.1)], "a string, x double, b string, y double")
    assert [r[0] for r in df.select(pages.prefer_fallback(F.col("a"), F.col("x"), F.col("b"), F.col("y"))).collect()] == [True, True, False]


def _corpus(spark):
    rng = random.Random(3)
    rows = []
    for d in range(4):
        for p in range(1, 5):
            lines = ["A head line of the report"]
            for _ in range(12):
                words = [rng.choice("river stone field house water light small great green".split()) for _ in range(rng.randint(3, 60))]
                lines.append(" ".join(words).capitalize() + rng.choice([".", "", "?"]))
            rows.append((f"d{d}", p, "\n".join(lines), None))
    rows.append(("empty", 1, "", None))
    return make(spark, rows)


def test_plan_invariants(spark, tmp_path):
    p = _corpus(spark)
    made = ingest(p)
    rows = made.chunks.orderBy("doc_id", "chunk_index").collect()
    assert rows and all(r.token_count <= 512 for r in rows)
    for d in {r.doc_id for r in rows}:
        mine = [r for r in rows if r.doc_id == d]
        assert [r.chunk_index for r in mine] == list(range(len(mine)))
        assert len({r.text_hash for r in mine}) == len(mine)
        assert [r.next_chunk_id for r in mine[:-1]] == [r.chunk_id for r in mine[1:]] and mine[0].prev_chunk_id is None
    assert {r.doc_id: r.status for r in made.statuses.collect()}["empty"] == "failed"
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        again = ingest(p.repartition(1)).chunks.orderBy("doc_id", "chunk_index").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == rows


def test_stream(spark, tmp_path):
    p = _corpus(spark)
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    index = IndexTable(spark, str(tmp_path / "index"))
    for _ in range(2):
        ingest_stream(stream_pages(spark, str(tmp_path / "in")), index, "u", HashingEmbedder, str(tmp_path / "checkpoint")).awaitTermination()
    expected = ingest(p).chunks
    assert index.read().count() == expected.count()
    index.delete_documents(["d0"])
    assert index.read().filter("document_id = 'd0'").count() == 0 and index.read().count() > 0
    row = index_rows(expected, "u", HashingEmbedder).first()
    assert len(row.vector) == 64 and row.user_id == "u"


def test_sources(spark, tmp_path):
    class FakePdf:
        def pages(self, content):
            return [(1, content.decode(), [("Big title", 20.0), ("Body of the page.", 10.0)], [[["a", None], ["b\nc", "dd"]]])]

        def bookmarks(self, content):
            return [(1, "Big title", 1)]

    (tmp_path / "a.txt").write_text("first page\fsecond page")
    (tmp_path / "b.pdf").write_bytes(b"text of a pdf")
    (tmp_path / "c.pdf").write_bytes(b"")
    assert [r.text for r in text_pages(spark, str(tmp_path)).orderBy("page_number").collect()] == ["first page", "second page"]
    found, tables, marks = pdf_pages(raw_documents(spark, str(tmp_path), "*.pdf"), FakePdf)
    assert [(b.block_type, b.heading_level) for b in found.first().blocks] == [("heading", 1), ("paragraph", None)]
    assert tables.first().text == "| a |  |\n| b c | dd |" and marks.count() == 1
    (tmp_path / "cases.json").write_text('[{"query": "q", "expected_chunk_ids": ["x"]}, {"query": "r", "expected_chunk_ids": [], "document_ids": ["d"]}]')
    assert eval_cases(spark, str(tmp_path / "cases.json")).count() == 2


def test_classify(spark):
    p = make(spark, [("d", 1, "- item\nWhy?\nplain", None), ("d", 2, "", [block("heading", "1) looks like a list", 2)])])
    got = [(r.page_number, r.block_type) for r in blocks.explode_blocks(blocks.classify_blocks(p)).orderBy("page_number", "block_ord").collect()]
    assert got == [(1, "list"), (1, "qa"), (1, "paragraph"), (2, "list")]


def test_recognize(spark):
    class Engine:
        def __init__(self, language, text, confidence):
            self.said = (f"{text} {language}", confidence)

        def read(self, image, page):
            return self.said

    rows = [("d", 1, "A text layer that is long enough to keep.", b""), ("d", 2, "", b""), ("e", 1, "", b"")]
    images = spark.createDataFrame(rows, "doc_id string, page_number int, text string, image binary")
    got = {(r.doc_id, r.page_number): (r.text, r.confidence, r.engine) for r in ocr.recognize(images, lambda k: Engine(k, "read", 0.9)).collect()}
    assert got == {("d", 1): (rows[0][2], 0.98, "text_layer"), ("d", 2): ("read en", 0.9, "primary"), ("e", 1): ("read devanagari", 0.9, "primary")}
    again = ocr.recognize(images, lambda k: Engine(k, "read", 0.1), lambda k: Engine(k, "better", 0.7)).filter("doc_id = 'e'").first()
    assert (again.text, again.engine) == ("better devanagari", "fallback")
    assert {r.doc_id: r.confidence for r in ocr.average_confidence(ocr.recognize(images, lambda k: Engine(k, "x", 0.9))).collect()}["e"] == 0.9


def test_older_cleaning(spark):
    p = spark.createDataFrame([("q", 1, "Why?\nHow?\nSo.\n"), ("q", 2, "a\nb"), ("p", 1, "a\nb")], "doc_id string, page_number int, text string")
    got = {(r.doc_id, r.page_number): r.text for r in pages.clean_pages(p).collect()}
    assert got == {("q", 1): "Why?\nHow?\nSo.", ("q", 2): "a\nb", ("p", 1): "a b"}


def test_objects(spark, tmp_path):
    path = put_object(spark, f"file://{tmp_path}/deep/a.bin", b"\x00\xff")
    assert (tmp_path / "deep/a.bin").read_bytes() == b"\x00\xff"
    assert delete_object(spark, path) and not delete_object(spark, path)


def test_simple_variant(spark):
    p = spark.createDataFrame([("d", 1, "Intro text here.\n\n1. Title\nbody line\n\nmore."), ("d", 2, "Next title\n"), ("e", 1, " \n")], "doc_id string, page_number int, text string")
    made = simple.simple_sections(p)
    got = [(r.doc_id, r.section_no, r.section_title, r.text, r.page_number) for r in made.orderBy("doc_id", "section_no").collect()]
    assert got == [("d", 0, None, "Intro text here.", 1), ("d", 1, "1. Title", "body line\n\nmore.", 1), ("d", 2, "Next title", "", 2), ("e", 0, None, "", 1)]
    rows = simple.simple_chunks(made).orderBy("doc_id", "chunk_index").collect()
    assert [(r.chunk_index, r.text) for r in rows] == [(0, "Intro text here."), (1, "1. Title\nbody line more."), (2, "Next title")]
    rows = spark.createDataFrame([("q1?\nq2？\na2\nplain",), ("One. Two?\n\nThree",)], "t string").select(simple.simple_units(F.col("t")).alias("u"))
    assert [r.u for r in rows.collect()] == [["q1?", "q2？\na2", "plain"], ["One.", "Two?", "Three"]]


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_texts_are_not_gathered_by_document(spark):
    """Windows and groups over whole documents hold headings and numbers; texts meet by section, in bounded batches."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(key)
    made = chunks.draft_chunks(sections.detect_sections(blocks.classify_blocks(_corpus(spark))))
    seen = 0
    for node in _nodes(made._jdf.queryExecution().optimizedPlan()):
        kind = node.nodeName()
        by = node.partitionSpec() if kind == "Window" else node.groupingExpressions() if kind == "Aggregate" else None
        if by is not None and by.size() == 1 and by.mkString(",").startswith("doc_id#"):
            names = {x.split("#")[0].strip() for x in node.children().apply(0).output().mkString(",").split(",")}
            assert not names & {"text", "blocks", "b", "line", "items", "page"}
            seen += 1
    assert seen
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == X.BATCH_ROWS
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == X.BATCH_BYTES


def test_sections_over_bare_pages(spark):
    """Bare pages count only where a document has no others; sections go on over pages; nulls are keys like others."""
    blank = [block("paragraph", " ")]
    p = make(spark, [("d", 1, "unread", blank), ("d", 2, "", [block("heading", "Title", 2), block("paragraph", "One.", 2)]), ("d", 3, "", [block("paragraph", "Two.", 3), block("heading", "Next", 3, 2), block("paragraph", "Three.", 3)]), ("e", 1, "first", []), ("f", 1, "kept", [block("paragraph", "")]), ("f", 2, "too", [block("paragraph", "", 2)]), (None, 1, "A null key.", None), ("g", 1, "", None)])
    got = {(r.doc_id, r.section_no): (r.section_title, r.text, r.heading_path, r.page_start, r.page_end, len(r.blocks)) for r in sections.detect_sections(p).collect()}
    assert got == {
        ("d", 0): ("Title", "One.\nTwo.", ["Title"], 2, 3, 3), ("d", 1): ("Next", "Three.", ["Title", "Next"], 3, 3, 2), ("e", 0): ("first", "", ["first"], 1, 1, 1),
        ("f", 0): (None, "kept\n\ntoo", [], 1, 2, 0), (None, 0): (None, "A null key.", [], 1, 1, 1), ("g", 0): (None, "", [], 1, 1, 0),
    }


def _by_built_in(rows, least=0.45, most=64):
    """Cleaned pieces with their counts, by the built-in expressions."""
    lines = F.col("lines")
    cleaned = F.when(lines, X.clean_text("t", lines=True)).otherwise(X.clean_text("t"))
    kept = rows.select("id", cleaned.alias("t")).filter(X.is_embeddable("t", least))
    return kept.select("id", F.posexplode(units.split_long(F.col("t"), most)).alias("n", "t")).select("id", "n", "t", X.shape("t").alias("m"))


def test_pieces_in_one_pass_are_those_of_the_expressions(spark):
    """Cleaning, worth, cuts and counts of units in Arrow batches (F2, F3) against the expressions."""
    rng = random.Random(5)
    odd = list("ab cd\t\n\n\r-\xad\x00\x0b\x1c\x85\xa0\u0130\u0141\u02a2\u034b\u0361\u0301\u1680\u2003\u2028\u200b\u2060\u3000\ufeff\uffff?.") + ["অ", "ক", "্", "é", "字", "😀", "-\n", "  ", "word ", "আইঈ "]
    texts = ["".join(rng.choices(odd + ["letters "] * rng.randint(0, 40), k=rng.choice((0, 4, 12, 60, 900)))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, lines) for i, t in enumerate([*texts, None, "", "ten chars!"]) for lines in (True, False)], "id int, t string, lines boolean").withColumn("id", F.col("id") * 2 + F.col("lines").cast("int"))
    got = rows.select("id", F.posexplode(units.worth_pieces(F.col("t"), F.col("lines"), 0.45, 64)).alias("n", "p"))
    got = sorted((r.id, r.n, r.p.text, r.p.n, r.p.solid, r.p.indic, r.p.latin) for r in got.collect())
    expected = sorted((r.id, r.n, r.t, r.m.n, r.m.solid, r.m.indic, r.m.latin) for r in _by_built_in(rows).collect())
    assert got == expected and len(got) > 400


def test_white_space_and_suspect_characters(spark):
    """The classes that are looked up quickly hold each character that they held by ranges."""
    rows = spark.createDataFrame([(chr(c),) for c in (*range(1, 0x3100), *range(0xFE00, 0x10100))], "c string")
    white = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    assert rows.filter(F.col("c").rlike(white) != F.col("c").rlike(X.WHITE)).count() == 0
    assert rows.filter(F.col("c").rlike(f"[\r{X.CONTROL}{X.INVISIBLE}{X.GARBAGE}]") & ~F.col("c").rlike(X.SUSPECT)).count() == 0
    assert rows.filter(F.col("c").rlike(X.WHITE)).count() == len(X.WHITE_CHARS)


def _by_steps(split, languages, config):
    """chunk_sections one step after the other, with texts."""
    drafts = chunks.measure(chunks.draft_chunks(split, config), languages)
    kept = chunks.noise_filter(chunks.merge_tiny(chunks.exact_dedup(drafts, ["section_no", "draft_no"]), config), config)
    return chunks.neighbour_links(chunks.reindex(kept, ["section_no", "draft_no"])).drop("section_no", "draft_no")


def test_chunks_follow_from_measures(spark):
    """dedup, merge, filter and numbers by measures give the rows of the steps, and no window carries texts."""
    rng = random.Random(9)
    line = lambda: rng.choice(("Same line on many pages, again and again.", "- item one", "What is it?", "123 456 789 000 111 222.", " ".join(rng.choices(["tiger", "river", "নদী", "বাঘ", "ąx"], k=rng.randint(3, 150))) + "."))
    rows = [(f"d{d}", p, "\n".join(([f"Part {p}"] if rng.random() < 0.7 else []) + [line() for _ in range(rng.randint(0, 9))]), None) for d in range(4) for p in range(1, 30)]
    split = sections.detect_sections(blocks.classify_blocks(make(spark, [*rows, ("empty", 1, "", None)]))).persist()
    languages = spark.createDataFrame([("d0", "as"), ("d1", "en")], "doc_id string, language string")
    config = EngineConfig(chunk_target=60, chunk_max=80, chunk_min=20, chunk_overlap=10)
    made, expected = chunks.chunk_sections(split, languages, None, config), _by_steps(split, languages, config)
    assert made.columns == expected.columns
    key = lambda r: (r.doc_id, r.chunk_index)
    got = sorted(made.collect(), key=key)
    assert got == sorted(expected.collect(), key=key) and len(got) > 100
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    held = [x for x in plan.splitlines() if "Window [" in x and "windowspecdefinition(doc_id" in x]
    assert held and not any("text" in x for x in held) and "row_number" not in plan


def test_statuses_read_no_texts(spark):
    """chunks are counted by measures; the drafts' texts are not read, and the counts are those of the chunks."""
    made = ingest(make(spark, [("d", p, "Title\n" + f"Words of page {p} go on here. " * 40, None) for p in range(1, 6)] + [("none", 1, "", None)]))
    plan = made.statuses._jdf.queryExecution().executedPlan().toString()
    reads = [x.split("]")[0] for x in plan.splitlines() if "FileScan parquet [" in x]
    assert any("measures" in x for x in reads) and not any("texts" in x for x in reads)
    n = {r.doc_id: r["count"] for r in made.chunks.groupBy("doc_id").count().collect()}
    assert {r.doc_id: (r.n_chunks, r.status) for r in made.statuses.collect()} == {"d": (n["d"], "ready"), "none": (0, "failed")}
    made.release()


def test_staged_writes_leave_no_shuffle_files(spark):
    """what a staged write has shuffled goes with it."""
    from lexloom.sources.staging import Staged

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (disk.getAllFiles().apply(i).getPath() for i in range(disk.getAllFiles().size())) if f.endswith(".data")}
    before = files()
    staged = Staged(spark.range(100_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).repartition(8, "t"), "x")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert staged.table.count() == 100_000
    staged.release()
