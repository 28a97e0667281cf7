"""Search, ranking, context, evaluation and the relational operators on small tables."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lexloom.functions import parsing, prompts
from lexloom.functions import vectors as V
from lexloom.operators import bm25, context, dense, evaluation, ranking, relational
from lexloom.operators.logs import StageLog
from lexloom.plans.retrieve import retrieve
from lexloom.sources import connectors

PASSAGES = ["The capital of the region lies on a wide river.", "Tea grows on the hills of the east.", "The river floods in summer.", "Schools open at nine.", "Silk is woven in the villages."]


def chunk_table(spark):
    rows = [(f"c{i}", f"d{i % 2}", f"u{i % 2}", i, "s", None, 1, 1, t, None) for i, t in enumerate(PASSAGES)]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, user_id string, chunk_index int, section_id string, section_title string, page_start int, page_number int, text string, token_count int")
    return connectors.with_embeddings(c, connectors.HashingEmbedder)


def test_dense_scope(spark):
    c = chunk_table(spark)
    q = c.filter("chunk_id = 'c0'").select(F.lit("q").alias("query_id"), "vector", F.lit("u0").alias("user_id"), F.array(F.lit("d0")).alias("document_ids"))
    got = dense.dense_search(q, c, 5).orderBy("rank").collect()
    assert got[0].chunk_id == "c0" and got[0].score == pytest.approx(1.0)
    assert {r.chunk_id for r in got} == {"c0", "c2", "c4"}


def test_bm25_by_hand(spark):
    c = spark.createDataFrame([("a", "x y y"), ("b", "x z"), ("c", "w")], "chunk_id string, text string")
    got = {r.chunk_id: r.score for r in bm25.bm25_search(spark.createDataFrame([("q", "y x x")], "query_id string, text string"), bm25.build_index(c)).collect()}
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    tf = lambda n, dl: n / (n + 1.2 * (0.25 + 0.75 * dl / 2))
    assert got == {"a": pytest.approx(2 * idf(2) * tf(1, 3) + idf(1) * tf(2, 3)), "b": pytest.approx(2 * idf(2) * tf(1, 2))}


def hits(spark, *ids):
    return spark.createDataFrame([("q", c, i) for i, c in enumerate(ids, 1)], "query_id string, chunk_id string, rank int")


def test_rrf_ties(spark):
    got = ranking.rrf([hits(spark, "b", "a"), hits(spark, "a", "b")]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a"] and got[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_mmr(spark):
    schema = "query_id string, chunk_id string, text string, score double, rank int"
    c = spark.createDataFrame([("q", "a", "the old town by the river", 1.0, 1), ("q", "b", "the old town by the river bank", 0.95, 2), ("q", "c", "history of tea", 0.8, 3)], schema)
    assert [r.chunk_id for r in ranking.mmr(c, 2, 0.7).orderBy("mmr_rank").collect()] == ["a", "c"]
    assert [r.chunk_id for r in ranking.mmr(c, 5).orderBy("mmr_rank").collect()] == ["a", "b", "c"]


def test_context(spark):
    schema = "query_id string, chunk_id string, document_id string, section_id string, section_title string, page_start int, page_number int, chunk_index int, text string, token_count int"
    run = spark.createDataFrame([("q", f"c{i}", "d", "s", "T", 1, 1, i, f"t{i}", 10) for i in range(4)], schema)
    got = context.build_context(run).orderBy("context_rank").collect()
    assert [r.expanded_text for r in got] == ["t0\nt1", "t2\nt3"]
    from lexloom.config import EngineConfig

    assert [r.expanded_text for r in context.build_context(run, EngineConfig(strict=False)).collect()] == ["t0\nt1\nt2\nt3"]
    big = spark.createDataFrame([("q", f"c{i}", "d", f"s{i}", None, i + 1, 1, 0, f"t{i}", n) for i, n in enumerate((2000, 1500, 100))], schema)
    assert [r.chunk_id for r in context.build_context(big).collect()] == ["c0"]
    assert context.context_block(context.build_context(run)).first().context == "[S1] T (p.1)\nt0\nt1\n\n[S2] T (p.1)\nt2\nt3"


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", ["x"]), ("b", [])], "case_id string, expected_chunk_ids array<string>")
    h = spark.createDataFrame([("a", "x", 7)], "case_id string, chunk_id string, rank int")
    a = evaluation.case_metrics(cases, h).filter("case_id = 'a'").first()
    assert (a.recall_at_5, a.recall_at_10, a.mrr, a.hit) == (0.0, 1.0, pytest.approx(1 / 7), 1.0)
    assert evaluation.evaluate(cases, h).first().hit_rate == 0.5
    assert evaluation.evaluate(cases.limit(0), h).first().mrr == 0.0


def test_benchmark_file(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"query": "a", "expected_chunk_ids": ["x", "y"]}]')
    got = evaluation.run_benchmark(spark, str(tmp_path / "c.json"), lambda c: c.select("case_id", F.lit("y").alias("chunk_id"), F.lit(2).alias("rank")))
    assert (got["recall_at_5"], got["mrr"], got["hit_rate"]) == (0.5, 0.5, 1.0) and got["latency_ms"] > 0


def test_plan(spark):
    c = chunk_table(spark)
    q = spark.createDataFrame([("q1", "capital  of the region", "u0"), ("q2", "tea hills", "u1"), ("q3", "???", "u9")], "query_id string, text string, user_id string")
    found = retrieve(q, c, bm25.build_index(c), connectors.HashingEmbedder)
    top = {r.query_id: r.chunk_id for r in found.reranked.filter("rerank_rank = 1").collect()}
    assert top == {"q1": "c0", "q2": "c1"}
    assert {r.query_id for r in found.contexts.collect()} == {"q1", "q2"}
    assert {r.stage for r in found.trace().collect()} == {"dense", "bm25", "fused", "mmr", "reranked"}


def test_last_turns(spark):
    m = spark.createDataFrame([("c", i, "user" if i % 2 == 0 else "assistant") for i in range(20)], "conversation_id string, created_at int, role string")
    got = relational.last_turns(m, 6, ["created_at"]).orderBy("position").collect()
    assert [r.created_at for r in got] == list(range(8, 20))


def test_writes(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert {tuple(r) for r in relational.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(ValueError):
        relational.page_of(t, [F.col("id")], limit=101)
    with pytest.raises(ValueError):
        relational.rename(t, "1", "")


def test_stage_log(spark, tmp_path):
    log = StageLog(spark, str(tmp_path / "log"))
    with log.stage("parse", "d", size=3) as out:
        out["pages"] = 2
    with pytest.raises(RuntimeError), log.stage("embed"):
        raise RuntimeError("x" * 3000)
    got = {r.stage: r for r in log.latest().collect()}
    assert got["parse"].status == "success" and got["embed"].status == "failed" and len(got["embed"].error) == 2000


@pytest.mark.parametrize(("raw", "expected"), [("[0.5, 1]", [0.5, 1.0]), ('[{"score": 0.5}, {"score": 1}]', [0.5, 1.0]), ('{"scores": [0.5, 1]}', [0.5, 1.0]), ('{"logits": [[0.5], [1]]}', [0.5, 1.0]), ('[[{"label": "a", "score": 0.5}, {"label": "b", "score": 1}]]', [0.5, 1.0]), ("[]", [0.0, 0.0])])
def test_rerank_scores(spark, raw, expected):
    assert spark.createDataFrame([(raw,)], "j string").select(parsing.rerank_scores(F.col("j"), 2)).first()[0] == expected


def test_parsing(spark):
    say = lambda j: spark.createDataFrame([(j,)], "j string").select(parsing.chat_answer(F.col("j"))).first()[0]
    assert say('{"choices": [{"message": {"content": " ", "reasoning_content": "yes "}}]}') == "yes"
    assert say('{"choices": [{"message": {}}], "output": "top"}') == "top"
    assert say('{"output": "top"}') is None
    delta = lambda j: spark.createDataFrame([(j,)], "j string").select(parsing.stream_delta(F.col("j"))).first()[0]
    assert delta('data: {"choices": [{"delta": {"content": "a"}}]}') == "a"
    assert delta("data: [DONE]") is None and delta("event: x") is None


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]])], "a array<double>, z array<double>, m array<array<double>>")
    r = df.select(V.l2_normalize(F.col("a")), V.l2_normalize(F.col("z")), V.mean_pool(F.col("m")), V.cosine(F.col("a"), F.col("z"))).first()
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0.0, 0.0] and r[2] == pytest.approx([0.5**0.5] * 2) and r[3] is None


def test_connectors():
    tries = []

    def fail():
        tries.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        connectors.retry(fail, sleep=lambda _: None)
    assert len(tries) == 3 and connectors.model_wait(9) == 30.0
    with pytest.raises(ValueError):
        connectors.ocr_engine("null", "xx")
    assert connectors.ocr_engine("unknown").read(b"", 1) == ("", 0.0)
    assert connectors.QuotingChat().complete([{"role": "user", "content": "[S1] T\nSome text\nmore"}]) == "Some text [S1]"


def test_messages(spark):
    h = spark.createDataFrame([("q", "c", [("user", "hi")])], "q string, c string, h array<struct<role:string,content:string>>")
    got = h.select(prompts.messages(F.col("q"), F.col("c"), F.col("h"))).first()[0]
    assert [m.role for m in got] == ["system", "user", "user"] and got[2].content.startswith("Passages:\nc")
