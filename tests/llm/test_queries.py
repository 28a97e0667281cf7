"""The queries of this subpackage run on the driver's tables, and give the rows of their SQL."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from lexloom.llm import queries
from tests.oracle import SF, connect, rows_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")

COLUMNS = {
    "op1": {"doc_id", "held_out", "score", "predicted"},
    "op2": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op3": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4": {"doc_id", "fingerprint", "component_id"},
    "op5": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op6": {"query_id", "rank", "vec_id", "score"},
    "op7": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert len(got) and COLUMNS.get(name.split("_")[0], set()) <= set(got.columns)
    if name in queries.ORACLE_SQL:
        assert rows_of(got) == rows_of(connect().execute(queries.ORACLE_SQL[name]).df())


def test_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
