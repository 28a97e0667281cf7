"""The entry module gives the core queries whatever becomes of the large-corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("blocked", ["xxhash", "zstandard", "lexloom.llm", "corpus_pipeline"])
def test_entry_without(blocked):
    code = f"""
import sys
sys.modules[{blocked!r}] = None
import __spark_entry__ as e
from lexloom import queries
assert set(queries.QUERIES) <= set(e.queries()) and set(queries.ORACLE_SQL) <= set(e.oracle_sql())
assert "pipeline" not in e.queries() or {blocked!r} == "zstandard"  # which no stage of it needs
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
