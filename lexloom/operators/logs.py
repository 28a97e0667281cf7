"""Stage logs and retrieval traces as tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.schema import STAGE_LOGS

ERROR_CHARS = 2000


class StageLog:
    """Rows of started, success and failed stages, appended to a table at a path. A failure of the log is no failure."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, **row) -> None:
        full = {f.name: row.get(f.name) for f in STAGE_LOGS}
        full["created_at"] = full["created_at"] or datetime.now(UTC).replace(tzinfo=None)
        full["error"] = full["error"][:ERROR_CHARS] if full["error"] else None
        self.spark.createDataFrame([tuple(full.values())], STAGE_LOGS).write.mode("append").parquet(self.path)

    @contextmanager
    def stage(self, name: str, document_id: str | None = None, **inputs) -> Iterator[dict]:
        """Log the stage that the block is; what the block puts in the dict is its output summary. Errors go on."""
        key, began, out = uuid.uuid4().hex, time.monotonic(), {}
        summary = {k: str(v) for k, v in inputs.items()} or None
        self.record(id=key, stage=name, status="started", document_id=document_id, input_summary=summary)
        done = lambda **more: self.record(id=key, stage=name, document_id=document_id, input_summary=summary, duration_ms=int(1000 * (time.monotonic() - began)), **more)
        try:
            yield out
        except Exception as e:
            done(status="failed", error=str(e))
            raise
        done(status="success", output_summary={k: str(v) for k, v in out.items()} or None)

    def latest(self) -> DataFrame:
        """The last status of each stage that was logged."""
        rank = F.when(F.col("status") == "started", 0).otherwise(1)
        log = self.spark.read.schema(STAGE_LOGS).parquet(self.path)
        return log.groupBy("id").agg(F.max_by(F.struct("stage", "status", "document_id", "duration_ms", "error"), F.struct(rank, "created_at")).alias("s")).select("id", "s.*")


def trace(stages: dict[str, DataFrame]) -> DataFrame:
    """(query_id, stage, rank, chunk_id, score, section_title, page_number, preview) of the candidates at each stage."""
    out = None
    for name, rows in stages.items():
        pick = lambda c, kind, rows=rows: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
        part = rows.select("query_id", F.lit(name).alias("stage"), pick("rank", "int").alias("rank"), F.col("chunk_id").cast("string").alias("chunk_id"), F.bround(pick("score", "double"), 4).alias("score"), pick("section_title", "string").alias("section_title"), pick("page_number", "int").alias("page_number"), X.preview(pick("text", "string"), 300).alias("preview"))
        out = part if out is None else out.unionByName(part)
    return out
