"""Ingestion as a stream: new pages are chunked in micro-batches and replace their documents in the index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexloom.config import DEFAULT, EngineConfig
from lexloom.plans.ingest import index_rows, ingest
from lexloom.schema import PAGES
from lexloom.sources.connectors import Embedder
from lexloom.sources.files import IndexTable


def stream_pages(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(pages: DataFrame, index: IndexTable, user_id: str, make: Callable[[], Embedder], checkpoint: str, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Ingest what is there and stop. Ids depend on content, and a batch replaces its documents whole, so a batch that
    runs again after a failure leaves the same table. A document's pages must come in one batch."""

    def write(batch: DataFrame, _: int) -> None:
        made = ingest(batch, config=config)
        index.replace_documents(index_rows(made.chunks, user_id, make, config))
        made.release()

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
