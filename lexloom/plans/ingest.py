"""The ingestion plan: pages of all documents to chunks with vectors and index rows, in one DAG."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.operators import blocks, chunks, headers, pages, sections
from lexloom.sources.connectors import Embedder, with_embeddings
from lexloom.sources.staging import Staged


@dataclass
class Ingested:
    profiles: DataFrame
    pages: DataFrame
    sections: DataFrame
    chunks: DataFrame
    languages: DataFrame
    statuses: DataFrame
    staged: list[Staged]

    def release(self) -> None:
        """Delete what was written for the branches of the plan that share it."""
        for x in self.staged:
            x.release()


def ingest(parsed: DataFrame, ocr: DataFrame | None = None, tables: DataFrame | None = None, bookmarks: DataFrame | None = None, config: EngineConfig = DEFAULT) -> Ingested:
    """Profile, tables, OCR merge, furniture, block types, sections and chunks of parsed pages.

    A document without chunks has the status failed and the error "No embeddable text extracted", others are ready.
    Merged pages and chunk drafts are written to the shared folder, as several branches read them; ``release`` deletes
    them.
    """
    staged: list[Staged] = []

    def stage(label: str, rows: DataFrame) -> DataFrame:
        staged.append(Staged(rows, label))
        return staged[-1].table

    profiles = pages.profile(parsed, tables, bookmarks)
    found = pages.route_tables(parsed, tables, profiles) if tables is not None else parsed
    if ocr is None:
        ocr = found.select("doc_id", "page_number", "text", "confidence").limit(0)
    merged = pages.merge_parsed_with_ocr(found, ocr)
    # blocks are made of lines again by each branch that reads them: they would double what is written
    typed = blocks.classify_blocks(stage("pages", headers.strip_headers(merged, strip_blocks=not config.strict)))
    split = sections.detect_sections(typed, config.strict)
    languages = pages.document_language(typed, config)
    confidences = ocr.select("doc_id", "page_number", "confidence")
    drafts = stage("drafts", chunks.measured_drafts(split, config))
    made = chunks.finished_chunks(drafts, languages, confidences, config)
    some = chunks.chunk_counts(drafts, config)
    statuses = profiles.select("doc_id").join(some, "doc_id", "left").select("doc_id", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.when(F.col("n_chunks") > 0, "ready").otherwise("failed").alias("status"), F.when(F.col("n_chunks").isNull(), "No embeddable text extracted").alias("error_message"))
    return Ingested(profiles, typed, split, made, languages, statuses, staged)


def index_rows(made: DataFrame, user_id: str, make: Callable[[], Embedder], config: EngineConfig = DEFAULT, profiles: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Rows of the index table: the payloads and vectors of chunks.

    profiles (doc_id, document_type) and files (doc_id, source_file) give what chunks do not know; without them it is null.
    """
    rows = with_embeddings(made, make, batch=config.embedding_batch)
    for table, column in ((profiles, "document_type"), (files, "source_file")):
        rows = rows.withColumn(column, F.lit(None).cast("string")) if table is None else rows.join(table.select("doc_id", column), "doc_id", "left")
    rows = rows.withColumn("user_id", F.lit(user_id)).withColumn("page_number", F.col("page_start")).withColumn("source_language", F.col("language"))
    return rows.withColumnRenamed("doc_id", "document_id")
