"""Files in and out: raw documents, parsed pages, evaluation cases, and index tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import relational
from lexloom.operators.pages import heading_level_of_font, table_markdown, text_layer_confidence
from lexloom.schema import EVAL_CASES
from lexloom.sources.connectors import Pdf


def raw_documents(spark: SparkSession, path: str, pattern: str = "*", most: int = 50 * 1024 * 1024) -> DataFrame:
    """(doc_id, path, length, content) of files, empty and too large ones left out; doc_id is a hash of the path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length").between(1, most)).select(F.sha2("path", 256).alias("doc_id"), "path", "length", "content")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def put_object(spark: SparkSession, path: str, content: bytes) -> str:
    """Write one object in whatever store the path names; its path."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def delete_object(spark: SparkSession, path: str) -> bool:
    """Remove one object; whether it was there."""
    fs, p = _path(spark, path)
    return fs.delete(p, False)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files as pages, parted by form feeds: (doc_id, page_number, text, confidence, engine, indic_ratio)."""
    files = raw_documents(spark, path, "*.txt")
    rows = files.select("doc_id", F.posexplode(F.split(F.decode("content", "UTF-8"), "\f")).alias("n", "text"))
    return rows.select("doc_id", (F.col("n") + 1).alias("page_number"), "text", F.lit(1.0).alias("confidence"), F.lit("text").alias("engine"), X.indic_ratio("text").alias("indic_ratio"))


def pdf_pages(files: DataFrame, make: Callable[[], Pdf]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages with blocks, tables (doc_id, page_number, table_ord, text) and bookmarks of raw documents, by an extractor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = make()
        for b in batches:
            rows = []
            for doc, content in zip(b["doc_id"], b["content"], strict=True):
                marks = bool(pdf.bookmarks(content))
                for n, text, spans, tables in pdf.pages(content):
                    rows.append((doc, n, text, [{"text": t, "size": float(s)} for t, s in spans], tables, marks))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "spans", "tables", "marked"])

    schema = "doc_id string, page_number int, text string, spans array<struct<text:string,size:double>>, tables array<array<array<string>>>, marked boolean"
    found = files.select("doc_id", "content").mapInPandas(run, schema)
    n = F.col("page_number")

    def block(s):
        level = heading_level_of_font(s["size"], s["text"])
        return F.struct(F.when(level.isNotNull(), "heading").otherwise("paragraph").alias("block_type"), s["text"].alias("text"), n.alias("page_start"), n.alias("page_end"), F.lit(1.0).alias("confidence"), level.cast("int").alias("heading_level"), s["size"].alias("font_size"))

    text = X.clean_text("text", lines=True)
    pages = found.select("doc_id", "page_number", text.alias("text"), F.transform(F.filter("spans", lambda s: X.strip(s["text"]) != ""), block).alias("blocks"), F.lit("text_layer").alias("engine"))
    pages = pages.select("doc_id", "page_number", "text", text_layer_confidence("text").alias("confidence"), "engine", X.indic_ratio("text").alias("indic_ratio"), "blocks")
    tables = found.select("doc_id", "page_number", F.posexplode("tables").alias("table_ord", "rows")).select("doc_id", "page_number", "table_ord", table_markdown(F.col("rows")).alias("text"))
    return pages, tables.filter(F.length(X.strip("text")) >= 10), found.filter("marked").select("doc_id").distinct()


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON array, with a case_id by their content."""
    cases = spark.read.schema(EVAL_CASES).option("multiLine", True).json(path)
    return cases.withColumn("case_id", F.sha2(F.to_json(F.struct(*cases.columns)), 256))


class IndexTable:
    """A table of chunks at a path, parted by ``by``; writes replace whole partitions that they touch, so they can be repeated."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", by: str = "document_id"):
        self.spark, self.path, self.key, self.by = spark, path, key, by

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        rows.write.mode("ignore").partitionBy(self.by).parquet(self.path)

    def replace_documents(self, rows: DataFrame) -> None:
        """Write the partitions of the rows' documents anew."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)

    def delete_documents(self, ids: list[str]) -> None:
        """Remove the partitions of documents."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for i in ids:
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(self.by, str(i))
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            p.getFileSystem(conf).delete(p, True)
        self.spark.catalog.refreshByPath(self.path)

    def upserted(self, rows: DataFrame) -> DataFrame:
        return relational.upsert(self.read(), rows, self.key)
