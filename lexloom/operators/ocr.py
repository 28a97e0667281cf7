"""The OCR pass: which pages are read by a machine, by which engine, and whose reading counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.config import DEFAULT, EngineConfig
from lexloom.functions import text as X
from lexloom.operators import pages as P
from lexloom.sources.connectors import Ocr


def _read(rows: DataFrame, make: Callable[[str], Ocr], text: str, confidence: str) -> DataFrame:
    """``rows`` with what an engine of each row's language reads in its image."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {text} string, {confidence} double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines: dict[str, Ocr] = {}
        for b in batches:
            read = [engines.setdefault(k, make(k) if k not in engines else engines[k]).read(i, n) for k, i, n in zip(b["ocr_language"], b["image"], b["page_number"], strict=True)]
            yield b.assign(**{text: [t for t, _ in read], confidence: [float(c) for _, c in read]})

    return rows.mapInPandas(run, schema)


def recognize(images: DataFrame, primary: Callable[[str], Ocr], fallback: Callable[[str], Ocr] | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """(doc_id, page_number, text, confidence, engine) of pages (doc_id, page_number, text, image).

    A page whose own text is real content keeps it at 0.98. Others are read by the primary engine, in the language of
    the page or of its document; doubtful readings are read again, and the better one counts.
    """
    rows = images.select("doc_id", "page_number", "text", "image")
    document = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", X.text_of("text").alias("t"))).over(Window.partitionBy("doc_id"))), lambda x: x["t"]), " ")
    rows = rows.withColumn("hint", document)
    layer = rows.filter(P.use_text_layer("text")).select("doc_id", "page_number", "text", F.lit(0.98).alias("confidence"), F.lit("text_layer").alias("engine"))
    asked = rows.filter(~P.use_text_layer("text")).withColumn("ocr_language", P.ocr_language(F.col("text"), F.col("hint"), config)).drop("text", "hint")
    first = _read(asked, primary, "t1", "c1")
    read = first.select("doc_id", "page_number", F.col("t1").alias("text"), F.col("c1").alias("confidence"), F.lit("primary").alias("engine"))
    if fallback is not None:
        doubtful = P.needs_fallback(F.col("c1"), F.col("t1"), config)
        good = first.filter(~doubtful).select("doc_id", "page_number", F.col("t1").alias("text"), F.col("c1").alias("confidence"), F.lit("primary").alias("engine"))
        again = _read(first.filter(doubtful), fallback, "t2", "c2")
        take = P.prefer_fallback(F.col("t1"), F.col("c1"), F.col("t2"), F.col("c2"))
        pick = lambda a, b: F.when(take, b).otherwise(a)
        second = again.select("doc_id", "page_number", pick(F.col("t1"), F.col("t2")).alias("text"), pick(F.col("c1"), F.col("c2")).alias("confidence"), pick(F.lit("primary"), F.lit("fallback")).alias("engine"))
        read = good.unionByName(second)
    return layer.unionByName(read)


def average_confidence(ocr: DataFrame) -> DataFrame:
    """(doc_id, confidence): the mean over pages."""
    return ocr.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
