"""A corpus pipeline of the large-corpus operators: documents in, token sequences out.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents. Nulls,
empty and very long texts, repeated rows, empty tables and further columns are handled as the operators state.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, linededup, packing, rules, simhash
from lexloom.llm.common import Scratch, fold_of, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts, learnt from labels of three of four folds."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return rules.keep_quality(docs, rules.train(docs, labels, usable=fold_of("doc_id", 4) != 2))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those of which nothing is left go."""
    return linededup.strip_shared(docs, count="n_chars" if "n_chars" in docs.columns else None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group whose SimHash fingerprints link."""
    return simhash.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their places in sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("best_fit_packing", pack),
]

#: The classifier is trained and the tokenizer is a program, so SQL cannot give these rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the table documents; each stage's result is written and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
