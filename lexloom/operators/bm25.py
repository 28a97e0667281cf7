"""Lexical search: an inverted index as tables, and BM25 for a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators.dense import best_per_query, scope

#: Words of any script with their marks; words of plain letters and digits.
UNICODE_WORDS, ASCII_WORDS = r"[\p{L}\p{N}\p{M}_]+", "[a-z0-9]+"


def analyze(c: Column | str, pattern: str = UNICODE_WORDS) -> Column:
    """Words of a text, in order: of the folded text by default, of the lower-cased one for ASCII words."""
    text = F.lower(X.text_of(c)) if pattern == ASCII_WORDS else X.fold(c)
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


@dataclass
class LexicalIndex:
    """postings (term, chunk_id, tf, length), terms (term, df), stats (n, average): over all chunks, whoever owns them."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    pattern: str


def build_index(chunks: DataFrame, pattern: str = UNICODE_WORDS, keep: bool = False) -> LexicalIndex:
    """The index of chunks (chunk_id, text). ``keep`` holds the postings (in memory, else on disk) for several searches;
    a large index is better written, by term, and read back."""
    words = chunks.select("chunk_id", analyze("text", pattern).alias("words")).withColumn("length", F.size("words").cast("long"))
    postings = words.select("chunk_id", "length", F.explode("words").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    postings = postings.persist(StorageLevel.MEMORY_AND_DISK) if keep else postings
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = words.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    return LexicalIndex(postings, terms, stats, pattern)


def bm25_search(queries: DataFrame, index: LexicalIndex, chunks: DataFrame | None = None, k: int = 20, k1: float = 1.2, b: float = 0.75, digits: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks of each query (query_id, text) that share a word with it.

    A word counts as often as the query has it. With ``chunks`` (chunk_id, user_id, document_id) a query sees only its
    scope; counts stay those of the whole index. With ``digits`` scores are rounded before ranks are given, so that equal
    texts tie whatever the order in which their scores were summed.
    """
    wanted = queries.select("query_id", F.explode(analyze("text", index.pattern)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    rated = wanted.join(index.terms, "term").crossJoin(F.broadcast(index.stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rated = rated.select("query_id", "term", (idf * F.col("times")).alias("weight"), "average")
    tf = F.col("tf") / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("length") / F.col("average")))
    score = F.sum(F.col("weight") * tf)
    hits = rated.join(index.postings, "term").groupBy("query_id", "chunk_id").agg((score if digits is None else F.round(score, digits)).alias("score"))
    if chunks is not None and (seen := scope(queries, chunks)) is not None:
        who = [c for c in ("query_id", "user_id", "document_ids") if c in queries.columns]
        owned = [c for c in ("chunk_id", "user_id", "document_id") if c in chunks.columns]
        hits = hits.join(queries.select(*who).alias("q"), "query_id").join(chunks.select(*owned).alias("c"), "chunk_id").filter(seen).select("query_id", "chunk_id", "score")
    return best_per_query(hits, k)
