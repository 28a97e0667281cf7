"""Model services: what the engine asks of them, deterministic stand-ins that need no network, and retries.

A connector is made once in each Python worker and called with batches; it must give the same for the same input, since
a task may run again.
"""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

R = TypeVar("R")


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Chat(Protocol):
    def complete(self, messages: list[dict]) -> str: ...

    def stream(self, messages: list[dict]) -> Iterator[str]: ...


class Ocr(Protocol):
    def read(self, image: bytes, page: int) -> tuple[str, float]: ...


class Speech(Protocol):
    def transcribe(self, audio: bytes) -> dict: ...


class Pdf(Protocol):
    """Pages of a PDF as (page_number, text, [(text, font size)], [[cells of a row]] of tables); and its bookmarks."""

    def pages(self, content: bytes) -> list[tuple[int, str, list[tuple[str, float]], list[list[list[str]]]]]: ...

    def bookmarks(self, content: bytes) -> list[tuple[int, str, int]]: ...

    def images(self, content: bytes, dpi: int = 200) -> list[bytes]: ...


def retry(call: Callable[[], R], tries: int = 3, wait: Callable[[int], float] = lambda n: 0.5 * 2**n, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> R:
    """The call's result, tried again after errors that may pass."""
    for n in range(tries):
        try:
            return call()
        except transient:
            if n == tries - 1:
                raise
            sleep(wait(n))
    raise AssertionError("unreachable")


def model_wait(n: int) -> float:
    """Waits for a model that is loading: doubling, 30 seconds at most."""
    return min(30.0, 2.0**n)


class HashingEmbedder:
    """Signed hashing of words, L2-normalised: equal texts are equal, shared words bring texts near."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class OverlapReranker:
    """The Jaccard similarity of the sets of lower-cased words."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        sets = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
        return [len(a & b) / len(a | b) if a and b else 0.0 for a, b in sets]


class QuotingChat:
    """Quotes the start of the first passage."""

    def complete(self, messages: list[dict]) -> str:
        said = messages[-1]["content"]
        first = said.partition("[S1]")[2].partition("\n")[2].partition("\n")[0]
        return f"{first[:200]} [S1]" if first else "Not found."

    def stream(self, messages: list[dict]) -> Iterator[str]:
        for word in self.complete(messages).split(" "):
            yield word + " "


class NullOcr:
    def read(self, image: bytes, page: int) -> tuple[str, float]:
        return "", 0.0


#: OCR engines by name; languages that an engine knows.
OCR_ENGINES: dict[str, Callable[[], Ocr]] = {"null": NullOcr}
OCR_LANGUAGES = ("devanagari", "en")


def ocr_engine(name: str, language: str = OCR_LANGUAGES[0]) -> Ocr:
    """The engine of a name, or one that reads nothing; a language that is not known is an error."""
    if language not in OCR_LANGUAGES:
        raise ValueError(f"no OCR for {language}")
    return OCR_ENGINES.get(name, NullOcr)()


def with_embeddings(rows: DataFrame, make: Callable[[], Embedder], text: str = "text", batch: int = 8, name: str = "vector") -> DataFrame:
    """``rows`` with a vector of each text, asked for in batches."""

    @F.pandas_udf("array<double>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in model.embed(texts[i : i + batch])])

    return rows.withColumn(name, embed(text))


def rerank_score(make: Callable[[], Reranker], query: Column, text: Column) -> Column:
    @F.pandas_udf("double")
    def score(series: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in series:
            yield pd.Series(model.score(list(zip(q.fillna(""), t.fillna(""), strict=True))), dtype="float64")

    return score(query, text)
