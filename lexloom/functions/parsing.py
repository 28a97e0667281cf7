"""Answers of model services, parsed from their JSON as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as X

FIELDS = ("content", "reasoning_content", "text")


def _said(c: Column) -> Column:
    return F.nullif(X.strip(c), F.lit(""))


def chat_answer(json: Column) -> Column:
    """The first field of the first choice's message that is not blank, else one at the top; null if there is none."""
    inner = [_said(F.get_json_object(json, f"$.choices[0].message.{f}")) for f in FIELDS]
    outer = [_said(F.get_json_object(json, f"$.{f}")) for f in ("output", "text", "response")]
    return F.when(F.get_json_object(json, "$.choices[0]").isNotNull(), F.coalesce(*inner, *outer))


def stream_delta(line: Column) -> Column:
    """The text of one server-sent event; null for other lines and for the end."""
    data = F.trim(F.regexp_extract(line, r"^data:(.*)$", 1))
    return F.when((data != "") & (data != "[DONE]"), F.coalesce(*[F.nullif(F.get_json_object(data, f"$.choices[0].delta.{f}"), F.lit("")) for f in FIELDS]))


def rerank_scores(json: Column, n: Column | int) -> Column:
    """Scores of n texts in any of five shapes: an array of numbers, of objects with a score, of arrays of either, or such
    under "scores" or "logits", or one array of objects within an array. An empty array gives zeros, another shape null."""
    count = F.lit(n) if isinstance(n, int) else n
    inner = F.coalesce(F.get_json_object(json, "$.scores"), F.get_json_object(json, "$.logits"), json)
    batch = F.transform(F.from_json(json, "array<array<struct<score:double>>>")[0], lambda x: x["score"])
    items = F.from_json(inner, "array<string>")
    one = lambda x: F.coalesce(x.try_cast("double"), F.get_json_object(x, "$.score").try_cast("double"), F.get_json_object(x, "$[0].score").try_cast("double"), F.get_json_object(x, "$[0]").try_cast("double"))
    is_batch = json.rlike(r"^\s*\[\s*\[\s*\{")
    flat = F.when(F.size(items) == 0, F.array_repeat(F.lit(0.0), count)).otherwise(F.slice(F.transform(items, one), F.lit(1), F.greatest(count, F.lit(0))))
    return F.when(is_batch, F.slice(batch, F.lit(1), count)).otherwise(flat)
