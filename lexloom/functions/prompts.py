"""Prompts for chat models, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as X

SYSTEM_PROMPT = (
    "Answer questions from the given passages only, in the language of the question (Assamese or English; for a mixed "
    "question, the language that prevails). Give the answer alone, in a sentence or two, and mark the passages that it "
    "rests on as [S1], [S2] and so on. If the passages do not hold the answer, say so briefly in that language."
)
#: What stands before the passages, before the question and after it, by language of the question.
TURN = {
    "en": ("Passages:\n", "\n\n---\nQuestion: ", "\n\nUse these passages only and mark those used as [S#]."),
    "as": ("প্ৰসংগ:\n", "\n\n---\nপ্ৰশ্ন: ", "\n\nকেৱল এই প্ৰসংগৰ পৰা উত্তৰ দিয়ক, উৎসবোৰ [S#] বুলি দেখুৱাওক।"),
}


def user_turn(query: Column, context: Column, language: Column) -> Column:
    by = lambda k: F.concat(F.lit(TURN[k][0]), context, F.lit(TURN[k][1]), query, F.lit(TURN[k][2]))
    return F.when(language == "en", by("en")).otherwise(by("as"))


def messages(query: Column, context: Column, history: Column | None = None, language: Column | None = None) -> Column:
    """An array of (role, content): the system's, the history's, then the question with its context."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    first, last = F.array(say("system", F.lit(SYSTEM_PROMPT))), F.array(say("user", user_turn(query, context, X.detect_query_language(query) if language is None else language)))
    past = F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")) if history is not None else None
    return F.concat(first, past, last) if past is not None else F.concat(first, last)
