"""Listings, lookups and keyed writes on the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(table: DataFrame, user_id: str | int | None = None, owner: str = "user_id") -> DataFrame:
    """Rows that are not deleted, of one user if given."""
    rows = table.filter(F.col("deleted_at").isNull()) if "deleted_at" in table.columns else table
    return rows if user_id is None else rows.filter(F.col(owner) == user_id)


def page_of(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0, most: int = 100) -> DataFrame:
    """A page of rows in order; ``order`` must end in a key, so that pages neither overlap nor skip."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be 1 to {most}, offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def list_documents(documents: DataFrame, user_id: str | int, limit: int = 20, offset: int = 0) -> tuple[int, DataFrame]:
    """The number of a user's live documents, and a page of them, the newest first."""
    rows = live(documents, user_id)
    return rows.count(), page_of(rows, [F.desc("created_at"), F.col("id")], limit, offset)


def list_conversations(conversations: DataFrame, user_id: str | int, limit: int = 20, offset: int = 0) -> tuple[int, DataFrame]:
    """The number of a user's live conversations, and a page of them, by last message or creation, the latest first."""
    rows = live(conversations, user_id)
    return rows.count(), page_of(rows, [F.coalesce("last_message_at", "created_at").desc(), F.col("id")], limit, offset)


def list_messages(messages: DataFrame, conversation_id: str | int, limit: int = 50, offset: int = 0) -> tuple[int, DataFrame]:
    """The number of a conversation's messages, and a page of them in order; of one moment the user's come first."""
    rows = messages.filter(F.col("conversation_id") == conversation_id)
    return rows.count(), page_of(rows, [F.col("created_at"), (F.col("role") != "user").cast("int"), F.col("id")], limit, offset, 200)


def last_turns(messages: DataFrame, turns: int, order: list[str], conversation: str = "conversation_id") -> DataFrame:
    """The last ``turns * 2`` messages of each conversation, numbered from the oldest."""
    down = Window.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    up = Window.partitionBy(conversation).orderBy(*order)
    kept = messages.withColumn("_n", F.row_number().over(down)).filter(F.col("_n") <= turns * 2).drop("_n")
    return kept.withColumn("position", F.row_number().over(up))


def owned(table: DataFrame, key: str, user_id: str) -> DataFrame:
    """The live row of a key that the user owns: one row or none."""
    return live(table, user_id).filter(F.col("id") == key).limit(1)


def new_conversation(conversation_id: Column, user_id: Column, message: Column, now: Column) -> Column:
    """The row of a conversation that a message begins; its title is the message's first 80 characters."""
    none = F.lit(None).cast("timestamp")
    return F.struct(conversation_id.alias("id"), user_id.alias("user_id"), F.substring(message, 1, 80).alias("title"), now.alias("created_at"), now.alias("updated_at"), none.alias("last_message_at"), none.alias("deleted_at"))


def names_of(rows: DataFrame, documents: DataFrame, key: str = "document_id") -> DataFrame:
    """``rows`` with the display name of their documents; owner and deletion do not count."""
    return rows.join(documents.select(F.col("id").alias(key), "display_name"), key, "left")


def soft_delete(table: DataFrame, keys: list, now: Column, key: str = "id") -> DataFrame:
    """``table`` with deleted_at set on rows of the keys that are live."""
    return table.withColumn("deleted_at", F.when(F.col(key).isin(keys) & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at")))


def rename(documents: DataFrame, key: str, name: str) -> DataFrame:
    """``documents`` with a new display name of 1 to 512 characters; nothing else changes."""
    if not 1 <= len(name) <= 512:
        raise ValueError("a name has 1 to 512 characters")
    return documents.withColumn("display_name", F.when(F.col("id") == key, F.lit(name)).otherwise(F.col("display_name")))


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``table`` with the rows' keys replaced or added; of rows with one key that with the greatest ``order`` counts, and
    of equals, or without an order, that whose values hash highest, so that a run again gives the same."""
    first = [F.desc(c) for c in ([order] if order else [])]
    w = Window.partitionBy(key).orderBy(*first, F.desc(F.xxhash64(*rows.columns)))
    fresh = rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
    return table.join(fresh.select(key), key, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))


def delete_by_document(table: DataFrame, document_ids: DataFrame, column: str = "document_id") -> DataFrame:
    return table.join(document_ids.select(F.col(document_ids.columns[0]).alias(column)).distinct(), column, "left_anti").select(*table.columns)


def backfill_page_start(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("page_start", F.coalesce("page_start", "page_number"))


def persist_turn(messages: DataFrame, conversations: DataFrame, turn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the two rows of each turn added, and conversations with the time of their last message.

    turn: conversation_id, user_id, user_message_id, assistant_message_id, question, answer, input_type,
    retrieved_chunk_ids, model_used, latency_ms, created_at.
    """
    none = F.lit(None)
    both = F.array(
        F.struct(F.col("user_message_id").alias("id"), F.lit("user").alias("role"), F.col("input_type"), F.col("question").alias("content_text"), none.cast("array<string>").alias("retrieved_chunk_ids"), none.cast("string").alias("model_used"), none.cast("int").alias("latency_ms")),
        F.struct(F.col("assistant_message_id").alias("id"), F.lit("assistant").alias("role"), F.lit("text").alias("input_type"), F.col("answer").alias("content_text"), F.col("retrieved_chunk_ids"), F.col("model_used"), F.col("latency_ms").cast("int").alias("latency_ms")),
    )
    rows = turn.select("conversation_id", "user_id", "created_at", F.explode(both).alias("m")).select("conversation_id", "user_id", "created_at", "m.*")
    last = turn.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("_last"))
    touched = conversations.join(last, "id", "left").withColumn("last_message_at", F.greatest("last_message_at", "_last")).select(*conversations.columns)
    return messages.unionByName(rows, allowMissingColumns=True).select(*messages.columns), touched


def latest_status(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
