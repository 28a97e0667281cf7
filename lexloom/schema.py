"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _of(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BLOCK = _of(("block_type", _S), ("text", _S), ("page_start", _I), ("page_end", _I), ("confidence", _D), ("heading_level", _I), ("font_size", _D))
PAGES = _of(("doc_id", _S), ("page_number", _I), ("text", _S), ("confidence", _D), ("engine", _S), ("indic_ratio", _D), ("blocks", T.ArrayType(BLOCK)))
BLOCKS = _of(("doc_id", _S), ("page_number", _I), ("block_ord", _I), ("block_type", _S), ("text", _S), ("confidence", _D), ("heading_level", _I), ("font_size", _D))
SECTIONS = _of(("doc_id", _S), ("section_no", _I), ("section_id", _S), ("section_title", _S), ("heading_path", T.ArrayType(_S)), ("text", _S), ("page_start", _I), ("page_end", _I), ("blocks", T.ArrayType(BLOCK)))
CHUNKS = _of(
    ("doc_id", _S), ("chunk_index", _I), ("chunk_id", _S), ("section_id", _S), ("section_title", _S), ("heading_path", T.ArrayType(_S)), ("page_start", _I), ("page_end", _I),
    ("block_type", _S), ("text", _S), ("token_count", _I), ("quality_score", _D), ("language", _S), ("text_hash", _S), ("ocr_confidence", _D),
)
CANDIDATES = _of(("query_id", _S), ("chunk_id", _S), ("document_id", _S), ("rank", _I), ("score", _D), ("source", _S))
EVAL_CASES = _of(("query", _S), ("expected_chunk_ids", T.ArrayType(_S)), ("document_ids", T.ArrayType(_S)))

DOCUMENTS_TABLE = _of(
    ("id", _S), ("user_id", _S), ("original_filename", _S), ("display_name", _S), ("s3_bucket", _S), ("s3_key", _S), ("mime_type", _S), ("file_size_bytes", _L), ("page_count", _I),
    ("language", _S), ("document_type", _S), ("status", _S), ("error_message", _S), ("created_at", _TS), ("updated_at", _TS), ("deleted_at", _TS),
)
CHUNKS_TABLE = _of(
    ("id", _S), ("document_id", _S), ("user_id", _S), ("chunk_index", _I), ("section_id", _S), ("section_title", _S), ("page_number", _I), ("page_start", _I), ("page_end", _I),
    ("heading_path", T.ArrayType(_S)), ("block_type", _S), ("quality_score", _D), ("language", _S), ("text", _S), ("token_count", _I), ("prev_chunk_id", _S), ("next_chunk_id", _S),
    ("ocr_confidence", _D), ("qdrant_point_id", _S), ("opensearch_doc_id", _S), ("created_at", _TS),
)
CONVERSATIONS_TABLE = _of(("id", _S), ("user_id", _S), ("title", _S), ("created_at", _TS), ("updated_at", _TS), ("last_message_at", _TS), ("deleted_at", _TS))
MESSAGES_TABLE = _of(
    ("id", _S), ("conversation_id", _S), ("user_id", _S), ("role", _S), ("input_type", _S), ("content_text", _S), ("raw_audio_s3_key", _S), ("retrieved_chunk_ids", T.ArrayType(_S)),
    ("model_used", _S), ("latency_ms", _I), ("created_at", _TS),
)
REQUEST_LOGS = _of(("id", _S), ("request_id", _S), ("user_id", _S), ("method", _S), ("path", _S), ("status_code", _I), ("latency_ms", _I), ("request_summary", T.MapType(_S, _S)), ("error", _S), ("created_at", _TS))
STAGE_LOGS = _of(("id", _S), ("stage", _S), ("status", _S), ("document_id", _S), ("input_summary", T.MapType(_S, _S)), ("output_summary", T.MapType(_S, _S)), ("duration_ms", _L), ("error", _S), ("created_at", _TS))
SCHEMA_BY_TABLE = {
    "documents": DOCUMENTS_TABLE, "chunks": CHUNKS_TABLE, "conversations": CONVERSATIONS_TABLE, "messages": MESSAGES_TABLE, "api_request_logs": REQUEST_LOGS, "pipeline_stage_logs": STAGE_LOGS,
}
