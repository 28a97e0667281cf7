"""Text functions under SQL names; Catalyst inlines their bodies, so they cost what the expressions do."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _s(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(spark: SparkSession, prefix: str = "lx_") -> list[str]:
    """Create temporary SQL functions; their names."""
    from lexloom.functions import text as X

    solid = f"length(regexp_replace(coalesce(t, ''), {_s(X.WHITE)}, ''))"
    share = lambda p: f"CASE WHEN {solid} = 0 THEN 0.0D ELSE length(regexp_replace(coalesce(t, ''), {_s('[^' + p[1:-1] + ']+')}, '')) / {solid} END"
    n = prefix
    bodies = {
        "indic_ratio(t STRING) RETURNS DOUBLE": share(X.INDIC),
        "latin_ratio(t STRING) RETURNS DOUBLE": share(X.LATIN),
        "garbage_ratio(t STRING) RETURNS DOUBLE": f"CASE WHEN coalesce(t, '') = '' THEN 0.0D ELSE regexp_count(t, {_s(f'[{X.GARBAGE}]')}) / length(t) END",
        "strip(t STRING) RETURNS STRING": f"btrim(t, {_s(X.WHITE_CHARS)})",
        "language(t STRING) RETURNS STRING": f"CASE WHEN {n}indic_ratio(t) >= 0.15 AND {n}latin_ratio(t) >= 0.15 THEN 'mixed' WHEN {n}indic_ratio(t) >= 0.15 THEN 'as' WHEN {n}latin_ratio(t) >= 0.15 THEN 'en' ELSE 'as' END",
        "token_count(t STRING) RETURNS INT": f"CASE WHEN coalesce(t, '') = '' THEN 0 ELSE greatest(1, cast(floor(length(t) / CASE WHEN {n}indic_ratio(t) >= {n}latin_ratio(t) THEN 2.5D ELSE 4.0D END) AS int)) END",
        "quality(t STRING) RETURNS DOUBLE": f"CASE WHEN length({n}strip(coalesce(t, ''))) < 5 THEN 0.0D ELSE greatest(0.0D, least(1.0D, 0.5D * greatest({n}indic_ratio(t), {n}latin_ratio(t)) + 0.3D * (1.0D - {n}garbage_ratio(t) * 10) + 0.2D * least({n}latin_ratio(t) + {n}indic_ratio(t), 1.0D))) END",
        "content_hash(t STRING) RETURNS STRING": "sha2(coalesce(t, ''), 256)",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {n}{head} RETURN {body}")
    return [n + head.split("(")[0] for head in bodies]
