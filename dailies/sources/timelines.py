"""Timeline documents: the version gate, typed segments of accepted ones, reasons of refused ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the version that is read.
VERSION = 2
SEGMENT = "struct<id: string, clip: string, `in`: double, `out`: double, speed: double, mute_source: boolean>"
BODY = f"tracks struct<video: array<{SEGMENT}>>, broken string"


def gate_timelines(docs: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """Accepted documents (``key``, ``segments``) and refused ones (``key``, ``reason``, ``version``) of JSON texts in ``doc``.

    A document is refused as 'unreadable' (no JSON, or null), 'not_an_object', 'no_version', 'version' (any but the number
    VERSION; a text that looks like it is none), or 'invalid' (a field of another type, or a segment without id, clip,
    in or out). Both come from one parsed row each; nothing is dropped between them.
    """
    value = F.try_parse_json("doc")
    kind = F.schema_of_variant(F.variant_get(value, "$.version", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$.version", "double"))
    body = F.from_json("doc", BODY, {"columnNameOfCorruptRecord": "broken"})
    parsed = docs.select(key, value.isNull().alias("unreadable"), F.schema_of_variant(value).startswith("OBJECT").alias("object"), kind.alias("kind"), number.alias("number"), F.try_variant_get(value, "$.version", "string").alias("version"), body.alias("body"))
    segments = F.coalesce("body.tracks.video", F.array().cast(f"array<{SEGMENT}>"))
    lacking = F.exists(segments, lambda s: s.isNull() | s["id"].isNull() | s["clip"].isNull() | s["in"].isNull() | s["out"].isNull())
    reason: Column = (
        F.when(F.col("unreadable"), "unreadable").when(~F.col("object"), "not_an_object").when(F.col("kind").isNull() | (F.col("kind") == "VOID"), "no_version")
        .when(~F.coalesce(F.col("number") == VERSION, F.lit(False)), "version").when(F.col("body.broken").isNotNull() | lacking, "invalid")
    )
    told = parsed.select(key, reason.alias("reason"), "version", segments.alias("segments"))
    return told.where("reason IS NULL").select(key, "segments"), told.where("reason IS NOT NULL").select(key, "reason", "version")


def timeline_segments(accepted: DataFrame, key: str = "project_id") -> DataFrame:
    """One row for each segment of accepted documents, times as integer microseconds; speed and sound default to 1 and heard."""
    us = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    rows = accepted.select(key, F.posexplode("segments").alias("pos", "s"))
    return rows.select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("s.id").alias("segment"), F.col("s.clip").alias("clip"), us("s.in").alias("in_us"), us("s.out").alias("out_us"),
        F.coalesce("s.speed", F.lit(1.0)).alias("speed"), F.coalesce("s.mute_source", F.lit(False)).alias("muted"),
    )
