"""Whole flows: footage to catalogue, cut to programme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailies.operators import catalogue, layout, resolve, segment
from dailies.operators.ordered import Splits, running


def footage_to_catalogue(transcripts: DataFrame, instructions: DataFrame, attempts: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Transcripts and analyses to the flagged sentence catalogue; ``ord`` is clip order, then sentence."""
    sentences = segment.sentence_ids(segment.split_sentences(transcripts)).withColumn("ord", F.col("clip_id") * 1_048_576 + F.col("n"))
    return catalogue.sentence_catalogue(sentences, instructions, attempts, splits=splits)


def cut_to_programme(beats: DataFrame, *, fps: int = 30, splits: Splits | None = None) -> tuple[DataFrame, DataFrame]:
    """Beats with geometry to (placed segments, refused beats)."""
    resolved = resolve.resolve_beats(beats, fps=fps, splits=splits)
    pieces = running(resolve.beat_segments(resolved), ["project_id"], ["pos", "i"], {"__n": ("sum", F.lit(1).cast("bigint"))}, splits)
    rows = pieces.withColumn("beat", F.col("pos")).withColumn("pos", F.col("__n")).drop("__n")
    plain = rows.withColumns({"transition": F.lit("cut"), "transition_us": F.lit(0).cast("bigint"), "speed": F.lit(1)})
    return layout.place_segments(plain, fps=fps, splits=splits), resolved.where(F.col("error").isNotNull())
