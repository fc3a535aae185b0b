"""Which shot a segment shows, and the beat labels around a point of the programme."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.operators.joins import asof_join

P = ["project_id"]


def shot_of_segment(segments: DataFrame, beats: DataFrame, *, slack_us: int = 50_000) -> DataFrame:
    """Index of the shot each segment shows, null for the beat's own picture: project_id, beat, pos, shot.

    ``segments``: project_id, beat, pos, clip_id, in_us; ``beats``: project_id, beat, clip_id, shots (array of clip_id,
    in_us in order). Both lists are walked forward together: a segment takes the next shot on its clip, unless it
    plays the beat's own clip and that shot starts elsewhere. A beat is one row, so the walk is an array fold.
    """
    mine = segments.groupBy("project_id", "beat").agg(F.sort_array(F.collect_list(F.struct("pos", "clip_id", "in_us"))).alias("segs"))
    b = beats.select("project_id", "beat", F.col("clip_id").alias("own"), "shots").join(mine, ["project_id", "beat"])
    start = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<pos:bigint,shot:int>>").alias("out"))

    def step(acc: Column, seg: Column) -> Column:
        rest = F.slice(F.col("shots"), acc["cursor"] + 1, F.greatest(F.size("shots"), F.lit(1)))
        at = F.array_position(F.transform(rest, lambda s: s["clip_id"]), seg["clip_id"]).cast("int")
        index = acc["cursor"] + at - 1
        elsewhere = (F.col("own") == seg["clip_id"]) & (F.abs(F.get(F.col("shots"), index)["in_us"] - seg["in_us"]) > slack_us)
        shot = F.when((at > 0) & ~F.coalesce(elsewhere, F.lit(False)), index)
        return F.struct(F.coalesce(shot + 1, acc["cursor"]).alias("cursor"), F.concat(acc["out"], F.array(F.struct(seg["pos"].cast("bigint").alias("pos"), shot.cast("int").alias("shot")))).alias("out"))

    walked = b.select("project_id", "beat", F.explode(F.aggregate("segs", start, step, lambda a: a["out"])).alias("x"))
    return walked.select("project_id", "beat", "x.pos", "x.shot")


def segment_labels(segments: DataFrame, beats: DataFrame) -> DataFrame:
    """``b012 (shot 2)`` or ``b012 (own picture)`` for each segment of a known beat: project_id, pos, label. ``beats`` also has name."""
    shown = shot_of_segment(segments, beats).join(beats.select("project_id", "beat", "name"), ["project_id", "beat"])
    what = F.when(F.col("shot").isNull(), "own picture").otherwise(F.concat(F.lit("shot "), (F.col("shot") + 1).cast("string")))
    return shown.select("project_id", "pos", F.concat("name", F.lit(" ("), what, F.lit(")")).alias("label"))


def labels_around(points: DataFrame, placed: DataFrame, labels: DataFrame, at: str, *, edge_us: int = 50_000) -> DataFrame:
    """The labels on either side of each point: columns of ``points`` with label_before and label_after.

    Before: the last labelled segment that starts more than ``edge_us`` earlier; after: the first segment that ends more
    than ``edge_us`` later (null if it has no label).
    """
    line = placed.select("project_id", "pos", "start_us", "end_us").join(labels, ["project_id", "pos"], "left")
    early = points.withColumns({"__b": F.col(at) - edge_us, "__a": F.col(at) + edge_us})
    began = line.where(F.col("label").isNotNull()).select("project_id", "pos", "start_us", F.col("label").alias("label_before"))
    out = asof_join(early, began, P, "__b", "start_us", ["label_before"], inclusive=False, tie=["pos"])
    ends = line.select("project_id", "pos", "end_us", F.col("label").alias("label_after"))
    out = asof_join(out, ends, P, "__a", "end_us", ["label_after"], direction="forward", inclusive=False, tie=["pos"])
    return out.select(*points.columns, "label_before", "label_after")
