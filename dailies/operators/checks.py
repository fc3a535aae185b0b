"""Rule checks: each returns the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailies.functions.arith import idiv, round_div
from dailies.operators.intervals import adjacent_overlaps
from dailies.operators.joins import interval_join
from dailies.operators.ordered import Splits, running
from dailies.operators.segment import islands

P = ["project_id"]


def _dur():
    return idiv(F.col("out_us") - F.col("in_us"), F.col("speed"))


def shot_length_limits(placed: DataFrame, *, switch_us: int = 360_000_000, early_us: int = 4_000_000, late_us: int = 7_000_000) -> DataFrame:
    limit = F.when(F.col("start_us") < switch_us, early_us).otherwise(late_us)
    return placed.select("project_id", "pos", "start_us", _dur().alias("dur_us"), limit.alias("limit_us")).where(F.col("dur_us") > F.col("limit_us"))


def shot_pace(placed: DataFrame, *, window_us: int = 30_000_000, until_us: int = 360_000_000, limit_us: int = 5_000_000) -> DataFrame:
    """Consecutive (not sliding) windows of the opening whose shots are too long on average.

    A shot counts in every window it touches; windows start before the programme ends.
    """
    total = placed.groupBy(*P).agg(F.max_by("end_us", "pos").alias("total"))
    last_bin = idiv(F.least("total", F.lit(until_us)) - 1, window_us)
    shots = placed.join(total, P).where(idiv("start_us", window_us) <= last_bin).select(
        "project_id", _dur().alias("dur_us"),
        F.explode(F.sequence(idiv("start_us", window_us), F.least(idiv(F.col("end_us") - 1, window_us), last_bin))).alias("bin"),
    )
    return (
        shots.groupBy("project_id", (F.col("bin") * window_us).alias("bin_us"))
        .agg(F.count("*").alias("shots"), F.sum("dur_us").alias("total_us"))
        .where((F.col("shots") >= 2) & (F.col("total_us") > F.col("shots") * limit_us))
    )


def dead_time(placed: DataFrame, captions: DataFrame, *, limit_ms: int = 12_000, splits: Splits | None = None) -> DataFrame:
    """Gaps between visual changes (to the millisecond) longer than ``limit_ms``."""
    total = placed.groupBy(*P).agg(F.max_by("end_us", "pos").alias("t"))
    ms = lambda c: round_div(F.col(c), 1000).alias("ms")
    changes = (
        placed.select("project_id", ms("start_us"))
        .unionByName(captions.join(total.select(*P), P, "left_semi").select("project_id", ms("s_us")))
        .unionByName(total.select("project_id", F.lit(0).cast("bigint").alias("ms")))
        .unionByName(total.select("project_id", ms("t")))
        .distinct()
    )
    return running(changes, P, ["ms"], {"to_ms": ("lead", F.col("ms"))}, splits).where(
        F.col("to_ms") - F.col("ms") > limit_ms
    ).select("project_id", F.col("ms").alias("from_ms"), "to_ms")


def aroll_runs(placed: DataFrame, *, limit_us: int = 10_000_000, splits: Splits | None = None) -> DataFrame:
    """Stretches of heard talking-head segments longer than ``limit_us`` (``aroll`` marks them)."""
    runs = islands(placed, P, ["pos"], ~(F.col("aroll") & F.col("__pa")), {"__pa": F.col("aroll")}, splits).where("aroll")
    return (
        runs.groupBy("project_id", "run").agg(F.min("start_us").alias("s_us"), F.max_by("end_us", "pos").alias("e_us"))
        .where(F.col("e_us") - F.col("s_us") > limit_us).drop("run")
    )


def aroll_share(placed: DataFrame, *, low: int = 30, high: int = 45) -> DataFrame:
    """Projects whose talking-head share of the runtime is outside ``low``..``high`` percent."""
    s = placed.groupBy(*P).agg(
        F.sum(F.when(F.col("aroll"), _dur()).otherwise(0)).alias("aroll_us"), F.max_by("end_us", "pos").alias("total_us")
    )
    pct = F.col("aroll_us") * 100
    return s.where((F.col("aroll_us") > 0) & ((pct < F.col("total_us") * low) | (pct > F.col("total_us") * high)))


def timeline_issues(placed: DataFrame, items: DataFrame, clips: DataFrame, *, slack_us: int = 50_000) -> DataFrame:
    """Structural problems as (project_id, code, ref) rows."""
    row = lambda df, code, ref: df.select("project_id", F.lit(code).alias("code"), F.col(ref).cast("bigint").alias("ref"))
    repeated = placed.groupBy("project_id", "beat").agg(F.count("*").alias("n")).where("n > 1")
    inside = placed.join(clips, "clip_id")
    parts = [
        row(placed.join(clips, "clip_id", "left_anti"), "unknown_clip", "pos"),
        row(inside.where((F.col("out_us") > F.col("dur_us") + slack_us) & (F.col("out_us") > F.col("in_us"))), "range_exceeds_clip", "pos"),
        row(placed.where((F.col("out_us") <= F.col("in_us")) | (F.col("in_us") < 0) | (F.col("speed") <= 0)), "bad_range", "pos"),
        row(repeated, "duplicate_id", "beat"),
        row(adjacent_overlaps(items, P, "item"), "overlapping_items", "next_id"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
