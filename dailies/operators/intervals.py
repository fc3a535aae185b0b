"""Interval algebra over half-open ``[s, e)`` ranges in integer microseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators.joins import asof_join, interval_join
from dailies.operators.ordered import Splits, ordered_fold, running

S, E = "s_us", "e_us"


def _islands(df: DataFrame, keys: list[str], start: str, end: str, gap: int, splits: Splits | None) -> DataFrame:
    """Number the groups of ranges whose start is within ``gap`` of everything before them."""
    reach = running(df, keys, [start], {"__reach": ("max_before", F.col(end))}, splits)
    fresh = F.col("__reach").isNull() | (F.col(start) - F.col("__reach") > gap)
    return running(
        reach.withColumn("__new", fresh.cast("bigint")), keys, [start], {"__island": ("sum", F.col("__new"))}, splits
    )


def merge_ranges(
    df: DataFrame,
    keys: Sequence[str],
    *,
    merge_gap_us: int = 400_000,
    pad_us: int = 150_000,
    splits: Splits | None = None,
) -> DataFrame:
    """Pad ranges, then join those that touch or are at most ``merge_gap_us`` apart.

    Ranges with the same start are reduced to the longest before any window, so copies of one
    range never meet in one task.
    """
    keys = list(keys)
    padded = (
        df.where(F.col(E) > F.col(S))
        .select(*keys, F.greatest(F.col(S) - pad_us, F.lit(0)).alias(S), (F.col(E) + pad_us).alias(E))
        .groupBy(*keys, S)
        .agg(F.max(E).alias(E))
    )
    return (
        _islands(padded, keys, S, E, merge_gap_us, splits)
        .groupBy(*keys, "__island")
        .agg(F.min(S).alias(S), F.max(E).alias(E))
        .drop("__island")
    )


def subtract_ranges(
    spans: DataFrame, holes: DataFrame, keys: Sequence[str], span_id: str, *, splits: Splits | None = None
) -> DataFrame:
    """Parts of each span not covered by any hole, one row per surviving piece.

    A piece either starts at the span's own start (unless a hole covers it) or at the end of a
    merged hole, and runs to the next hole; so no span ever needs its holes gathered.
    """
    keys = list(keys)
    merged = merge_ranges(holes, keys, merge_gap_us=0, pad_us=0, splits=splits)
    merged = running(merged, keys, [S], {"h_next": ("lead", F.col(S))}, splits).select(
        *keys, F.col(S).alias("h_s"), F.col(E).alias("h_e"), "h_next"
    )
    spans = spans.where(F.col(E) > F.col(S)).select(*keys, span_id, S, E)
    head = asof_join(
        spans, merged, keys, S, "h_e", ["h_s"], direction="forward", inclusive=False, splits=splits
    ).select(*keys, span_id, S, F.least(F.col(E), F.coalesce("h_s", E)).alias(E))
    ends = merged.withColumn("h_e1", F.col("h_e") + 1)
    after = interval_join(spans, ends, keys, (S, E), ("h_e", "h_e1"), right_us=1).where(F.col("h_e") > F.col(S))
    tail = after.select(*keys, span_id, F.col("h_e").alias(S), F.least(F.col(E), F.coalesce("h_next", E)).alias(E))
    return head.unionByName(tail).where(F.col(E) > F.col(S))


def complement(
    df: DataFrame, windows: DataFrame, keys: Sequence[str], *, splits: Splits | None = None
) -> DataFrame:
    """Gaps between ranges inside each key's ``[w0_us, w1_us)``, including head and tail."""
    keys = list(keys)
    w0, w1 = F.col("w0_us"), F.col("w1_us")
    inside = (
        df.join(windows, keys)
        .select(*keys, w0, w1, F.greatest(S, w0).alias(S), F.least(E, w1).alias(E))
        .where(F.col(E) > F.col(S))
        .groupBy(*keys, "w0_us", "w1_us", S)
        .agg(F.max(E).alias(E))
    )
    cursor = running(inside, keys, [S], {"__cur": ("max_before", F.col(E))}, splits)
    gaps = cursor.select(*keys, F.coalesce("__cur", w0).alias(S), F.col(S).alias(E))
    last = inside.groupBy(*keys).agg(F.max(E).alias("__last"))
    tail = windows.join(last, keys, "left").select(*keys, F.coalesce("__last", w0).alias(S), w1.alias(E))
    return gaps.unionByName(tail).where(F.col(E) > F.col(S))


def coverage(spans: DataFrame, ranges: DataFrame, keys: Sequence[str], span_id: str) -> DataFrame:
    """Summed (not united) overlap of every span with the ranges, and whether it covers the span.

    ``covered_ppm`` is the fraction in millionths, capped at one; an empty span counts as covered.
    """
    keys = list(keys)
    other = ranges.select(*keys, F.col(S).alias("r_s"), F.col(E).alias("r_e"))
    hits = (
        interval_join(spans.select(*keys, span_id, S, E), other, keys, (S, E), ("r_s", "r_e"))
        .groupBy(*keys, span_id)
        .agg(F.sum(F.least(E, "r_e") - F.greatest(S, "r_s")).alias("overlap_us"))
    )
    length = F.col(E) - F.col(S)
    over = F.coalesce("overlap_us", F.lit(0))
    ppm = F.when(length <= 0, 1_000_000).otherwise(F.least(idiv(over * 1_000_000, F.greatest(length, F.lit(1))), F.lit(1_000_000)))
    return spans.select(*keys, span_id, S, E).join(hits, [*keys, span_id], "left").select(
        *keys, span_id, S, E, over.alias("overlap_us"), ppm.cast("bigint").alias("covered_ppm")
    )


def adjacent_overlaps(df: DataFrame, keys: Sequence[str], item: str, *, splits: Splits | None = None) -> DataFrame:
    """Neighbours by start time (ties by item) where the next begins before the previous ends."""
    specs = {"next_id": ("lead", F.col(item)), "next_s": ("lead", F.col(S))}
    return (
        running(df, keys, [S, item], specs, splits)
        .where(F.col("next_s") < F.col(E))
        .select(*keys, item, "next_id", (F.col(E) - F.col("next_s")).alias("overlap_us"))
    )


def intersect_ranges(left: DataFrame, right: DataFrame, keys: Sequence[str], *, longer_than_us: int = 1_000) -> DataFrame:
    """Every pairwise intersection longer than ``longer_than_us``; inputs carry ``a_id`` / ``b_id``."""
    a = left.select(*keys, "a_id", F.col(S).alias("a_s"), F.col(E).alias("a_e"))
    b = right.select(*keys, "b_id", F.col(S).alias("b_s"), F.col(E).alias("b_e"))
    pairs = interval_join(a, b, keys, ("a_s", "a_e"), ("b_s", "b_e"), min_overlap=longer_than_us)
    return pairs.select(
        *keys, "a_id", "b_id", F.greatest("a_s", "b_s").alias(S), F.least("a_e", "b_e").alias(E)
    )


def protected_ranges(analysis: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Instruction spans and every take attempt but the kept one, from per-clip documents.

    ``instructions`` is ARRAY<STRUCT<s_us,e_us>>; ``takes`` is
    ARRAY<STRUCT<attempts:ARRAY<STRUCT<s_us,e_us>>, keep:INT>>.  A negative ``keep`` counts from
    the end, a missing one means the last; an out-of-range one protects every attempt.
    """
    keys = list(keys)

    def losing(take: Column) -> Column:
        n = F.size(take["attempts"])
        keep = F.coalesce(take["keep"], n - 1)
        keep = F.when(keep < 0, keep + n).otherwise(keep)
        return F.when(n >= 2, F.filter(take["attempts"], lambda a, i: i != keep)).otherwise(F.slice(take["attempts"], 1, 0))

    rejected = F.flatten(F.transform("takes", losing))
    spans = analysis.select(
        *keys,
        F.explode(
            F.concat(
                F.transform("instructions", lambda i: F.struct(i[S].alias(S), i[E].alias(E), F.lit("instruction").alias("why"))),
                F.transform(rejected, lambda i: F.struct(i[S].alias(S), i[E].alias(E), F.lit("rejected_take").alias("why"))),
            )
        ).alias("__p"),
    )
    return spans.select(*keys, F.col("__p.s_us").alias(S), F.col("__p.e_us").alias(E), F.col("__p.why").alias("why")).where(
        F.col(E) > F.col(S)
    )


def duck_regions(
    speech: DataFrame,
    keys: Sequence[str],
    total: str,
    *,
    attack_us: int = 150_000,
    release_us: int = 600_000,
    pre_roll_us: int = 150_000,
    splits: Splits | None = None,
) -> DataFrame:
    """Merged gain envelopes (a0, a1, b0, b1) around speech, clamped to the ``total`` column."""
    keys = list(keys)
    t = F.col(total)
    a1 = F.greatest(F.col(S) - pre_roll_us, F.lit(0))
    b0 = F.greatest(F.when(t > 0, F.least(E, t)).otherwise(F.col(E)), a1)
    b1 = F.when(t > 0, F.least(b0 + release_us, t)).otherwise(b0 + release_us)
    shaped = (
        speech.where((F.col(E) > F.col(S)) & ~((t > 0) & (F.col(S) >= t)))
        .groupBy(*keys, total, S)
        .agg(F.max(E).alias(E))
        .select(
            *keys, F.col(S).alias("__s"), F.greatest(a1 - attack_us, F.lit(0)).alias("a0"),
            a1.alias("a1"), b0.alias("b0"), b1.alias("b1"),
        )
    )
    reach = running(shaped, keys, ["__s"], {"__reach": ("max_before", F.col("b1"))}, splits)
    fresh = (F.col("__reach").isNull() | (F.col("a0") > F.col("__reach"))).cast("bigint")
    return (
        running(reach.withColumn("__new", fresh), keys, ["__s"], {"__island": ("sum", F.col("__new"))}, splits)
        .groupBy(*keys, "__island")
        .agg(F.min("a0").alias("a0"), F.min("a1").alias("a1"), F.max("b0").alias("b0"), F.max("b1").alias("b1"))
        .drop("__island")
    )


def _envelope(t: Column) -> Column:
    a0, a1, b0, b1 = (F.col(c) for c in ("a0", "a1", "b0", "b1"))
    return (
        F.when(a0.isNull() | (t < a0) | (t >= b1), F.lit(0.0))
        .when(t < a1, (t - a0) / (a1 - a0))
        .when(t < b0, F.lit(1.0))
        .otherwise((b1 - t) / (b1 - b0))
    )


def duck_envelope(
    samples: DataFrame, regions: DataFrame, keys: Sequence[str], t: str, *, splits: Splits | None = None
) -> DataFrame:
    """Envelope value (0 open .. 1 ducked) at every sample time."""
    found = asof_join(samples, regions, keys, t, "a0", ["a0", "a1", "b0", "b1"], splits=splits)
    return found.select(*samples.columns, _envelope(F.col(t)).alias("env"))


def duck_keyframes(
    regions: DataFrame,
    keys: Sequence[str],
    *,
    base: float = 1.0,
    ducked: float = 0.25,
    step_us: int = 50_000,
    splits: Splits | None = None,
) -> DataFrame:
    """Gain keyframes of the envelopes: ramps sampled every ``step_us``, repeated gains dropped."""
    keys = list(keys)

    def ramp(lo: str, hi: str) -> Column:
        inner = F.col(hi) - F.col(lo) > step_us
        steps = F.when(inner, F.sequence(F.col(lo) + step_us, F.col(hi) - 1, F.lit(step_us))).otherwise(
            F.array().cast("array<bigint>")
        )
        return F.concat(F.array(lo), steps, F.array(hi))

    times = F.concat(ramp("a0", "a1"), ramp("b0", "b1"), F.array("b1"))
    points = regions.select(*keys, "a0", "a1", "b0", "b1", F.posexplode(times).alias("k", "t_us"))
    gain = F.round(F.lit(base) + F.lit(ducked - base) * _envelope(F.col("t_us")), 6)
    points = points.select(*keys, "t_us", (F.col("k") + 1).alias("k"), gain.alias("gain"))
    opening = regions.select(*keys).distinct().select(
        *keys, F.lit(-1).cast("bigint").alias("t_us"), F.lit(0).alias("k"), F.lit(float(base)).alias("gain")
    )
    lined = running(points.unionByName(opening), keys, ["t_us", "k"], {"__prev": ("lag", F.col("gain"))}, splits)
    return lined.where(F.col("__prev").isNull() | (F.abs(F.col("gain") - F.col("__prev")) >= 1e-6)).select(
        *keys, F.greatest("t_us", F.lit(0)).alias("t_us"), "gain"
    )


def silence_ranges(
    events: DataFrame, keys: Sequence[str], t: str, kind: str, order: str, duration: str, *, splits: Splits | None = None
) -> DataFrame:
    """Pair each silence end with the start right before it; close an open last start by duration."""
    specs = {
        "__pk": ("lag", F.col(kind)), "__pt": ("lag", F.col(t)), "__nk": ("lead", F.col(kind)),
    }
    lined = running(events, keys, [t, order], specs, splits)
    closed = lined.where((F.col(kind) == "end") & (F.col("__pk") == "start")).select(
        *keys, F.greatest("__pt", F.lit(0)).alias(S), F.col(t).alias(E)
    )
    opened = lined.where((F.col(kind) == "start") & F.col("__nk").isNull()).select(
        *keys, F.greatest(t, F.lit(0)).alias(S), F.col(duration).alias(E)
    )
    return closed.unionByName(opened).where(F.col(E) > F.col(S))


def mutes_by_gain(mutes: DataFrame, keys: Sequence[str], gain: str, *, splits: Splits | None = None) -> DataFrame:
    """Ranges numbered in time order inside each distinct gain of a key."""
    usable = mutes.where(F.col(E) > F.col(S)).groupBy(*keys, gain, S, E).agg(F.count("*").alias("copies"))
    return running(usable, [*keys, gain], [S, E], {"n": ("sum", F.lit(1).cast("bigint"))}, splits)


def mute_ranges_union(
    planned: DataFrame, flags: DataFrame, clips: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Planned mutes plus background-music flags that are not to be kept; the first of equals wins.

    ``planned``: keys, pos, s_us, e_us, gain_db.  ``flags``: keys, pos, s_us, e_us, suggest.  Equal
    means the same clip and the same bounds to the hundredth of a second; planned ones go first.
    """
    keys = list(keys)
    from_flags = flags.where(F.coalesce("suggest", F.lit("mute")) != "keep").select(
        *keys, F.lit(1).alias("src"), "pos", S, E,
        F.when(F.coalesce("suggest", F.lit("mute")) == "mute", -60).otherwise(-14).alias("gain_db"),
    )
    both = planned.select(*keys, F.lit(0).alias("src"), "pos", S, E, "gain_db").unionByName(from_flags)
    hundredth = lambda c: idiv(F.col(c) + 5_000, 10_000)
    first = F.min_by(F.struct(S, E, "gain_db", "src"), F.struct("src", "pos"))
    return (
        both.where(F.col(E) > F.col(S))
        .join(clips.select(*keys), keys, "left_semi")
        .groupBy(*keys, hundredth(S).alias("s_cs"), hundredth(E).alias("e_cs"))
        .agg(first.alias("__f"))
        .select(*keys, F.col("__f.s_us").alias(S), F.col("__f.e_us").alias(E), F.col("__f.gain_db").alias("gain_db"),
                F.col("__f.src").alias("src"))
    )


def apply_mute_edits(requests: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Apply add / update / delete requests in order; returns each request with its outcome.

    The state is the key's current list of ranges.  Requests address an entry by list index or,
    failing that, by its clip and bounds within a millisecond (the first match).  ``slot`` is the
    stable number of the entry touched (numbered by its adding), null when refused.
    """

    def start() -> dict:
        return {"live": [], "born": 0}

    def locate(state: dict, row) -> int:
        if row.index is not None and row.index == row.index and 0 <= int(row.index) < len(state["live"]):
            return int(row.index)
        for i, (_, clip, s, e) in enumerate(state["live"]):
            if clip == row.clip and abs(s - row.match_s) < 1_000 and abs(e - row.match_e) < 1_000:
                return i
        return -1

    def step(state: dict, row):
        live = state["live"]
        if row.op != "delete" and row.e_us <= row.s_us:
            return "bad_range", None, len(live)
        if row.op == "add":
            live.append((state["born"], row.clip, row.s_us, row.e_us))
            state["born"] += 1
            return "added", state["born"] - 1, len(live)
        at = locate(state, row)
        if at < 0:
            return "not_found", None, len(live)
        slot = live[at][0]
        if row.op == "delete":
            live.pop(at)
            return "deleted", slot, len(live)
        live[at] = (slot, row.clip, row.s_us, row.e_us)
        return "updated", slot, len(live)

    return ordered_fold(requests, keys, order, start, step, "outcome string; slot bigint; live bigint")
