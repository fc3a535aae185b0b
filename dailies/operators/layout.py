"""Programme layout: whole-frame placement and everything mapped through it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.functions.arith import idiv, round_div
from dailies.operators.intervals import merge_ranges
from dailies.operators.joins import asof_join, interval_join, longest, nearest_times, within_reach
from dailies.operators.ordered import Splits, running
from dailies.session import materialize

P = ["project_id"]


def frames(us: Column, fps: int) -> Column:
    """Nearest whole number of frames, halves up."""
    return idiv(us * (2 * fps) + 1_000_000, 2_000_000)


def frame_time(n: Column, fps: int) -> Column:
    return round_div(n * 1_000_000, fps)


def place_segments(
    segments: DataFrame, *, fps: int = 30, overlapping: Sequence[str] = ("xfade",), splits: Splits | None = None
) -> DataFrame:
    """Add the programme position of every segment, computed in whole frames.

    A segment lasts at least one frame; an overlapping transition pulls it back by at most its own
    and the previous length.  The start is the sum of earlier lengths less the overlaps so far.
    """
    length = F.greatest(frames(idiv(F.col("out_us") - F.col("in_us"), F.col("speed")), fps), F.lit(1).cast("bigint"))
    sized = segments.withColumn("len_f", length)
    sized = running(sized, P, ["pos"], {"__prev": ("lag", F.col("len_f"))}, splits)
    pulls = F.col("transition").isin(*overlapping) & F.col("__prev").isNotNull()
    sized = sized.withColumn(
        "overlap_f", F.when(pulls, F.least(frames(F.col("transition_us"), fps), "__prev", "len_f")).otherwise(0).cast("bigint")
    )
    specs = {"__sum": ("sum", F.col("len_f") - F.col("overlap_f"))}
    placed = running(sized, P, ["pos"], specs, splits).drop("__prev")
    start = F.col("__sum") - F.col("len_f")
    return placed.select(
        *segments.columns, "len_f", "overlap_f", start.alias("start_f"), (start + F.col("len_f")).alias("end_f"),
        frame_time(start, fps).alias("start_us"), frame_time(start + F.col("len_f"), fps).alias("end_us"),
    )


def beat_spans(placed: DataFrame, keys: Sequence[str] = ("project_id", "beat")) -> DataFrame:
    """Start of each beat's first segment and end of its last, by order."""
    return placed.groupBy(*keys).agg(
        F.min_by("start_us", "pos").alias("start_us"), F.max_by("end_us", "pos").alias("end_us"), F.min("pos").alias("first_pos")
    )


def beat_at(probes: DataFrame, spans: DataFrame, t: str, *, splits: Splits | None = None) -> DataFrame:
    """Last beat starting at or before ``t``; before the first one, the first beat."""
    hit = asof_join(probes, spans, P, t, "start_us", ["beat"], tie=["first_pos"], splits=splits)
    first = spans.groupBy(*P).agg(F.min_by("beat", "first_pos").alias("__first"))
    return hit.join(first, P, "left").withColumn("beat", F.coalesce("beat", "__first")).drop("__first")


def beat_ending_at(probes: DataFrame, spans: DataFrame, t: str, *, step_back_us: int = 50_000, splits: Splits | None = None) -> DataFrame:
    """Exclusive-end lookup: a boundary within ``step_back_us`` before ``t`` belongs to the beat before."""
    shifted = probes.withColumn("__t", F.col(t) - step_back_us)
    return beat_at(shifted, spans, "__t", splits=splits).drop("__t")


def sound_map(placed: DataFrame) -> DataFrame:
    """Segments with where their sound is read: ``a_clip``, ``a_in``, ``a_out``, and the audible part ``h_in``, ``h_out`` of it.

    A segment borrows the range ``sound_in_us``, ``sound_out_us`` of ``sound_clip_id`` where that is not null, else it is
    heard as its own picture. ``heard_in_us`` and ``heard_out_us`` (in the time of the clip that is heard) narrow what is
    audible; nulls, and columns that are not there, narrow nothing.
    """
    has = lambda c: F.col(c) if c in placed.columns else F.lit(None)
    borrowed = has("sound_clip_id").isNotNull()
    named = placed.withColumns({
        "a_clip": F.when(borrowed, has("sound_clip_id")).otherwise(F.col("clip_id")).cast(placed.schema["clip_id"].dataType),
        "a_in": F.when(borrowed, has("sound_in_us")).otherwise(F.col("in_us")).cast("bigint"),
        "a_out": F.when(borrowed, has("sound_out_us")).otherwise(F.col("out_us")).cast("bigint"),
    })
    return named.withColumns({"h_in": F.greatest("a_in", has("heard_in_us").cast("bigint")), "h_out": F.least("a_out", has("heard_out_us").cast("bigint"))})


def words_on_segments(placed: DataFrame, words: DataFrame, *, heard: bool = True) -> DataFrame:
    """Words mapped through every segment that plays them, in programme time.

    With ``heard`` words come from the clip that is heard (see sound_map), cut to the audible part, and muted segments are
    skipped; ``clip_id`` is that clip. Without it words of the picture's range count, whatever is heard.
    """
    if heard:
        segs = sound_map(placed.where(~F.col("muted"))).where("h_out > h_in").select("project_id", "pos", F.col("a_clip").alias("clip_id"), F.col("h_in").alias("g_in"), F.col("h_out").alias("g_out"), F.col("a_in").alias("g_from"), "speed", F.col("start_us").alias("g_start"))
    else:
        segs = placed.select("project_id", "pos", "clip_id", F.col("in_us").alias("g_in"), F.col("out_us").alias("g_out"), F.col("in_us").alias("g_from"), "speed", F.col("start_us").alias("g_start"))
    w = words.select("clip_id", F.col("pos").alias("word"), "s_us", "e_us", "text")
    # words are many: those before and after all segments of their clip stay where they are, others are posted for long segments only where there are some
    used = segs.groupBy(F.col("clip_id").alias("__clip")).agg(F.min("g_in").alias("__low"), F.max("g_out").alias("__high"), F.bool_or(F.col("g_out").isNull()).alias("__open"))
    inside = (F.col("clip_id") == F.col("__clip")) & (F.col("__open") | (F.col("s_us") < F.col("__high"))) & F.coalesce(F.col("e_us") > F.col("__low"), F.lit(True))
    w = w.join(used.hint("shuffle_hash"), inside, "left_semi")
    hit = interval_join(segs, w, ["clip_id"], ("g_in", "g_out"), ("s_us", "e_us"), left_us=longest(segs, "g_in", "g_out"))
    at = lambda x: F.col("g_start") + idiv(x - F.col("g_from"), F.col("speed"))
    return hit.select(
        "project_id", "pos", "clip_id", "word", "text",
        at(F.greatest("s_us", "g_in")).alias("s_us"), at(F.least("e_us", "g_out")).alias("e_us"),
    )


def speech_in_programme(placed: DataFrame, words: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    return merge_ranges(words_on_segments(placed, words), P, splits=splits)


def _local(x: Column, step_us: int = 100) -> Column:
    """Segment-local, post-speed time of an instant of the clip, in whole steps."""
    return round_div(idiv(x - F.col("g_from"), F.col("speed")), step_us) * step_us


def local_ranges(placed: DataFrame, ranges: DataFrame, range_id: str, *, of: str = "sound", step_us: int = 100, many: bool = False) -> DataFrame:
    """Clip-time ranges in segment-local, post-speed time (0.1 ms steps), clipped to the segment.

    ``of`` says whose range of which clip they meet: the 'sound' that is read for the segment (mutes), the 'audible' part
    of it (speech), or the 'picture'; ``clip_id`` is that clip. ``many``: most ranges lie beside all segments (words), and
    are not to be moved.
    """
    clip, low, high, start = {"sound": ("a_clip", "a_in", "a_out", "a_in"), "audible": ("a_clip", "h_in", "h_out", "a_in"), "picture": ("clip_id", "in_us", "out_us", "in_us")}[of]
    segs = sound_map(placed).select("project_id", "pos", F.col(clip).alias("clip_id"), F.col(low).alias("g_in"), F.col(high).alias("g_out"), F.col(start).alias("g_from"), "speed", "start_us", "muted")
    r, segs = ranges.select("clip_id", range_id, "s_us", "e_us"), segs.where("g_out > g_in")
    length = None
    if many:
        segs = materialize(segs)  # for its two readers
        r, length = within_reach(r, segs.select("clip_id", F.col("g_in").alias("s"), F.col("g_out").alias("e")), "clip_id", ("s_us", "e_us"))
    hit = interval_join(segs, r, ["clip_id"], ("g_in", "g_out"), ("s_us", "e_us"), right_us=length)
    return hit.select(
        "project_id", "pos", "clip_id", range_id, "start_us", "muted", _local(F.greatest("s_us", "g_in"), step_us).alias("s_us"),
        _local(F.least("e_us", "g_out"), step_us).alias("e_us"),
    )


def audible_windows(placed: DataFrame) -> DataFrame:
    """Segments of which only a part is heard: its start and end in segment-local, post-speed time; one without any has an empty one."""
    cut = sound_map(placed).where((F.col("h_in") > F.col("a_in")) | (F.col("h_out") < F.col("a_out"))).withColumn("g_from", F.col("a_in"))
    return cut.select("project_id", "pos", F.col("a_clip").alias("clip_id"), _local(F.col("h_in")).alias("s_us"), _local(F.greatest("h_in", "h_out")).alias("e_us"))


def mutes_in_programme(placed: DataFrame, mutes: DataFrame, range_id: str) -> DataFrame:
    """Each mute once per unmuted segment whose picture uses its slice, in programme time (a track display goes by the picture)."""
    hit = local_ranges(placed.where(~F.col("muted")), mutes, range_id, of="picture", step_us=1)
    return hit.select(
        "project_id", "pos", "clip_id", range_id,
        (F.col("start_us") + F.col("s_us")).alias("s_us"), (F.col("start_us") + F.col("e_us")).alias("e_us"),
    )


def to_render_time(probes: DataFrame, placed: DataFrame, rendered: DataFrame, t: str, *, splits: Splits | None = None) -> DataFrame:
    """Programme time to rendered time: the offset of the covering segment, or of the last one."""
    both = placed.select("project_id", "pos", "start_us", "end_us").join(
        rendered.select("project_id", "pos", F.col("start_us").alias("r_start")), ["project_id", "pos"]
    ).withColumn("shift", F.col("r_start") - F.col("start_us"))
    hit = asof_join(probes, both, P, t, "end_us", ["shift"], direction="forward", inclusive=False, tie=["pos"], splits=splits)
    last = both.groupBy(*P).agg(F.max_by("shift", "pos").alias("__last"))
    return hit.join(last, P).select(
        *P, *[c for c in probes.columns if c not in P], F.greatest(F.col(t) + F.coalesce("shift", "__last"), F.lit(0)).alias("render_us")
    )


def near_instant(probes: DataFrame, items: DataFrame, keys: Sequence[str], t: str, *, around_us: int) -> DataFrame:
    """Items whose closed span meets the closed ``[t - around, t + around]``."""
    p = probes.withColumns({"__from": F.col(t) - around_us, "__till": F.col(t) + around_us + 1})
    it = items.withColumn("__e1", F.col("e_us") + 1)
    return interval_join(p, it, keys, ("__from", "__till"), ("s_us", "__e1"), left_us=2 * around_us + 1).drop("__from", "__till", "__e1")


def speech_geometry(
    beats: DataFrame, words: DataFrame, protected: DataFrame, *, fps: int = 30, pad_before_us: int = 300_000,
    pad_after_us: int = 450_000, guard_us: int = 50_000, splits: Splits | None = None,
) -> DataFrame:
    """Picture and sound limits of spoken beats (clip_id, beat, first_us, last_us, dur_us).

    Sound keeps ``guard_us`` from the neighbouring words and stays out of protected ranges, but
    never cuts the beat's own words.
    """
    k = ["clip_id"]
    ends = lambda df: df.select("clip_id", F.col("e_us").alias("at"))
    starts = lambda df: df.select("clip_id", F.col("s_us").alias("at"))
    both = nearest_times(beats, k, "first_us", {"prev_e": ends(words), "stop_e": ends(protected)}, splits=splits)
    both = nearest_times(both, k, "last_us", {"next_s": starts(words), "stop_s": starts(protected)}, direction="forward", splits=splits)
    limit = F.col("dur_us") - frame_time(F.lit(1), fps)
    seg_in = F.greatest(F.col("first_us") - pad_before_us, F.lit(0))
    seg_out = F.least(F.col("last_us") + pad_after_us, limit)
    a0 = F.least(F.greatest(seg_in, F.col("prev_e") + guard_us, F.col("stop_e")), "first_us")
    a1 = F.greatest(F.least(seg_out, F.col("next_s") - guard_us, F.col("stop_s"), limit), "last_us")
    return both.select(*beats.columns, seg_in.alias("seg_in"), seg_out.alias("seg_out"), a0.alias("a0"), a1.alias("a1"))


def tight_joins(beats: DataFrame, *, min_air_us: int = 350_000, splits: Splits | None = None) -> DataFrame:
    """Neighbouring spoken beats whose tail plus head pause is too short (joined takes excepted)."""
    specs = {"__pe": ("lag", F.col("tail_us")), "__pk": ("lag", F.col("kind")), "prev": ("lag", F.col("beat"))}
    lined = running(beats, P, ["pos"], specs, splits)
    both = (F.col("kind") == "speech") & (F.col("__pk") == "speech") & ~F.col("joined")
    return lined.where(both & (F.col("__pe") + F.col("head_us") < min_air_us)).select(
        *P, "prev", "beat", (F.col("__pe") + F.col("head_us")).alias("air_us")
    )


def voice_shots(shots: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Shots under a narration: chained from 0, cut at its length, the last stretched over the rest.

    Input: project_id, beat, pos, in_us, out_us, length_us (narration), clip_us (footage length). The last visible
    shot is stretched only if its footage covers all that is missing; else the beat has no pieces (see
    ``uncovered_voice``).
    """
    laid, bad = _voice_layout(shots, splits)
    return laid.join(bad.select("project_id", "beat"), ["project_id", "beat"], "left_anti").select("project_id", "beat", "pos", "at_us", "in_us", "out_us")


def uncovered_voice(shots: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Narrated beats whose shots, even stretched, end before the narration: project_id, beat, missing_us."""
    return _voice_layout(shots, splits)[1]


def _voice_layout(shots: DataFrame, splits: Splits | None) -> tuple[DataFrame, DataFrame]:
    keys = ["project_id", "beat"]
    dur = F.col("out_us") - F.col("in_us")
    lined = running(shots, keys, ["pos"], {"__end": ("sum", dur)}, splits)
    lined = lined.withColumn("at_us", F.col("__end") - dur).where(F.col("at_us") < F.col("length_us"))
    lined = running(lined, keys, ["pos"], {"__next": ("lead", F.col("pos"))}, splits)
    want = F.col("in_us") + F.col("length_us") - F.col("at_us")
    last = F.col("__next").isNull()
    lacking = F.when(last & (F.col("__end") < F.col("length_us")) & (want > F.col("clip_us")), F.col("length_us") - F.col("__end"))
    laid = lined.withColumn("missing_us", lacking).withColumn("out_us", F.when(last, want).otherwise(F.col("out_us")))
    return laid, laid.where(F.col("missing_us").isNotNull()).select(*keys, "missing_us")


def clip_first_use(segments: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Distinct clips of a project numbered by first use."""
    first = segments.groupBy("project_id", "clip_id").agg(F.min("pos").alias("first_pos"))
    return running(first, P, ["first_pos", "clip_id"], {"n": ("sum", F.lit(1).cast("bigint"))}, splits).drop("first_pos")


def content_end(placed: DataFrame, items: DataFrame) -> DataFrame:
    """Furthest point any track of a project reaches."""
    video = placed.groupBy(*P).agg(F.max_by("end_us", "pos").alias("v"))
    other = items.groupBy(*P).agg(F.max("e_us").alias("o"))
    return video.join(other, P, "left").select(*P, F.greatest("v", "o").alias("end_us"))


def trim_cues(cues: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Cues cut where the next one starts; of several with one start the last stays."""
    kept = cues.groupBy("project_id", "s_us").agg(F.max_by(F.struct("item", "e_us"), "item").alias("__c")).select(
        "project_id", F.col("__c.item").alias("item"), "s_us", F.col("__c.e_us").alias("e_us")
    )
    lined = running(kept, P, ["s_us"], {"__next": ("lead", F.col("s_us"))}, splits)
    return lined.select("project_id", "item", "s_us", F.least("e_us", F.coalesce("__next", "e_us")).alias("e_us")).where(F.col("e_us") > F.col("s_us"))
