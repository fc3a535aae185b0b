"""Structural validation of whole timelines: one issue row for each broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.operators.intervals import adjacent_overlaps
from dailies.operators.ordered import Splits, running

P = ["project_id"]
SLACK_US = 50_000


def _codes(*rules: tuple[Column, str]) -> Column:
    """Codes of the rules that are broken; a rule on a null value is not."""
    return F.filter(F.array(*[F.when(broken, F.lit(code)) for broken, code in rules]), lambda c: c.isNotNull())


def _exploded(df: DataFrame, ref: str, codes: Column) -> DataFrame:
    return df.select("project_id", F.col(ref).cast("string").alias("ref"), F.explode(codes).alias("code"))


def segment_issues(placed: DataFrame, clips: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Broken rules of the picture track: ranges, speeds, known clips and lengths, borrowed sound, heard windows, transitions, overlaps.

    ``placed``: project_id, pos, segment (its id), clip_id, in_us, out_us, speed, transition, transition_us, start_us, end_us and, null
    where a segment has none, audio_clip, audio_in_us, audio_out_us, window_in_us, window_out_us. ``clips``: clip_id, dur_us
    (null: unknown). One pass over the segments with two look-ups of clips; neighbours come from one running window.
    """
    known = clips.select("clip_id", "dur_us").dropDuplicates(["clip_id"])
    own = known.select(F.col("clip_id").alias("__c"), F.col("dur_us").alias("__d"))
    lent = known.select(F.col("clip_id").alias("__ac"), F.col("dur_us").alias("__ad"))
    s = running(placed, P, ["pos"], {"__pe": ("lag", F.col("end_us")), "__ps": ("lag", F.col("start_us"))}, splits)
    s = s.join(own, s["clip_id"] == own["__c"], "left").join(lent, s["audio_clip"] == lent["__ac"], "left")
    length = F.col("out_us") - F.col("in_us")
    borrowed, bad_audio = F.col("audio_clip").isNotNull(), F.col("audio_out_us") <= F.col("audio_in_us")
    foreign, early = F.col("__ac").isNull(), F.col("audio_in_us") < 0
    heard_in, heard_out = F.coalesce("audio_in_us", "in_us"), F.coalesce("audio_out_us", "out_us")
    empty_window = F.col("window_out_us") <= F.col("window_in_us")
    plays = F.col("end_us") - F.col("start_us")
    codes = _codes(
        (length <= 0, "empty_range"), (F.col("in_us") < 0, "negative_in"), (F.col("speed") <= 0, "bad_speed"), (F.col("__c").isNull(), "unknown_clip"),
        (F.col("__c").isNotNull() & (length > 0) & (F.col("out_us") > F.col("__d") + SLACK_US), "range_exceeds_clip"),
        (borrowed & foreign, "unknown_audio_clip"), (borrowed & ~foreign & bad_audio, "empty_audio_range"), (borrowed & ~foreign & ~bad_audio & early, "negative_audio_in"),
        (borrowed & ~foreign & ~bad_audio & ~early & (F.col("audio_out_us") > F.col("__ad") + SLACK_US), "audio_exceeds_clip"),
        (empty_window, "empty_window"), (~empty_window & ((F.col("window_in_us") < heard_in) | (F.col("window_out_us") > heard_out)), "window_outside_audio"),
        (F.col("transition_us") < 0, "negative_transition"), (F.col("transition_us") > plays, "transition_too_long"),
        (F.col("start_us") < F.col("__ps"), "starts_before_last"), ((F.col("__pe") > F.col("start_us")) & (F.col("transition") != "xfade"), "overlap_without_xfade"),
    )
    return _exploded(s, "segment", codes).unionByName(
        placed.groupBy("project_id", "segment").agg(F.count("*").alias("n")).where("n > 1").select("project_id", F.col("segment").cast("string").alias("ref"), F.lit("duplicate_id").alias("code"))
    )


def track_issues(items: DataFrame, totals: DataFrame, *, skip: tuple[str, ...] = (), splits: Splits | None = None) -> DataFrame:
    """Broken rules of captions, music, voice and effects.

    ``items``: project_id, track (caption, music, voice, sfx), item, s_us, e_us, text, style, has_file. ``skip`` leaves whole tracks out.
    """
    t = items.where(~F.col("track").isin(*skip)) if skip else items
    t = t.join(totals.select("project_id", "total_us"), P, "left")
    caption, music = F.col("track") == "caption", F.col("track") == "music"
    total = F.coalesce("total_us", F.lit(0))
    codes = _codes(
        ((caption | music) & (F.col("e_us") <= F.col("s_us")), "empty_range"), (caption & ((F.col("s_us") < 0) | (F.col("e_us") > total)), "outside_programme"),
        (caption & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty_text"), (music & (F.col("s_us") > total), "starts_after_end"),
        (F.col("track").isin("voice", "sfx") & (F.col("s_us") < 0), "negative_position"), (~caption & ~F.col("has_file"), "missing_file"),
    )
    alone = t.where((caption & (F.coalesce("style", F.lit("")) != "subtitle")) | music)
    crossing = adjacent_overlaps(alone, [*P, "track"], "item", splits=splits).select("project_id", F.col("next_id").cast("string").alias("ref"), F.concat("track", F.lit("_overlap")).alias("code"))
    named = F.transform(codes, lambda c: F.concat_ws("_", F.col("track"), c))
    return _exploded(t, "item", named).unionByName(crossing)


def mark_issues(marks: DataFrame, totals: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Broken rules of mutes, markers and chapters.

    ``marks``: project_id, kind (mute, marker, chapter), item (order of chapters), s_us, e_us, known (whether a mute's clip is).
    """
    m = marks.join(totals.select("project_id", "total_us"), P, "left")
    plain = _codes(
        ((F.col("kind") == "mute") & (F.col("e_us") <= F.col("s_us")), "mute_empty_range"), ((F.col("kind") == "mute") & ~F.col("known"), "mute_unknown_clip"),
        ((F.col("kind") == "marker") & (F.col("s_us") > F.coalesce("total_us", F.lit(0))), "marker_past_end"),
    )
    chapters = running(marks.where("kind = 'chapter'"), P, ["item"], {"__p": ("lag", F.col("s_us"))}, splits)
    late = _codes((F.col("s_us") <= F.coalesce("__p", F.lit(-1_000_000)), "chapter_not_ascending"), (F.col("__p").isNull() & (F.col("s_us") != 0), "first_chapter_not_zero"))
    return _exploded(m, "item", plain).unionByName(_exploded(chapters, "item", late))


def canvas_issues(projects: DataFrame) -> DataFrame:
    return _exploded(projects, "project_id", _codes((F.least("fps", "width", "height") <= 0, "bad_canvas")))


def validate_timelines(placed: DataFrame, clips: DataFrame, items: DataFrame, marks: DataFrame, projects: DataFrame, totals: DataFrame, *, skip: tuple[str, ...] = (), splits: Splits | None = None) -> DataFrame:
    """All rules together: project_id, ref, code."""
    out = segment_issues(placed, clips, splits=splits).unionByName(track_issues(items, totals, skip=skip)).unionByName(mark_issues(marks, totals))
    return out.unionByName(canvas_issues(projects))


def preflight(placed: DataFrame, clips: DataFrame, items: DataFrame, marks: DataFrame, projects: DataFrame, totals: DataFrame, sources: DataFrame, *, skip: tuple[str, ...] = ()) -> DataFrame:
    """What stands against a render: every broken rule, and each clip seen or heard that has no source file.

    ``skip`` names tracks that the render leaves out (music, voice).
    """
    used = placed.select("project_id", "clip_id").unionByName(placed.where("audio_clip IS NOT NULL").select("project_id", F.col("audio_clip").alias("clip_id"))).distinct()
    lost = used.join(sources.select("clip_id").distinct(), "clip_id", "left_anti")
    return validate_timelines(placed, clips, items, marks, projects, totals, skip=skip).unionByName(
        lost.select("project_id", F.col("clip_id").cast("string").alias("ref"), F.lit("missing_source").alias("code"))
    )
