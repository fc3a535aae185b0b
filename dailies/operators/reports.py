"""Roll-ups, conformance checks and look-ups that read several tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.functions.rules import ENDING_GUARD, PLAN_ENDING_GUARD
from dailies.operators.dedupe import drop_stutters
from dailies.operators.intervals import merge_ranges, subtract_ranges
from dailies.operators.joins import asof_join, interval_join, overlapped, within_reach
from dailies.operators.layout import words_on_segments
from dailies.operators.ordered import Splits, running
from dailies.operators.segment import gap_cues, keep_ranges
from dailies.session import materialize

P = ["project_id"]
CLIP = ["project_id", "clip_id"]


def _cut_marked(words: DataFrame, cuts: DataFrame, keys: list[str], splits: Splits | None = None) -> DataFrame:
    """Words with ``__cut``, whether a cut overlaps them or another copy of theirs; a null position has no copies and is not cut."""
    spans = cuts.select(*keys, F.col("s_us").alias("s"), F.col("e_us").alias("e"))
    marked = overlapped(words, spans, keys, ("s_us", "e_us"), "__cut", splits=splits)
    return marked.withColumn("__cut", F.max("__cut").over(Window.partitionBy(*keys, "pos")) & F.col("pos").isNotNull())


def _drop_marked(words: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Words with ``__dropped``, whether their sentence is among ``dropped`` (keys, n); beside each other, not joined. Nulls match nothing."""
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "n")])
    line = words.withColumn("__gone", F.lit(False)).unionByName(dropped.where(known).select(*keys, "n", F.lit(True).alias("__gone")), allowMissingColumns=True)
    line = line.withColumn("__dropped", F.max("__gone").over(Window.partitionBy(*keys, "n")) & F.coalesce(known, F.lit(False)))
    return line.where(~F.col("__gone")).select(*words.columns, "__dropped")


def without_cuts(words: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words that overlap none of the given cut ranges."""
    return _cut_marked(words, cuts, list(keys)).where(~F.col("__cut")).select(*words.columns)


def clean_narration(words: DataFrame, dropped_sentences: DataFrame, cuts: DataFrame, keys: Sequence[str] = CLIP, *, splits: Splits | None = None) -> DataFrame:
    """Kept time ranges of a narration after sentence drops, manual cuts and stutters, in that order.

    ``words`` carry the sentence number ``n``; ``dropped_sentences`` names (keys, n) already ruled out. Words that go are
    marked and stay in the stream, so that the stream is never joined with itself. A word of which one copy stays, stays.
    """
    keys = list(keys)
    at = [*keys, "pos"]
    marked = _cut_marked(_drop_marked(words.select(*keys, "n", "pos", "s_us", "e_us", "text"), dropped_sentences, keys), cuts, keys, splits)
    marked = marked.select(*at, "s_us", "e_us", "text", (F.col("__cut") | F.col("__dropped")).alias("__gone"))
    lined = drop_stutters(marked, keys, gone=F.col("__gone"), splits=splits)
    stays = ~F.col("__gone") & F.col("reason").isNull()
    for c in at:
        stays = stays & F.col(c).isNotNull()
    mask = lined.select(*at, "s_us", "e_us", F.max(stays).over(Window.partitionBy(*at)).alias("keep"))
    return keep_ranges(mask, keys, splits=splits)


def programme_cues(placed: DataFrame, words: DataFrame) -> DataFrame:
    """Subtitle cues in programme time from the words of the pictures shown."""
    on = words_on_segments(placed, words, heard=False)
    # one programme-time order per project, ties by segment and word
    return gap_cues(on.drop("clip_id"), P, order=["s_us", "pos", "word"])


def footage_log(clips: DataFrame, transcripts: DataFrame, instructions: DataFrame, music: DataFrame) -> DataFrame:
    """Totals per project over the registry, with its transcripts and analyses where they exist."""
    t = transcripts.groupBy(*CLIP).agg(F.sum("n_words").alias("n_words"), F.bool_or("mismatch").alias("mismatch"))
    i = instructions.groupBy(*CLIP).agg(F.count("*").alias("instructions"))
    m = music.groupBy(*CLIP).agg(F.count("*").alias("music"))
    j = clips.join(t, CLIP, "left").join(i, CLIP, "left").join(m, CLIP, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return j.groupBy(*P).agg(
        F.count("*").alias("clips"), total("duration_us"), total("n_words"), total("instructions"), total("music"),
        F.count(F.when(F.col("n_words").isNull(), 1)).alias("untranscribed"), F.count(F.when(F.col("mismatch"), 1)).alias("mismatches"),
    )


def rank_frames(frames: DataFrame, *, top: int = 12, splits: Splits | None = None) -> DataFrame:
    """Best thumbnail frames: flagged candidates first, then quality, then order; the report keeps ``top``."""
    keyed = frames.withColumns({"__late": F.when(F.col("candidate"), 0).otherwise(1).cast("bigint"), "__worse": -F.col("quality")})
    lined = running(keyed, P, ["__late", "__worse", "pos"], {"rank": ("sum", F.lit(1).cast("bigint"))}, splits)
    return lined.where(F.col("rank") <= top).drop("__late", "__worse")


def compact_transcripts(transcripts: DataFrame, sentences: DataFrame, *, budget: int = 6_000) -> DataFrame:
    """Words as JSON if that fits the budget, else numbered sentences, else the text cut to length."""
    as_json = F.to_json(F.transform("words", lambda w: F.struct(w["text"].alias("t"), w["s_us"].alias("s"))))
    text = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    packed = F.array_sort(F.collect_list(F.struct("n", F.concat_ws(" ", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("]")), "text").alias("l"))))
    s = sentences.groupBy(*CLIP).agg(F.array_join(F.transform(packed, lambda x: x["l"]), "\n").alias("by_sentence"))  # one clip's sentences
    j = transcripts.select(*CLIP, as_json.alias("j"), text.alias("t")).join(s, CLIP, "left")
    return j.select(
        *CLIP, F.when(F.length("j") <= budget, "words").when(F.length("by_sentence") <= budget, "sentences").otherwise("text").alias("level"),
        F.when(F.length("j") <= budget, F.col("j")).when(F.length("by_sentence") <= budget, F.col("by_sentence")).otherwise(F.substring("t", 1, budget)).alias("content"),
    )


def planner_sentences(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows shown to the planner: no instructions, losers marked with why they may be skipped."""
    skip = F.when(F.col("retake_of").isNotNull(), "retake").when(F.col("duplicate_of").isNotNull(), "duplicate")
    return catalogue.where("not instruction").select(*CLIP, "n", skip.alias("skip"))


def segment_keys(segments: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Content key of every segment: a digest of the fields that decide what it looks like."""
    return segments.withColumn("key", F.sha1(F.to_json(F.struct(*fields))))


def orphan_keys(cache: DataFrame, segments: DataFrame, fields: Sequence[str]) -> DataFrame:
    return cache.join(segment_keys(segments, fields).select("key"), "key", "left_anti")


def denoise_backlog(flagged: DataFrame, *, price_micro_per_minute: int) -> DataFrame:
    """Windy clips not yet denoised per project, and what denoising them would cost (free when the engine is local)."""
    todo = flagged.where((F.col("flag") == "windy") & ~F.col("denoised"))
    cost = idiv(F.sum("duration_us") * price_micro_per_minute, 60_000_000)
    return todo.groupBy(*P).agg(F.count("*").alias("clips"), cost.alias("usd_micro"))


def project_overview(clips: DataFrame, stages: DataFrame, costs: DataFrame, names: Sequence[str]) -> DataFrame:
    """Clip count, one status column per stage, spend, and whether the render is older than the plan."""
    c = clips.groupBy(*P).agg(F.count("*").alias("clips"))
    status = [F.coalesce(F.max_by(F.when(F.col("stage") == s, F.col("status")), F.when(F.col("stage") == s, F.col("ts"))), F.lit("pending")).alias(s) for s in names]
    at = lambda s: F.max(F.when(F.col("stage") == s, F.col("ts")))
    st = stages.groupBy(*P).agg(*status, F.coalesce(at("render") < at("plan"), F.lit(False)).alias("stale"))
    spent = costs.groupBy(*P).agg(F.sum("usd_micro").alias("usd_micro"))
    j = c.join(st, P, "left").join(spent, P, "left")
    return j.select(*P, "clips", *[F.coalesce(s, F.lit("pending")).alias(s) for s in names], F.coalesce("stale", F.lit(False)).alias("stale"), F.coalesce("usd_micro", F.lit(0)).cast("bigint").alias("usd_micro"))


def size_music(cues: DataFrame, plan: DataFrame, *, least_us: int = 30_000_000) -> DataFrame:
    """Length to ask for per cue (at least 30 s), mood from the cut or else from the plan's cue of that id."""
    p = plan.select("project_id", "item", F.col("mood").alias("plan_mood"))
    return cues.where(F.col("e_us") > F.col("s_us")).join(p, ["project_id", "item"], "left").select(
        "project_id", "item", F.greatest(F.col("e_us") - F.col("s_us"), F.lit(least_us)).alias("length_us"), F.coalesce("mood", "plan_mood").alias("mood")
    )


def level_windows(blocks: DataFrame, *, length_us: int, points: int = 8) -> DataFrame:
    """Mean power of evenly spaced candidate windows per clip; the loudest and the quietest of each."""
    span = blocks.groupBy("clip_id").agg(F.max("e_us").alias("end"))
    step = F.greatest(F.col("end") - length_us, F.lit(0))
    grid = span.select("clip_id", "end", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: idiv(step * i, points - 1)))).alias("w_s"))
    grid = grid.withColumn("w_e", F.least(F.col("w_s") + length_us, F.col("end")))
    pts = blocks.select("clip_id", "s_us", (F.col("s_us") + 1).alias("s1"), "sum_sq", "n")
    w = interval_join(pts, grid.select("clip_id", "w_s", "w_e"), ["clip_id"], ("s_us", "s1"), ("w_s", "w_e")).groupBy("clip_id", "w_s").agg((F.sum("sum_sq") / F.sum("n")).alias("power"))
    return w.groupBy("clip_id").agg(
        F.max_by("w_s", F.struct("power", -F.col("w_s"))).alias("loudest_us"), F.min_by("w_s", F.struct("power", "w_s")).alias("quietest_us"), F.max("power").alias("loudest_power")
    )


def clip_badges(analysis: DataFrame) -> DataFrame:
    """Counts shown on a clip card, from its analysis document alone."""
    extra = F.aggregate("takes", F.lit(0), lambda n, t: n + F.greatest(F.size(t["attempts"]) - 1, F.lit(0)))
    return analysis.select(*CLIP, F.size("instructions").alias("instructions"), extra.alias("extra_takes"))


def clip_flags(analyses: DataFrame, transcripts: DataFrame) -> DataFrame:
    """All badges of a clip from its typed analysis and its transcript's header (clip_id, language, language_mismatch); either may be missing."""
    extra = F.aggregate("takes", F.lit(0), lambda n, t: n + F.greatest(F.size(t["attempts"]) - 1, F.lit(0)))
    place = F.array_join(F.filter(F.array("location.name", "location.city"), lambda x: x != ""), ", ")
    a = analyses.select(
        "clip_id", "kind", F.size("instructions").alias("instructions"), extra.alias("takes"), F.size("background_music").alias("background_music"), "summary", place.alias("location"),
        F.col("visual.thumbnail_candidate").alias("thumbnail_candidate"),
    )
    both = a.join(transcripts.select("clip_id", F.col("language").alias("transcript_language"), "language_mismatch"), "clip_id", "full")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("instructions", "takes", "background_music")}
    no = {c: F.coalesce(c, F.lit(False)) for c in ("thumbnail_candidate", "language_mismatch")}
    return both.withColumns({**zero, **no, **{c: F.coalesce(c, F.lit("")) for c in ("summary", "location")}})


def ending_guard(cues: DataFrame, totals: DataFrame, *, tail_us: int = 3_000_000) -> DataFrame:
    """Projects whose last seconds contain a wrap-up phrase (cues joined in order; the tail is a few cues)."""
    tail = cues.join(totals, P).where((F.col("s_us") < F.col("total_us")) & (F.col("e_us") > F.col("total_us") - tail_us))
    packed = F.array_sort(F.collect_list(F.struct("s_us", "text")))
    said = tail.groupBy(*P).agg(F.array_join(F.transform(packed, lambda x: x["text"]), " ").alias("said"))
    return said.withColumn("phrase", F.regexp_extract("said", f"({ENDING_GUARD})", 1)).where(F.col("phrase") != "").select("project_id", "phrase")


def plan_endings(captions: DataFrame, totals: DataFrame, notes: DataFrame, *, tail_us: int = 5_000_000) -> DataFrame:
    """Wrap-up phrases that a plan holds in its last seconds: in captions that end there, or in the notes of its last segment.

    ``notes``: project_id, item, text of each project's last segment. One row for each place with a phrase.
    """
    late = captions.join(totals, P).where(F.col("e_us") >= F.col("total_us") - tail_us).select("project_id", F.lit("caption").alias("place"), "item", "text")
    said = late.unionByName(notes.select("project_id", F.lit("notes").alias("place"), "item", "text"))
    phrase = F.regexp_extract(F.coalesce("text", F.lit("")), f"({PLAN_ENDING_GUARD})", 1)
    return said.withColumn("phrase", phrase).where(F.col("phrase") != "").select("project_id", "place", "item", "phrase")


def file_conformance(probes: DataFrame, *, codec: str = "h264", pix_fmt: str = "yuv420p", width: int = 1920, height: int = 1080, fps: int = 30) -> DataFrame:
    """Every rule a rendered file breaks."""
    c = F.col
    found = F.array(
        F.when(~c("codec").eqNullSafe(codec), "codec"), F.when(~c("pix_fmt").eqNullSafe(pix_fmt), "pix_fmt"), F.when((c("display_width") != width) | (c("display_height") != height), "size"),
        F.when(c("fps_int") != fps, "fps"), F.when(c("hdr").isNotNull(), "hdr"), F.when(c("rotation") != 0, "rotation"),
    )
    return probes.select("clip_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def loudness_conformance(measured: DataFrame, *, target_milli: int = -14_000) -> DataFrame:
    """Files off the loudness target by over 1 LU (1.5 for previews) or above the peak ceiling (milli-units)."""
    slack = F.when(F.col("preview"), 1_500).otherwise(1_000)
    ceiling = F.when(F.col("preview"), 0).otherwise(-1_000)
    found = F.array(F.when(F.abs(F.col("lufs_milli") - target_milli) > slack, "loudness"), F.when(F.col("peak_milli") > ceiling, "true_peak"))
    return measured.select("item", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def music_separation(music: DataFrame, speech: DataFrame, blocks: DataFrame, keys: Sequence[str], *, least_us: int = 3_000_000, splits: Splits | None = None) -> DataFrame:
    """Mean power of music alone and of speech over music, where each lasts long enough."""
    keys = list(keys)
    m = merge_ranges(music, keys, merge_gap_us=0, pad_us=0, splits=splits).withColumn("rid", F.col("s_us"))
    talk = merge_ranges(speech, keys, merge_gap_us=0, pad_us=0, splits=splits)
    alone = subtract_ranges(m, talk, keys, "rid", splits=splits).select(*keys, "s_us", "e_us", F.lit("alone").alias("part"))
    t = talk.select(*keys, F.col("s_us").alias("t_s"), F.col("e_us").alias("t_e"))
    both = interval_join(m, t, keys, ("s_us", "e_us"), ("t_s", "t_e")).select(*keys, F.greatest("s_us", "t_s").alias("s_us"), F.least("e_us", "t_e").alias("e_us"), F.lit("under").alias("part"))
    parts = alone.unionByName(both)
    length = parts.groupBy(*keys).agg(*[F.sum(F.when(F.col("part") == p, F.col("e_us") - F.col("s_us")).otherwise(0)).alias(f"{p}_us") for p in ("alone", "under")])
    pts = blocks.select(*keys, F.col("s_us").alias("b_s"), (F.col("s_us") + 1).alias("b_e"), "sum_sq", "n")
    lv = interval_join(pts, parts, keys, ("b_s", "b_e"), ("s_us", "e_us")).groupBy(*keys).agg(
        *[F.sum(F.when(F.col("part") == p, F.col("sum_sq"))).alias(f"{p}_sq") for p in ("alone", "under")], *[F.sum(F.when(F.col("part") == p, F.col("n"))).alias(f"{p}_n") for p in ("alone", "under")])
    return length.where((F.col("alone_us") >= least_us) & (F.col("under_us") >= least_us)).join(lv, keys, "left")


def chapter_issues(chapters: DataFrame, *, apart_us: int = 10_000_000, splits: Splits | None = None) -> DataFrame:
    """Chapter list problems: too few, first not at zero, out of order or close, generic titles, short tail."""
    specs = {"__p": ("lag", F.col("s_us")), "__n": ("lead", F.col("s_us"))}
    lined = running(chapters, P, ["pos"], specs, splits)
    generic = F.lower(F.trim("title")).rlike("^(cz[eę][sś][cć]|part|rozdzia[lł])\\s*\\d+$")
    found = F.array(
        F.when(F.col("__p").isNull() & (F.col("s_us") != 0), "first_not_zero"), F.when(F.trim("title") == "", "no_title").when(generic, "generic_title"),
        F.when(F.col("s_us") > F.col("total_us"), "past_end"), F.when(F.col("s_us") <= F.col("__p"), "not_ascending").when(F.col("s_us") - F.col("__p") < apart_us, "too_close"),
        F.when(F.col("__n").isNull() & (F.col("s_us") > F.col("total_us") - apart_us), "short_tail"),
    )
    rows = lined.select("project_id", "pos", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))
    few = chapters.groupBy(*P).agg(F.count("*").alias("n")).where("n < 3").select("project_id", F.lit(None).cast("bigint").alias("pos"), F.lit("too_few").alias("issue"))
    return rows.unionByName(few)


def publish_fallbacks(answers: DataFrame, plan: DataFrame, *, max_tags: int = 15) -> DataFrame:
    """Missing titles and tags filled from the plan; tags cut to what the site takes."""
    j = plan.join(answers, P, "left")
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.col("tags")).otherwise(F.col("plan_tags"))
    return j.select("project_id", F.coalesce("title", "plan_title").alias("title"), F.slice(tags, 1, max_tags).alias("tags"))


def joined_duration_issues(placed: DataFrame, measured: DataFrame, *, fps: int = 30) -> DataFrame:
    """Joined files off their expected length by more than a few frames (more with every soft transition)."""
    first = placed.groupBy(*P).agg(F.min("pos").alias("__f"))
    soft = (F.col("transition").isin("fade", "xfade") & (F.col("pos") != F.col("__f"))).cast("bigint")
    e = placed.join(first, P).groupBy(*P).agg(F.max_by("end_us", "pos").alias("expected_us"), F.sum(soft).alias("soft"))
    tol = F.greatest(F.lit(100_000), idiv((F.col("soft") + 2) * 1_000_000, fps))
    return e.join(measured, P).where(F.abs(F.col("actual_us") - F.col("expected_us")) > tol).select(
        "project_id", "expected_us", "actual_us", tol.cast("bigint").alias("tolerance_us")
    )


def missing_sources(segments: DataFrame, assets: DataFrame) -> DataFrame:
    """Clips the programme needs that have no source file."""
    return segments.select("project_id", "clip_id").distinct().join(assets.select("clip_id"), "clip_id", "left_anti")


def moments(probes: DataFrame, placed: DataFrame, words: DataFrame, captions: DataFrame, voice: DataFrame) -> DataFrame:
    """What a programme shows and says at each asked instant.

    Voice-over comes before a silent shot, then spoken words, then plain ambient sound.
    """
    seg = asof_join(probes, placed, P, "t_us", "start_us", ["pos", "clip_id", "in_us", "speed", "start_us", "end_us", "muted"], tie=["pos"])
    # written for its three readers
    seg = materialize(seg.where(F.col("t_us") < F.col("end_us")).withColumn("clip_us", F.col("in_us") + (F.col("t_us") - F.col("start_us")) * F.col("speed")))
    on = lambda items, n: interval_join(
        probes.withColumn("__z", F.col("t_us") + 1), items.select("project_id", F.col("s_us").alias("i_s"), F.col("e_us").alias("i_e")), P, ("t_us", "__z"), ("i_s", "i_e"), left_us=1
    ).groupBy("project_id", "probe").agg(F.count("*").alias(n))
    w = words.select("clip_id", F.col("s_us").alias("w_s"), F.col("e_us").alias("w_e"))
    spans = seg.select("project_id", "probe", "clip_id", (F.col("clip_us") - 1_000_000).alias("a"), (F.col("clip_us") + 1_000_001).alias("z"))
    w, length = within_reach(w, spans.select("clip_id", F.col("a").alias("s"), F.col("z").alias("e")), "clip_id", ("w_s", "w_e"))  # the others stay where they are
    near = interval_join(spans, w, ["clip_id"], ("a", "z"), ("w_s", "w_e"), left_us=2_000_001, right_us=length).groupBy("project_id", "probe").agg(F.count("*").alias("words"))
    j = seg.join(on(captions, "captions"), ["project_id", "probe"], "left").join(on(voice, "voice"), ["project_id", "probe"], "left").join(near, ["project_id", "probe"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    kind = F.when(n("voice") > 0, "voice").when(F.col("muted"), "silent").when(n("words") > 0, "words").otherwise("ambient")
    return j.select("project_id", "probe", "t_us", "pos", "clip_id", "clip_us", n("captions").alias("captions"), n("words").alias("words"), kind.alias("heard"))


def narration_target(requests: DataFrame, beats: DataFrame) -> DataFrame:
    """Beat a narration goes to: the one it names, else a beat id in its text, else the first beat of a clip it names."""
    text_beat = F.nullif(F.regexp_extract("text", "\\b(b\\d{3,})\\b", 1), F.lit(""))
    text_clip = F.nullif(F.regexp_extract("text", "\\b(c\\d{3,})\\b", 1), F.lit(""))
    r = requests.withColumns({"__tb": text_beat, "__tc": text_clip})
    known = beats.select("project_id", "id").distinct()
    a = known.select("project_id", F.col("id").alias("after"), F.col("id").alias("by_after"))
    b = known.select("project_id", F.col("id").alias("__tb"), F.col("id").alias("by_text"))
    c = beats.groupBy("project_id", F.col("clip").alias("__tc")).agg(F.min_by("id", "pos").alias("by_clip"))
    j = r.join(a, ["project_id", "after"], "left").join(b, ["project_id", "__tb"], "left").join(c, ["project_id", "__tc"], "left")
    return j.select("project_id", "request", F.coalesce("by_after", "by_text", "by_clip").alias("beat"))
