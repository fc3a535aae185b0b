"""Edit decisions to segments: claims, speech and shot layout, plan to cut, cards."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators.intervals import subtract_ranges
from dailies.operators.joins import asof_join, interval_join
from dailies.operators.ordered import Splits, ordered_fold, running
from dailies.session import materialize

P = ["project_id"]
PIECES = "array<struct<clip:bigint,in_us:bigint,out_us:bigint,audio_in:bigint,audio_out:bigint,borrows:boolean>>"


def first_fit(ranges: DataFrame, keys: Sequence[str], order: str, lo: str, hi: str, *, splits: Splits | None = None) -> DataFrame:
    """Closed ranges taken in ``order``, each unless it touches one already taken: keys, lo, hi, order of those taken.

    Of equal ranges only the first can be taken, so copies are reduced before anything is ordered. Ranges that touch
    nothing else restart the walk: only a chain of overlapping distinct ranges shares a task.
    """
    keys = list(keys)
    once = ranges.groupBy(*keys, lo, hi).agg(F.min(order).alias(order))
    lined = running(once, keys, [lo, hi], {"__r": ("max_before", F.col(hi))}, splits)
    lined = lined.withColumn("__new", F.when(F.col(lo) <= F.col("__r"), 0).otherwise(1).cast("bigint"))
    lined = running(lined, keys, [lo, hi], {"__island": ("sum", F.col("__new"))}, splits).drop("__r", "__new")

    def step(state, row):
        lows, highs = state
        first, last = getattr(row, lo), getattr(row, hi)
        at = bisect_right(lows, last)
        if at and highs[at - 1] >= first:
            return (False,)
        lows.insert(at, first)
        highs.insert(at, last)
        return (True,)

    walked = ordered_fold(lined, [*keys, "__island"], [order], lambda: ([], []), step, "taken boolean")
    return walked.where("taken").select(*keys, lo, hi, order)


def claim_errors(beats: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Spoken beats that are refused, with the first rule broken: project_id, pos, error.

    ``beats``: project_id, pos, kind, clip_id, sents (n, known, instruction), first_word, last_word; (project_id, pos)
    is unique. Sentences are checked in their order: unknown, instruction, claimed by an earlier beat; then that their
    numbers follow each other. A beat that passes claims its sentences, and then its words, unless those were claimed.
    What may claim is an unbroken range of one clip, so claims are settled for each chain of overlapping ranges, and
    no project is walked.
    """
    sents = F.col("sents")
    n = F.size(sents)
    bad = F.transform(sents, lambda x, i: F.struct(i.alias("i"), F.when(~F.coalesce(x["known"], F.lit(False)), "unknown_sentence").when(x["instruction"], "instruction_sentence").alias("e")))
    worst = F.get(F.filter(bad, lambda x: x["e"].isNotNull()), F.lit(0))
    rest = F.greatest(n - 1, F.lit(0))
    broken = F.exists(F.zip_with(F.slice(sents, 1, rest), F.slice(sents, 2, rest), lambda x, y: y["n"] != x["n"] + 1), lambda x: x)
    spoken = materialize(beats.where("kind <> 'broll'").select(
        *P, "pos", "clip_id", "first_word", "last_word", F.transform(sents, lambda x: x["n"]).alias("numbers"),
        F.coalesce(worst["i"], n).alias("upto"), F.coalesce(worst["e"], F.when(broken, "sentences_not_contiguous")).alias("static")))
    clip = [*P, "clip_id"]
    able = spoken.where(F.col("static").isNull() & (F.size("numbers") > 0))
    taken = first_fit(able.select(*clip, "pos", F.get("numbers", F.lit(0)).alias("lo"), F.element_at("numbers", -1).alias("hi")), clip, "pos", "lo", "hi", splits=splits)
    taken = materialize(taken)
    owner = taken.select(*clip, F.col("pos").alias("owner"), F.explode(F.sequence("lo", "hi")).alias("n"))
    asked = spoken.select(*clip, "pos", F.explode(F.array_distinct(F.slice("numbers", F.lit(1), F.col("upto")))).alias("n"))
    reused = asked.join(owner, [*clip, "n"]).where(F.col("owner") < F.col("pos")).select(*P, "pos").distinct().withColumn("reused", F.lit(True))
    checked = spoken.join(reused, [*P, "pos"], "left").withColumn("error", F.when(F.col("reused"), "sentence_reused").otherwise(F.col("static")))
    wordy = checked.where("error is null and first_word is not null").select(*clip, "pos", F.col("first_word").alias("lo"), F.col("last_word").alias("hi"))
    heard = first_fit(wordy, clip, "pos", "lo", "hi", splits=splits).select(*P, "pos")
    twice = wordy.join(heard, [*P, "pos"], "left_anti").select(*P, "pos", F.lit("words_reused").alias("error"))
    return checked.where(F.col("error").isNotNull()).select(*P, "pos", "error").unionByName(twice)


def _lay_out(clip: int, seg_in: int, seg_out: int, shots, dur_us: int, min_shot_us: int) -> list[dict]:
    """Own-picture pieces with shots cut in at their points; a short rest is covered by the last shot."""
    piece = lambda c, a, b, x, y, own: dict(clip=c, in_us=a, out_us=b, audio_in=x, audio_out=y, borrows=not own)
    out: list[dict] = []
    at, room = seg_in, None
    for shot in sorted(shots, key=lambda s: s["point_us"] if s["point_us"] is not None else seg_in):
        point = max(at, seg_in if shot["point_us"] is None else int(shot["point_us"]))
        if point > at:
            out.append(piece(clip, at, point, at, point, True))
            at = point
        length = min(min(int(shot["out_us"]), int(shot["limit_us"])) - int(shot["in_us"]), seg_out - at)
        if seg_out <= at or length <= 0:
            continue
        out.append(piece(int(shot["clip"]), int(shot["in_us"]), int(shot["in_us"]) + length, at, at + length, False))
        at, room = at + length, int(shot["limit_us"])
    rest = seg_out - at
    if rest <= 0:
        return out
    if rest < min_shot_us and out and out[-1]["borrows"] and out[-1]["out_us"] + rest <= room:
        out[-1]["out_us"] += rest
        out[-1]["audio_out"] = seg_out
        return out
    out.append(piece(clip, at, seg_out, at, seg_out, True))
    return out


def resolve_beats(
    beats: DataFrame, *, fps: int = 30, pad_before_us: int = 300_000, pad_after_us: int = 450_000, min_shot_us: int = 800_000,
    splits: Splits | None = None,
) -> DataFrame:
    """Every project's beats in order: claims, take joining and piece layout.

    Beats carry their geometry (from ``layout.speech_geometry``) and shots with resolved cut-in points. Claims are
    settled first (:func:`claim_errors`). Then only beats that may join the one before share a walk: the next take of
    the same clip, close behind it, both accepted. A joined beat reports the meeting point; the earlier beat's
    last piece is shortened afterwards from the next row.
    """
    frame = 1_000_000 // fps
    beats = materialize(beats)  # read for the claims and for the walk
    errors = claim_errors(beats, splits=splits)
    if splits is None:  # no project is hot: beats go out by project, errors beside them
        told = errors.where("project_id IS NOT NULL AND pos IS NOT NULL").select(*P, "pos", F.col("error").alias("__e"), F.lit(True).alias("__told"))
        line = beats.unionByName(told, allowMissingColumns=True).repartition(*P)
        line = line.withColumn("__all", F.collect_list("__e").over(Window.partitionBy(*P, "pos"))).where("__told IS NULL")
        judged = line.select(*beats.columns, F.explode_outer("__all").alias("error"))
    else:
        judged = beats.join(errors, [*P, "pos"], "left")
    speaks = (F.col("kind") != "broll") & F.col("error").isNull()
    last = F.struct(speaks.alias("speaks"), "clip_id", "last_us")
    lined = running(judged, P, ["pos"], {"__p": ("lag", last)}, splits)
    apart = F.col("first_us") - F.col("__p.last_us")
    close = speaks & F.col("__p.speaks") & (F.col("__p.clip_id") == F.col("clip_id")) & (apart >= 0) & (apart < pad_before_us + pad_after_us)
    lined = lined.withColumn("__new", F.when(close, 0).otherwise(1).cast("bigint"))
    lined = running(lined, P, ["pos"], {"__takes": ("sum", F.col("__new"))}, splits).drop("__p", "__new")

    def step(state: dict, row):
        if row.kind == "broll":
            return None, None, None, [dict(clip=int(row.clip_id), in_us=int(row.seg_in), out_us=int(row.seg_out), audio_in=None, audio_out=None, borrows=False)]
        if row.error is not None:
            return None, None, None, []
        seg_in, a0, joined = int(row.seg_in), int(row.a0), None
        prev = state["prev"]
        if prev is not None:
            meet = (prev["last_us"] + int(row.first_us)) // 2
            tail = prev["piece"]
            cut = tail["audio_out"] - meet
            if tail["out_us"] - cut - tail["in_us"] >= frame:
                joined = seg_in = a0 = meet
        pieces = _lay_out(int(row.clip_id), seg_in, int(row.seg_out), row.shots, int(row.dur_us), min_shot_us)
        state["prev"] = {"last_us": int(row.last_us), "piece": pieces[-1]} if pieces else None
        return joined, a0, int(row.a1), pieces

    walked = ordered_fold(
        lined, [*P, "__takes"], ["pos"], lambda: {"prev": None}, step, f"joined_us bigint; heard_in bigint; heard_out bigint; pieces {PIECES}"
    )
    after = running(walked, P, ["pos"], {"next_join": ("lead", F.col("joined_us"))}, splits)
    last = F.element_at("pieces", -1)
    shorter = last["audio_out"] - F.col("next_join")
    patched = F.struct(
        last["clip"].alias("clip"), last["in_us"].alias("in_us"), (last["out_us"] - shorter).alias("out_us"), last["audio_in"].alias("audio_in"),
        F.col("next_join").alias("audio_out"), last["borrows"].alias("borrows"))
    pieces = F.when(F.col("next_join").isNull() | (F.size("pieces") == 0), F.col("pieces")).otherwise(
        F.concat(F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(0))), F.array(patched)))
    heard = F.coalesce("next_join", "heard_out")
    return after.select(*beats.columns, "error", "joined_us", "heard_in", heard.alias("heard_out"), pieces.alias("pieces"))


def beat_segments(resolved: DataFrame) -> DataFrame:
    """Segment rows of the resolved beats with stable ids and the audible part of each."""
    p = resolved.where(F.col("error").isNull()).select("project_id", "pos", "uid", "kind", "heard_in", "heard_out", F.posexplode("pieces").alias("i", "p"))
    w0, w1 = F.greatest("heard_in", "p.audio_in"), F.least("heard_out", "p.audio_out")
    silent = F.col("p.audio_in").isNotNull() & F.col("heard_in").isNotNull() & (w1 <= w0)
    partial = ~silent & F.col("heard_in").isNotNull() & ((w0 > F.col("p.audio_in")) | (w1 < F.col("p.audio_out")))
    return p.select(
        "project_id", "pos", "i", F.substring(F.sha1(F.concat_ws("#", "uid", F.col("i").cast("string"))), 1, 8).alias("segment_uid"), F.col("p.clip").alias("clip_id"),
        "p.in_us", "p.out_us", "p.borrows", F.coalesce(silent, F.lit(False)).alias("muted"), F.when(partial, w0).alias("window_in"), F.when(partial, w1).alias("window_out"),
    )


def range_problems(ranges: DataFrame, *, slack_us: int = 50_000) -> DataFrame:
    """Ranges outside ``0 <= in < out <= duration`` (with a little slack), named by the first rule broken."""
    why = F.when(F.col("in_us") < 0, "negative_in").when(F.col("out_us") <= F.col("in_us"), "empty").when(F.col("out_us") > F.col("dur_us") + slack_us, "past_end")
    return ranges.withColumn("problem", why).where(F.col("problem").isNotNull())


def broll_pieces(beats: DataFrame, words: DataFrame, *, fps: int = 30) -> DataFrame:
    """B-roll clamped to the last whole frame, with ``speaks`` where heard sound contains words."""
    limit = F.col("dur_us") - 1_000_000 // fps
    b = beats.withColumn("out_us", F.least("out_us", limit)).where(F.col("out_us") > F.col("in_us"))
    w = words.select("clip_id", F.col("s_us").alias("w_s"), F.col("e_us").alias("w_e"))
    talk = interval_join(b.where("not muted").select("beat", "clip_id", "in_us", "out_us"), w, ["clip_id"], ("in_us", "out_us"), ("w_s", "w_e")).select("beat").distinct()
    return b.join(talk.withColumn("speaks", F.lit(True)), "beat", "left").withColumn("speaks", F.coalesce("speaks", F.lit(False)))


def place_captions(captions: DataFrame, spans: DataFrame, *, over_us: int = 500_000, least_us: int = 100_000) -> DataFrame:
    """Beat-relative captions in programme time: ended with their beat (plus a little), never shorter than 0.1 s.

    Captions of a beat that is gone are reported as dropped.
    """
    at = F.col("start_us") + F.col("offset_us")
    end = F.greatest(F.least(at + F.col("length_us"), F.col("end_us") + over_us), at + least_us)
    return captions.join(spans, ["project_id", "beat"], "left").select(
        "project_id", "item", "beat", at.alias("at_us"), F.when(at.isNotNull(), end).alias("to_us"), at.isNull().alias("dropped")
    )


def place_music(cues: DataFrame, spans: DataFrame) -> DataFrame:
    """Cues given as from/to beats: a lost end snaps to the project's first or last beat."""
    edge = spans.groupBy(*P).agg(F.min("start_us").alias("p0"), F.max("end_us").alias("p1"))
    a = spans.select("project_id", F.col("beat").alias("from_beat"), F.col("start_us").alias("s0"))
    b = spans.select("project_id", F.col("beat").alias("to_beat"), F.col("end_us").alias("e0"))
    j = cues.join(a, ["project_id", "from_beat"], "left").join(b, ["project_id", "to_beat"], "left").join(edge, P)
    return j.select("project_id", "item", F.coalesce("s0", "p0").alias("s_us"), F.coalesce("e0", "p1").alias("e_us")).where(F.col("e_us") > F.col("s_us"))


def plan_speech_beats(chosen: DataFrame, catalogue: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Chosen sentence ids to spoken beats: unusable ids dropped, first use wins, one beat per run.

    ``chosen``: project_id, pos, clip_id, n;  ``catalogue``: clip_id, n, instruction.
    """
    usable = chosen.join(catalogue.where("not instruction").select("clip_id", "n"), ["clip_id", "n"], "left_semi")
    first = usable.groupBy("project_id", "clip_id", "n").agg(F.min("pos").alias("pos"))
    specs = {"__pc": ("lag", F.col("clip_id")), "__pn": ("lag", F.col("n"))}
    lined = running(first, P, ["pos"], specs, splits)
    go_on = (F.col("__pc") == F.col("clip_id")) & (F.col("n") == F.col("__pn") + 1)
    lined = lined.withColumn("__new", F.when(go_on, 0).otherwise(1).cast("bigint"))
    return running(lined, P, ["pos"], {"beat": ("sum", F.col("__new"))}, splits).groupBy("project_id", "beat", "clip_id").agg(
        F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.count("*").alias("sentences")
    )


def plan_broll(spans: DataFrame, blocked: DataFrame, *, least_us: int = 800_000, splits: Splits | None = None) -> DataFrame:
    """B-roll ranges without instruction (or rejected) stretches; pieces under 0.8 s are dropped."""
    return subtract_ranges(spans, blocked, ["clip_id"], "item", splits=splits).where(F.col("e_us") - F.col("s_us") >= least_us)


def plan_captions(captions: DataFrame, *, least_us: int = 400_000, gap_us: int = 50_000, default_us: int = 2_500_000, splits: Splits | None = None) -> DataFrame:
    """Captions clamped to the programme; a card that still stands when the next begins ends just before it.

    A card without an end lasts ``default_us``; what is shorter than ``least_us`` in the programme is dropped, and a
    card is never trimmed below that.
    """
    start = F.greatest("s_us", F.lit(0))
    c = captions.select("project_id", "item", "subtitle", start.alias("s_us"), F.when(F.coalesce("e_us", F.lit(0)) <= start, start + default_us).otherwise(F.col("e_us")).alias("e_us"), "total_us")
    c = c.withColumn("e_us", F.least("e_us", "total_us")).where(F.col("e_us") - F.col("s_us") >= least_us).drop("total_us")
    lined = running(c, P, ["s_us", "item"], {"__n": ("lead", F.col("s_us"))}, splits)
    end = F.when(~F.col("subtitle") & (F.col("__n") < F.col("e_us")), F.greatest(F.col("__n") - gap_us, F.col("s_us") + least_us)).otherwise(F.col("e_us"))
    return lined.select("project_id", "item", "s_us", end.alias("e_us"))


def accept_music(cues: DataFrame, *, least_us: int = 5_000_000, splits: Splits | None = None) -> DataFrame:
    """Music cues accepted in order; each starts after the last accepted one, short leftovers are refused.

    The walk restarts wherever every earlier cue has ended, so only overlapping cues share a task.
    """
    lined = running(cues, P, ["s_us", "item"], {"__r": ("max_before", F.col("e_us"))}, splits)
    lined = lined.withColumn("__new", F.when(F.col("__r") > F.col("s_us"), 0).otherwise(1).cast("bigint"))
    lined = running(lined, P, ["s_us", "item"], {"island": ("sum", F.col("__new"))}, splits).drop("__r", "__new")

    def step(state, row):
        at = max(int(row.s_us), state["end"])
        if row.e_us - at < least_us:
            return False, None
        state["end"] = int(row.e_us)
        return True, at

    return ordered_fold(lined, ["project_id", "island"], ["s_us", "item"], lambda: {"end": 0}, step, "accepted boolean; at_us bigint").drop("island")


def thin_chapters(chapters: DataFrame, beats: DataFrame, *, apart_us: int = 10_000_000, tail_us: int = 10_000_000, splits: Splits | None = None) -> DataFrame:
    """Chapters (project_id, item, at_us, total_us) on the beats (project_id, beat, start_us) that play at their times.

    The start of the beat counts: one chapter for each beat (the earliest), none in the last ten seconds, each at
    least ten seconds after the last kept one; the first is moved to the project's first beat. A start that far from
    the one before it is kept whatever happened earlier, so the walk restarts there.
    """
    at = chapters.withColumn("at_us", F.greatest("at_us", F.lit(0)))
    c = asof_join(at, beats.select("project_id", F.col("start_us").alias("s_us"), "beat"), P, "at_us", "s_us", ["s_us", "beat"], splits=splits)
    c = c.where(F.col("s_us") <= F.greatest(F.col("total_us") - tail_us, F.lit(0)))
    c = c.groupBy("project_id", "s_us").agg(F.min(F.struct("at_us", "item")).alias("first"), F.max("beat").alias("beat")).select("project_id", "s_us", "beat", "first.item")
    lined = running(c, P, ["s_us"], {"__p": ("lag", F.col("s_us"))}, splits)
    lined = lined.withColumn("__new", F.when(F.col("s_us") - F.col("__p") < apart_us, 0).otherwise(1).cast("bigint"))
    lined = running(lined, P, ["s_us"], {"island": ("sum", F.col("__new"))}, splits).select("project_id", "island", "s_us", "beat", "item")

    def step(state, row):
        keep = state["last"] is None or row.s_us - state["last"] >= apart_us
        if keep:
            state["last"] = int(row.s_us)
        return (keep,)

    kept = ordered_fold(lined, ["project_id", "island"], ["s_us"], lambda: {"last": None}, step, "kept boolean").where("kept")
    opening = beats.groupBy("project_id").agg(F.min_by("beat", F.struct("start_us", "beat")).alias("__b"))
    leading = kept.groupBy("project_id").agg(F.min("s_us").alias("__s"))
    kept = kept.join(leading, P).join(opening, P)
    return kept.select("project_id", "item", F.when(F.col("s_us") == F.col("__s"), F.col("__b")).otherwise(F.col("beat")).alias("beat"))


def template_times(totals: DataFrame, template: Sequence[tuple[str, int]]) -> DataFrame:
    """Times of the configured marks (negative ones from the end) that fall inside each programme: project_id, label, t_us."""
    marks = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(at).cast("bigint").alias("at_us")) for label, at in template])
    t = totals.select("project_id", "total_us", F.inline(marks))
    at = F.when(F.col("at_us") < 0, F.col("total_us") + F.col("at_us")).otherwise(F.col("at_us"))
    return t.withColumn("t_us", at).where((F.col("t_us") >= 0) & (F.col("t_us") <= F.col("total_us"))).select("project_id", "label", "t_us")


def plan_markers(totals: DataFrame, beats: DataFrame, template: Sequence[tuple[str, int]], *, cta: str = "subscribe-cta", splits: Splits | None = None) -> DataFrame:
    """Configured marks and the call to action pinned to the beats that play at their times, once for each beat and label.

    ``totals``: project_id, total_us, cta_us (null or not positive: 30 % of the programme, to a tenth of a second).
    """
    usual = F.bround(F.col("total_us") * 0.3 / 100_000).cast("bigint") * 100_000
    at = F.when(F.col("cta_us") > 0, F.col("cta_us")).otherwise(usual)
    call = totals.select("project_id", "total_us", F.lit(cta).alias("label"), at.alias("t_us")).where((F.col("t_us") > 0) & (F.col("t_us") < F.col("total_us"))).drop("total_us")
    marks = template_times(totals, template).unionByName(call)
    found = asof_join(marks, beats.select("project_id", F.col("start_us").alias("s_us"), "beat"), P, "t_us", "s_us", ["beat"], splits=splits)
    return found.where(F.col("beat").isNotNull()).select("project_id", "beat", "label").distinct()


def missing_markers(totals: DataFrame, template: Sequence[tuple[str, int]], markers: DataFrame, *, tolerance_us: int = 5_000_000) -> DataFrame:
    """Template marks with no marker of that label and none within five seconds."""
    want = template_times(totals, template)
    near = interval_join(
        want.withColumns({"__a": F.col("t_us") - tolerance_us, "__z": F.col("t_us") + tolerance_us + 1}),
        markers.select("project_id", F.col("t_us").alias("m_us"), (F.col("t_us") + 1).alias("m_e")), P, ("__a", "__z"), ("m_us", "m_e"),
    ).select("project_id", "label", "t_us").distinct()
    return want.join(near, ["project_id", "label", "t_us"], "left_anti").join(markers.select("project_id", "label"), ["project_id", "label"], "left_anti")


def absorb_broll(beats: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """B-roll beats right after a narration's target beat that its length covers.

    ``beats``: project_id, pos, kind, dur_us, target BOOLEAN, length_us.  The run ends at the first
    beat that is no b-roll; a beat is absorbed while the beats before it are shorter than the narration.
    """
    start = F.when(F.col("target"), F.struct("pos", "length_us"))
    stop = F.when((F.col("kind") != "broll") | F.col("target"), F.col("pos"))
    specs = {"__t": ("last_before", start), "__x": ("last_before", stop), "__sum": ("sum", F.when(F.col("kind") == "broll", F.col("dur_us")).otherwise(0))}
    base = running(beats, P, ["pos"], specs, splits)
    at = running(base, P, ["pos"], {"__s0": ("last_before", F.when(F.col("target"), F.struct("pos", F.col("__sum").alias("s"))))}, splits)
    inside = (F.col("kind") == "broll") & ~F.col("target") & F.col("__t").isNotNull() & (F.col("__x") <= F.col("__t.pos"))
    before = F.col("__sum") - F.col("dur_us") - F.col("__s0.s")
    return at.where(inside & (before < F.col("__t.length_us"))).select("project_id", "pos", F.col("__t.pos").alias("voice_pos"), before.alias("covered_us"))


def location_cards(
    beats: DataFrame, *, min_gap_us: int = 90_000_000, least_us: int = 2_500_000, open_us: int = 10_000_000, end_us: int = 15_000_000,
    offset_us: int = 400_000, splits: Splits | None = None,
) -> DataFrame:
    """Beats that get a card: on a change of place, unless that place was carded lately.

    ``beats``: project_id, pos, s_us, e_us, place, cutaway, in programme order. A beat too short hands the card to the
    next long enough beat of the same unbroken run. A cutaway to a place neither changes the place nor gets a card, so
    the active place is the last one of the beats that count. What is left for each place is a rule on its own
    candidates: the next card is the first at least ``min_gap_us`` after this one. It is found for all at once, and the
    chain from each candidate that surely gets its card is followed by pointers doubled in each round.
    """
    if min_gap_us + offset_us <= 0:
        raise ValueError("cards need a gap")
    total = beats.groupBy(*P).agg(F.max("e_us").alias("total"))
    b = beats.join(total, P).withColumn("to_us", F.greatest(F.lit(open_us), F.col("total") - end_us))
    inside = (F.col("s_us") >= open_us) & (F.col("s_us") < F.col("to_us"))
    b = b.select(*P, "pos", "s_us", "e_us", "to_us", "place", F.coalesce("cutaway", F.lit(False)).alias("cutaway"), inside.alias("inside"))
    b = running(b, P, ["pos"], {"__p": ("lag", F.struct("place")), "__in": ("sum", F.col("inside").cast("bigint"))}, splits)
    changed = F.col("__p").isNull() | ~F.col("place").eqNullSafe(F.col("__p.place"))
    counts = (F.col("__in") > 0) & (~F.col("inside") | ~F.col("cutaway") | F.col("place").isNull())
    b = b.withColumn("__new", changed.cast("bigint"))
    b = running(b, P, ["pos"], {"stretch": ("sum", F.col("__new")), "__a": ("last_before", F.when(counts, F.struct("place")))}, splits)
    fits = F.when((F.col("e_us") - F.col("s_us") >= least_us) & (F.col("s_us") < F.col("to_us")), F.struct("pos", F.col("s_us").alias("s")))
    b = running(b, [*P, "stretch"], ["pos"], {"__t": ("next", fits)}, None)
    arrives = F.col("inside") & F.col("place").isNotNull() & ~F.col("cutaway") & (F.col("__a").isNull() | ~F.col("place").eqNullSafe(F.col("__a.place")))
    c = b.where(arrives & F.col("__t").isNotNull()).select(*P, "place", "pos", "s_us", F.col("__t.pos").alias("card_pos"), (F.col("__t.s") + offset_us).alias("at_us"))
    key = [*P, "place"]
    c = running(c, key, ["s_us", "pos"], {"__r": ("max_before", F.col("at_us"))}, None)
    sure = F.col("__r").isNull() | (F.col("s_us") - F.col("__r") >= min_gap_us)
    c = running(c.withColumn("__sure", sure.cast("bigint")), key, ["s_us", "pos"], {"island": ("sum", F.col("__sure"))}, None)
    c = materialize(c.drop("__r").withColumn("free_us", F.col("at_us") + min_gap_us))
    later = asof_join(c.select(*key, "island", "pos", "free_us"), c.select(*key, "island", "s_us", F.col("pos").alias("to_pos")), [*key, "island"], "free_us", "s_us", ["to_pos"], direction="forward")
    carded = follow(c.where("__sure = 1").select(*P, "pos"), later.where(F.col("to_pos").isNotNull()).select(*P, "pos", "to_pos"))
    return c.join(carded, [*P, "pos"]).select(*P, "pos", "place", "card_pos", "at_us")


def follow(heads: DataFrame, steps: DataFrame) -> DataFrame:
    """All positions on the chains that start at ``heads`` (project_id, pos) and go on by ``steps`` (project_id, pos, to_pos).

    Each round joins the reached positions with the pointers and the pointers with themselves, so that a chain of any
    length takes as many rounds as its length has binary digits. Chains must not meet, steps lead forward.
    """
    reached, jump = heads, materialize(steps)
    while not jump.isEmpty():
        reached = materialize(reached.unionByName(reached.join(jump, [*P, "pos"]).select(*P, F.col("to_pos").alias("pos"))))
        onward = jump.select(*P, F.col("pos").alias("to_pos"), F.col("to_pos").alias("further"))
        jump = materialize(jump.join(onward, [*P, "to_pos"]).select(*P, "pos", F.col("further").alias("to_pos")))
    return reached


def replace_captions(old: DataFrame, new: DataFrame, *, kind: str = "location", splits: Splits | None = None) -> DataFrame:
    """Captions of other kinds kept, those of ``kind`` replaced, all renumbered by beat and offset."""
    both = old.where(F.col("kind") != kind).unionByName(new)
    numbered = running(both, P, ["beat_pos", "offset_us", "kind", "item"], {"n": ("sum", F.lit(1).cast("bigint"))}, splits)
    return numbered.withColumn("id", F.format_string("c%03d", "n")).drop("n")


def duration_drift(before: DataFrame, after: DataFrame, *, over_us: int = 500_000) -> DataFrame:
    """Beats whose length differs by more than half a second between two versions (or exist in one only)."""
    j = before.select("project_id", "beat", F.col("dur_us").alias("b")).join(after.select("project_id", "beat", F.col("dur_us").alias("a")), ["project_id", "beat"], "full_outer")
    drift = F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))
    return j.select("project_id", "beat", drift.alias("drift_us")).where(F.abs("drift_us") > over_us)
