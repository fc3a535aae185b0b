"""Sentence catalogue, places and selections around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.functions.text import slug
from dailies.operators.dedupe import near_duplicates
from dailies.operators.joins import asof_join, interval_join, overlapped, within_reach
from dailies.operators.layout import sound_map
from dailies.operators.ordered import Splits, running
from dailies.session import materialize

CLIP = ["project_id", "clip_id"]


def flag_instructions(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """``instruction``: the sentence overlaps a spoken instruction of its clip."""
    marked = overlapped(sentences.drop("instruction"), spans.select(*CLIP, F.col("s_us").alias("s"), F.col("e_us").alias("e")), CLIP, ("s_us", "e_us"), "instruction")
    # a sentence goes with its copies; one without a number has none
    return marked.withColumn("instruction", F.max("instruction").over(Window.partitionBy(*CLIP, "n")) & F.col("n").isNotNull())


def retake_pointers(sentences: DataFrame, attempts: DataFrame) -> DataFrame:
    """First sentence of the kept attempt for each sentence that overlaps a losing one.

    ``attempts``: clip keys, take, i, n_attempts, keep, s_us, e_us.  Out-of-range ``keep`` means the
    last attempt; a take whose kept attempt holds no sentence is ignored; the last take wins.
    """
    k = F.coalesce("keep", F.col("n_attempts") - 1)
    k = F.when(k < 0, k + F.col("n_attempts")).otherwise(k)
    k = F.when((k < 0) | (k >= F.col("n_attempts")), F.col("n_attempts") - 1).otherwise(k)
    a = attempts.where(F.col("n_attempts") >= 2).select(
        *CLIP, "take", (F.col("i") == k).alias("kept"), F.col("s_us").alias("a_s"), F.col("e_us").alias("a_e")
    )
    # only sentences under an attempt are dealt out to meet theirs
    under = overlapped(sentences.select(*CLIP, "n", "s_us", "e_us"), a.select(*CLIP, F.col("a_s").alias("s"), F.col("a_e").alias("e")), CLIP, ("s_us", "e_us"), "under").where("under").drop("under")
    hit = interval_join(under, a, CLIP, ("s_us", "e_us"), ("a_s", "a_e")).select(*CLIP, "n", "take", "kept")
    first = hit.where("kept").groupBy(*CLIP, "take").agg(F.min("n").alias("target"))
    lost = hit.where("not kept").join(first, [*CLIP, "take"]).where(F.col("n") != F.col("target"))
    return lost.groupBy(*CLIP, "n").agg(F.max_by("target", "take").alias("retake_of"))


def sentence_catalogue(sentences: DataFrame, instructions: DataFrame, attempts: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Sentences with instruction, retake and duplicate flags and whether they are kept by default."""
    flagged = flag_instructions(sentences.drop("instruction"), instructions)
    dup = near_duplicates(flagged, splits=splits)
    full = flagged.join(retake_pointers(sentences, attempts), [*CLIP, "n"], "left").join(dup, ["project_id", "ord"], "left")
    return full.withColumn("keep_default", ~F.col("instruction") & F.col("retake_of").isNull() & F.col("duplicate_of").isNull())


def sentences_in_range(ranges: DataFrame, sentences: DataFrame, range_id: str, *, min_percent: int = 50) -> DataFrame:
    """Sentences touched by each range with the covered share; ``kept`` from half covered on."""
    s = sentences.select(*CLIP, "n", F.col("s_us").alias("t_s"), F.col("e_us").alias("t_e"))
    hit = interval_join(ranges.select(*CLIP, range_id, "s_us", "e_us"), s, CLIP, ("s_us", "e_us"), ("t_s", "t_e"))
    over, own = F.least("e_us", "t_e") - F.greatest("s_us", "t_s"), F.col("t_e") - F.col("t_s")
    return hit.select(*CLIP, range_id, "n", "s_us", "e_us", "t_s", "t_e", idiv(over * 1000, own).alias("covered_milli"), (over * 100 >= own * min_percent).alias("kept"))


def range_extension(ranges: DataFrame, sentences: DataFrame, range_id: str, *, over_us: int = 500_000) -> DataFrame:
    """Ranges whose kept sentences reach more than ``over_us`` beyond what was played."""
    kept = sentences_in_range(ranges, sentences, range_id).where("kept").groupBy(*CLIP, range_id, "s_us", "e_us").agg(
        F.min("t_s").alias("f"), F.max("t_e").alias("l")
    )
    return kept.select(*CLIP, range_id, (F.greatest(F.col("s_us") - F.col("f"), F.lit(0)) + F.greatest(F.col("l") - F.col("e_us"), F.lit(0))).alias("extra_us")).where(F.col("extra_us") > over_us)


def nearest_sentence_end(points: DataFrame, sentences: DataFrame, t: str, *, splits: Splits | None = None) -> DataFrame:
    """Sentence whose end is closest to ``t`` (earlier on a tie); none at or before the first start."""
    ends = sentences.select(*CLIP, F.col("n").alias("n_b"), F.col("e_us").alias("e_b"))
    late = sentences.select(*CLIP, F.col("n").alias("n_a"), F.col("e_us").alias("e_a"))
    first = sentences.groupBy(*CLIP).agg(F.min("s_us").alias("__first"))
    b = asof_join(points, ends, CLIP, t, "e_b", ["n_b", "e_b"], splits=splits)
    a = asof_join(b, late, CLIP, t, "e_a", ["n_a", "e_a"], direction="forward", inclusive=False, splits=splits).join(first, CLIP)
    before = F.col("e_a").isNull() | (F.col("e_b").isNotNull() & (F.col(t) - F.col("e_b") <= F.col("e_a") - F.col(t)))
    blank = F.col(t) <= F.col("__first")
    return a.select(
        *points.columns, F.when(~blank, F.when(before, F.col("n_b")).otherwise(F.col("n_a"))).alias("after_n"),
        F.when(~blank, F.when(before, F.col(t) - F.col("e_b")).otherwise(F.col("e_a") - F.col(t))).alias("distance_us"),
    )


def first_seen_distinct(items: DataFrame, keys: Sequence[str], text: str, pos: str, *, splits: Splits | None = None) -> DataFrame:
    """Texts distinct by trimmed lower case, the first spelling kept, numbered in first-seen order."""
    clean = F.trim(text)
    firsts = items.where(clean != "").groupBy(*keys, F.lower(clean).alias("__k")).agg(F.min_by(clean, pos).alias(text), F.min(pos).alias("first_pos"))
    return running(firsts, keys, ["first_pos", "__k"], {"n": ("sum", F.lit(1).cast("bigint"))}, splits).drop("__k", "first_pos")


def place_groups(clips: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """Distinct (name, city, country) of a project, numbered from 0 by first clip."""
    g = clips.where(F.coalesce("name", F.lit("")) != "").groupBy("project_id", "name", "city", "country").agg(F.min("pos").alias("first_pos"), F.count("*").alias("clips"))
    return running(g, ["project_id"], ["first_pos"], {"__n": ("sum", F.lit(1).cast("bigint"))}, splits).withColumn("group_id", F.col("__n") - 1).drop("__n")


def assign_places(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """Answer row per group (the last one wins), a slug of the name where none came back."""
    last = answers.groupBy("project_id", "group_id").agg(F.max_by(F.struct("place_id", "label"), "answer_pos").alias("a"))
    return groups.join(last, ["project_id", "group_id"], "left").select(
        "project_id", "group_id", "name", F.coalesce("a.place_id", slug(F.col("name"))).alias("place_id"), F.coalesce("a.label", "name").alias("label")
    )


def inherit_places(clips: DataFrame, *, low: float = 0.5, splits: Splits | None = None) -> DataFrame:
    """Nameless low-confidence clips take the place of the nearest named one (earlier on a tie)."""
    named = F.when(F.col("place").isNotNull(), F.struct("pos", "place"))
    lined = running(clips, ["project_id"], ["pos"], {"__b": ("last_before", named), "__a": ("next_after", named)}, splits)
    back, ahead = F.col("pos") - F.col("__b.pos"), F.col("__a.pos") - F.col("pos")
    near = F.when(ahead.isNull() | (back <= ahead), F.col("__b.place")).otherwise(F.col("__a.place"))
    take = F.col("place").isNull() & (F.col("confidence") < low)
    return lined.select(*clips.columns, F.coalesce("place", F.when(take, near)).alias("resolved"))


def uncovered_music(flags: DataFrame, placed: DataFrame, mutes: DataFrame, *, min_percent: int = 90) -> DataFrame:
    """Flagged music the cut shows that mutes (-6 dB or lower) cover by less than ``min_percent``.

    The used part of a flag is taken per segment of its picture clip, heard or not.
    """
    f = flags.select("clip_id", "flag", F.col("s_us").alias("f_s"), F.col("e_us").alias("f_e"))
    g = placed.select("project_id", "pos", "clip_id", "in_us", "out_us")
    used = interval_join(g, f, ["clip_id"], ("in_us", "out_us"), ("f_s", "f_e")).select(
        "project_id", "pos", "clip_id", "flag", F.greatest("in_us", "f_s").alias("u_s"), F.least("out_us", "f_e").alias("u_e")
    )
    m = mutes.where(F.col("gain_db") <= -6).select("clip_id", F.col("s_us").alias("m_s"), F.col("e_us").alias("m_e"))
    hit = interval_join(used, m, ["clip_id"], ("u_s", "u_e"), ("m_s", "m_e")).groupBy("project_id", "pos", "flag").agg(
        F.sum(F.least("u_e", "m_e") - F.greatest("u_s", "m_s")).alias("over")
    )
    length = F.col("u_e") - F.col("u_s")
    cover = F.least(F.coalesce("over", F.lit(0)), length)
    return used.join(hit, ["project_id", "pos", "flag"], "left").where(cover * 100 < length * min_percent).select(
        "project_id", "pos", "clip_id", "flag", length.alias("used_us"), cover.alias("covered_us")
    )


def match_styles(requests: DataFrame, styles: DataFrame, *, fallback: str) -> DataFrame:
    """Best style per request by shared tokens, half a point per token inside the style's name.

    ``requests``: request, tokens ARRAY<STRING>; ``styles``: style, tags ARRAY<STRING>.  Only
    styles sharing a token or name part can score, so the join is on tokens; the name part is a
    lookup of every token the style list knows.
    """
    want = requests.select("request", F.explode(F.array_distinct("tokens")).alias("tok"))
    tags = styles.select("style", F.explode(F.array_distinct("tags")).alias("tok"))
    overlap = want.join(tags, "tok").select("request", "style", F.lit(2).alias("half_points"))
    parts = want.select("tok").distinct().join(styles.select("style", F.regexp_replace("style", "-", "").alias("bare")), F.expr("contains(bare, tok)")).select("tok", "style")
    inside = want.join(parts, "tok").select("request", "style", F.lit(1).alias("half_points"))
    score = overlap.unionByName(inside).groupBy("request", "style").agg(F.sum("half_points").alias("half_points"))
    best = score.groupBy("request").agg(F.min_by(F.struct("style", "half_points"), F.struct(-F.col("half_points"), F.col("style"))).alias("b"))
    return requests.select("request").join(best, "request", "left").select(
        "request", F.coalesce("b.style", F.lit(fallback)).alias("style"), F.coalesce("b.half_points", F.lit(0)).cast("bigint").alias("half_points")
    )


def cut_boundaries(placed: DataFrame, words: DataFrame, *, fps: int = 30, inside_us: int = 20_000, replay_us: int = 50_000, splits: Splits | None = None) -> DataFrame:
    """Audio boundaries between neighbouring segments: last and first word, margins, cut-through words.

    Sides go by the clip and range that are heard, borrowed sound included, whatever part of it is audible.
    """
    heard = sound_map(placed).select("project_id", "pos", "end_us", "muted", F.col("a_clip").alias("clip_id"), F.col("a_in").alias("in_us"), F.col("a_out").alias("out_us"))
    specs = {f"b_{c}": ("lead", F.col(c)) for c in ("pos", "clip_id", "in_us", "out_us", "muted")}
    lined = running(heard, ["project_id"], ["pos"], specs, splits).where(F.col("b_pos").isNotNull())
    frame = (1_000_000 + fps - 1) // fps
    cont = (F.col("clip_id") == F.col("b_clip_id")) & (F.abs(F.col("b_in_us") - F.col("out_us")) <= frame) & ~F.col("muted") & ~F.col("b_muted")
    edges = materialize(lined.where(~cont & ~(F.col("muted") & F.col("b_muted"))))  # for its four readers
    sides = [("clip_id", "in_us", "out_us", "muted"), ("b_clip_id", "b_in_us", "b_out_us", "b_muted")]
    heard_at = F.inline(F.array(*[F.when(~F.col(off), F.struct(F.col(clip).alias("clip_id"), F.col(lo).alias("s"), F.col(hi).alias("e"))) for clip, lo, hi, off in sides]))
    w = words.select("clip_id", F.col("s_us").alias("w_s"), F.col("e_us").alias("w_e"), F.col("text").alias("word"))
    w, length = within_reach(w, edges.select(heard_at), "clip_id", ("w_s", "w_e"))  # the others stay where they are

    def side(clip: str, lo: str, hi: str, off: str, last: bool) -> DataFrame:
        span = edges.where(~F.col(off)).select("project_id", "pos", F.col(clip).alias("clip_id"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
        hit = interval_join(span, w, ["clip_id"], ("lo", "hi"), ("w_s", "w_e"), right_us=length)
        pick = (F.max_by if last else F.min_by)(F.struct("word", "w_s", "w_e"), F.struct("w_s", "w_e"))
        return hit.groupBy("project_id", "pos").agg(pick.alias("a" if last else "b"))

    out = edges.join(side(*sides[0], True), ["project_id", "pos"], "left")
    out = out.join(side(*sides[1], False), ["project_id", "pos"], "left")
    out_in = (F.col("a.w_s") < F.col("out_us") - inside_us) & (F.col("a.w_e") > F.col("out_us") + inside_us)
    in_in = (F.col("b.w_s") < F.col("b_in_us") - inside_us) & (F.col("b.w_e") > F.col("b_in_us") + inside_us)
    again = F.when((F.col("clip_id") == F.col("b_clip_id")) & ~F.col("muted") & ~F.col("b_muted"), F.greatest(F.col("out_us") - F.col("b_in_us"), F.lit(0))).otherwise(0)
    flags = F.filter(F.array(F.when(F.coalesce(out_in, F.lit(False)), "out inside word"), F.when(F.coalesce(in_in, F.lit(False)), "in inside word"), F.when(again > replay_us, "replayed")), lambda x: x.isNotNull())
    return out.select(
        "project_id", "pos", F.col("end_us").alias("at_us"), F.col("a.word").alias("last_word"), (F.col("out_us") - F.col("a.w_e")).alias("out_margin_us"),
        F.col("b.word").alias("first_word"), (F.col("b.w_s") - F.col("b_in_us")).alias("in_margin_us"), again.cast("bigint").alias("replayed_us"), flags.alias("flags"),
    )


def render_context(boundaries: DataFrame, render_words: DataFrame, keys: Sequence[str], at: str, *, tol_us: int = 50_000, window_us: int = 2_500_000, min_gap_us: int = 350_000, straddle_us: int = 80_000, splits: Splits | None = None) -> DataFrame:
    """What is heard around each boundary: the gap between the nearest words, and a word cut through."""
    keys, names = list(keys), boundaries.columns
    # only words within reach of a boundary count for it, so they meet in one join; null keys meet, but nothing is cut through at a null
    reach = max(window_us, tol_us, straddle_us)
    point = boundaries.distinct().select(F.struct(*keys).alias("__k"), F.struct(*names).alias("__row"), F.col(at).alias("__at"), (F.col(at) - reach).alias("__p0"), (F.col(at) + reach + 1).alias("__p1"))
    w = render_words.select(F.struct(*keys).alias("__k"), "s_us", "e_us", F.least("s_us", "e_us").alias("__w0"), (F.greatest("s_us", "e_us") + 1).alias("__w1"))
    hit = interval_join(point, w, ["__k"], ("__p0", "__p1"), ("__w0", "__w1"), left_us=2 * reach + 1)
    t, s, e = F.col("__at"), F.col("s_us"), F.col("e_us")
    found = hit.groupBy("__row").agg(
        F.max(F.when(e <= t + tol_us, e)).alias("be"), F.min(F.when(s >= t - tol_us, s)).alias("as_"), F.bool_or((s < t - straddle_us) & (e > t + straddle_us)).alias("chopped"),
    )
    out = boundaries.select(*names, F.struct(*names).alias("__row")).join(found, "__row", "left")
    ok = (F.col("be") > F.col(at) - window_us) & (F.col("as_") < F.col(at) + window_us)
    out = out.select(*names, F.when(ok, F.col("as_") - F.col("be")).alias("gap_us"), (F.coalesce("chopped", F.lit(False)) & F.forall(F.array(*[F.col(c).isNotNull() for c in names]), lambda x: x)).alias("chopped"))
    return out.withColumn("no_air", F.coalesce(F.col("gap_us") < min_gap_us, F.lit(False)))
