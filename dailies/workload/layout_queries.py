"""Placement, mapping and pacing over the order lines as segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators import checks, layout, validation
from dailies.operators.ordered import plan_splits
from dailies.operators.segment import islands
from dailies.workload.adapter import RANGES, SEGMENTS, TASK_DOCUMENTS, WORDS, clips, dealt, ranges, segments, table, words
from dailies.workload.interval_queries import merged_sql
from dailies.workload.registry import query

P = ["project_id"]
FR = "greatest(1, (2 * 30 * ((out_us - in_us) // speed) + 1000000) // 2000000)"


def placed_cte(name: str = "placed", kinds: str = "'xfade'") -> str:
    return f"""{name}_a AS (SELECT *, {FR} AS len_f, lag({FR}) OVER w AS pl FROM segments WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
{name}_b AS (SELECT *, CASE WHEN transition IN ({kinds}) AND pl IS NOT NULL THEN least((60 * transition_us + 1000000) // 2000000, pl, len_f) ELSE 0 END AS overlap_f FROM {name}_a),
{name}_c AS (SELECT *, (sum(len_f) OVER w - sum(overlap_f) OVER w - len_f)::BIGINT AS start_f FROM {name}_b WINDOW w AS (PARTITION BY project_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT *, start_f + len_f AS end_f, (start_f * 2000000 + 30) // 60 AS start_us, ((start_f + len_f) * 2000000 + 30) // 60 AS end_us, beat_mod AS beat FROM {name}_c)"""


PLACED = SEGMENTS + ",\n" + placed_cte()


def cut_segments(spark, d):
    return segments(spark, d)


def placed(spark, d, **kw):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").cast("bigint").alias("pos"))
    return layout.place_segments(segments(spark, d), splits=plan_splits(lines, P, "pos"), **kw).withColumn("beat", F.col("beat_mod"))


@query("place_segments", f"WITH {PLACED} SELECT project_id, pos, clip_id, len_f, overlap_f, start_f, end_f, start_us, end_us FROM placed")
def place_segments(spark, d):
    return placed(spark, d).select("project_id", "pos", "clip_id", "len_f", "overlap_f", "start_f", "end_f", "start_us", "end_us")


@query("programme_length", f"WITH {PLACED} SELECT project_id, count(*) AS segments, max_by(end_f, pos) AS frames, max_by(end_us, pos) AS length_us FROM placed GROUP BY 1")
def programme_length(spark, d):
    return placed(spark, d).groupBy("project_id").agg(
        F.count("*").alias("segments"), F.max_by("end_f", "pos").alias("frames"), F.max_by("end_us", "pos").alias("length_us")
    )


SPANS = PLACED + """,
spans AS (SELECT project_id, beat, min_by(start_us, pos) AS start_us, max_by(end_us, pos) AS end_us, min(pos) AS first_pos FROM placed GROUP BY ALL)"""


@query("beat_spans", f"WITH {SPANS} SELECT * FROM spans")
def beat_spans(spark, d):
    return layout.beat_spans(placed(spark, d))


PROBES = "probes AS (SELECT o_orderkey AS project_id, o_custkey AS probe, CAST(round(o_totalprice * 100) AS BIGINT) % 15000000 - 500000 AS t_us FROM orders)"


def probes(spark, d):
    t = F.round(F.col("o_totalprice") * 100).cast("bigint") % 15_000_000 - 500_000
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("probe"), t.alias("t_us"))


@query("beat_at", f"""WITH {SPANS}, {PROBES}
SELECT project_id, probe, t_us, coalesce((SELECT max_by(beat, (start_us, first_pos)) FROM spans s WHERE s.project_id = p.project_id AND start_us <= t_us), (SELECT min_by(beat, first_pos) FROM spans s WHERE s.project_id = p.project_id)) AS beat FROM probes p""")
def beat_at(spark, d):
    return layout.beat_at(probes(spark, d), layout.beat_spans(placed(spark, d)), "t_us")


@query("beat_ending_at", f"""WITH {SPANS}, {PROBES}
SELECT project_id, probe, t_us, coalesce((SELECT max_by(beat, (start_us, first_pos)) FROM spans s WHERE s.project_id = p.project_id AND start_us <= t_us - 50000), (SELECT min_by(beat, first_pos) FROM spans s WHERE s.project_id = p.project_id)) AS beat FROM probes p""")
def beat_ending_at(spark, d):
    return layout.beat_ending_at(probes(spark, d), layout.beat_spans(placed(spark, d)), "t_us")


#: Every third segment borrows the sound of another clip, every fourth is heard in part; where the sound is read, and what of it is audible.
SOUNDED = """sounded AS (SELECT *, CASE WHEN pos % 3 = 1 THEN (clip_id * 7 + pos) % (SELECT count(*) FROM documents) ELSE clip_id END AS a_clip,
  CASE WHEN pos % 3 = 1 THEN in_us + 1500000 ELSE in_us END AS a_in, CASE WHEN pos % 3 = 1 THEN out_us + 1500000 ELSE out_us END AS a_out FROM placed),
heard AS (SELECT *, CASE WHEN pos % 4 = 2 THEN a_in + clip_id % 5 * 200000 ELSE a_in END AS h_in, CASE WHEN pos % 4 = 2 THEN least(a_out, a_out + 600000 - clip_id % 7 * 300000) ELSE a_out END AS h_out FROM sounded)"""


def sounded(spark, d):
    borrows, partly = F.col("pos") % 3 == 1, F.col("pos") % 4 == 2
    shift = F.when(borrows, F.lit(1_500_000))
    return placed(spark, d).withColumns({
        "sound_clip_id": F.when(borrows, (F.col("clip_id") * 7 + F.col("pos")) % clips(spark, d)), "sound_in_us": F.col("in_us") + shift, "sound_out_us": F.col("out_us") + shift,
        "heard_in_us": F.when(partly, F.col("in_us") + F.coalesce(shift, F.lit(0)) + F.col("clip_id") % 5 * 200_000), "heard_out_us": F.when(partly, F.col("out_us") + F.coalesce(shift, F.lit(0)) + 600_000 - F.col("clip_id") % 7 * 300_000),
    })


ON_SOUND = """onseg AS (SELECT g.project_id, g.pos, w.clip_id, w.pos AS word, w.text, start_us + (greatest(w.s_us, h_in) - a_in) // speed AS s_us, start_us + (least(w.e_us, h_out) - a_in) // speed AS e_us
  FROM heard g JOIN words w ON g.a_clip = w.clip_id AND w.s_us < g.h_out AND w.e_us > g.h_in AND g.h_out > g.h_in WHERE NOT muted)"""


ON_SEG = """onseg AS (SELECT g.project_id, g.pos, g.clip_id, w.pos AS word, w.text, start_us + (greatest(w.s_us, in_us) - in_us) // speed AS s_us, start_us + (least(w.e_us, out_us) - in_us) // speed AS e_us
  FROM placed g JOIN words w ON g.clip_id = w.clip_id AND w.s_us < g.out_us AND w.e_us > g.in_us {where})"""


@query("speech_in_programme", f"""WITH {PLACED}, {SOUNDED}, {WORDS}, {ON_SOUND}, {merged_sql('onseg', 'm', 400000, 150000, 'project_id')} SELECT * FROM m""")
def speech_in_programme(spark, d):
    return layout.speech_in_programme(sounded(spark, d), words(spark, d))


@query("captions_in_programme", f"""WITH {PLACED}, {WORDS}, {ON_SEG.format(where='')} SELECT * FROM onseg""")
def captions_in_programme(spark, d):
    return layout.words_on_segments(placed(spark, d), words(spark, d), heard=False)


MUTES = "mutes AS (SELECT event_id % (SELECT count(*) FROM documents) AS clip_id, event_id AS mute, event_id % 9 * 1000000 AS s_us, event_id % 9 * 1000000 + (event_id % 31 + 1) * 77777 AS e_us FROM events)"


def mutes(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(
        (e % clips(spark, d)).alias("clip_id"), e.alias("mute"), (e % 9 * 1_000_000).alias("s_us"), (e % 9 * 1_000_000 + (e % 31 + 1) * 77_777).alias("e_us")
    )


def local_sql(src: str, span: str, clip: str, low: str, high: str, start: str, step: int = 100) -> str:
    at = lambda x: f"(2 * (({x} - {start}) // speed) + {step}) // {2 * step} * {step}"
    return f"""loc AS (SELECT project_id, g.pos, m.clip_id, {span}, start_us, muted, {at(f"greatest(s_us, {low})")} AS ls, {at(f"least(e_us, {high})")} AS le
 FROM {src} g JOIN m ON g.{clip} = m.clip_id AND m.s_us < g.{high} AND m.e_us > g.{low} AND g.{high} > g.{low})"""


@query("segment_local_mutes", f"WITH {PLACED}, {SOUNDED}, {MUTES}, m AS (SELECT * FROM mutes), {local_sql('heard', 'mute', 'a_clip', 'a_in', 'a_out', 'a_in')} SELECT project_id, pos, clip_id, mute, ls AS s_us, le AS e_us FROM loc")
def segment_local_mutes(spark, d):
    return layout.local_ranges(sounded(spark, d), mutes(spark, d), "mute").drop("start_us", "muted")


@query("segment_local_speech", f"WITH {PLACED}, {SOUNDED}, {WORDS}, m AS (SELECT clip_id, pos AS word, s_us, e_us FROM words), {local_sql('heard', 'word', 'a_clip', 'h_in', 'h_out', 'a_in')} SELECT project_id, pos, clip_id, word, ls AS s_us, le AS e_us FROM loc")
def segment_local_speech(spark, d):
    spoken = words(spark, d).select("clip_id", F.col("pos").alias("word"), "s_us", "e_us")
    return layout.local_ranges(sounded(spark, d), spoken, "word", of="audible", many=True).drop("start_us", "muted")


@query("audible_windows", f"WITH {PLACED}, {SOUNDED} SELECT project_id, pos, a_clip AS clip_id, (2 * ((h_in - a_in) // speed) + 100) // 200 * 100 AS s_us, (2 * ((greatest(h_in, h_out) - a_in) // speed) + 100) // 200 * 100 AS e_us FROM heard WHERE h_in > a_in OR h_out < a_out")
def audible_windows(spark, d):
    return layout.audible_windows(sounded(spark, d))


@query("mutes_in_programme", f"WITH {PLACED}, {MUTES}, m AS (SELECT * FROM mutes), {local_sql('placed', 'mute', 'clip_id', 'in_us', 'out_us', 'in_us', 1)} SELECT project_id, pos, clip_id, mute, start_us + ls AS s_us, start_us + le AS e_us FROM loc WHERE NOT muted")
def mutes_in_programme(spark, d):
    return layout.mutes_in_programme(sounded(spark, d), mutes(spark, d), "mute")


def render_placed(spark, d):
    return placed(spark, d, overlapping=("xfade", "fade"))


RENDER = placed_cte("rend", "'xfade','fade'")


@query("render_time_map", f"""WITH {PLACED}, {RENDER}, {PROBES}, b AS (SELECT a.project_id, a.pos, a.end_us, r.start_us - a.start_us AS shift FROM placed a JOIN rend r USING (project_id, pos)),
h AS (SELECT p.*, coalesce((SELECT min_by(shift, (end_us, pos)) FROM b WHERE b.project_id = p.project_id AND end_us > t_us), (SELECT max_by(shift, pos) FROM b WHERE b.project_id = p.project_id)) AS shift FROM probes p)
SELECT project_id, probe, t_us, greatest(t_us + shift, 0) AS render_us FROM h WHERE shift IS NOT NULL""")
def render_time_map(spark, d):
    return layout.to_render_time(probes(spark, d), placed(spark, d), render_placed(spark, d), "t_us")


@query("segments_around", f"""WITH {PLACED}, {PROBES} SELECT project_id, probe, t_us, pos FROM probes JOIN placed USING (project_id) WHERE start_us <= t_us + 2000000 AND end_us >= t_us - 2000000""")
def segments_around(spark, d):
    items = placed(spark, d).select("project_id", "pos", F.col("start_us").alias("s_us"), F.col("end_us").alias("e_us"))
    return layout.near_instant(probes(spark, d), items, P, "t_us", around_us=2_000_000).select("project_id", "probe", "t_us", "pos")


@query("words_near", f"""WITH {WORDS}, q AS (SELECT o_orderkey AS query, o_orderkey % (SELECT count(*) FROM documents) AS clip_id, o_custkey * 10000 AS t_us FROM orders)
SELECT query, q.clip_id, t_us, w.pos, w.text FROM q JOIN words w ON w.clip_id = q.clip_id AND w.s_us <= t_us + 1000000 AND w.e_us >= t_us - 1000000""")
def words_near(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % clips(spark, d)).alias("clip_id"), (F.col("o_custkey") * 10_000).alias("t_us"))
    w = words(spark, d).select("clip_id", "pos", "s_us", "e_us", "text")
    return layout.near_instant(q, w, ["clip_id"], "t_us", around_us=1_000_000).select("query", "clip_id", "t_us", "pos", "text")


GEO = """beats AS (SELECT clip_id, i // 9 AS beat, min(s_us) AS first_us, max(e_us) AS last_us, max(n) * 490000 + 800000 AS dur_us FROM (SELECT *, pos AS i, max(pos) OVER (PARTITION BY clip_id) AS n FROM words) WHERE i % 9 BETWEEN 2 AND 6 GROUP BY ALL),
prot AS (SELECT event_id % (SELECT count(*) FROM documents) AS clip_id, event_id AS pid, event_id % 97 * 400000 AS s_us, event_id % 97 * 400000 + 700000 AS e_us FROM events)"""


def spoken_beats(spark, d):
    w = words(spark, d)
    doc = w.groupBy("clip_id").agg((F.max("pos") * 490_000 + 800_000).cast("bigint").alias("dur_us"))
    part = w.where((F.col("pos") % 9).between(2, 6)).groupBy("clip_id", idiv("pos", 9).cast("bigint").alias("beat")).agg(
        F.min("s_us").alias("first_us"), F.max("e_us").alias("last_us")
    )
    e = F.col("event_id")
    n = clips(spark, d)
    prot = table(spark, d, "events").select((e % n).alias("clip_id"), (e % 97 * 400_000).alias("s_us"), (e % 97 * 400_000 + 700_000).alias("e_us"))
    return part.join(doc, "clip_id"), w, dealt(prot, "clip_id", n, TASK_DOCUMENTS)  # beside the clips' words


@query("speech_geometry", f"""WITH {WORDS}, {GEO},
g AS (SELECT b.*, (SELECT max(e_us) FROM words w WHERE w.clip_id = b.clip_id AND w.e_us <= first_us) AS pe, (SELECT min(s_us) FROM words w WHERE w.clip_id = b.clip_id AND w.s_us >= last_us) AS ns,
 (SELECT max(e_us) FROM prot w WHERE w.clip_id = b.clip_id AND w.e_us <= first_us) AS qe, (SELECT min(s_us) FROM prot w WHERE w.clip_id = b.clip_id AND w.s_us >= last_us) AS qs FROM beats b),
h AS (SELECT *, greatest(first_us - 300000, 0) AS seg_in, least(last_us + 450000, dur_us - 33333) AS seg_out FROM g)
SELECT clip_id, beat, first_us, last_us, dur_us, seg_in, seg_out, least(greatest(seg_in, coalesce(pe + 50000, seg_in), coalesce(qe, seg_in)), first_us) AS a0,
 greatest(least(seg_out, coalesce(ns - 50000, seg_out), coalesce(qs, seg_out), dur_us - 33333), last_us) AS a1 FROM h""")
def speech_geometry(spark, d):
    beats, w, prot = spoken_beats(spark, d)
    return layout.speech_geometry(beats, w, prot).select("clip_id", "beat", "first_us", "last_us", "dur_us", "seg_in", "seg_out", "a0", "a1")


@query("neighbour_words", f"""WITH {WORDS}, {GEO} SELECT b.clip_id, beat, first_us, last_us, (SELECT max(e_us) FROM words w WHERE w.clip_id = b.clip_id AND w.e_us <= first_us) AS prev_e, (SELECT min(s_us) FROM words w WHERE w.clip_id = b.clip_id AND w.s_us >= last_us) AS next_s FROM beats b""")
def neighbour_words(spark, d):
    from dailies.operators.joins import nearest_times

    beats, w, _ = spoken_beats(spark, d)
    prev = nearest_times(beats.drop("dur_us"), ["clip_id"], "first_us", {"prev_e": w.select("clip_id", F.col("e_us").alias("at"))})
    return nearest_times(prev, ["clip_id"], "last_us", {"next_s": w.select("clip_id", F.col("s_us").alias("at"))}, direction="forward")


@query("tight_joins", f"""WITH {SEGMENTS}, b AS (SELECT project_id, pos, clip_id AS beat, CASE WHEN clip_id % 3 < 2 THEN 'speech' ELSE 'broll' END AS kind, clip_id % 7 * 60000 AS tail_us, clip_id % 5 * 60000 AS head_us, clip_id % 4 = 0 AS joined FROM segments),
l AS (SELECT *, lag(tail_us) OVER w AS pt, lag(kind) OVER w AS pk, lag(beat) OVER w AS prev FROM b WINDOW w AS (PARTITION BY project_id ORDER BY pos))
SELECT project_id, prev, beat, pt + head_us AS air_us FROM l WHERE kind = 'speech' AND pk = 'speech' AND NOT joined AND pt + head_us < 350000""")
def tight_joins(spark, d):
    c = F.col("clip_id")
    beats = segments(spark, d).select(
        "project_id", "pos", c.alias("beat"), F.when(c % 3 < 2, "speech").otherwise("broll").alias("kind"),
        (c % 7 * 60_000).alias("tail_us"), (c % 5 * 60_000).alias("head_us"), (c % 4 == 0).alias("joined"),
    )
    return layout.tight_joins(beats)


@query("voice_shots", f"""WITH {SEGMENTS}, s AS (SELECT project_id, beat_mod % 2 AS beat, pos, in_us, out_us, (project_id % 9 + 1) * 1000000 AS length_us, out_us + clip_id % 3 * 1500000 AS clip_us FROM segments),
r AS (SELECT *, sum(out_us - in_us) OVER (PARTITION BY project_id, beat ORDER BY pos) AS en FROM s),
v AS (SELECT *, (en - (out_us - in_us))::BIGINT AS at_us FROM r WHERE en - (out_us - in_us) < length_us),
z AS (SELECT *, lead(pos) OVER (PARTITION BY project_id, beat ORDER BY pos) IS NULL AS lst FROM v),
bad AS (SELECT project_id, beat FROM z WHERE lst AND en < length_us AND in_us + length_us - at_us > clip_us)
SELECT project_id, beat, pos, at_us, in_us, CASE WHEN lst THEN in_us + length_us - at_us ELSE out_us END AS out_us FROM z ANTI JOIN bad USING (project_id, beat)""")
def voice_shots(spark, d):
    return layout.voice_shots(narrated(spark, d))


@query("uncovered_voice", f"""WITH {SEGMENTS}, s AS (SELECT project_id, beat_mod % 2 AS beat, pos, in_us, out_us, (project_id % 9 + 1) * 1000000 AS length_us, out_us + clip_id % 3 * 1500000 AS clip_us FROM segments),
t AS (SELECT project_id, beat, any_value(length_us) AS length_us, sum(out_us - in_us)::BIGINT AS total FROM s GROUP BY ALL), l AS (SELECT project_id, beat, max_by(clip_us - out_us, pos) AS room FROM s GROUP BY ALL)
SELECT project_id, beat, length_us - total AS missing_us FROM t JOIN l USING (project_id, beat) WHERE total < length_us AND length_us - total > room""")
def uncovered_voice(spark, d):
    return layout.uncovered_voice(narrated(spark, d))


def narrated(spark, d):
    return segments(spark, d).select(
        "project_id", (F.col("beat_mod") % 2).alias("beat"), "pos", "in_us", "out_us", ((F.col("project_id") % 9 + 1) * 1_000_000).alias("length_us"),
        (F.col("out_us") + F.col("clip_id") % 3 * 1_500_000).alias("clip_us"),
    )


@query("clip_first_use", f"WITH {SEGMENTS} SELECT project_id, clip_id, row_number() OVER (PARTITION BY project_id ORDER BY fp, clip_id) AS n FROM (SELECT project_id, clip_id, min(pos) AS fp FROM segments GROUP BY ALL)")
def clip_first_use(spark, d):
    return layout.clip_first_use(segments(spark, d))


CAPS = """caps AS (SELECT o_orderkey AS project_id, o_orderkey * 4 + k AS item, (CAST(round(o_totalprice * 100) AS BIGINT) + k * 3333333) % 20000000 AS s_us,
  (CAST(round(o_totalprice * 100) AS BIGINT) + k * 3333333) % 20000000 + 500000 + (o_custkey % 4) * 1000000 AS e_us FROM orders, range(3) r(k))"""


def captions(spark, d):
    base = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("project_id"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"),
    )
    s = (F.col("c") + F.col("k") * 3_333_333) % 20_000_000
    return base.select(
        "project_id", (F.col("project_id") * 4 + F.col("k")).alias("item"), s.alias("s_us"), (s + 500_000 + F.col("o_custkey") % 4 * 1_000_000).alias("e_us")
    )


@query("content_end", f"WITH {PLACED}, {CAPS} SELECT v.project_id, greatest(v.e, c.e) AS end_us FROM (SELECT project_id, max_by(end_us, pos) AS e FROM placed GROUP BY 1) v LEFT JOIN (SELECT project_id, max(e_us) AS e FROM caps GROUP BY 1) c USING (project_id)")
def content_end(spark, d):
    return layout.content_end(placed(spark, d), captions(spark, d))


@query("trim_music_cues", f"""WITH {CAPS}, k AS (SELECT *, lead(s_us) OVER (PARTITION BY project_id ORDER BY s_us, item) AS nx FROM caps)
SELECT project_id, item, s_us, least(e_us, coalesce(nx, e_us)) AS e_us FROM k WHERE nx IS NULL OR nx > s_us""")
def trim_music_cues(spark, d):
    return layout.trim_cues(captions(spark, d))


@query("shot_length_limits", f"""WITH {PLACED}, d AS (SELECT project_id, pos, start_us, (out_us - in_us) // speed AS dur_us, CASE WHEN start_us < 6000000 THEN 2500000 ELSE 4000000 END AS limit_us FROM placed) SELECT * FROM d WHERE dur_us > limit_us""")
def shot_length_limits(spark, d):
    return checks.shot_length_limits(placed(spark, d), switch_us=6_000_000, early_us=2_500_000, late_us=4_000_000)


@query("shot_pace", f"""WITH {PLACED}, t AS (SELECT project_id, max_by(end_us, pos) AS total FROM placed GROUP BY 1),
b AS (SELECT project_id, unnest(range(0, least(total, 18000000), 3000000)) AS bin_us FROM t)
SELECT b.project_id, bin_us, count(*) AS shots, sum((out_us - in_us) // speed)::BIGINT AS total_us FROM b JOIN placed p ON p.project_id = b.project_id AND p.start_us < bin_us + 3000000 AND p.end_us > bin_us
GROUP BY ALL HAVING count(*) >= 2 AND sum((out_us - in_us) // speed) > 2000000 * count(*)""")
def shot_pace(spark, d):
    return checks.shot_pace(placed(spark, d), window_us=3_000_000, until_us=18_000_000, limit_us=2_000_000)


@query("dead_time", f"""WITH {PLACED}, {CAPS}, t AS (SELECT project_id, max_by(end_us, pos) AS total FROM placed GROUP BY 1),
c AS (SELECT project_id, (start_us + 500) // 1000 AS ms FROM placed UNION SELECT project_id, (s_us + 500) // 1000 FROM caps SEMI JOIN t USING (project_id) UNION SELECT project_id, 0 FROM t UNION SELECT project_id, (total + 500) // 1000 FROM t),
l AS (SELECT *, lead(ms) OVER (PARTITION BY project_id ORDER BY ms) AS nx FROM c) SELECT project_id, ms AS from_ms, nx AS to_ms FROM l WHERE nx - ms > 3000""")
def dead_time(spark, d):
    return checks.dead_time(placed(spark, d), captions(spark, d), limit_ms=3_000)


ROLL = "r AS (SELECT *, beat_mod < 3 AND NOT muted AS aroll FROM placed)"


@query("aroll_runs", f"""WITH {PLACED}, {ROLL}, f AS (SELECT *, sum(CASE WHEN aroll AND lag(aroll) OVER w THEN 0 ELSE 1 END) OVER () AS x FROM r WINDOW w AS (PARTITION BY project_id ORDER BY pos) LIMIT 0),
g AS (SELECT *, lag(aroll) OVER (PARTITION BY project_id ORDER BY pos) AS pa FROM r), h AS (SELECT *, sum(CASE WHEN aroll AND coalesce(pa, false) THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY pos) AS run FROM g)
SELECT project_id, min(start_us) AS s_us, max_by(end_us, pos) AS e_us FROM h WHERE aroll GROUP BY project_id, run HAVING max_by(end_us, pos) - min(start_us) > 5000000""")
def aroll_runs(spark, d):
    base = placed(spark, d).withColumn("aroll", (F.col("beat_mod") < 3) & ~F.col("muted"))
    return checks.aroll_runs(base, limit_us=5_000_000)


@query("aroll_share", f"""WITH {PLACED}, {ROLL}, s AS (SELECT project_id, sum(CASE WHEN aroll THEN (out_us - in_us) // speed ELSE 0 END)::BIGINT AS aroll_us, max_by(end_us, pos) AS total_us FROM r GROUP BY 1)
SELECT * FROM s WHERE aroll_us > 0 AND (aroll_us * 100 < total_us * 30 OR aroll_us * 100 > total_us * 45)""")
def aroll_share(spark, d):
    base = placed(spark, d).withColumn("aroll", (F.col("beat_mod") < 3) & ~F.col("muted"))
    return checks.aroll_share(base)


@query("continuous_audio_runs", f"""WITH {SEGMENTS}, s AS (SELECT *, clip_id % 3 AS aclip FROM segments),
l AS (SELECT *, lag(aclip) OVER w AS pc, lag(out_us) OVER w AS po, lag(muted) OVER w AS pm FROM s WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
f AS (SELECT *, sum(CASE WHEN pc = aclip AND NOT pm AND NOT muted AND in_us - po <= 33333 AND po - in_us < 2500000 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY pos) AS run FROM l)
SELECT project_id, run::BIGINT AS run, count(*) AS n, min(pos) AS first_pos FROM f GROUP BY ALL""")
def continuous_audio_runs(spark, d):
    segs = segments(spark, d).withColumn("aclip", F.col("clip_id") % 3)
    fresh = ~((F.col("pc") == F.col("aclip")) & ~F.col("pm") & ~F.col("muted") & (F.col("in_us") - F.col("po") <= 33_333) & (F.col("po") - F.col("in_us") < 2_500_000))
    lags = {"pc": F.col("aclip"), "po": F.col("out_us"), "pm": F.col("muted")}
    return islands(segs, P, ["pos"], fresh, lags).groupBy("project_id", "run").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@query("contiguous_id_runs", f"""WITH {SEGMENTS}, s AS (SELECT project_id, pos, clip_id % 2 AS clip, clip_id // 2 % 6 AS n FROM segments),
l AS (SELECT *, lag(clip) OVER w AS pc, lag(n) OVER w AS pn FROM s WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
f AS (SELECT *, sum(CASE WHEN pc = clip AND n = pn + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY pos) AS run FROM l)
SELECT project_id, run::BIGINT AS run, clip, min(n) AS first_n, max(n) AS last_n FROM f GROUP BY ALL""")
def contiguous_id_runs(spark, d):
    s = segments(spark, d).select("project_id", "pos", (F.col("clip_id") % 2).alias("clip"), (idiv("clip_id", 2) % 6).alias("n"))
    fresh = ~((F.col("pc") == F.col("clip")) & (F.col("n") == F.col("pn") + 1))
    runs = islands(s, P, ["pos"], fresh, {"pc": F.col("clip"), "pn": F.col("n")})
    return runs.groupBy("project_id", "run", "clip").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"))


@query("timeline_issues", f"""WITH {PLACED}, {CAPS}, known AS (SELECT p_partkey AS clip_id, p_size * 250000 AS dur_us FROM part WHERE p_partkey % 10 <> 0),
i AS (SELECT project_id, 'unknown_clip' AS code, pos AS ref FROM placed ANTI JOIN known USING (clip_id)
 UNION ALL SELECT project_id, 'range_exceeds_clip', pos FROM placed JOIN known USING (clip_id) WHERE out_us > dur_us + 50000 AND out_us > in_us
 UNION ALL SELECT project_id, 'bad_range', pos FROM placed WHERE out_us <= in_us OR in_us < 0 OR speed <= 0
 UNION ALL SELECT project_id, 'duplicate_id', beat FROM placed GROUP BY project_id, beat HAVING count(*) > 1
 UNION ALL SELECT project_id, 'overlapping_items', item FROM (SELECT project_id, e_us, lead(item) OVER w AS item, lead(s_us) OVER w AS ns FROM caps WINDOW w AS (PARTITION BY project_id ORDER BY s_us, item)) WHERE ns < e_us)
SELECT * FROM i""")
def timeline_issues(spark, d):
    known = table(spark, d, "part").where(F.col("p_partkey") % 10 != 0).select(F.col("p_partkey").alias("clip_id"), (F.col("p_size") * 250_000).cast("bigint").alias("dur_us"))
    return checks.timeline_issues(placed(spark, d), captions(spark, d), known)


#: Timelines with borrowed sound, heard windows, tracks and marks, so that every rule of the validation is met and broken.
TIMELINES = f"""{PLACED}, {CAPS}, known AS (SELECT p_partkey AS clip_id, p_size * 250000 AS dur_us FROM part WHERE p_partkey % 10 <> 0),
tl AS (SELECT project_id, pos, beat AS segment, clip_id, in_us - CASE WHEN clip_id % 50 = 0 THEN 9000000 ELSE 0 END AS in_us, out_us, speed - CASE WHEN clip_id % 31 = 0 THEN 2 ELSE 0 END AS speed, transition,
  CASE WHEN clip_id % 17 = 0 THEN -1 WHEN clip_id % 19 = 0 THEN 999000000 ELSE transition_us END AS transition_us, start_us, end_us,
  CASE WHEN pos % 2 = 0 THEN clip_id + 1 END AS audio_clip, CASE WHEN pos % 2 = 0 THEN in_us - CASE WHEN clip_id % 7 = 0 THEN 3000000 ELSE 0 END END AS audio_in_us,
  CASE WHEN pos % 2 = 0 THEN out_us - CASE WHEN clip_id % 11 = 0 THEN 90000000 ELSE 0 END END AS audio_out_us,
  CASE WHEN pos % 3 = 0 THEN in_us + 100000 END AS window_in_us, CASE WHEN pos % 3 = 0 THEN in_us + (clip_id % 5) * 400000 END AS window_out_us FROM placed),
tot AS (SELECT project_id, max_by(end_us, pos) AS total_us FROM placed GROUP BY 1),
it AS (SELECT project_id, CASE item % 4 WHEN 0 THEN 'caption' WHEN 1 THEN 'music' WHEN 2 THEN 'voice' ELSE 'sfx' END AS track, item, s_us - CASE WHEN project_id % 3 = 0 THEN 900000 ELSE 0 END AS s_us,
  e_us - CASE WHEN project_id % 5 = 0 THEN 2600000 ELSE 0 END AS e_us, CASE WHEN project_id % 4 = 0 THEN ' ' ELSE 'x' END AS text, CASE WHEN project_id % 7 = 0 THEN 'subtitle' ELSE 'hook' END AS style, project_id % 6 <> 0 AS has_file FROM caps
  UNION ALL SELECT project_id, CASE WHEN project_id % 2 = 0 THEN 'caption' ELSE 'music' END, item + 10000000, s_us, e_us, 'y', 'location', true FROM caps),
mk AS (SELECT project_id, CASE item % 3 WHEN 0 THEN 'mute' WHEN 1 THEN 'marker' ELSE 'chapter' END AS kind, item, s_us - s_us % 4000000 AS s_us, e_us - CASE WHEN project_id % 5 = 0 THEN 9000000 ELSE 0 END AS e_us, project_id % 2 = 0 AS known FROM caps
  UNION ALL SELECT project_id, 'chapter', item + 20000000, s_us // 2, e_us, true FROM caps)"""


def timelines(spark, d):
    """(placed, clips, items, marks, projects, totals) as TIMELINES has them."""
    c, even, third = F.col("clip_id"), F.col("pos") % 2 == 0, F.col("pos") % 3 == 0
    p = placed(spark, d)
    tl = p.select(
        "project_id", "pos", F.col("beat").alias("segment"), "clip_id", (F.col("in_us") - F.when(c % 50 == 0, 9_000_000).otherwise(0)).alias("in_us"), "out_us",
        (F.col("speed") - F.when(c % 31 == 0, 2).otherwise(0)).alias("speed"), "transition", F.when(c % 17 == 0, -1).when(c % 19 == 0, 999_000_000).otherwise(F.col("transition_us")).cast("bigint").alias("transition_us"),
        "start_us", "end_us", F.when(even, c + 1).alias("audio_clip"), F.when(even, F.col("in_us") - F.when(c % 7 == 0, 3_000_000).otherwise(0)).alias("audio_in_us"),
        F.when(even, F.col("out_us") - F.when(c % 11 == 0, 90_000_000).otherwise(0)).alias("audio_out_us"),
        F.when(third, F.col("in_us") + 100_000).alias("window_in_us"), F.when(third, F.col("in_us") + (c % 5) * 400_000).alias("window_out_us"),
    )
    known = table(spark, d, "part").where(F.col("p_partkey") % 10 != 0).select(F.col("p_partkey").alias("clip_id"), (F.col("p_size") * 250_000).cast("bigint").alias("dur_us"))
    caps, pid, i = captions(spark, d), F.col("project_id"), F.col("item")
    track = F.when(i % 4 == 0, "caption").when(i % 4 == 1, "music").when(i % 4 == 2, "voice").otherwise("sfx")
    items = caps.select(
        "project_id", track.alias("track"), "item", (F.col("s_us") - F.when(pid % 3 == 0, 900_000).otherwise(0)).alias("s_us"), (F.col("e_us") - F.when(pid % 5 == 0, 2_600_000).otherwise(0)).alias("e_us"),
        F.when(pid % 4 == 0, " ").otherwise("x").alias("text"), F.when(pid % 7 == 0, "subtitle").otherwise("hook").alias("style"), (pid % 6 != 0).alias("has_file"),
    ).unionByName(caps.select("project_id", F.when(pid % 2 == 0, "caption").otherwise("music").alias("track"), (i + 10_000_000).alias("item"), "s_us", "e_us", F.lit("y").alias("text"), F.lit("location").alias("style"), F.lit(True).alias("has_file")))
    kind = F.when(i % 3 == 0, "mute").when(i % 3 == 1, "marker").otherwise("chapter")
    marks = caps.select(
        "project_id", kind.alias("kind"), "item", (F.col("s_us") - F.col("s_us") % 4_000_000).alias("s_us"), (F.col("e_us") - F.when(pid % 5 == 0, 9_000_000).otherwise(0)).alias("e_us"), (pid % 2 == 0).alias("known"),
    ).unionByName(caps.select("project_id", F.lit("chapter").alias("kind"), (i + 20_000_000).alias("item"), idiv("s_us", 2).alias("s_us"), "e_us", F.lit(True).alias("known")))
    projects = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") % 40).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"))
    totals = p.groupBy("project_id").agg(F.max_by("end_us", "pos").alias("total_us"))
    return tl, known, items, marks, projects, totals


ISSUES = f"""s AS (SELECT tl.*, lag(end_us) OVER w AS pe, lag(start_us) OVER w AS ps, k.clip_id AS c, k.dur_us AS d, a.clip_id AS ac, a.dur_us AS ad FROM tl LEFT JOIN known k ON k.clip_id = tl.clip_id LEFT JOIN known a ON a.clip_id = tl.audio_clip WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
x AS (SELECT project_id, segment::VARCHAR AS ref, unnest([CASE WHEN out_us <= in_us THEN 'empty_range' END, CASE WHEN in_us < 0 THEN 'negative_in' END, CASE WHEN speed <= 0 THEN 'bad_speed' END, CASE WHEN c IS NULL THEN 'unknown_clip' END,
 CASE WHEN c IS NOT NULL AND out_us > in_us AND out_us > d + 50000 THEN 'range_exceeds_clip' END, CASE WHEN audio_clip IS NOT NULL AND ac IS NULL THEN 'unknown_audio_clip' END,
 CASE WHEN ac IS NOT NULL AND audio_out_us <= audio_in_us THEN 'empty_audio_range' END, CASE WHEN ac IS NOT NULL AND audio_out_us > audio_in_us AND audio_in_us < 0 THEN 'negative_audio_in' END,
 CASE WHEN ac IS NOT NULL AND audio_out_us > audio_in_us AND audio_in_us >= 0 AND audio_out_us > ad + 50000 THEN 'audio_exceeds_clip' END, CASE WHEN window_out_us <= window_in_us THEN 'empty_window' END,
 CASE WHEN window_out_us > window_in_us AND (window_in_us < coalesce(audio_in_us, in_us) OR window_out_us > coalesce(audio_out_us, out_us)) THEN 'window_outside_audio' END,
 CASE WHEN transition_us < 0 THEN 'negative_transition' END, CASE WHEN transition_us > end_us - start_us THEN 'transition_too_long' END, CASE WHEN start_us < ps THEN 'starts_before_last' END,
 CASE WHEN pe > start_us AND transition <> 'xfade' THEN 'overlap_without_xfade' END]) AS code FROM s
 UNION ALL SELECT project_id, segment::VARCHAR, 'duplicate_id' FROM tl GROUP BY project_id, segment HAVING count(*) > 1
 UNION ALL SELECT project_id, item::VARCHAR, track || '_' || unnest([CASE WHEN track IN ('caption', 'music') AND e_us <= s_us THEN 'empty_range' END, CASE WHEN track = 'caption' AND (s_us < 0 OR e_us > coalesce(total_us, 0)) THEN 'outside_programme' END,
 CASE WHEN track = 'caption' AND trim(text) = '' THEN 'empty_text' END, CASE WHEN track = 'music' AND s_us > coalesce(total_us, 0) THEN 'starts_after_end' END, CASE WHEN track IN ('voice', 'sfx') AND s_us < 0 THEN 'negative_position' END,
 CASE WHEN track <> 'caption' AND NOT has_file THEN 'missing_file' END]) FROM it LEFT JOIN tot USING (project_id)
 UNION ALL SELECT project_id, n::VARCHAR, track || '_overlap' FROM (SELECT project_id, track, e_us, lead(item) OVER w AS n, lead(s_us) OVER w AS ns FROM it WHERE track = 'music' OR (track = 'caption' AND style <> 'subtitle') WINDOW w AS (PARTITION BY project_id, track ORDER BY s_us, item)) WHERE ns < e_us
 UNION ALL SELECT project_id, item::VARCHAR, unnest([CASE WHEN kind = 'mute' AND e_us <= s_us THEN 'mute_empty_range' END, CASE WHEN kind = 'mute' AND NOT known THEN 'mute_unknown_clip' END, CASE WHEN kind = 'marker' AND s_us > coalesce(total_us, 0) THEN 'marker_past_end' END]) FROM mk LEFT JOIN tot USING (project_id)
 UNION ALL SELECT project_id, item::VARCHAR, unnest([CASE WHEN s_us <= coalesce(p, -1000000) THEN 'chapter_not_ascending' END, CASE WHEN p IS NULL AND s_us <> 0 THEN 'first_chapter_not_zero' END]) FROM (SELECT *, lag(s_us) OVER (PARTITION BY project_id ORDER BY item) AS p FROM mk WHERE kind = 'chapter')
 UNION ALL SELECT o_orderkey, o_orderkey::VARCHAR, 'bad_canvas' FROM orders WHERE o_custkey % 40 = 0)"""


@query("timeline_validation", f"WITH {TIMELINES},\n{ISSUES} SELECT * FROM x WHERE code IS NOT NULL")
def timeline_validation(spark, d):
    return validation.validate_timelines(*timelines(spark, d))


@query("preflight", f"""WITH {TIMELINES},
{ISSUES}, src AS (SELECT l_partkey AS clip_id FROM lineitem WHERE l_suppkey % 9 <> 0)
SELECT project_id, ref, code FROM x WHERE code IS NOT NULL AND code NOT LIKE 'music%'
UNION ALL SELECT DISTINCT project_id, c::VARCHAR, 'missing_source' FROM (SELECT project_id, clip_id AS c FROM tl UNION SELECT project_id, audio_clip FROM tl WHERE audio_clip IS NOT NULL) u WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.clip_id = c)""")
def preflight(spark, d):
    sources = table(spark, d, "lineitem").where("l_suppkey % 9 <> 0").select(F.col("l_partkey").alias("clip_id"))
    return validation.preflight(*timelines(spark, d), sources, skip=("music",))
