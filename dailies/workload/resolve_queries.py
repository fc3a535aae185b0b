"""Cut resolution, plan conversion and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators import layout, resolve
from dailies.operators.ordered import plan_splits
from dailies.session import materialize
from dailies.workload.adapter import RANGES, SEGMENTS, WORDS, clips, ranges, segments, table, words
from dailies.workload.interval_queries import A_SIDE, B_SIDE, merged_sql, split_sides
from dailies.workload.layout_queries import CAPS, PLACED, SPANS, captions, placed
from dailies.workload.registry import query
from dailies.workload.text_queries import SENT, sentences

P = ["project_id"]


def cut_beats(spark, d):
    """Two sentences per beat of every clip, some reused, skipping or past the end, with shots on some."""
    s = materialize(sentences(spark, d).select("clip_id", "n", "first", "last", "s_us", "e_us"))
    k = F.col("k")
    base = s.groupBy("clip_id").agg(F.max("n").alias("total"), F.max("e_us").alias("end")).select(
        "clip_id", "total", (F.col("end") + 1_000_000).alias("dur_us"), F.explode(F.sequence(F.lit(0), idiv(F.col("total"), 2).cast("int"))).alias("k"))
    a = F.when((k % 5 == 4), 2 * k - 1).otherwise(2 * k + 1)
    b = F.when(k % 7 == 6, a + 2).otherwise(a + 1)
    base = base.withColumns({"a": a.cast("int"), "b": b.cast("int")})
    one = s.select("clip_id", F.col("n").alias("a"), F.col("first").alias("first_word"), F.col("s_us").alias("first_us"), F.col("e_us").alias("a_end"))
    two = s.select("clip_id", F.col("n").alias("b"), F.col("last").alias("last_word"), F.col("e_us").alias("last_us"))
    j = base.join(one, ["clip_id", "a"], "left").join(two, ["clip_id", "b"], "left")
    sent = lambda n: F.struct(F.col(n).cast("bigint").alias("n"), (F.col(n) <= F.col("total")).alias("known"), ((F.col("clip_id") + F.col(n)) % 11 == 0).alias("instruction"))
    shot = lambda i, point: F.struct((F.col("clip_id") + i).alias("clip"), F.lit(1_000_000).cast("bigint").alias("in_us"), F.lit(2_000_000).cast("bigint").alias("out_us"), point.alias("point_us"), F.lit(2_500_000).cast("bigint").alias("limit_us"))
    none = F.lit(None).cast("bigint")
    shots = F.when(k % 3 == 0, F.array(shot(1, F.col("a_end")))).when(k % 3 == 1, F.array(shot(2, none), shot(3, F.col("a_end")))).otherwise(F.slice(F.array(shot(1, none)), 1, 0))
    known = F.col("first_us").isNotNull() & F.col("last_us").isNotNull()
    first, last = F.when(known, F.col("first_us")).otherwise(0), F.when(known, F.col("last_us")).otherwise(0)
    return j.select(
        F.col("clip_id").alias("project_id"), k.cast("bigint").alias("pos"), F.concat_ws("-", F.col("clip_id").cast("string"), k.cast("string")).alias("uid"), F.lit("speech").alias("kind"), "clip_id",
        F.array(sent("a"), sent("b")).alias("sents"), F.coalesce("first_word", F.lit(0)).cast("bigint").alias("first_word"), F.coalesce("last_word", F.lit(0)).cast("bigint").alias("last_word"),
        first.alias("first_us"), last.alias("last_us"), "dur_us", F.greatest(first - 300_000, F.lit(0)).alias("seg_in"), F.least(last + 450_000, "dur_us").alias("seg_out"),
        F.greatest(first - 100_000, F.lit(0)).alias("a0"), F.least(last + 100_000, "dur_us").alias("a1"), shots.alias("shots"))


CUT = SENT + """, tt AS (SELECT clip_id, max(n) AS total FROM sent GROUP BY 1), kk AS (SELECT clip_id, total, unnest(range(0, total // 2 + 1)) AS k FROM tt),
ab AS (SELECT *, CASE WHEN k % 7 = 6 THEN a + 2 ELSE a + 1 END AS b FROM (SELECT *, CASE WHEN k % 5 = 4 THEN 2*k-1 ELSE 2*k+1 END AS a FROM kk)),
wk AS (SELECT clip_id, 0::BIGINT AS k, []::BIGINT[] AS cl, 'x'::VARCHAR AS error FROM tt UNION ALL
 SELECT clip_id, k + 1, CASE WHEN error = '' THEN list_concat(cl, [a, b]) ELSE cl END, error FROM (SELECT w.clip_id, w.k, w.cl, a, b,
  CASE WHEN a > total THEN 'unknown_sentence' WHEN (w.clip_id + a) % 11 = 0 THEN 'instruction_sentence' WHEN list_contains(w.cl, a) THEN 'sentence_reused' WHEN b > total THEN 'unknown_sentence' WHEN (w.clip_id + b) % 11 = 0 THEN 'instruction_sentence' WHEN list_contains(w.cl, b) THEN 'sentence_reused'
   WHEN b <> a + 1 THEN 'sentences_not_contiguous' ELSE '' END AS error FROM wk w JOIN ab ON ab.clip_id = w.clip_id AND ab.k = w.k))"""


@query("sentence_claims", f"WITH RECURSIVE {CUT} SELECT clip_id AS project_id, k - 1 AS pos, nullif(error, '') AS error FROM wk WHERE k > 0")
def sentence_claims(spark, d):
    return resolve.resolve_beats(cut_beats(spark, d)).select("project_id", "pos", "error")


@query("resolve_cut")
def resolve_cut(spark, d):
    return resolve.beat_segments(resolve.resolve_beats(cut_beats(spark, d)))


@query("range_problems", f"WITH {SEGMENTS}, r AS (SELECT project_id, pos, in_us - 500000 AS in_us, out_us, p_size * 250000 AS dur_us FROM segments JOIN part ON p_partkey = clip_id), x AS (SELECT *, CASE WHEN in_us < 0 THEN 'negative_in' WHEN out_us <= in_us THEN 'empty' WHEN out_us > dur_us + 50000 THEN 'past_end' END AS problem FROM r) SELECT * FROM x WHERE problem IS NOT NULL")
def range_problems(spark, d):
    known = table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), (F.col("p_size") * 250_000).cast("bigint").alias("dur_us"))
    r = segments(spark, d).join(known, "clip_id").select("project_id", "pos", (F.col("in_us") - 500_000).alias("in_us"), "out_us", "dur_us")
    return resolve.range_problems(r)


@query("broll_pieces", f"""WITH {SEGMENTS}, {WORDS}, b AS (SELECT project_id, pos, clip_id, in_us, least(out_us, p_size * 250000 - 33333) AS out_us, muted FROM segments JOIN part ON p_partkey = clip_id)
SELECT project_id, pos, clip_id, in_us, out_us, NOT muted AND EXISTS (SELECT 1 FROM words w WHERE w.clip_id = b.clip_id AND w.s_us < b.out_us AND w.e_us > b.in_us) AS speaks FROM b WHERE out_us > in_us""")
def broll_pieces(spark, d):
    known = table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), (F.col("p_size") * 250_000).cast("bigint").alias("dur_us"))
    b = segments(spark, d).join(known, "clip_id").withColumn("beat", F.struct("project_id", "pos"))
    return resolve.broll_pieces(b, words(spark, d)).select("project_id", "pos", "clip_id", "in_us", "out_us", "speaks")


@query("place_captions", f"""WITH {SPANS}, c AS (SELECT l_orderkey AS project_id, l_linenumber * 100000 + l_suppkey AS item, l_partkey % 6 AS beat, l_suppkey * 10000 AS offset_us, l_partkey % 9 * 300000 AS length_us FROM lineitem)
SELECT c.project_id, item, c.beat, start_us + offset_us AS at_us, CASE WHEN start_us IS NOT NULL THEN greatest(least(start_us + offset_us + length_us, end_us + 500000), start_us + offset_us + 100000) END AS to_us, start_us IS NULL AS dropped FROM c LEFT JOIN spans s ON s.project_id = c.project_id AND s.beat = c.beat""")
def place_captions(spark, d):
    c = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project_id"), (F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).alias("item"), (F.col("l_partkey") % 6).alias("beat"),
        (F.col("l_suppkey") * 10_000).alias("offset_us"), (F.col("l_partkey") % 9 * 300_000).alias("length_us"))
    return resolve.place_captions(c, layout.beat_spans(placed(spark, d)))


@query("place_music", f"""WITH {SPANS}, c AS (SELECT o_orderkey AS project_id, o_custkey AS item, o_custkey % 6 AS fb, o_custkey // 6 % 6 AS tb FROM orders), e AS (SELECT project_id, min(start_us) AS p0, max(end_us) AS p1 FROM spans GROUP BY 1),
j AS (SELECT c.project_id, item, coalesce(a.start_us, p0) AS s_us, coalesce(b.end_us, p1) AS e_us FROM c JOIN e USING (project_id) LEFT JOIN spans a ON a.project_id = c.project_id AND a.beat = fb LEFT JOIN spans b ON b.project_id = c.project_id AND b.beat = tb) SELECT * FROM j WHERE e_us > s_us""")
def place_music(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_custkey").alias("item"), (F.col("o_custkey") % 6).alias("from_beat"), (idiv("o_custkey", 6) % 6).alias("to_beat"))
    return resolve.place_music(c, layout.beat_spans(placed(spark, d)))


CHOSEN = "ch AS (SELECT user_id AS project_id, event_id AS pos, (event_id // 40) % (SELECT count(*) FROM documents) AS clip_id, 1 + event_id % 40 // 2 AS n FROM events)"


@query("plan_speech_beats", f"""WITH {SENT}, {CHOSEN}, u AS (SELECT ch.project_id, ch.clip_id, ch.n, min(pos) AS pos FROM ch JOIN sent s ON s.clip_id = ch.clip_id AND s.n = ch.n AND (s.clip_id + s.n) % 11 <> 0 GROUP BY ALL),
l AS (SELECT *, lag(clip_id) OVER w AS pc, lag(n) OVER w AS pn FROM u WINDOW w AS (PARTITION BY project_id ORDER BY pos)), r AS (SELECT *, sum(CASE WHEN pc = clip_id AND n = pn + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id ORDER BY pos) AS beat FROM l)
SELECT project_id, beat::BIGINT AS beat, clip_id, min(n) AS first_n, max(n) AS last_n, count(*) AS sentences FROM r GROUP BY ALL""")
def plan_speech_beats(spark, d):
    e = F.col("event_id")
    chosen = table(spark, d, "events").select(F.col("user_id").alias("project_id"), e.alias("pos"), (idiv(e, 40) % clips(spark, d)).alias("clip_id"), (idiv(e % 40, 2) + 1).cast("int").alias("n"))
    return resolve.plan_speech_beats(chosen, sentences(spark, d))


@query("plan_broll", f"""WITH {RANGES}, {A_SIDE}, {B_SIDE}, {merged_sql('b', 'm', 0, 0)},
pts AS (SELECT a.clip_id, a.event_id, a.s_us AS p FROM a WHERE e_us > s_us UNION SELECT a.clip_id, a.event_id, a.e_us FROM a WHERE e_us > s_us
  UNION SELECT a.clip_id, a.event_id, m.s_us FROM a JOIN m ON a.clip_id = m.clip_id AND m.s_us > a.s_us AND m.s_us < a.e_us UNION SELECT a.clip_id, a.event_id, m.e_us FROM a JOIN m ON a.clip_id = m.clip_id AND m.e_us > a.s_us AND m.e_us < a.e_us),
seg AS (SELECT clip_id, event_id AS item, p AS s_us, lead(p) OVER (PARTITION BY clip_id, event_id ORDER BY p) AS e_us FROM pts)
SELECT * FROM seg WHERE e_us - s_us >= 800000 AND NOT EXISTS (SELECT 1 FROM m WHERE m.clip_id = seg.clip_id AND m.s_us <= seg.s_us AND m.e_us >= seg.e_us)""")
def plan_broll(spark, d):
    a, b, splits = split_sides(spark, d)
    return resolve.plan_broll(a.withColumnRenamed("event_id", "item"), b, splits=splits)


@query("plan_captions", f"""WITH {CAPS}, c AS (SELECT project_id, item, item % 5 = 0 AS sub, s_us - 700000 AS s, CASE WHEN item % 7 <> 0 THEN e_us ELSE 0 END AS e FROM caps), k AS (SELECT project_id, item, sub, greatest(s, 0) AS s_us, least(CASE WHEN e <= greatest(s, 0) THEN greatest(s, 0) + 2500000 ELSE e END, 18000000) AS e_us FROM c),
l AS (SELECT *, lead(s_us) OVER (PARTITION BY project_id ORDER BY s_us, item) AS n FROM k WHERE e_us - s_us >= 400000)
SELECT project_id, item, s_us, CASE WHEN NOT sub AND coalesce(n < e_us, false) THEN greatest(n - 50000, s_us + 400000) ELSE e_us END AS e_us FROM l""")
def plan_captions(spark, d):
    c = captions(spark, d).select("project_id", "item", (F.col("item") % 5 == 0).alias("subtitle"), (F.col("s_us") - 700_000).alias("s_us"), F.when(F.col("item") % 7 != 0, F.col("e_us")).alias("e_us"), F.lit(18_000_000).cast("bigint").alias("total_us"))
    return resolve.plan_captions(c)


@query("accept_music", f"""WITH RECURSIVE {RANGES}, r AS (SELECT clip_id AS project_id, event_id AS item, s_us, e_us, row_number() OVER (PARTITION BY clip_id ORDER BY s_us, event_id) AS rn FROM ranges),
f AS (SELECT DISTINCT project_id, 0::BIGINT AS rn, 0::BIGINT AS en, 0::BIGINT AS item, false AS accepted, 0::BIGINT AS at_us FROM r UNION ALL
 SELECT r.project_id, r.rn, CASE WHEN r.e_us - greatest(r.s_us, f.en) >= 5000000 THEN r.e_us ELSE f.en END, r.item, r.e_us - greatest(r.s_us, f.en) >= 5000000, CASE WHEN r.e_us - greatest(r.s_us, f.en) >= 5000000 THEN greatest(r.s_us, f.en) END FROM f JOIN r ON r.project_id = f.project_id AND r.rn = f.rn + 1)
SELECT project_id, item, accepted, at_us FROM f WHERE rn > 0""")
def accept_music(spark, d):
    base = ranges(spark, d).select(F.col("clip_id").alias("project_id"), F.col("event_id").alias("item"), "s_us", "e_us")
    return resolve.accept_music(base, splits=plan_splits(base, P, "s_us")).select("project_id", "item", "accepted", "at_us")


BEATS = "beats AS (SELECT project_id, 's' || s_us AS beat, s_us AS start_us FROM (SELECT DISTINCT clip_id AS project_id, s_us FROM ranges WHERE event_type = 'view'))"


def beats_of(spark, d):
    views = ranges(spark, d).where("event_type = 'view'").select(F.col("clip_id").alias("project_id"), F.col("s_us").alias("start_us")).distinct()
    return views.withColumn("beat", F.concat(F.lit("s"), F.col("start_us").cast("string")))


@query("thin_chapters", f"""WITH RECURSIVE {RANGES}, {BEATS}, q AS (SELECT clip_id AS project_id, event_id AS item, s_us + 1000000 AS at_us FROM ranges),
g AS (SELECT q.project_id, item, at_us, start_us AS s_us, beat FROM q ASOF JOIN beats b ON q.project_id = b.project_id AND q.at_us >= b.start_us WHERE start_us <= 6000000000 - 10000000),
u AS (SELECT project_id, s_us, beat, arg_min(item, [at_us, item]) AS item FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY s_us) AS rn FROM u),
f AS (SELECT project_id, rn, s_us AS last, item, beat, s_us, true AS kept FROM r WHERE rn = 1 UNION ALL SELECT r.project_id, r.rn, CASE WHEN r.s_us - f.last >= 60000000 THEN r.s_us ELSE f.last END, r.item, r.beat, r.s_us, r.s_us - f.last >= 60000000 FROM f JOIN r ON r.project_id = f.project_id AND r.rn = f.rn + 1),
o AS (SELECT project_id, arg_min(beat, start_us) AS b0 FROM beats GROUP BY 1)
SELECT project_id, item, CASE WHEN s_us = min(s_us) OVER (PARTITION BY project_id) THEN b0 ELSE beat END AS beat FROM f JOIN o USING (project_id) WHERE kept""")
def thin_chapters(spark, d):
    base = ranges(spark, d).select(F.col("clip_id").alias("project_id"), F.col("event_id").alias("item"), (F.col("s_us") + 1_000_000).alias("at_us"), F.lit(6_000_000_000).alias("total_us"))
    return resolve.thin_chapters(base, beats_of(spark, d), apart_us=60_000_000)


TEMPLATE = [("hook", 0), ("promise", 2_000_000), ("turn", 5_000_000), ("payoff", -2_000_000), ("opening", 0)]
TSQL = """tp(label, at_us) AS (VALUES ('hook', 0), ('promise', 2000000), ('turn', 5000000), ('payoff', -2000000), ('opening', 0)), tot AS (SELECT project_id, max_by(end_us, pos) AS total_us FROM placed GROUP BY 1),
mk AS (SELECT project_id, label, t_us FROM (SELECT project_id, total_us, label, CASE WHEN at_us < 0 THEN total_us + at_us ELSE at_us END AS t_us FROM tot, tp) WHERE t_us BETWEEN 0 AND total_us)"""


def totals(spark, d):
    return placed(spark, d).groupBy("project_id").agg(F.max_by("end_us", "pos").alias("total_us"))


@query("plan_markers", f"""WITH {PLACED}, {TSQL}, c AS (SELECT project_id, total_us, CASE WHEN project_id % 2 = 0 THEN 1500000 ELSE round_even(total_us * 0.3::DOUBLE / 100000, 0)::BIGINT * 100000 END AS t_us FROM tot),
m AS (SELECT * FROM mk UNION ALL SELECT project_id, 'subscribe-cta', t_us FROM c WHERE t_us > 0 AND t_us < total_us), b AS (SELECT project_id, pos AS beat, start_us FROM placed QUALIFY row_number() OVER (PARTITION BY project_id, start_us ORDER BY pos DESC) = 1)
SELECT DISTINCT m.project_id, b.beat, label FROM m ASOF JOIN b ON m.project_id = b.project_id AND m.t_us >= b.start_us""")
def plan_markers(spark, d):
    t = totals(spark, d).withColumn("cta_us", F.when(F.col("project_id") % 2 == 0, 1_500_000).cast("bigint"))
    return resolve.plan_markers(t, placed(spark, d).select("project_id", F.col("pos").alias("beat"), "start_us"), TEMPLATE)


@query("missing_markers", f"""WITH {PLACED}, {TSQL}, {CAPS}, mm AS (SELECT project_id, s_us AS t_us, CASE WHEN item % 3 = 0 THEN 'hook' ELSE 'other' END AS label FROM caps)
SELECT * FROM mk WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.project_id = mk.project_id AND (mm.label = mk.label OR abs(mm.t_us - mk.t_us) <= 1000000))""")
def missing_markers(spark, d):
    m = captions(spark, d).select("project_id", F.col("s_us").alias("t_us"), F.when(F.col("item") % 3 == 0, "hook").otherwise("other").alias("label"))
    return resolve.missing_markers(totals(spark, d), TEMPLATE, m, tolerance_us=1_000_000)


@query("absorb_broll", f"""WITH {SEGMENTS}, b AS (SELECT project_id, pos, CASE WHEN beat_mod < 4 THEN 'broll' ELSE 'speech' END AS kind, out_us - in_us AS dur_us, clip_id % 5 = 0 AS target, clip_id % 7 * 1000000 AS length_us FROM segments),
s AS (SELECT *, sum(CASE WHEN kind <> 'broll' OR target THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY pos) AS g FROM b),
t AS (SELECT s.*, first_value(target) OVER w AS tg, first_value(pos) OVER w AS vp, first_value(length_us) OVER w AS vl, sum(CASE WHEN kind = 'broll' AND NOT target THEN dur_us ELSE 0 END) OVER (PARTITION BY project_id, g ORDER BY pos) - dur_us AS before FROM s WINDOW w AS (PARTITION BY project_id, g ORDER BY pos))
SELECT project_id, pos, vp AS voice_pos, before::BIGINT AS covered_us FROM t WHERE kind = 'broll' AND NOT target AND tg AND before < vl""")
def absorb_broll(spark, d):
    b = segments(spark, d).select("project_id", "pos", F.when(F.col("beat_mod") < 4, "broll").otherwise("speech").alias("kind"), (F.col("out_us") - F.col("in_us")).alias("dur_us"), (F.col("clip_id") % 5 == 0).alias("target"), (F.col("clip_id") % 7 * 1_000_000).alias("length_us"))
    return resolve.absorb_broll(b)


@query("location_cards", f"""WITH RECURSIVE {PLACED}, b AS (SELECT project_id, pos, start_us AS s, end_us AS e, CASE WHEN beat_mod > 0 THEN 'place' || (beat_mod % 3) ELSE '' END AS place, clip_id % 9 = 0 AS cutaway, row_number() OVER (PARTITION BY project_id ORDER BY pos) AS rn,
  greatest(500000, max(end_us) OVER (PARTITION BY project_id) - 1000000) AS to_us FROM placed),
n AS (SELECT *, CASE WHEN place = lag(place) OVER (PARTITION BY project_id ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM b), st AS (SELECT *, sum(nw) OVER (PARTITION BY project_id ORDER BY pos) AS stretch FROM n),
tg AS (SELECT *, min(CASE WHEN e - s >= 1500000 AND s < to_us THEN pos END) OVER (PARTITION BY project_id, stretch ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS card_pos FROM st),
r AS (SELECT tg.*, x.s + 400000 AS at_us, tg.s >= 500000 AND tg.s < tg.to_us AS elig FROM tg LEFT JOIN b x ON x.project_id = tg.project_id AND x.pos = tg.card_pos),
w AS (SELECT DISTINCT project_id, 0::BIGINT AS rn, '?' AS active, false AS entered, -1000000000000::BIGINT AS s0, -1000000000000::BIGINT AS s1, -1000000000000::BIGINT AS s2, 0::BIGINT AS pos, '' AS place, 0::BIGINT AS card_pos, 0::BIGINT AS at_us, false AS card FROM b UNION ALL
 SELECT project_id, rn, CASE WHEN elig AND place <> '' AND place <> act AND cutaway THEN act ELSE place END, entered, CASE WHEN card AND place = 'place0' THEN at_us ELSE s0 END, CASE WHEN card AND place = 'place1' THEN at_us ELSE s1 END, CASE WHEN card AND place = 'place2' THEN at_us ELSE s2 END, pos, place, card_pos, at_us, card
 FROM (SELECT *, coalesce(elig AND place <> '' AND place <> act AND NOT cutaway AND card_pos IS NOT NULL AND s - CASE place WHEN 'place0' THEN s0 WHEN 'place1' THEN s1 ELSE s2 END >= 6000000, false) AS card
  FROM (SELECT r.*, CASE WHEN elig AND NOT w.entered THEN '?' ELSE w.active END AS act, w.entered OR elig AS entered, w.s0, w.s1, w.s2 FROM w JOIN r ON r.project_id = w.project_id AND r.rn = w.rn + 1)))
SELECT project_id, pos, place, card_pos, at_us FROM w WHERE card""")
def location_cards(spark, d):
    k = F.col("beat_mod")
    b = placed(spark, d).select("project_id", "pos", F.col("start_us").alias("s_us"), F.col("end_us").alias("e_us"), F.when(k > 0, F.concat(F.lit("place"), (k % 3).cast("string"))).alias("place"), (F.col("clip_id") % 9 == 0).alias("cutaway"))
    return resolve.location_cards(b, min_gap_us=6_000_000, least_us=1_500_000, open_us=500_000, end_us=1_000_000)


@query("replace_captions", f"""WITH {CAPS}, o AS (SELECT project_id, item, CASE WHEN item % 3 = 0 THEN 'location' ELSE 'text' END AS kind, item % 4 AS beat_pos, s_us AS offset_us FROM caps),
b AS (SELECT * FROM o WHERE kind <> 'location' UNION ALL SELECT project_id, item + 1000000, 'location', beat_pos + 1, offset_us FROM o WHERE item % 4 = 1)
SELECT *, printf('c%03d', row_number() OVER (PARTITION BY project_id ORDER BY beat_pos, offset_us, kind, item)) AS id FROM b""")
def replace_captions(spark, d):
    o = captions(spark, d).select("project_id", "item", F.when(F.col("item") % 3 == 0, "location").otherwise("text").alias("kind"), (F.col("item") % 4).alias("beat_pos"), F.col("s_us").alias("offset_us"))
    new = o.where(F.col("item") % 4 == 1).select("project_id", (F.col("item") + 1_000_000).alias("item"), F.lit("location").alias("kind"), (F.col("beat_pos") + 1).alias("beat_pos"), "offset_us")
    return resolve.replace_captions(o, new)


@query("duration_drift", f"""WITH {SPANS}, v AS (SELECT project_id, beat, end_us - start_us AS d FROM spans), a AS (SELECT project_id, beat, d + beat * 300000 AS d FROM v WHERE project_id % 5 <> 0)
SELECT * FROM (SELECT project_id, beat, coalesce(a.d, 0) - coalesce(v.d, 0) AS drift_us FROM v FULL JOIN a USING (project_id, beat)) WHERE abs(drift_us) > 500000""")
def duration_drift(spark, d):
    v = layout.beat_spans(placed(spark, d)).select("project_id", "beat", (F.col("end_us") - F.col("start_us")).alias("dur_us"))
    a = v.where(F.col("project_id") % 5 != 0).select("project_id", "beat", (F.col("dur_us") + F.col("beat") * 300_000).alias("dur_us"))
    return resolve.duration_drift(v, a)
