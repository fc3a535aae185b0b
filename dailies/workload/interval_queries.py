"""Interval algebra over the event ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators import intervals as iv
from dailies.operators.ordered import plan_splits
from dailies.workload.adapter import RANGES, SPEECH_TYPES, TASK_DOCUMENTS, TOTAL, WORDS, clip_total, clips, dealt, ranges, table, transcripts
from dailies.workload.registry import query

KEY = ["clip_id"]

A_SIDE = "a AS (SELECT * FROM ranges WHERE event_type IN ('click','view','purchase'))"
B_SIDE = "b AS (SELECT * FROM ranges WHERE event_type NOT IN ('click','view','purchase'))"


def merged_sql(source: str, name: str, gap: int, pad: int, keys: str = "clip_id") -> str:
    return f"""{name}_p AS (SELECT {keys}, greatest(s_us - {pad}, 0) AS s_us, e_us + {pad} AS e_us FROM {source} WHERE e_us > s_us),
{name}_f AS (SELECT *, CASE WHEN s_us - max(e_us) OVER (PARTITION BY {keys} ORDER BY s_us, e_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {name}_p),
{name}_i AS (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s_us, e_us ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_f),
{name} AS (SELECT {keys}, min(s_us) AS s_us, max(e_us) AS e_us FROM {name}_i GROUP BY {keys}, isl)"""


def split_sides(spark, d):
    base = ranges(spark, d)
    speech = F.col("event_type").isin(*SPEECH_TYPES)
    return base.where(speech), base.where(~speech), plan_splits(base, KEY, "s_us")


@query("merge_ranges", f"WITH {RANGES}, {merged_sql('ranges', 'm', 400000, 150000)} SELECT * FROM m")
def merge_ranges(spark, d):
    base = ranges(spark, d)
    return iv.merge_ranges(base, KEY, splits=plan_splits(base, KEY, "s_us"))


@query("subtract_ranges", f"""WITH {RANGES}, {A_SIDE}, {B_SIDE}, {merged_sql('b', 'm', 0, 0)},
pts AS (SELECT a.clip_id, a.event_id, a.s_us AS p FROM a WHERE e_us > s_us
  UNION SELECT a.clip_id, a.event_id, a.e_us FROM a WHERE e_us > s_us
  UNION SELECT a.clip_id, a.event_id, m.s_us FROM a JOIN m ON a.clip_id = m.clip_id AND m.s_us > a.s_us AND m.s_us < a.e_us
  UNION SELECT a.clip_id, a.event_id, m.e_us FROM a JOIN m ON a.clip_id = m.clip_id AND m.e_us > a.s_us AND m.e_us < a.e_us),
seg AS (SELECT clip_id, event_id, p AS s_us, lead(p) OVER (PARTITION BY clip_id, event_id ORDER BY p) AS e_us FROM pts)
SELECT * FROM seg WHERE e_us IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.clip_id = seg.clip_id AND m.s_us <= seg.s_us AND m.e_us >= seg.e_us)""")
def subtract_ranges(spark, d):
    a, b, splits = split_sides(spark, d)
    return iv.subtract_ranges(a, b, KEY, "event_id", splits=splits)


@query("complement_ranges", f"""WITH {RANGES}, w AS (SELECT clip_id, 500000000 AS w0, {TOTAL} - 500000000 AS w1 FROM (SELECT DISTINCT clip_id FROM ranges)),
c AS (SELECT w.clip_id, w0, w1, greatest(s_us, w0) AS s_us, least(e_us, w1) AS e_us FROM ranges JOIN w USING (clip_id)),
g AS (SELECT clip_id, coalesce(max(e_us) OVER (PARTITION BY clip_id ORDER BY s_us, e_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w0) AS s_us, s_us AS e_us FROM c WHERE e_us > s_us
 UNION ALL SELECT w.clip_id, coalesce((SELECT max(e_us) FROM c WHERE c.clip_id = w.clip_id AND c.e_us > c.s_us), w.w0), w.w1 FROM w)
SELECT * FROM g WHERE e_us > s_us""")
def complement_ranges(spark, d):
    base = ranges(spark, d)
    windows = base.select("clip_id").distinct().select(
        "clip_id", F.lit(500_000_000).cast("bigint").alias("w0_us"), (clip_total() - 500_000_000).alias("w1_us")
    )
    return iv.complement(base, windows, KEY, splits=plan_splits(base, KEY, "s_us"))


@query("range_coverage", f"""WITH {RANGES}, {A_SIDE}, {B_SIDE},
o AS (SELECT a.clip_id, a.event_id, a.s_us, a.e_us, sum(CASE WHEN b.clip_id IS NULL THEN 0 ELSE greatest(0, least(a.e_us, b.e_us) - greatest(a.s_us, b.s_us)) END)::BIGINT AS overlap_us
 FROM a LEFT JOIN b ON a.clip_id = b.clip_id AND a.s_us < b.e_us AND b.s_us < a.e_us GROUP BY ALL)
SELECT *, CASE WHEN e_us <= s_us THEN 1000000 ELSE least((overlap_us * 1000000) // (e_us - s_us), 1000000) END AS covered_ppm FROM o""")
def range_coverage(spark, d):
    a, b, _ = split_sides(spark, d)
    return iv.coverage(a, b, KEY, "event_id")


@query("total_range_length", f"""WITH {RANGES} SELECT clip_id, event_type, sum(greatest(e_us - s_us, 0))::BIGINT AS total_us FROM ranges GROUP BY ALL""")
def total_range_length(spark, d):
    return ranges(spark, d).groupBy("clip_id", "event_type").agg(
        F.sum(F.greatest(F.col("e_us") - F.col("s_us"), F.lit(0))).alias("total_us")
    )


@query("adjacent_overlaps", f"""WITH {RANGES}, n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(s_us) OVER w AS ns FROM ranges WINDOW w AS (PARTITION BY clip_id ORDER BY s_us, event_id))
SELECT clip_id, event_id, next_id, e_us - ns AS overlap_us FROM n WHERE ns < e_us""")
def adjacent_overlaps(spark, d):
    base = ranges(spark, d)
    return iv.adjacent_overlaps(base, KEY, "event_id", splits=plan_splits(base, KEY, "s_us"))


@query("intersect_ranges", f"""WITH {RANGES}, {A_SIDE}, {B_SIDE}
SELECT a.clip_id, a.event_id AS a_id, b.event_id AS b_id, greatest(a.s_us, b.s_us) AS s_us, least(a.e_us, b.e_us) AS e_us
FROM a JOIN b ON a.clip_id = b.clip_id AND least(a.e_us, b.e_us) - greatest(a.s_us, b.s_us) > 1000""")
def intersect_ranges(spark, d):
    a, b, _ = split_sides(spark, d)
    return iv.intersect_ranges(a.withColumnRenamed("event_id", "a_id"), b.withColumnRenamed("event_id", "b_id"), KEY)


def analysis(spark, d):
    """Per document: two instruction spans and, on every fifth, a take with three attempts."""
    ms = lambda x: (x * 1_000).cast("bigint")
    at = F.col("doc_id") % 7
    span = lambda s, e: F.struct(ms(s).alias("s_us"), ms(e).alias("e_us"))
    instr = F.array(span(at * 2_000 + 1_000, at * 2_000 + 2_500), span(at * 9_000 + 30_000, at * 9_000 + 31_000 - at * 400))
    attempts = F.array(span(at * 0 + 5_000, at * 0 + 8_000), span(at * 0 + 9_000, at * 0 + 13_000), span(at * 100 + 14_000, at * 100 + 20_000))
    keep = (F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 9 - 4)).cast("int")
    take = F.struct(attempts.alias("attempts"), keep.alias("keep"))
    takes = F.when(F.col("doc_id") % 5 == 0, F.array(take)).otherwise(F.slice(F.array(take), 1, 0))
    rows = dealt(table(spark, d, "documents").select("source", "doc_id"), "doc_id", clips(spark, d), TASK_DOCUMENTS)  # beside the words of their clips
    return rows.select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("clip_id"), instr.alias("instructions"), takes.alias("takes")
    )


ANALYSIS = """instr AS (SELECT source AS project_id, doc_id AS clip_id, (doc_id%7*2000+1000)*1000 AS s_us, (doc_id%7*2000+2500)*1000 AS e_us FROM documents
  UNION ALL SELECT source, doc_id, (doc_id%7*9000+30000)*1000, (doc_id%7*9000+31000-doc_id%7*400)*1000 FROM documents),
att AS (SELECT source AS project_id, doc_id AS clip_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 9 - 4 END AS keep, a.*
  FROM documents, LATERAL (VALUES (0, 5000000, 8000000), (1, 9000000, 13000000), (2, (doc_id%7*100+14000)*1000, (doc_id%7*100+20000)*1000)) a(i, s_us, e_us)
  WHERE doc_id % 5 = 0)"""


@query("protected_ranges", f"""WITH {ANALYSIS}
SELECT project_id, clip_id, s_us, e_us, 'instruction' AS why FROM instr WHERE e_us > s_us
UNION ALL SELECT project_id, clip_id, s_us, e_us, 'rejected_take' FROM att
WHERE e_us > s_us AND i <> CASE WHEN keep IS NULL THEN 2 WHEN keep < 0 THEN keep + 3 ELSE keep END""")
def protected_ranges(spark, d):
    return iv.protected_ranges(analysis(spark, d), ["project_id", "clip_id"])


DUCK = f"""dk_s AS (SELECT clip_id, s_us, e_us, {TOTAL} AS total FROM ranges WHERE event_type IN ('click','view','purchase') AND e_us > s_us AND s_us < {TOTAL}),
dk_a AS (SELECT *, greatest(0, s_us - 150000) AS a1 FROM dk_s),
dk_b AS (SELECT *, greatest(0, a1 - 150000) AS a0, greatest(least(e_us, total), a1) AS b0 FROM dk_a),
dk_c AS (SELECT *, least(b0 + 600000, total) AS b1 FROM dk_b),
dk_f AS (SELECT *, CASE WHEN a0 <= max(b1) OVER (PARTITION BY clip_id ORDER BY s_us, e_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM dk_c),
dk_i AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY s_us, e_us ROWS UNBOUNDED PRECEDING) AS isl FROM dk_f),
dk AS (SELECT clip_id, min(a0) AS a0, min(a1) AS a1, max(b0) AS b0, max(b1) AS b1 FROM dk_i GROUP BY clip_id, isl)"""


def _ducks(spark, d):
    a, b, splits = split_sides(spark, d)
    return iv.duck_regions(a.withColumn("total_us", clip_total()), KEY, "total_us", splits=splits), b, splits


@query("duck_regions", f"WITH {RANGES}, {DUCK} SELECT * FROM dk")
def duck_regions(spark, d):
    return _ducks(spark, d)[0]


ENV = "CASE WHEN a0 IS NULL OR t_us < a0 OR t_us >= b1 THEN 0.0 WHEN t_us < a1 THEN (t_us - a0)::DOUBLE / (a1 - a0)::DOUBLE WHEN t_us < b0 THEN 1.0 ELSE (b1 - t_us)::DOUBLE / (b1 - b0)::DOUBLE END"


@query("duck_envelope", f"""WITH {RANGES}, {B_SIDE}, {DUCK}, s AS (SELECT clip_id, event_id, s_us AS t_us FROM b)
SELECT s.clip_id, s.event_id, s.t_us, CAST({ENV} AS DOUBLE) AS env FROM s LEFT JOIN dk ON s.clip_id = dk.clip_id AND s.t_us >= dk.a0 AND s.t_us < dk.b1""")
def duck_envelope(spark, d):
    regions, b, splits = _ducks(spark, d)
    return iv.duck_envelope(b.select("clip_id", "event_id", F.col("s_us").alias("t_us")), regions, KEY, "t_us", splits=splits)


@query("duck_keyframes", f"""WITH {RANGES}, {DUCK},
t AS (SELECT dk.*, unnest(list_concat([a0], range(a0 + 50000, a1, 50000), [a1, b0], range(b0 + 50000, b1, 50000), [b1, b1])) AS t_us,
  generate_subscripts(list_concat([a0], range(a0 + 50000, a1, 50000), [a1, b0], range(b0 + 50000, b1, 50000), [b1, b1]), 1) AS k FROM dk),
g AS (SELECT clip_id, t_us, k, round(1.0::DOUBLE - 0.75::DOUBLE * ({ENV})::DOUBLE, 6) AS gain FROM t UNION ALL SELECT DISTINCT clip_id, -1, 0, 1.0::DOUBLE FROM dk),
l AS (SELECT *, lag(gain) OVER (PARTITION BY clip_id ORDER BY t_us, k) AS prev FROM g)
SELECT clip_id, greatest(t_us, 0) AS t_us, gain FROM l WHERE prev IS NULL OR abs(gain - prev) >= 1e-6""")
def duck_keyframes(spark, d):
    regions, _, splits = _ducks(spark, d)
    return iv.duck_keyframes(regions, KEY, splits=splits)


@query("silence_ranges", f"""WITH {RANGES}, ev AS (SELECT clip_id, event_id, s_us, CASE WHEN event_id % 3 = 0 THEN 'end' ELSE 'start' END AS kind FROM ranges),
l AS (SELECT *, lag(kind) OVER w AS pk, lag(s_us) OVER w AS ps, lead(kind) OVER w AS nk FROM ev WINDOW w AS (PARTITION BY clip_id ORDER BY s_us, event_id)),
r AS (SELECT clip_id, ps AS s_us, s_us AS e_us FROM l WHERE kind = 'end' AND pk = 'start'
  UNION ALL SELECT clip_id, s_us, 6400000000 FROM l WHERE kind = 'start' AND nk IS NULL)
SELECT * FROM r WHERE e_us > s_us""")
def silence_ranges(spark, d):
    base = ranges(spark, d)
    events = base.select(
        "clip_id", "event_id", F.col("s_us").alias("t_us"), F.lit(6_400_000_000).alias("duration_us"),
        F.when(F.col("event_id") % 3 == 0, "end").otherwise("start").alias("kind"),
    )
    return iv.silence_ranges(events, KEY, "t_us", "kind", "event_id", "duration_us", splits=plan_splits(base, KEY, "s_us"))


@query("mutes_by_gain", f"""WITH {RANGES}, m AS (SELECT clip_id, -(event_id % 3) * 6 AS gain_db, s_us, e_us FROM ranges WHERE e_us > s_us),
g AS (SELECT clip_id, gain_db, s_us, e_us, count(*) AS copies FROM m GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY clip_id, gain_db ORDER BY s_us, e_us) AS n FROM g""")
def mutes_by_gain(spark, d):
    base = ranges(spark, d).withColumn("gain_db", -(F.col("event_id") % 3) * 6)
    return iv.mutes_by_gain(base, KEY, "gain_db", splits=plan_splits(base, ["clip_id", "gain_db"], "s_us"))


@query("mute_ranges_union", f"""WITH {RANGES}, c AS (SELECT o_custkey AS clip_id FROM orders WHERE o_custkey % 4 <> 0 GROUP BY 1),
q AS (SELECT clip_id, (s_us // 60000000) * 60000000 AS s_us, (s_us // 60000000) * 60000000 + 30000000 + event_id % 2 * 3000 AS e_us, event_id, event_type FROM ranges),
u AS (SELECT clip_id, 0 AS src, event_id, s_us, e_us, -24 AS gain_db FROM q WHERE event_type = 'click'
 UNION ALL SELECT clip_id, 1, event_id, s_us, e_us, CASE WHEN event_type = 'view' THEN -60 ELSE -14 END FROM q WHERE event_type IN ('view', 'error')),
k AS (SELECT *, row_number() OVER (PARTITION BY clip_id, (s_us + 5000) // 10000, (e_us + 5000) // 10000 ORDER BY src, event_id) AS rn FROM u SEMI JOIN c USING (clip_id))
SELECT clip_id, s_us, e_us, gain_db, src FROM k WHERE rn = 1""")
def mute_ranges_union(spark, d):
    minute = idiv("s_us", 60_000_000) * 60_000_000
    base = ranges(spark, d).select(
        "clip_id", F.col("event_id").alias("pos"), "event_type", minute.alias("s_us"),
        (minute + 30_000_000 + F.col("event_id") % 2 * 3_000).alias("e_us"),
    )
    suggest = F.expr("CASE event_type WHEN 'view' THEN 'mute' WHEN 'error' THEN 'duck' ELSE 'keep' END")
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("clip_id")).where(F.col("clip_id") % 4 != 0).distinct()
    return iv.mute_ranges_union(
        base.where(F.col("event_type") == "click").withColumn("gain_db", F.lit(-24)),
        base.where(F.col("event_type") != "click").withColumn("suggest", suggest),
        known, KEY,
    )


@query("apply_mute_edits", """WITH RECURSIVE req AS (SELECT user_id AS project_id, event_id,
  CASE WHEN event_id % 5 < 3 THEN 'add' WHEN event_id % 5 = 3 THEN 'update' ELSE 'delete' END AS op,
  event_id % 3 AS clip, event_id % 11 * 1000000 AS s_us, event_id % 11 * 1000000 + (event_id % 7 - 1) * 500000 AS e_us,
  CASE WHEN event_id % 2 = 0 THEN event_id % 6 END AS idx, event_id % 13 % 11 * 1000000 + 400 AS ms,
  event_id % 13 % 11 * 1000000 + (event_id % 17 % 7 - 1) * 500000 AS me,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT u.project_id, 0::BIGINT AS rn, []::STRUCT(slot BIGINT, clip BIGINT, s BIGINT, e BIGINT)[] AS live, 0::BIGINT AS born, NULL::BIGINT AS event_id, ''::VARCHAR AS outcome, NULL::BIGINT AS slot
  FROM (SELECT DISTINCT user_id AS project_id FROM events) u
 UNION ALL
 SELECT project_id, rn, CASE WHEN outcome = 'added' THEN list_append(live, {'slot': born, 'clip': clip, 's': s_us, 'e': e_us})
   WHEN outcome = 'deleted' THEN list_concat(live[1:(hit-1)], live[(hit+1):])
   WHEN outcome = 'updated' THEN list_concat(live[1:(hit-1)], [{'slot': live[hit].slot, 'clip': clip, 's': s_us, 'e': e_us}], live[(hit+1):])
   ELSE live END, CASE WHEN outcome = 'added' THEN born + 1 ELSE born END, event_id, outcome,
   CASE WHEN outcome = 'added' THEN born WHEN outcome IN ('deleted','updated') THEN live[hit].slot END
 FROM (SELECT *, CASE WHEN op <> 'delete' AND e_us <= s_us THEN 'bad_range' WHEN op = 'add' THEN 'added' WHEN hit IS NULL OR hit = 0 THEN 'not_found' WHEN op = 'delete' THEN 'deleted' ELSE 'updated' END AS outcome
   FROM (SELECT f.project_id, r.rn, f.live, f.born, r.event_id, r.op, r.clip, r.s_us, r.e_us,
     CASE WHEN r.idx IS NOT NULL AND r.idx < len(f.live) THEN r.idx + 1
       ELSE list_position(list_transform(f.live, lambda x: x.clip = r.clip AND abs(x.s - r.ms) < 1000 AND abs(x.e - r.me) < 1000), true) END AS hit
     FROM f JOIN req r ON r.project_id = f.project_id AND r.rn = f.rn + 1)))
SELECT project_id, event_id, outcome, slot, len(live) AS live FROM f WHERE rn > 0""")
def apply_mute_edits(spark, d):
    eid = F.col("event_id")
    requests = table(spark, d, "events").select(
        F.col("user_id").alias("project_id"), "event_id",
        F.when(eid % 5 < 3, "add").when(eid % 5 == 3, "update").otherwise("delete").alias("op"),
        (eid % 3).alias("clip"), (eid % 11 * 1_000_000).alias("s_us"),
        (eid % 11 * 1_000_000 + (eid % 7 - 1) * 500_000).alias("e_us"),
        F.when(eid % 2 == 0, eid % 6).alias("index"),
        (eid % 13 % 11 * 1_000_000 + 400).alias("match_s"),
        (eid % 13 % 11 * 1_000_000 + (eid % 17 % 7 - 1) * 500_000).alias("match_e"),
    )
    return iv.apply_mute_edits(requests, ["project_id"], ["event_id"]).select("project_id", "event_id", "outcome", "slot", "live")
