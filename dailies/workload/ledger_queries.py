"""Ledger, status, probe and noise queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators import ledger, media
from dailies.operators.ordered import plan_splits
from dailies.workload.adapter import RANGES, WORDS, clips, ranges, table, words
from dailies.workload.interval_queries import merged_sql
from dailies.workload.registry import query

COSTS = """costs AS (SELECT o_custkey AS project_id, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS service, l_linestatus AS op,
  CAST(round(l_extendedprice * 100) AS BIGINT) * 10 AS usd_micro FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
ORDER = ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def costs(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate")).cast("bigint").alias("day"),
        F.col("l_returnflag").alias("service"), F.col("l_linestatus").alias("op"), (F.round(F.col("l_extendedprice") * 100).cast("bigint") * 10).alias("usd_micro"),
    )
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("project_id"))
    return li.join(o, "l_orderkey")


def budgets(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("project_id"), (F.round(F.col("c_acctbal") * 100).cast("bigint") * 1_000).alias("cap_micro")
    )


BUDGETS = "budgets AS (SELECT c_custkey AS project_id, CAST(round(c_acctbal * 100) AS BIGINT) * 1000 AS cap_micro FROM customer)"


@query("cost_summary", f"WITH {COSTS} SELECT project_id, service, op, sum(usd_micro)::BIGINT AS usd_micro, count(*) AS entries FROM costs GROUP BY ROLLUP (project_id, service, op) HAVING project_id IS NOT NULL")
def cost_summary(spark, d):
    return ledger.cost_summary(costs(spark, d))


@query("remaining_budget", f"WITH {COSTS}, {BUDGETS} SELECT project_id, cap_micro, coalesce(s, 0) AS spent_micro, greatest(cap_micro - coalesce(s, 0), 0) AS left_micro FROM budgets LEFT JOIN (SELECT project_id, sum(usd_micro)::BIGINT AS s FROM costs GROUP BY 1) USING (project_id)")
def remaining_budget(spark, d):
    return ledger.remaining_budget(costs(spark, d), budgets(spark, d))


@query("estimate_cost", """WITH p AS (SELECT p_brand AS model, min(p_size) AS price_micro, 60 AS per FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1),
w AS (SELECT l_orderkey AS project_id, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) * 100 AS units, p_brand || CASE l_returnflag WHEN 'R' THEN ':free' WHEN 'A' THEN ':batch' ELSE '' END AS model FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT w.*, CASE WHEN price_micro IS NULL OR right(w.model, 5) = ':free' THEN 0 WHEN right(w.model, 6) = ':batch' THEN units * price_micro // (per * 2) ELSE units * price_micro // per END::BIGINT AS usd_micro
FROM w LEFT JOIN p ON p.model = split_part(w.model, ':', 1)""")
def estimate_cost(spark, d):
    part = table(spark, d, "part")
    prices = part.where(F.col("p_brand") != "Brand#1").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_size").cast("bigint").alias("price_micro")).withColumn("per", F.lit(60).cast("bigint"))
    tag = F.when(F.col("l_returnflag") == "R", ":free").when(F.col("l_returnflag") == "A", ":batch").otherwise("")
    work = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("project_id"), "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity").cast("bigint") * 100).alias("units"), F.concat("p_brand", tag).alias("model")
    )
    return ledger.estimate_cost(work, prices)


@query("admit_charges", f"""WITH RECURSIVE {COSTS}, {BUDGETS}, c AS (SELECT costs.*, cap_micro, row_number() OVER (PARTITION BY project_id ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM costs JOIN budgets USING (project_id)),
f AS (SELECT project_id, 0::BIGINT AS rn, 0::BIGINT AS spent, 0::BIGINT AS usd_micro, false AS accepted, 0::BIGINT AS l_orderkey, 0 AS l_linenumber, 0::BIGINT AS l_partkey FROM budgets
 UNION ALL SELECT c.project_id, c.rn, f.spent + CASE WHEN f.spent + c.usd_micro <= c.cap_micro THEN c.usd_micro ELSE 0 END, c.usd_micro, f.spent + c.usd_micro <= c.cap_micro, c.l_orderkey, c.l_linenumber, c.l_partkey
 FROM f JOIN c ON c.project_id = f.project_id AND c.rn = f.rn + 1)
SELECT project_id, l_orderkey, l_linenumber, l_partkey, usd_micro, accepted FROM f WHERE rn > 0""")
def admit_charges(spark, d):
    base = costs(spark, d)
    charges = base.join(budgets(spark, d), "project_id")
    return ledger.admit_charges(charges, ["project_id"], ORDER, splits=plan_splits(base, ["project_id"], "day")).select(
        "project_id", "l_orderkey", "l_linenumber", "l_partkey", "usd_micro", "accepted"
    )


STATUS = "st AS (SELECT user_id AS clip_id, event_type AS stage, event_id, event_id AS ts, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' ELSE 'error' END AS status, CASE WHEN event_id % 4 = 3 THEN props END AS error FROM events)"


def statuses(spark, d):
    e = F.col("event_id")
    status = F.when(e % 4 == 0, "pending").when(e % 4 == 1, "running").when(e % 4 == 2, "done").otherwise("error")
    return table(spark, d, "events").select(
        F.col("user_id").alias("clip_id"), F.col("event_type").alias("stage"), e.alias("event_id"), e.alias("ts"), status.alias("status"), F.when(e % 4 == 3, F.col("props")).alias("error")
    )


@query("latest_status", f"""WITH {STATUS} SELECT clip_id, stage, max_by(status, event_id) AS status, arg_max_null(error, event_id) AS error, max(ts) FILTER (WHERE status = 'running') AS started, max(ts) FILTER (WHERE status = 'done') AS finished FROM st GROUP BY ALL""")
def latest_status(spark, d):
    return ledger.latest_status(statuses(spark, d), ["clip_id", "stage"], ["event_id"])


@query("pending_work", f"""WITH {STATUS}, m AS (SELECT clip_id, stage, max_by(status, event_id) AS status, max(event_id) % 50 AS h FROM st GROUP BY ALL),
i AS (SELECT DISTINCT clip_id, stage, clip_id % 50 AS content_hash FROM st) SELECT i.* FROM i WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.clip_id = i.clip_id AND m.stage = i.stage AND m.status = 'done' AND m.h % 2 = i.content_hash % 2)""")
def pending_work(spark, d):
    st = statuses(spark, d)
    manifest = st.groupBy("clip_id", "stage").agg(F.max_by("status", "event_id").alias("status"), (F.max("event_id") % 50).alias("h"))
    manifest = manifest.select("clip_id", "stage", "status", (F.col("h") % 2).alias("content_hash"))
    items = st.select("clip_id", "stage", (F.col("clip_id") % 50).alias("full")).distinct().withColumn("content_hash", F.col("full") % 2)
    return ledger.pending_work(items, manifest, ["clip_id", "stage"]).select("clip_id", "stage", F.col("full").alias("content_hash"))


PROBE_DOC = """'{{"codec":"' || CASE WHEN p_size % 5 = 0 THEN 'hevc' ELSE 'h264' END || '","pix_fmt":"' || CASE WHEN p_size % 7 = 0 THEN 'yuv420p10le' ELSE 'yuv420p' END || '","r_frame_rate":"' || CASE p_partkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '30/1' WHEN 2 THEN '25' ELSE '120/0' END
 || '","avg_frame_rate":"' || CASE p_partkey % 6 WHEN 0 THEN '24000/1001' WHEN 1 THEN '37/2' ELSE '30/1' END || '","width":' || CASE WHEN p_size % 11 = 0 THEN 1280 ELSE 1920 END || ',"height":1080,"rotation":' || CASE WHEN p_size % 9 = 0 THEN -90 ELSE 0 END || ',"transfer":"' || CASE WHEN p_partkey % 13 = 0 THEN 'arib-std-b67' ELSE 'bt709' END || '"}}'"""
PROBES = f"SELECT p_partkey AS clip_id, {PROBE_DOC.replace('{{', '{').replace('}}', '}')} AS doc FROM part"


def probe_docs(spark, d):
    # the same text expression runs in both engines; it only lands JSON, it is not the operator
    doc = PROBE_DOC.replace("{{", "{").replace("}}", "}")
    return table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), F.expr(doc).alias("doc"))


NORM = f"""raw AS ({PROBES}), n0 AS (SELECT clip_id, doc->>'codec' AS codec, doc->>'pix_fmt' AS pix_fmt, doc->>'r_frame_rate' AS r, doc->>'avg_frame_rate' AS a, (doc->>'width')::INT AS w, (doc->>'height')::INT AS h, (doc->>'rotation')::INT AS rot, doc->>'transfer' AS tr FROM raw),
n1 AS (SELECT *, ((-rot) % 360 + 360) % 360 AS rotation, CASE r WHEN '120/0' THEN 0.0 WHEN '25' THEN 25.0 ELSE split_part(r,'/',1)::DOUBLE / split_part(r,'/',2)::DOUBLE END AS rf, split_part(a,'/',1)::DOUBLE / split_part(a,'/',2)::DOUBLE AS af FROM n0),
n AS (SELECT clip_id, codec, pix_fmt, CASE WHEN pix_fmt LIKE '%10le' THEN 10 ELSE 8 END AS bit_depth, CASE WHEN abs(af - 23.976) < 0.15 THEN 24 WHEN abs(af - 30) < 0.15 THEN 30 WHEN abs(af - 25) < 0.15 THEN 25 ELSE CAST(round_even(af, 0) AS INT) END AS fps_int, rotation,
 CASE WHEN rotation IN (90,270) THEN h ELSE w END AS display_width, CASE WHEN rotation IN (90,270) THEN w ELSE h END AS display_height, CASE WHEN tr = 'arib-std-b67' THEN 'hlg' WHEN tr = 'smpte2084' THEN 'pq' END AS hdr, abs(af - rf) > greatest(af, rf) * 0.02 AS rates_differ FROM n1)"""


@query("normalize_probe", f"WITH {NORM} SELECT *, CASE WHEN display_height > display_width THEN 'portrait' ELSE 'landscape' END AS orientation FROM n")
def normalize_probe(spark, d):
    return media.normalize_probe(probe_docs(spark, d))


MEZZ = f"""{NORM}, z AS (SELECT clip_id, CASE WHEN codec <> 'h264' THEN 'codec ' || codec WHEN pix_fmt <> 'yuv420p' THEN 'pix_fmt ' || pix_fmt WHEN rotation <> 0 THEN 'rotation ' || rotation
 WHEN NOT (display_width = 1920 AND display_height = 1080 OR display_width = 1080 AND display_height = 1920) THEN 'size ' || display_width || 'x' || display_height WHEN rates_differ THEN 'vfr' WHEN hdr IS NOT NULL THEN 'hdr ' || hdr WHEN fps_int <> 30 THEN 'fps ' || fps_int * 1000 ELSE '' END AS reason FROM n)"""


def mezzanine(spark, d):
    p = media.normalize_probe(probe_docs(spark, d)).withColumns({"vfr": F.col("rates_differ"), "fps_milli": F.col("fps_int") * 1000})
    return p.select("clip_id", media.mezzanine_reason().alias("reason"))


@query("mezzanine_reasons", f"WITH {MEZZ} SELECT * FROM z")
def mezzanine_reasons(spark, d):
    return mezzanine(spark, d)


@query("mezzanine_summary", f"WITH {MEZZ} SELECT CASE WHEN reason = '' THEN 'copy' ELSE 'encode' END AS mode, split_part(reason, ' ', 1) AS cause, count(*) AS clips FROM z GROUP BY ALL")
def mezzanine_summary(spark, d):
    return media.mezzanine_summary(mezzanine(spark, d))


@query("variable_rate", f"""WITH {RANGES}, g AS (SELECT clip_id, s_us - lag(s_us) OVER (PARTITION BY clip_id ORDER BY s_us) AS d FROM (SELECT DISTINCT clip_id, s_us FROM ranges)),
m AS (SELECT clip_id, quantile_cont(d, 0.5) AS med FROM g WHERE d > 0 GROUP BY 1), v AS (SELECT clip_id, count(*) AS gaps, count(*) FILTER (WHERE abs(d - med) > med * 0.25) AS off FROM g JOIN m USING (clip_id) WHERE d > 0 GROUP BY 1)
SELECT clip_id, packets, packets <= 12 OR gaps IS NULL OR off * 10 > gaps AS vfr FROM (SELECT clip_id, count(*) AS packets FROM ranges GROUP BY 1) LEFT JOIN v USING (clip_id)""")
def variable_rate(spark, d):
    return media.variable_rate(ranges(spark, d).select("clip_id", F.col("s_us").alias("pts_us")))


BLOCKS = "blocks AS (SELECT event_id % (SELECT count(*) FROM documents) AS clip_id, (event_id // (SELECT count(*) FROM documents)) * 137000 AS s_us, CAST(round(value * 100) AS BIGINT) AS sum_sq, 1000000 AS n FROM events)"


def blocks(spark, d):
    e, n = F.col("event_id"), clips(spark, d)
    return table(spark, d, "events").select(
        (e % n).alias("clip_id"), (idiv(e, n) * 137_000).alias("s_us"), F.round(F.col("value") * 100).cast("bigint").alias("sum_sq"), F.lit(1_000_000).cast("bigint").alias("n")
    )


LEVELS = f"""{WORDS}, {BLOCKS}, {merged_sql('words', 'm', 0, 0)}, w AS (SELECT clip_id, greatest(min(s_us) - 1000000, 0) AS w0, max(e_us) + 1000000 AS w1 FROM words GROUP BY 1 HAVING count(*) >= 4),
gp AS (SELECT clip_id, coalesce(lag(e_us) OVER (PARTITION BY clip_id ORDER BY s_us), w0) AS s_us, s_us AS e_us FROM m JOIN w USING (clip_id) UNION ALL SELECT clip_id, max(e_us), any_value(w1) FROM m JOIN w USING (clip_id) GROUP BY 1),
sp AS (SELECT clip_id, 'speech' AS part, s_us, e_us FROM m UNION ALL SELECT clip_id, 'gap', s_us, e_us FROM gp WHERE e_us > s_us),
h AS (SELECT sp.clip_id, sum(sum_sq) FILTER (WHERE part = 'speech') AS ss, sum(n) FILTER (WHERE part = 'speech') AS sn, sum(sum_sq) FILTER (WHERE part = 'gap') AS gs, sum(n) FILTER (WHERE part = 'gap') AS gn FROM blocks b JOIN sp ON b.clip_id = sp.clip_id AND b.s_us >= sp.s_us AND b.s_us < sp.e_us GROUP BY 1),
q AS (SELECT clip_id, sum(e_us - s_us) FILTER (WHERE part = 'speech')::BIGINT AS speech_us, coalesce(sum(e_us - s_us) FILTER (WHERE part = 'gap'), 0)::BIGINT AS gap_us FROM sp GROUP BY 1),
lv AS (SELECT clip_id, speech_us, gap_us, round(greatest(coalesce(log10(ss::DOUBLE / sn::DOUBLE) * 10, -90.0), -90.0), 2) AS speech_db, round(greatest(coalesce(log10(gs::DOUBLE / gn::DOUBLE) * 10, -90.0), -90.0), 2) AS gap_db FROM h JOIN q USING (clip_id) WHERE speech_us >= 500000 AND gap_us >= 500000)"""


@query("noise_levels", f"WITH {LEVELS} SELECT *, round(speech_db - gap_db, 2) AS snr_db FROM lv")
def noise_levels(spark, d):
    return media.noise_levels(words(spark, d), blocks(spark, d))


@query("noise_classes", f"""WITH {LEVELS}, u AS (SELECT DISTINCT l_partkey AS clip_id FROM lineitem WHERE NOT (l_linestatus = 'F' AND l_linenumber % 3 = 0)), c AS (SELECT clip_id, round(speech_db - gap_db, 2) AS snr_db, (clip_id % 10) / 10.0::DOUBLE AS low_band FROM lv SEMI JOIN u USING (clip_id))
SELECT *, CASE WHEN snr_db < 2 AND low_band > 0.8 THEN 'windy' WHEN snr_db < 4 THEN 'noisy' END AS flag FROM c""")
def noise_classes(spark, d):
    used = table(spark, d, "lineitem").where(~((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0))).select(F.col("l_partkey").alias("clip_id"))
    lv = media.noise_levels(words(spark, d), blocks(spark, d)).join(used, "clip_id", "left_semi")
    return media.classify_noise(lv.select("clip_id", "snr_db", ((F.col("clip_id") % 10) / F.lit(10.0)).alias("low_band")))


@query("low_band_ratio", """WITH c AS (SELECT count(*) AS k FROM documents), s AS (SELECT event_id % k AS clip_id, (event_id // k) // 20000 AS stretch, event_id // k AS pos, value AS x FROM events, c),
r AS (SELECT clip_id, stretch, x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY clip_id, stretch) AS n FROM s WINDOW w AS (PARTITION BY clip_id, stretch ORDER BY pos)),
h AS (SELECT clip_id, stretch, i, n, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / greatest(n - 1, 1))) AS y, unnest(range(0, n // 2 + 1)) AS k FROM r),
p AS (SELECT clip_id, stretch, n, k, sum(y * cos(2 * pi() * k * i / n)) ** 2 + sum(y * sin(2 * pi() * k * i / n)) ** 2 AS e FROM h GROUP BY ALL)
SELECT clip_id, stretch, CASE WHEN n < 2 OR sum(e) <= 1e-18 THEN 0.0 ELSE round(coalesce(sum(e) FILTER (WHERE k * 1000.0::DOUBLE / n < 150), 0) / sum(e), 6) END::DOUBLE AS low_band FROM p GROUP BY clip_id, stretch, n""")
def low_band_ratio(spark, d):
    e, n = F.col("event_id"), clips(spark, d)
    samples = table(spark, d, "events").select((e % n).alias("clip_id"), idiv(e, n).alias("pos"), F.col("value").alias("x"))
    return media.low_band_ratio(samples, ["clip_id"], rate=1000, max_s=20.0)


@query("level_gain", f"""WITH {RANGES}, l AS (SELECT clip_id, sum(CASE WHEN event_type <> 'error' THEN e_us - s_us ELSE 0 END)::BIGINT AS speech_us, sum(e_us - s_us)::BIGINT AS span_us, -(10 + clip_id % 30)::DOUBLE AS measured_db FROM ranges GROUP BY 1),
c AS (SELECT *, speech_us * 1000000 // greatest(span_us, 1) AS cover_ppm FROM l) SELECT *, CASE WHEN cover_ppm >= 600000 THEN round(greatest(least(-16.0 - measured_db, 10.0), -10.0), 2) ELSE 0.0 END::DOUBLE AS gain_db FROM c""")
def level_gain(spark, d):
    length = F.col("e_us") - F.col("s_us")
    l = ranges(spark, d).groupBy("clip_id").agg(F.sum(F.when(F.col("event_type") != "error", length).otherwise(0)).alias("speech_us"), F.sum(length).alias("span_us"))
    return media.level_gain(l.withColumn("measured_db", -(F.col("clip_id") % 30 + 10).cast("double")))
