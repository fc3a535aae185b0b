"""Analysis documents and rule sets over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.operators import conformance, labels, ledger, reports
from dailies.sources import analysis
from dailies.workload.adapter import table
from dailies.workload.layout_queries import CAPS, PLACED, captions, placed
from dailies.workload.registry import query


def analysis_bodies(spark, d):
    """A JSON analysis for each document: null lists, other spellings of kinds, spans outside the clip, extra keys, and text that is no JSON."""
    i = F.col("doc_id")
    kind = F.when(i % 6 == 0, '"aroll"').when(i % 6 == 1, '" B_Roll "').when(i % 6 == 2, '"silent"').when(i % 6 == 3, '"audio"').when(i % 6 == 4, '"weird"').otherwise("null")
    instructions = F.when(i % 4 == 0, "null").otherwise(F.concat(F.lit('[{"s": -2.5, "e": '), (i % 40).cast("string"), F.lit('.25, "text": "x"}, {"s": '), (i % 30).cast("string"), F.lit(', "e": 1.0004}]')))
    takes = F.concat(F.lit('[{"attempts": [{"s": 1, "e": 2}, {"s": 3, "e": 99}], "keep": '), (i % 7 - 3).cast("string"), F.lit('}, {"attempts": [{"s": 1, "e": 2}]}]'))
    visual = F.when(i % 5 == 0, "null").otherwise('{"best_frames": [-1.0, 5.5, 99.0]}')
    body = F.concat(F.lit('{"kind": '), kind, F.lit(', "instructions": '), instructions, F.lit(', "takes": '), takes, F.lit(', "visual": '), visual, F.lit(', "unheard_of": 1}'))
    return table(spark, d, "documents").select(F.col("doc_id").alias("clip_id"), F.when(i % 9 == 0, "no json").otherwise(body).alias("body"), F.when(i % 11 != 0, (i % 20 + 1).cast("double")).alias("duration_s"))


@query("analysis_scan", """WITH b AS (SELECT doc_id AS clip_id, doc_id % 9 = 0 AS broken, CASE WHEN doc_id % 11 <> 0 THEN (doc_id % 20 + 1)::DOUBLE ELSE 1e9 END AS lim, doc_id AS i FROM documents)
SELECT clip_id, broken, CASE WHEN broken THEN 'b-roll' ELSE CASE i % 6 WHEN 0 THEN 'a-roll' WHEN 1 THEN 'b-roll' WHEN 2 THEN 'silent-broll' WHEN 3 THEN 'audio-only' ELSE 'b-roll' END END AS kind,
 CASE WHEN broken OR i % 4 = 0 THEN 0 ELSE 2 END AS n_instructions, CASE WHEN broken OR i % 4 = 0 THEN NULL ELSE least(i % 40 + 0.25::DOUBLE, lim) END AS first_e,
 CASE WHEN broken OR i % 4 = 0 THEN NULL ELSE least((i % 30)::DOUBLE, lim) END AS second_s, CASE WHEN broken OR i % 4 = 0 THEN NULL ELSE greatest(1.0::DOUBLE, least((i % 30)::DOUBLE, lim)) END AS second_e,
 CASE WHEN broken THEN 0 ELSE 1 END AS n_takes, CASE WHEN NOT broken THEN greatest(0, least(i % 7 - 3, 1))::INTEGER END AS keep, CASE WHEN NOT broken THEN greatest(least(99.0::DOUBLE, lim), least(3.0::DOUBLE, lim)) END AS attempt_e,
 CASE WHEN broken OR i % 5 = 0 THEN 0.0 ELSE least(5.5::DOUBLE, lim) + least(99.0::DOUBLE, lim) END::DOUBLE AS frames FROM b""")
def analysis_scan(spark, d):
    a = analysis.clamp_times(analysis.analysis_documents(analysis_bodies(spark, d)), "duration_s")
    at = lambda c, i: F.get(F.col(c), F.lit(i))
    return a.select(
        "clip_id", "broken", "kind", F.size("instructions").alias("n_instructions"), at("instructions", 0)["e"].alias("first_e"), at("instructions", 1)["s"].alias("second_s"), at("instructions", 1)["e"].alias("second_e"),
        F.size("takes").alias("n_takes"), at("takes", 0)["keep"].alias("keep"), F.get(at("takes", 0)["attempts"], F.lit(1))["e"].alias("attempt_e"), F.aggregate("visual.best_frames", F.lit(0.0), lambda s, x: s + x).alias("frames"),
    )


@query("timeline_rules", f"""WITH {PLACED}, {CAPS}, s AS (SELECT *, CASE pos % 4 WHEN 0 THEN 'Teaser' WHEN 1 THEN CASE WHEN clip_id % 2 = 0 THEN 'Cold open: coldopen' ELSE 'b-roll' END END AS role FROM placed),
k AS (SELECT p_partkey AS clip_id, p_size % 3 = 0 AS vertical, p_size * 70 AS height FROM part), t AS (SELECT project_id, max_by(end_us, pos) AS total_us, min(pos) AS p0, arg_min_null(role, pos) AS r0 FROM s GROUP BY 1),
c AS (SELECT caps.project_id, item, s_us, e_us, CASE item % 3 WHEN 0 THEN 'subtitle' WHEN 1 THEN 'hook' ELSE 'location' END AS style, total_us FROM caps JOIN t USING (project_id))
SELECT project_id, item::VARCHAR AS ref, 'end_screen' AS code, 'warn' AS weight FROM c WHERE total_us > 20000000 AND style <> 'location' AND greatest(s_us, total_us - 20000000) < least(e_us, total_us)
UNION ALL SELECT project_id, item::VARCHAR, 'caption_outside', 'error' FROM c WHERE s_us < 0 OR e_us > total_us + 1000
UNION ALL SELECT project_id, pos::VARCHAR, CASE WHEN height >= 2160 THEN 'use_crop_pan' ELSE 'use_blur_fill' END, 'warn' FROM s JOIN k USING (clip_id) WHERE vertical AND muted AND speed = 1
UNION ALL SELECT project_id, p0::VARCHAR, 'opening_role', 'warn' FROM t WHERE NOT regexp_matches(coalesce(r0, ''), '(?i)cold-?open|hook|teaser')""")
def timeline_rules(spark, d):
    role = F.when(F.col("pos") % 4 == 0, "Teaser").when(F.col("pos") % 4 == 1, F.when(F.col("clip_id") % 2 == 0, "Cold open: coldopen").otherwise("b-roll"))
    shots = placed(spark, d).select("project_id", "pos", "clip_id", role.alias("role"), F.when(F.col("muted"), "cover").otherwise("fill").alias("fit"), F.col("speed").cast("double").alias("zoom"), "end_us")
    clips = table(spark, d, "part").select(F.col("p_partkey").alias("clip_id"), (F.col("p_size") % 3 == 0).alias("vertical"), (F.col("p_size") * 70).alias("height"))
    style = F.when(F.col("item") % 3 == 0, "subtitle").when(F.col("item") % 3 == 1, "hook").otherwise("location")
    return conformance.timeline_rules(shots, captions(spark, d).withColumn("style", style), clips)


@query("rendered_file_rules", """WITH f AS (SELECT o_orderkey AS project_id, o_custkey AS k, o_orderkey % 2 = 0 AS master FROM orders), r AS (SELECT project_id, k, master, k % 13 <> 0 AS hv, k % 17 <> 0 AS ha, CASE WHEN master THEN 'error' ELSE 'warn' END AS hard FROM f),
u AS (SELECT project_id, k::VARCHAR AS ref, unnest([CASE WHEN NOT hv THEN ['no_video', 'error'] END, CASE WHEN hv AND k % 5 = 0 THEN ['video_codec', 'error'] END, CASE WHEN hv AND k % 7 = 0 THEN ['pixel_format', 'error'] END,
 CASE WHEN hv AND master AND k % 3 = 0 THEN ['video_profile', 'error'] END, CASE WHEN hv AND k % 4 = 0 THEN ['frame_rate', 'warn'] END, CASE WHEN hv AND master AND k % 6 = 0 THEN ['resolution', 'warn'] END, CASE WHEN hv AND (k % 8 = 0 OR k % 9 = 0) THEN ['colour_tags', hard] END,
 CASE WHEN NOT ha THEN ['no_audio', 'error'] END, CASE WHEN ha AND k % 10 = 0 THEN ['audio_codec', 'error'] END, CASE WHEN ha AND k % 10 <> 0 AND k % 11 = 0 THEN ['audio_profile', 'warn'] END, CASE WHEN ha AND k % 12 = 0 THEN ['sample_rate', 'error'] END,
 CASE WHEN ha AND k % 14 = 0 THEN ['channels', 'warn'] END, CASE WHEN ha AND master AND k % 4 = 1 THEN ['audio_bitrate', 'error'] END, CASE WHEN ha AND master AND k % 4 = 2 THEN ['audio_bitrate', 'warn'] END,
 CASE WHEN k % 15 = 0 THEN ['faststart', hard] END, CASE WHEN k % 15 = 1 THEN ['no_boxes', 'warn'] END, CASE WHEN k % 16 = 0 THEN ['edit_list', 'warn'] END]) AS x FROM r)
SELECT project_id, ref, x[1] AS code, x[2] AS weight FROM u WHERE x IS NOT NULL""")
def rendered_file_rules(spark, d):
    k = F.col("o_custkey")
    pick = lambda n, a, b: F.when(k % n == 0, a).otherwise(b)
    video = F.struct(
        pick(5, "hevc", "h264").alias("codec"), pick(3, "Main", "High").alias("profile"), pick(7, "yuv422p", "yuv420p").alias("pix_fmt"), pick(6, 1280, 1920).alias("width"), F.lit(1080).alias("height"), pick(4, 25.0, 29.97).alias("fps"),
        F.lit("bt709").alias("primaries"), F.when(k % 8 != 0, "bt709").alias("transfer"), pick(9, "bt2020", "bt709").alias("space"),
    )
    bits = F.when(k % 4 == 1, 128_000).when(k % 4 == 2, 256_000).when(k % 4 == 3, 384_000).otherwise(0)
    audio = F.struct(pick(10, "mp3", "aac").alias("codec"), pick(11, "HE-AAC", "lc").alias("profile"), pick(12, 44_100, 48_000).alias("rate"), pick(14, 1, 2).alias("channels"), bits.alias("bit_rate"))
    files = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("project_id"), k.alias("file"), (F.col("o_orderkey") % 2 == 0).alias("master"), F.when(k % 13 != 0, video).alias("video"), F.when(k % 17 != 0, audio).alias("audio"),
        F.struct(F.lit(1920).alias("width"), F.lit(1080).alias("height"), F.lit(30.0).alias("fps")).alias("canvas"), F.when(k % 15 == 0, False).when(k % 15 != 1, True).alias("faststart"), pick(16, -2_000, 1_000).cast("bigint").alias("shift_us"),
    )
    return conformance.rendered_file_rules(files)


@query("clip_flags", """WITH b AS (SELECT doc_id AS clip_id, doc_id % 9 = 0 AS broken, doc_id AS i, lang FROM documents WHERE doc_id % 3 <> 1), t AS (SELECT doc_id AS clip_id, lang, doc_id % 4 = 0 AS mm FROM documents WHERE doc_id % 5 <> 0)
SELECT coalesce(b.clip_id, t.clip_id) AS clip_id, CASE WHEN b.clip_id IS NULL THEN NULL WHEN broken THEN 'b-roll' ELSE CASE i % 6 WHEN 0 THEN 'a-roll' WHEN 2 THEN 'silent-broll' WHEN 3 THEN 'audio-only' ELSE 'b-roll' END END AS kind,
 CASE WHEN b.clip_id IS NULL OR broken OR i % 4 = 0 THEN 0 ELSE 2 END AS instructions, CASE WHEN b.clip_id IS NULL OR broken THEN 0 ELSE 1 END AS takes, 0 AS background_music, '' AS summary,
 CASE WHEN b.clip_id IS NULL THEN '' WHEN i % 2 = 0 THEN 'pier, ' || i ELSE 'city' END AS location, false AS thumbnail_candidate, t.lang AS transcript_language, coalesce(mm, false) AS language_mismatch FROM b FULL JOIN t ON b.clip_id = t.clip_id""")
def clip_flags(spark, d):
    i = F.col("clip_id")
    place = F.struct(F.when(i % 2 == 0, "pier").otherwise("").alias("name"), F.when(i % 2 == 0, i.cast("string")).otherwise("city").alias("city"), F.lit(None).cast("string").alias("country"), F.lit(0.0).alias("confidence"))
    a = analysis.analysis_documents(analysis_bodies(spark, d)).where(i % 3 != 1).withColumn("location", place)
    t = table(spark, d, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("clip_id"), F.col("lang").alias("language"), (F.col("doc_id") % 4 == 0).alias("language_mismatch"))
    return reports.clip_flags(a, t)


@query("estimate_work", """WITH p AS (SELECT p_brand AS model, min(p_size) AS a, max(p_size) AS b FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1),
w AS (SELECT l_orderkey AS project_id, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN 'elevenlabs' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'fal' ELSE 'other' END AS service,
 CASE l_linenumber % 4 WHEN 0 THEN ['stt', 'music', 'tts', 'isolation', 'sfx', 'dub'][l_suppkey % 6 + 1] WHEN 1 THEN 'chat' ELSE CASE WHEN l_suppkey % 2 = 0 THEN 'image' ELSE 'video' END END AS op, p_brand AS model, CAST(l_quantity AS BIGINT) * 1000 AS units, CASE WHEN l_linenumber % 4 = 1 THEN l_suppkey * 1000 END AS units_out FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT w.*, CASE service WHEN 'elevenlabs' THEN CASE op WHEN 'stt' THEN units * 400000 // 3600 WHEN 'music' THEN units * 800000 // 60 WHEN 'tts' THEN units * 300000 // 1000 WHEN 'isolation' THEN units * 200000 // 60 ELSE 0 END
 WHEN 'openrouter' THEN coalesce((units * a * 1000 + units_out * b * 1000) // 1000000, 0) WHEN 'fal' THEN coalesce(units * CASE op WHEN 'image' THEN a ELSE b END, 0) ELSE 0 END::BIGINT AS usd_micro FROM w LEFT JOIN p USING (model)""")
def estimate_work(spark, d):
    part = table(spark, d, "part")
    n, m = F.col("l_linenumber") % 4, F.col("l_suppkey")
    voice = F.get(F.lit(["stt", "music", "tts", "isolation", "sfx", "dub"]), (m % 6).cast("int"))
    work = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("project_id"), "l_linenumber", "l_partkey", "l_suppkey", F.when(n == 0, "elevenlabs").when(n == 1, "openrouter").when(n == 2, "fal").otherwise("other").alias("service"),
        F.when(n == 0, voice).when(n == 1, "chat").otherwise(F.when(m % 2 == 0, "image").otherwise("video")).alias("op"), F.col("p_brand").alias("model"), (F.col("l_quantity").cast("bigint") * 1_000).alias("units"), F.when(n == 1, m * 1_000).alias("units_out"),
    )
    sizes = part.where("p_brand <> 'Brand#1'").groupBy(F.col("p_brand").alias("model")).agg(F.min("p_size").cast("bigint").alias("a"), F.max("p_size").cast("bigint").alias("b"))
    flat = lambda op, price: F.struct(F.lit("elevenlabs").alias("service"), F.lit(op).alias("op"), F.lit(None).cast("string").alias("model"), F.lit(price).cast("bigint").alias("price_micro"), F.lit(0).cast("bigint").alias("out_micro"))
    prices = spark.range(1).select(F.inline(F.array(flat("stt", 400_000), flat("music", 800_000), flat("tts", 300_000), flat("isolation", 200_000))))
    by_model = sizes.select(F.inline(F.array(
        F.struct(F.lit("openrouter").alias("service"), F.lit("chat").alias("op"), "model", (F.col("a") * 1_000).alias("price_micro"), (F.col("b") * 1_000).alias("out_micro")),
        F.struct(F.lit("fal").alias("service"), F.lit("image").alias("op"), "model", F.col("a").alias("price_micro"), F.lit(0).cast("bigint").alias("out_micro")),
        F.struct(F.lit("fal").alias("service"), F.lit("video").alias("op"), "model", F.col("b").alias("price_micro"), F.lit(0).cast("bigint").alias("out_micro")),
    )))
    return ledger.estimate_work(work, prices.unionByName(by_model))


#: Each beat's own clip and shots; segments play one of five clips, so that shots are trimmed, skipped and met again.
SHOTS = f"""{PLACED}, sg AS (SELECT project_id, beat, pos, clip_id % 5 AS clip_id, in_us, start_us, end_us FROM placed), bt AS (SELECT project_id, beat, project_id % 5 AS own, printf('b%03d', beat) AS name FROM sg WHERE beat <> 3 GROUP BY ALL),
sh AS (SELECT project_id, beat, clip_id, in_us + CASE WHEN pos % 3 = 0 THEN 100000 ELSE 0 END AS in_us, row_number() OVER (PARTITION BY project_id, beat ORDER BY pos) - 1 AS i FROM sg WHERE pos % 4 <> 0),
n AS (SELECT sg.*, own, name, row_number() OVER (PARTITION BY project_id, beat ORDER BY pos) AS rn FROM sg JOIN bt USING (project_id, beat)),
wk AS (SELECT project_id, beat, 0::BIGINT AS rn, 0::BIGINT AS cursor, 0::BIGINT AS pos, NULL::BIGINT AS shot FROM bt UNION ALL
 SELECT q.project_id, q.beat, q.rn, CASE WHEN c IS NOT NULL AND NOT (own = clip_id AND abs(sin - in_us) > 50000) THEN c + 1 ELSE cursor END, q.pos, CASE WHEN c IS NOT NULL AND NOT (own = clip_id AND abs(sin - in_us) > 50000) THEN c END
 FROM (SELECT n.*, wk.cursor, (SELECT min(i) FROM sh WHERE sh.project_id = n.project_id AND sh.beat = n.beat AND sh.clip_id = n.clip_id AND sh.i >= wk.cursor) AS c,
  (SELECT arg_min(sh.in_us, i) FROM sh WHERE sh.project_id = n.project_id AND sh.beat = n.beat AND sh.clip_id = n.clip_id AND sh.i >= wk.cursor) AS sin FROM wk JOIN n ON n.project_id = wk.project_id AND n.beat = wk.beat AND n.rn = wk.rn + 1) q)"""


def shot_beats(spark, d):
    sg = placed(spark, d).select("project_id", "beat", "pos", (F.col("clip_id") % 5).alias("clip_id"), "in_us", "start_us", "end_us")
    shot = F.when(F.col("pos") % 4 != 0, F.struct("pos", "clip_id", (F.col("in_us") + F.when(F.col("pos") % 3 == 0, 100_000).otherwise(0)).alias("in_us")))
    bt = sg.where("beat <> 3").groupBy("project_id", "beat").agg(F.transform(F.sort_array(F.collect_list(shot)), lambda x: F.struct(x["clip_id"].alias("clip_id"), x["in_us"].alias("in_us"))).alias("shots"))
    return sg, bt.withColumns({"clip_id": F.col("project_id") % 5, "name": F.format_string("b%03d", F.col("beat").cast("int"))})


@query("shot_of_segment", f"WITH RECURSIVE {SHOTS} SELECT project_id, beat, pos, shot::INTEGER AS shot FROM wk WHERE rn > 0")
def shot_of_segment(spark, d):
    return labels.shot_of_segment(*shot_beats(spark, d))


@query("labels_around", f"""WITH RECURSIVE {SHOTS}, lb AS (SELECT project_id, pos, name || CASE WHEN shot IS NULL THEN ' (own picture)' ELSE ' (shot ' || (shot + 1) || ')' END AS label FROM wk JOIN bt USING (project_id, beat) WHERE rn > 0),
pt AS (SELECT o_orderkey AS project_id, o_custkey * 7919 AS at_us FROM orders), ln AS (SELECT sg.project_id, sg.pos, start_us, end_us, label FROM sg LEFT JOIN lb USING (project_id, pos))
SELECT project_id, at_us, (SELECT arg_max(label, [start_us, pos]) FROM ln WHERE ln.project_id = pt.project_id AND label IS NOT NULL AND start_us < at_us - 50000) AS label_before,
 (SELECT arg_min(coalesce(label, '-'), [end_us, pos]) FROM ln WHERE ln.project_id = pt.project_id AND end_us > at_us + 50000) AS label_after FROM pt""")
def labels_around(spark, d):
    sg, bt = shot_beats(spark, d)
    points = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), (F.col("o_custkey") * 7_919).alias("at_us"))
    out = labels.labels_around(points, sg, labels.segment_labels(sg, bt), "at_us")
    later = sg.groupBy("project_id").agg(F.max("end_us").alias("last"))
    return out.join(later, "project_id", "left").withColumn("label_after", F.when(F.col("last") > F.col("at_us") + 50_000, F.coalesce("label_after", F.lit("-")))).drop("last")
