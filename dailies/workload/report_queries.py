"""Roll-ups, conformance and look-up queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators import media, reports, segment
from dailies.workload.adapter import RANGES, SEGMENTS, TASK_DOCUMENTS, WORDS, clips, dealt, ranges, segments, table, transcripts, words
from dailies.workload.catalogue_queries import instruction_spans
from dailies.workload.interval_queries import ANALYSIS, analysis, merged_sql
from dailies.workload.layout_queries import CAPS, FR, PLACED, PROBES, captions, placed, probes
from dailies.workload.ledger_queries import BLOCKS, COSTS, NORM, STATUS, blocks, costs, probe_docs, statuses
from dailies.workload.registry import query
from dailies.workload.resolve_queries import totals
from dailies.workload.text_queries import CLIP, SENT, sentences

P = ["project_id"]
CUTS = "cu AS (SELECT source AS project_id, doc_id AS clip_id, k * 9000000 + doc_id % 4 * 1000000 AS s_us, k * 9000000 + doc_id % 4 * 1000000 + 1700000 AS e_us FROM documents, range(3) r(k))"


def cuts(spark, d):
    rows = dealt(table(spark, d, "documents").select("source", "doc_id"), "doc_id", clips(spark, d), TASK_DOCUMENTS)  # beside the words of their clips
    b = rows.select(F.col("source").alias("project_id"), F.col("doc_id").alias("clip_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    s = (F.col("k") * 9_000_000 + F.col("clip_id") % 4 * 1_000_000).cast("bigint")
    return b.select(*CLIP, s.alias("s_us"), (s + 1_700_000).alias("e_us"))


@query("without_cuts", f"WITH {WORDS}, {CUTS} SELECT project_id, clip_id, pos FROM words w WHERE NOT EXISTS (SELECT 1 FROM cu WHERE cu.project_id = w.project_id AND cu.clip_id = w.clip_id AND w.s_us < cu.e_us AND w.e_us > cu.s_us)")
def without_cuts(spark, d):
    return reports.without_cuts(words(spark, d), cuts(spark, d), CLIP).select(*CLIP, "pos")


@query("clean_narration", f"""WITH {SENT}, {CUTS}, k0 AS (SELECT *, n % 6 = 0 OR EXISTS (SELECT 1 FROM cu WHERE cu.project_id = w.project_id AND cu.clip_id = w.clip_id AND w.s_us < cu.e_us AND w.e_us > cu.s_us) AS gone, right(rtrim(text), 1) = '-' AS cut, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS norm FROM sent_n w),
st AS (SELECT project_id, clip_id, pos, norm <> '' AND norm = lag(norm) OVER (PARTITION BY project_id, clip_id ORDER BY pos) AS rep FROM k0 WHERE NOT gone AND NOT cut),
k AS (SELECT k0.project_id, k0.clip_id, k0.pos, s_us, e_us, NOT gone AND NOT cut AND NOT coalesce(rep, false) AS keep FROM k0 LEFT JOIN st ON st.project_id = k0.project_id AND st.clip_id = k0.clip_id AND st.pos = k0.pos),
l AS (SELECT *, lag(keep) OVER w AS pk, lag(e_us) OVER w AS pe, lead(keep) OVER w AS nk, lead(s_us) OVER w AS ns FROM k WINDOW w AS (PARTITION BY project_id, clip_id ORDER BY pos)),
f AS (SELECT *, sum(CASE WHEN coalesce(pk, false) AND s_us - pe <= 800000 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, clip_id ORDER BY pos) AS n FROM l WHERE keep),
r AS (SELECT project_id, clip_id, n::BIGINT AS n, min(s_us) AS s, max(e_us) + CASE WHEN bool_or(coalesce(nk AND ns - e_us > 800000, false)) THEN 500000 ELSE 0 END AS e FROM f GROUP BY ALL)
SELECT project_id, clip_id, n, CASE WHEN n = 1 THEN greatest(s - 300000, 0) ELSE s END AS s_us, CASE WHEN n = max(n) OVER (PARTITION BY project_id, clip_id) THEN e + 450000 ELSE e END AS e_us FROM r""")
def clean_narration(spark, d):
    t = transcripts(spark, d)
    s = segment.split_sentences(t)
    w = segment.sentence_words(t).where("project_id IS NOT NULL AND clip_id IS NOT NULL")
    return reports.clean_narration(w, s.where(F.col("n") % 6 == 0), cuts(spark, d))


@query("programme_cues")
def programme_cues(spark, d):
    return reports.programme_cues(placed(spark, d), words(spark, d))


@query("footage_log", f"""WITH {WORDS}, {ANALYSIS}, c AS (SELECT source AS project_id, doc_id AS clip_id, n_chars * 1000 AS duration_us FROM documents), t AS (SELECT project_id, clip_id, count(*) AS n_words, any_value(lang) <> 'en' AS mismatch FROM words WHERE clip_id % 5 <> 0 GROUP BY ALL),
i AS (SELECT project_id, clip_id, count(*) AS ni FROM instr GROUP BY ALL), m AS (SELECT doc_id AS clip_id, count(*) AS nm FROM labels GROUP BY ALL)
SELECT c.project_id, count(*) AS clips, sum(duration_us)::BIGINT AS duration_us, coalesce(sum(n_words), 0)::BIGINT AS n_words, coalesce(sum(ni), 0)::BIGINT AS instructions, coalesce(sum(nm), 0)::BIGINT AS music, count(*) FILTER (WHERE n_words IS NULL) AS untranscribed, count(*) FILTER (WHERE mismatch) AS mismatches
FROM c LEFT JOIN t ON t.clip_id = c.clip_id LEFT JOIN i ON i.clip_id = c.clip_id LEFT JOIN m ON m.clip_id = c.clip_id GROUP BY 1""")
def footage_log(spark, d):
    doc = table(spark, d, "documents")
    clips = doc.select(F.col("source").alias("project_id"), F.col("doc_id").alias("clip_id"), (F.col("n_chars") * 1_000).alias("duration_us"))
    t = transcripts(spark, d).where((F.col("clip_id") % 5 != 0) & (F.size("words") > 0)).select(*CLIP, F.size("words").alias("n_words"), (F.col("lang") != "en").alias("mismatch"))
    music = table(spark, d, "labels").join(clips, F.col("doc_id") == F.col("clip_id")).select(*CLIP)
    return reports.footage_log(clips, t, instruction_spans(spark, d), music)


@query("rank_frames", "WITH f AS (SELECT user_id AS project_id, event_id AS pos, event_type = 'view' AS candidate, CAST(round(value * 100) AS BIGINT) AS quality FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY candidate DESC, quality DESC, pos) AS rank FROM f) SELECT * FROM r WHERE rank <= 12")
def rank_frames(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("pos"), (F.col("event_type") == "view").alias("candidate"), F.round(F.col("value") * 100).cast("bigint").alias("quality"))
    return reports.rank_frames(f)


@query("compact_transcripts")
def compact_transcripts(spark, d):
    return reports.compact_transcripts(transcripts(spark, d), segment.split_sentences(transcripts(spark, d)))


@query("planner_sentences", f"WITH {SENT}, k AS (SELECT *, (clip_id + n) % 11 = 0 AS i FROM sent) SELECT project_id, clip_id, n, CASE WHEN n % 7 = 0 THEN 'retake' WHEN n % 5 = 0 THEN 'duplicate' END AS skip FROM k WHERE NOT i")
def planner_sentences(spark, d):
    c = sentences(spark, d).withColumns({"retake_of": F.when(F.col("n") % 7 == 0, F.col("n") - 1), "duplicate_of": F.when(F.col("n") % 5 == 0, F.col("n"))})
    return reports.planner_sentences(c)


@query("orphan_keys", f"WITH {SEGMENTS}, k AS (SELECT DISTINCT clip_id, in_us, out_us FROM segments), c AS (SELECT l_partkey AS clip_id, l_suppkey % 10 * 1000000 AS in_us, l_suppkey % 10 * 1000000 + CAST(l_quantity AS BIGINT) * 100000 + l_linenumber % 2 AS out_us FROM lineitem) SELECT clip_id, in_us, out_us FROM c WHERE (clip_id, in_us, out_us) NOT IN (SELECT * FROM k)")
def orphan_keys(spark, d):
    fields = ["clip_id", "in_us", "out_us"]
    cache = table(spark, d, "lineitem").select(F.col("l_partkey").alias("clip_id"), (F.col("l_suppkey") % 10 * 1_000_000).alias("in_us"), (F.col("l_suppkey") % 10 * 1_000_000 + F.col("l_quantity").cast("bigint") * 100_000 + F.col("l_linenumber") % 2).alias("out_us"))
    return reports.orphan_keys(reports.segment_keys(cache, fields), segments(spark, d), fields).select(*fields)


@query("denoise_backlog", "SELECT o_custkey AS project_id, count(*) AS clips, sum(o_orderkey * 1000)::BIGINT * 120000 // 60000000 AS usd_micro FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 <> 0 GROUP BY 1")
def denoise_backlog(spark, d):
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderstatus") == "F", "windy").otherwise("noisy").alias("flag"), (F.col("o_orderkey") % 3 == 0).alias("denoised"), (F.col("o_orderkey") * 1_000).alias("duration_us"))
    return reports.denoise_backlog(f, price_micro_per_minute=120_000)


@query("project_overview", f"""WITH {STATUS}, {COSTS}, s AS (SELECT clip_id AS project_id, CASE stage WHEN 'view' THEN 'plan' WHEN 'click' THEN 'render' ELSE 'ingest' END AS stage, status, ts FROM st), c AS (SELECT o_custkey AS project_id, count(*) AS clips FROM orders GROUP BY 1),
g AS (SELECT project_id, max_by(status, ts) FILTER (WHERE stage = 'ingest') AS ingest, max_by(status, ts) FILTER (WHERE stage = 'plan') AS plan, max_by(status, ts) FILTER (WHERE stage = 'render') AS render, coalesce(max(ts) FILTER (WHERE stage = 'render') < max(ts) FILTER (WHERE stage = 'plan'), false) AS stale FROM s GROUP BY 1),
u AS (SELECT project_id, sum(usd_micro)::BIGINT AS usd_micro FROM costs GROUP BY 1)
SELECT c.project_id, clips, coalesce(ingest, 'pending') AS ingest, coalesce(plan, 'pending') AS plan, coalesce(render, 'pending') AS render, coalesce(stale, false) AS stale, coalesce(usd_micro, 0) AS usd_micro FROM c LEFT JOIN g USING (project_id) LEFT JOIN u USING (project_id)""")
def project_overview(spark, d):
    stage = F.when(F.col("stage") == "view", "plan").when(F.col("stage") == "click", "render").otherwise("ingest")
    st = statuses(spark, d).select(F.col("clip_id").alias("project_id"), stage.alias("stage"), "status", "ts")
    return reports.project_overview(table(spark, d, "orders").select(F.col("o_custkey").alias("project_id")), st, costs(spark, d), ["ingest", "plan", "render"])


@query("size_music", f"WITH {CAPS}, p AS (SELECT project_id, item, 'planned' AS mood FROM caps WHERE item % 2 = 0) SELECT c.project_id, c.item, greatest((e_us - s_us) * 20, 30000000) AS length_us, CASE WHEN c.item % 3 = 0 THEN 'cut' ELSE p.mood END AS mood FROM caps c LEFT JOIN p USING (project_id, item)")
def size_music(spark, d):
    c = captions(spark, d).select("project_id", "item", (F.col("s_us") * 20).alias("s_us"), (F.col("e_us") * 20).alias("e_us"), F.when(F.col("item") % 3 == 0, "cut").alias("mood"))
    plan = captions(spark, d).where(F.col("item") % 2 == 0).select("project_id", "item", F.lit("planned").alias("mood"))
    return reports.size_music(c, plan)


@query("level_windows", f"""WITH {BLOCKS}, e AS (SELECT clip_id, max(s_us + 137000) AS en FROM blocks GROUP BY 1), w AS (SELECT DISTINCT clip_id, en, greatest(en - 2000000, 0) * i // 7 AS w_s FROM e, range(8) r(i)),
p AS (SELECT w.clip_id, w_s, sum(sum_sq)::DOUBLE / sum(n)::DOUBLE AS power FROM w JOIN blocks b ON b.clip_id = w.clip_id AND b.s_us >= w_s AND b.s_us < least(w_s + 2000000, en) GROUP BY ALL)
SELECT clip_id, max_by(w_s, (power, -w_s)) AS loudest_us, min_by(w_s, (power, w_s)) AS quietest_us, max(power) AS loudest_power FROM p GROUP BY 1""")
def level_windows(spark, d):
    return reports.level_windows(blocks(spark, d).withColumn("e_us", F.col("s_us") + 137_000), length_us=2_000_000)


@query("clip_badges", "SELECT source AS project_id, doc_id AS clip_id, 2 AS instructions, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS extra_takes FROM documents")
def clip_badges(spark, d):
    return reports.clip_badges(analysis(spark, d))


@query("ending_guard", f"""WITH {PLACED}, {CAPS}, t AS (SELECT project_id, max_by(end_us, pos) AS total_us FROM placed GROUP BY 1), q AS (SELECT project_id, s_us, e_us, CASE WHEN item % 3 = 0 THEN 'Do usłyszenia' WHEN item % 3 = 1 THEN 'na tym końcZymy' ELSE 'Thanks for watching' END AS text FROM caps),
s AS (SELECT project_id, string_agg(text, ' ' ORDER BY s_us, text) AS said FROM q JOIN t USING (project_id) WHERE s_us < total_us AND e_us > total_us - 3000000 GROUP BY 1) SELECT project_id, regexp_extract(said, '(?i)do\\s+zobaczenia|na\\s+tym\\s+koń?cz[yę]m[ye]|do\\s+usłyszenia') AS phrase FROM s WHERE regexp_matches(said, '(?i)do\\s+zobaczenia|na\\s+tym\\s+koń?cz[yę]m[ye]|do\\s+usłyszenia')""")
def ending_guard(spark, d):
    text = F.when(F.col("item") % 3 == 0, "Do usłyszenia").when(F.col("item") % 3 == 1, "na tym końcZymy").otherwise("Thanks for watching")
    return reports.ending_guard(captions(spark, d).withColumn("text", text), totals(spark, d))


@query("plan_endings", f"""WITH {PLACED}, {CAPS}, t AS (SELECT project_id, max_by(end_us, pos) AS total_us, max(pos) AS item FROM placed GROUP BY 1),
n AS (SELECT project_id, 'notes' AS place, item, CASE WHEN project_id % 2 = 0 THEN 'trzymajcie się' ELSE 'calm' END AS text FROM t), a AS (SELECT project_id, place, q.item, text FROM (SELECT c.project_id, 'caption' AS place, c.item, CASE WHEN c.item % 3 = 0 THEN 'Thank for watching' WHEN c.item % 3 = 1 THEN 'See you SOON' ELSE 'Do usłyszenia' END AS text FROM caps c JOIN t USING (project_id) WHERE e_us >= total_us - 5000000) q UNION ALL SELECT * FROM n)
SELECT project_id, place, item, regexp_extract(text, '(?i)trzymajcie\\s+si[eę]|thanks?\\s+for\\s+watching|see\\s+you\\s+(?:next|soon)') AS phrase FROM a WHERE regexp_matches(text, '(?i)trzymajcie\\s+si[eę]|thanks?\\s+for\\s+watching|see\\s+you\\s+(?:next|soon)')""")
def plan_endings(spark, d):
    text = F.when(F.col("item") % 3 == 0, "Thank for watching").when(F.col("item") % 3 == 1, "See you SOON").otherwise("Do usłyszenia")
    notes = placed(spark, d).groupBy("project_id").agg(F.max("pos").alias("item")).withColumn("text", F.when(F.col("project_id") % 2 == 0, "trzymajcie się").otherwise("calm"))
    return reports.plan_endings(captions(spark, d).withColumn("text", text), totals(spark, d), notes)


@query("file_conformance", f"WITH {NORM} SELECT clip_id, unnest(list_filter([CASE WHEN codec <> 'h264' THEN 'codec' END, CASE WHEN pix_fmt <> 'yuv420p' THEN 'pix_fmt' END, CASE WHEN display_width <> 1920 OR display_height <> 1080 THEN 'size' END, CASE WHEN fps_int <> 30 THEN 'fps' END, CASE WHEN hdr IS NOT NULL THEN 'hdr' END, CASE WHEN rotation <> 0 THEN 'rotation' END], lambda x: x IS NOT NULL)) AS rule FROM n")
def file_conformance(spark, d):
    return reports.file_conformance(media.normalize_probe(probe_docs(spark, d)))


@query("loudness_conformance", "WITH m AS (SELECT o_orderkey AS item, o_orderkey % 2 = 0 AS preview, -14000 + o_custkey % 41 * 100 - 2000 AS l, o_custkey % 31 * 100 - 2500 AS p FROM orders) SELECT item, unnest(list_filter([CASE WHEN abs(l + 14000) > CASE WHEN preview THEN 1500 ELSE 1000 END THEN 'loudness' END, CASE WHEN p > CASE WHEN preview THEN 0 ELSE -1000 END THEN 'true_peak' END], lambda x: x IS NOT NULL)) AS rule FROM m")
def loudness_conformance(spark, d):
    c = F.col("o_custkey")
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 2 == 0).alias("preview"), (c % 41 * 100 - 16_000).alias("lufs_milli"), (c % 31 * 100 - 2_500).alias("peak_milli"))
    return reports.loudness_conformance(m)


@query("music_separation", f"""WITH {RANGES}, mu AS (SELECT * FROM ranges WHERE event_type IN ('click','view')), sp AS (SELECT * FROM ranges WHERE event_type IN ('purchase','error')), {merged_sql('mu', 'm', 0, 0)}, {merged_sql('sp', 't', 0, 0)},
b AS (SELECT clip_id, event_id, s_us, CAST(round(value * 100) AS BIGINT) AS sum_sq FROM events JOIN ranges USING (event_id)),
un AS (SELECT m.clip_id, greatest(m.s_us, t.s_us) AS s_us, least(m.e_us, t.e_us) AS e_us FROM m JOIN t ON m.clip_id = t.clip_id AND m.s_us < t.e_us AND m.e_us > t.s_us),
l AS (SELECT clip_id, sum(e_us - s_us) AS mt, (SELECT coalesce(sum(e_us - s_us), 0) FROM un WHERE un.clip_id = m.clip_id) AS u FROM m GROUP BY 1),
q AS (SELECT clip_id, (mt - u)::BIGINT AS alone_us, u::BIGINT AS under_us FROM l WHERE mt - u >= 3000000 AND u >= 3000000),
h AS (SELECT b.*, EXISTS (SELECT 1 FROM m WHERE m.clip_id = b.clip_id AND m.s_us <= b.s_us AND m.e_us > b.s_us) AS im, EXISTS (SELECT 1 FROM t WHERE t.clip_id = b.clip_id AND t.s_us <= b.s_us AND t.e_us > b.s_us) AS it FROM b)
SELECT q.*, (sum(sum_sq) FILTER (WHERE im AND NOT it))::BIGINT AS alone_sq, (sum(sum_sq) FILTER (WHERE im AND it))::BIGINT AS under_sq, nullif(count(*) FILTER (WHERE im AND NOT it), 0) AS alone_n, nullif(count(*) FILTER (WHERE im AND it), 0) AS under_n FROM q LEFT JOIN h USING (clip_id) GROUP BY ALL""")
def music_separation(spark, d):
    r = ranges(spark, d)
    value = table(spark, d, "events").select("event_id", F.round(F.col("value") * 100).cast("bigint").alias("sum_sq"))
    b = r.join(value, "event_id").select("clip_id", "s_us", "sum_sq", F.lit(1).cast("bigint").alias("n"))
    return reports.music_separation(r.where(F.col("event_type").isin("click", "view")), r.where(F.col("event_type").isin("purchase", "error")), b, ["clip_id"])


@query("chapter_issues", f"""WITH {CAPS}, c AS (SELECT project_id, item AS pos, CASE WHEN item % 4 = 0 AND item % 5 = 0 THEN 0 ELSE s_us END AS s_us, CASE item % 3 WHEN 0 THEN 'Part 3' WHEN 1 THEN ' ' ELSE 'Night market' END AS title, 18000000 AS total_us FROM caps WHERE item % 4 <> 2 OR item % 8 = 2),
l AS (SELECT *, lag(s_us) OVER w AS p, lead(s_us) OVER w AS n FROM c WINDOW w AS (PARTITION BY project_id ORDER BY pos))
SELECT project_id, pos, unnest(list_filter([CASE WHEN p IS NULL AND s_us <> 0 THEN 'first_not_zero' END, CASE WHEN trim(title) = '' THEN 'no_title' WHEN regexp_matches(lower(trim(title)), '^(part)\\s*[0-9]+$') THEN 'generic_title' END, CASE WHEN s_us > total_us THEN 'past_end' END, CASE WHEN s_us <= p THEN 'not_ascending' WHEN s_us - p < 10000000 THEN 'too_close' END, CASE WHEN n IS NULL AND s_us > total_us - 10000000 THEN 'short_tail' END], lambda x: x IS NOT NULL)) AS issue FROM l
UNION ALL SELECT project_id, NULL, 'too_few' FROM c GROUP BY 1 HAVING count(*) < 3""")
def chapter_issues(spark, d):
    i = F.col("item")
    c = captions(spark, d).where((i % 4 != 2) | (i % 8 == 2)).select(
        "project_id", i.alias("pos"), F.when((i % 4 == 0) & (i % 5 == 0), 0).otherwise(F.col("s_us")).cast("bigint").alias("s_us"),
        F.when(i % 3 == 0, "Part 3").when(i % 3 == 1, " ").otherwise("Night market").alias("title"), F.lit(18_000_000).cast("bigint").alias("total_us"))
    return reports.chapter_issues(c)


@query("publish_fallbacks", "SELECT c_custkey AS project_id, CASE WHEN c_custkey % 2 = 0 THEN 'T' || c_custkey ELSE c_name END AS title, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'x,y' ELSE array_to_string([c_mktsegment || i for i in range(0, 15)], ',') END AS tags FROM customer")
def publish_fallbacks(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "project_id")
    many = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.col("c_mktsegment"), i.cast("string")))
    plan = c.select("project_id", F.col("c_name").alias("plan_title"), many.alias("plan_tags"))
    tags = F.when(F.col("project_id") % 3 == 0, F.array(F.lit("x"), F.lit("y")))
    ans = c.where(F.col("project_id") % 2 == 0).select("project_id", F.concat(F.lit("T"), F.col("project_id").cast("string")).alias("title"), tags.alias("tags"))
    return reports.publish_fallbacks(ans, plan).withColumn("tags", F.array_join("tags", ","))


@query("joined_duration_issues", f"""WITH {PLACED}, e AS (SELECT project_id, max_by(end_us, pos) AS expected_us, count(*) FILTER (WHERE transition <> 'cut' AND pl IS NOT NULL) AS soft FROM placed GROUP BY 1), m AS (SELECT project_id, expected_us + project_id % 9 * 40000 AS actual_us FROM e),
t AS (SELECT project_id, expected_us, actual_us, greatest(100000, (soft + 2) * 1000000 // 30) AS tolerance_us FROM e JOIN m USING (project_id)) SELECT * FROM t WHERE abs(actual_us - expected_us) > tolerance_us""")
def joined_duration_issues(spark, d):
    measured = totals(spark, d).select("project_id", (F.col("total_us") + F.col("project_id") % 9 * 40_000).alias("actual_us"))
    return reports.joined_duration_issues(placed(spark, d), measured)


@query("missing_sources", f"WITH {SEGMENTS} SELECT DISTINCT project_id, clip_id FROM segments WHERE clip_id NOT IN (SELECT p_partkey FROM part WHERE p_size % 8 <> 0)")
def missing_sources(spark, d):
    assets = table(spark, d, "part").where(F.col("p_size") % 8 != 0).select(F.col("p_partkey").alias("clip_id"))
    return reports.missing_sources(segments(spark, d), assets)


@query("moments", f"""WITH {PLACED}, {WORDS}, {PROBES}, {CAPS}, vo AS (SELECT * FROM caps WHERE item % 7 = 0),
s AS (SELECT * FROM (SELECT p.project_id, p.probe, t_us, pos, clip_id, in_us, speed, start_us, end_us, muted, row_number() OVER (PARTITION BY p.project_id, p.probe ORDER BY start_us DESC, pos DESC) AS rn FROM probes p JOIN placed g ON g.project_id = p.project_id AND start_us <= t_us) WHERE rn = 1 AND t_us < end_us),
c AS (SELECT *, in_us + (t_us - start_us) * speed AS clip_us FROM s), n AS (SELECT c.*, (SELECT count(*) FROM caps k WHERE k.project_id = c.project_id AND k.s_us <= t_us AND k.e_us > t_us) AS captions, (SELECT count(*) FROM vo k WHERE k.project_id = c.project_id AND k.s_us <= t_us AND k.e_us > t_us) AS voice,
 (SELECT count(*) FROM words w WHERE w.clip_id = c.clip_id AND w.s_us < clip_us + 1000001 AND w.e_us > clip_us - 1000000) AS words FROM c)
SELECT project_id, probe, t_us, pos, clip_id, clip_us, captions, words, CASE WHEN voice > 0 THEN 'voice' WHEN muted THEN 'silent' WHEN words > 0 THEN 'words' ELSE 'ambient' END AS heard FROM n""")
def moments(spark, d):
    c = captions(spark, d)
    return reports.moments(probes(spark, d), placed(spark, d), words(spark, d), c, c.where(F.col("item") % 7 == 0))


@query("narration_target", f"""WITH {SEGMENTS}, b AS (SELECT project_id, pos, printf('b%03d', beat_mod) AS id, printf('c%03d', clip_id % 40) AS clip FROM segments),
r AS (SELECT o_orderkey AS project_id, o_custkey AS request, CASE WHEN o_custkey % 4 = 0 THEN printf('b%03d', o_custkey % 6) END AS after, printf('b%03d', o_custkey % 9) AS tb, printf('c%03d', o_custkey % 40) AS tc FROM orders)
SELECT project_id, request, coalesce((SELECT max(id) FROM b WHERE b.project_id = r.project_id AND id = after), (SELECT max(id) FROM b WHERE b.project_id = r.project_id AND id = tb), (SELECT min_by(id, pos) FROM b WHERE b.project_id = r.project_id AND clip = tc)) AS beat FROM r""")
def narration_target(spark, d):
    num = lambda p, c: F.format_string(f"{p}%03d", c)
    beats = segments(spark, d).select("project_id", "pos", num("b", F.col("beat_mod")).alias("id"), num("c", F.col("clip_id") % 40).alias("clip"))
    k = F.col("o_custkey")
    req = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), k.alias("request"), F.when(k % 4 == 0, num("b", k % 6)).alias("after"), F.concat(F.lit("put it after "), num("b", k % 9), F.lit(" or on "), num("c", k % 40)).alias("text"))
    return reports.narration_target(req, beats)
