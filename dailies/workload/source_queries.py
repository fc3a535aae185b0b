"""Document parsing; the documents are written by Spark from the given tables, row by row."""

from __future__ import annotations

import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators.ordered import running
from dailies.session import checkpoint_path, materialize
from dailies.sources import audio, sinks
from dailies.sources import documents as docs
from dailies.workload.adapter import SEGMENTS, WORDS, segments, table, transcripts
from dailies.workload.registry import query

STAGES = ("ingest", "transcribe", "analyze", "plan", "render")


def states(spark, d):
    """A state document per order: two to three clips, two stages, two ledger entries."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    clip = lambda i: F.struct(F.when((k + i) % 4 != 0, (k * 7 + i) % 5).cast("int").alias("order"), ((c % 50 + i) / F.lit(2.0)).alias("duration"))
    clips = F.map_from_arrays(F.array(*[F.format_string(f"c%03d", (k + i) % 3 * 10 + i) for i in range(3)]), F.array(*[clip(i) for i in range(3)]))
    stages = F.map_from_arrays(F.array(F.lit("ingest"), F.when(k % 2 == 0, "plan").otherwise("render")), F.array(
        F.struct(F.lit("done").alias("status"), k.alias("ts")), F.struct(F.when(c % 3 == 0, "error").otherwise("running").alias("status"), k.alias("ts"))))
    cost = lambda i: F.struct((k + i).alias("ts"), F.lit("stt").alias("service"), F.lit(f"op{i}").alias("op"), ((c + i) / F.lit(8.0)).alias("usd"))
    doc = F.to_json(F.struct(clips.alias("clips"), stages.alias("stages"), F.array(cost(0), cost(1)).alias("costs")))
    return table(spark, d, "orders").select(k.alias("project_id"), doc.alias("doc"))


@query("clip_registry", """WITH c AS (SELECT o_orderkey AS project_id, printf('c%03d', (o_orderkey + i) % 3 * 10 + i) AS clip, CASE WHEN (o_orderkey + i) % 4 <> 0 THEN (o_orderkey * 7 + i) % 5 ELSE 1000000 END AS clip_order, CAST(round((o_custkey % 50 + i) / 2.0 * 1000000) AS BIGINT) AS duration_us FROM orders, range(3) r(i))
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY clip_order, clip) - 1 AS pos FROM c""")
def clip_registry(spark, d):
    return docs.clip_rows(states(spark, d))


@query("stage_statuses", """SELECT o_orderkey AS project_id, stage, CASE WHEN stage = 'ingest' THEN 'done' WHEN stage = CASE WHEN o_orderkey % 2 = 0 THEN 'plan' ELSE 'render' END THEN CASE WHEN o_custkey % 3 = 0 THEN 'error' ELSE 'running' END ELSE 'pending' END AS status
FROM orders, (VALUES ('ingest'), ('transcribe'), ('analyze'), ('plan'), ('render')) s(stage)""")
def stage_statuses(spark, d):
    return docs.stage_rows(states(spark, d), STAGES)


@query("ledger_entries", "SELECT o_orderkey AS project_id, i AS pos, o_orderkey + i AS ts, 'stt' AS service, 'op' || i AS op, (o_custkey + i) * 125000 AS usd_micro FROM orders, range(2) r(i)")
def ledger_entries(spark, d):
    return docs.ledger_rows(states(spark, d))


def transcript_docs(spark, d):
    """Provider answers with mixed item types, both key spellings and some unusable times."""
    def item(w):
        p = w["pos"]
        start, end = w["s_us"] / F.lit(1e6), F.when(p % 29 == 0, w["s_us"] / F.lit(1e6)).when(p % 23 == 0, w["s_us"] / F.lit(1e6) + 3.5).otherwise(w["e_us"] / F.lit(1e6))
        alt = p % 2 == 0
        return F.struct(
            F.when(alt, w["text"]).alias("t"), F.when(~alt, F.concat(w["text"], F.lit(" "))).alias("text"), F.when(alt, start).alias("s"), F.when(~alt, start).alias("start"),
            F.when(alt, end).alias("e"), F.when(~alt & (p % 31 != 0), end).alias("end"),
            F.when(p % 10 == 0, "spacing").when(p % 10 == 1, "audio_event").when(p % 10 != 2, "word").alias("type"),
            F.when(p % 10 > 5, F.concat(F.lit("sp"), (idx(p) % 3).cast("string"))).alias("speaker"))

    def idx(p):
        return F.call_function("div", p, F.lit(40))

    doc = F.to_json(F.struct(F.upper("lang").alias("language_code"), F.transform("words", item).alias("words")))
    return transcripts(spark, d).select("project_id", "clip_id", doc.alias("doc"))


ITEMS = WORDS + """, it AS (SELECT project_id, clip_id, lang, pos, text, s_us, CASE WHEN pos % 29 = 0 THEN s_us WHEN pos % 23 = 0 THEN s_us + 3500000 ELSE e_us END AS e_us, pos % 2 = 1 AND pos % 31 = 0 AS no_end, pos % 10 AS ty FROM words)"""


@query("spoken_words", f"WITH {ITEMS} SELECT project_id, clip_id, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY s_us, e_us, pos) - 1 AS pos, s_us, e_us, text FROM it WHERE ty >= 2 AND NOT no_end AND e_us > s_us")
def spoken_words(spark, d):
    return docs.word_rows(transcript_docs(spark, d), ["project_id", "clip_id"])


@query("render_words", f"WITH {ITEMS} SELECT project_id, clip_id, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY s_us, e_us, pos) - 1 AS pos, s_us, e_us, text FROM it WHERE ty >= 2 AND NOT no_end AND e_us > s_us AND text <> '' AND e_us - s_us <= 3000000")
def render_words(spark, d):
    return docs.render_word_rows(transcript_docs(spark, d), ["project_id", "clip_id"])


@query("transcript_headers", f"""WITH {ITEMS}, sp AS (SELECT project_id, clip_id, 'sp' || pos // 40 % 3 AS s, min(pos) AS p FROM it WHERE ty > 5 GROUP BY ALL),
sa AS (SELECT project_id, clip_id, string_agg(s, ',' ORDER BY p) AS speakers FROM sp GROUP BY ALL),
h AS (SELECT project_id, clip_id, any_value(lang) AS language, count(*) FILTER (WHERE ty >= 2)::INT AS n_words, coalesce(string_agg(regexp_replace(text, '[()\\[\\]]', '', 'g'), ',' ORDER BY pos) FILTER (WHERE ty = 1), '') AS events,
 coalesce(max(CASE WHEN NOT no_end THEN e_us END) FILTER (WHERE ty >= 2), 0) AS duration_us FROM it GROUP BY ALL)
SELECT project_id, clip_id, language, n_words, events, coalesce(speakers, '') AS speakers, duration_us, n_words = 0 AS stub FROM h LEFT JOIN sa USING (project_id, clip_id)""")
def transcript_headers(spark, d):
    return docs.transcript_headers(transcript_docs(spark, d), ["project_id", "clip_id"])


@query("normalize_refs", f"""WITH {SEGMENTS}, b AS (SELECT project_id, pos, 'u' || pos AS uid, 'b' || beat_mod AS id FROM segments),
r AS (SELECT project_id, pos AS ref_pos, CASE pos // 4194304 % 3 WHEN 0 THEN 'u' || pos WHEN 1 THEN 'b' || (clip_id % 5) ELSE 'x' || beat_mod END AS ref FROM segments)
SELECT r.*, coalesce((SELECT uid FROM b WHERE b.project_id = r.project_id AND uid = ref), (SELECT min_by(uid, pos) FROM b WHERE b.project_id = r.project_id AND id = ref), ref) AS beat_uid,
 NOT EXISTS (SELECT 1 FROM b WHERE b.project_id = r.project_id AND (uid = ref OR id = ref)) AS dangling FROM r""")
def normalize_refs(spark, d):
    s = segments(spark, d)
    cat = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    beats = s.select("project_id", "pos", cat("u", F.col("pos")).alias("uid"), cat("b", F.col("beat_mod")).alias("id"))
    pick = F.call_function("div", F.col("pos"), F.lit(4_194_304)) % 3
    refs = s.select("project_id", F.col("pos").alias("ref_pos"), F.when(pick == 0, cat("u", F.col("pos"))).when(pick == 1, cat("b", F.col("clip_id") % 5)).otherwise(cat("x", F.col("beat_mod"))).alias("ref"))
    return docs.normalize_refs(refs, beats)


@query("display_ids", f"WITH {SEGMENTS} SELECT project_id, pos, printf('s%03d', row_number() OVER (PARTITION BY project_id ORDER BY pos)) AS id FROM segments")
def display_ids(spark, d):
    return docs.display_ids(segments(spark, d).select("project_id", "pos"), "s")


@query("assign_clip_numbers", """WITH RECURSIVE f AS (SELECT o_custkey AS project_id, o_orderkey AS source_file, epoch_us(o_orderdate) AS recorded FROM orders),
g AS (SELECT project_id, source_file, row_number() OVER (PARTITION BY project_id ORDER BY source_file) * 2 + project_id % 2 AS number FROM f WHERE source_file % 3 = 0),
n AS (SELECT f.*, g.number, row_number() OVER (PARTITION BY f.project_id ORDER BY recorded, f.source_file) AS position FROM f LEFT JOIN g USING (project_id, source_file)),
k AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY position) AS k FROM n WHERE number IS NULL),
fr AS (SELECT p.project_id, i AS number, row_number() OVER (PARTITION BY p.project_id ORDER BY i) AS k FROM (SELECT DISTINCT project_id FROM f) p, range(1, 200) r(i) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.project_id = p.project_id AND g.number = i))
SELECT project_id, source_file, position, number, false AS is_new FROM n WHERE number IS NOT NULL UNION ALL SELECT k.project_id, source_file, position, fr.number, true FROM k JOIN fr USING (project_id, k)""")
def assign_clip_numbers(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("source_file"), F.unix_date(F.to_date("o_orderdate")).cast("bigint").alias("recorded"))
    known = files.where(F.col("source_file") % 3 == 0)
    registry = running(known, ["project_id"], ["source_file"], {"r": ("sum", F.lit(1).cast("bigint"))}).select("project_id", "source_file", (F.col("r") * 2 + F.col("project_id") % 2).alias("number"))
    return docs.assign_clip_numbers(files, registry)


def answers(spark, d):
    e = F.col("event_id")
    num = lambda c: F.format_string("%d.5", c)
    body = F.when(e % 7 == 0, F.concat(F.lit('{"clip": "c'), e.cast("string"))).when(
        e % 2 == 0, F.concat(F.lit('{"clip": "c'), (e % 50).cast("string"), F.lit('", "in": '), num(e % 9), F.lit(', "out": '), num(e % 9 + 4), F.lit("}"))
    ).otherwise(F.concat(F.lit('{"clip_id": "c'), (e % 50).cast("string"), F.lit('", "start": '), num(e % 9), F.lit(', "end": '), num(e % 9 + 4), F.lit(', "frame_hint": "c003@'), num(e % 60), F.lit('"}')))
    return table(spark, d, "events").select(e.alias("answer_id"), body.alias("doc"), "props")


@query("plan_answers", """SELECT event_id AS answer_id, event_id % 7 = 0 AS corrupt, CASE WHEN event_id % 7 <> 0 THEN 'c' || event_id % 50 END AS clip,
CASE WHEN event_id % 7 <> 0 THEN event_id % 9 * 1000000 + 500000 END AS in_us, CASE WHEN event_id % 7 <> 0 THEN (event_id % 9 + 4) * 1000000 + 500000 END AS out_us,
CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 1 THEN 'c003' END AS hint_clip, CASE WHEN event_id % 7 <> 0 AND event_id % 2 = 1 THEN event_id % 60 * 1000000 + 500000 END AS hint_us FROM events""")
def plan_answers(spark, d):
    return docs.answer_rows(answers(spark, d).select("answer_id", "doc"))


@query("recover_json", """SELECT event_id AS answer_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE props END AS found, CASE event_id % 5 WHEN 0 THEN 'fence' WHEN 1 THEN 'fence' WHEN 4 THEN 'failed' ELSE 'scan' END AS how FROM events""")
def recover_json(spark, d):
    a = table(spark, d, "events").select(F.col("event_id").alias("answer_id"), "props")
    k = F.col("answer_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\nDone")))
        .when(k == 1, F.concat(F.lit("```"), "props", F.lit("```")))
        .when(k == 2, F.concat(F.lit("Sure {not json} then "), "props", F.lit(" and more")))
        .when(k == 3, F.concat(F.lit("```json\n{broken\n``` "), "props")).otherwise(F.lit("nothing { here"))
    )
    return docs.recover_json(a.select("answer_id", text.alias("doc")))


@query("wav_blocks", """WITH r AS (SELECT user_id AS clip_id, CAST(round(value * 100) AS BIGINT) % 60000 - 30000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
g AS (SELECT clip_id, i // 10 AS block, count(*) AS n, sum((x / 32768.0::DOUBLE) ** 2) AS sum_sq, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM r GROUP BY ALL)
SELECT clip_id, block, block * 10000 AS s_us, block * 10000 + n * 1000 AS e_us, n, sum_sq, lo, hi FROM g""")
def wav_blocks(spark, d):
    """Every user's events as the samples of a file in the shared folder, read back in byte ranges."""
    folder = f"{checkpoint_path(spark)}/wav-{uuid.uuid4().hex}"
    x = (F.round(F.col("value") * 100).cast("bigint") % 60_000 - 30_000).cast("int")

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        where, root = audio.locate(folder)
        where.create_dir(root, recursive=True)
        path = f"{root}/{key[0]}.wav"
        with where.open_output_stream(path) as out:
            out.write(audio.wav_bytes(pdf.sort_values("event_id")["x"].to_numpy(), 1_000))
        return pd.DataFrame({"path": [path]})

    materialize(table(spark, d, "events").select("user_id", "event_id", x.alias("x")).groupBy("user_id").applyInPandas(write, "path string"))
    audio.register_audio(spark)
    blocks = spark.read.format("wav_blocks").option("block_ms", 10).option("split_bytes", 1 << 20).load(folder)
    return blocks.select(F.regexp_extract("path", r"(-?\d+)\.wav$", 1).cast("bigint").alias("clip_id"), "block", "s_us", "e_us", "n", "sum_sq", "lo", "hi")


@query("project_table", "SELECT user_id AS project_id, event_id, event_id // 500 AS version, event_type FROM events QUALIFY version = max(version) OVER (PARTITION BY user_id)")
def project_table(spark, d):
    """Versions of projects arriving in two batches, the first one played again; the table holds the latest of each."""
    e = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("project_id"), "event_id", idiv(e, 500).alias("version"), "event_type")
    path = f"{checkpoint_path(spark)}/projects-{uuid.uuid4().hex}"
    write = sinks.versioned_projects(path)
    for number, odd in ((0, 0), (1, 1), (0, 0)):
        write(rows.where(F.col("version") % 2 == odd), number)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)
