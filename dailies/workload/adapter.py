"""How the given tables stand in for footage tables; every rule is integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailies.functions.arith import idiv

WORD_US, PAUSE_US, SPOKEN_US, PAUSE_EVERY = 400_000, 1_500_000, 300_000, 17

#: Documents and order lines that one task takes, so that a task's memory does not grow with the tables.
TASK_DOCUMENTS, TASK_LINES = 2_000, 250_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def clips(spark: SparkSession, d: str) -> int:
    """Number of clips; stand-ins deal their rows out over all of them, so no clip's share grows with the tables."""
    return max(1, table(spark, d, "documents").count())


def dealt(df: DataFrame, key: str, rows: int, per_task: int) -> DataFrame:
    """``df`` dealt out by a key over as many tasks as ``rows`` need; what is then grouped, ordered or joined by the key stays there."""
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(shuffled, -(-rows // per_task)), key)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Document rows dealt out by clip: work on words takes long for each byte, and a file may be one row group."""
    rows = table(spark, d, "documents").select("source", "doc_id", "lang", "text")
    return dealt(rows, "doc_id", clips(spark, d), TASK_DOCUMENTS)


def word_start(pos: Column) -> Column:
    pos = pos.cast("bigint")
    return pos * WORD_US + idiv(pos, PAUSE_EVERY) * PAUSE_US


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """One row per clip: project, clip, lang and its words in order (as a transcript file holds them)."""
    tokens = F.filter(F.split("text", "[ \\n\\t]+"), lambda t: t != "")
    words = F.transform(
        tokens,
        lambda t, i: F.struct(
            i.cast("bigint").alias("pos"), word_start(i).alias("s_us"), (word_start(i) + SPOKEN_US).alias("e_us"), t.alias("text")
        ),
    )
    return documents(spark, d).select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("clip_id"), "lang", words.alias("words")
    )


def words(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.filter(F.split("text", "[ \\n\\t]+"), lambda t: t != "")
    rows = documents(spark, d).select(
        F.col("source").alias("project_id"), F.col("doc_id").alias("clip_id"), "lang", F.posexplode(tokens).alias("pos", "text")
    )
    pos = F.col("pos").cast("bigint")
    start = word_start(pos)
    return rows.select("project_id", "clip_id", "lang", pos.alias("pos"), start.alias("s_us"), (start + SPOKEN_US).alias("e_us"), "text")


TOKENS = """toks AS (SELECT source AS project_id, doc_id AS clip_id, lang,
  list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda x: x <> '') AS t FROM documents)"""
WORDS = TOKENS + """,
words AS (SELECT project_id, clip_id, lang, i - 1 AS pos, t[i] AS text,
  (i-1)*400000 + ((i-1)//17)*1500000 AS s_us, (i-1)*400000 + ((i-1)//17)*1500000 + 300000 AS e_us
  FROM (SELECT project_id, clip_id, lang, t, unnest(range(1, len(t)+1)) AS i FROM toks))"""


def ranges(spark: SparkSession, d: str) -> DataFrame:
    """Events as ranges on their user's clip: start is the event time, length its value in seconds."""
    start = idiv(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"), 400)
    length = (F.round(F.col("value") * 100).cast("bigint") * 10_000).cast("bigint")
    return table(spark, d, "events").select(
        F.col("user_id").alias("clip_id"), "event_id", "event_type", start.alias("s_us"), (start + length).alias("e_us")
    )


RANGES = """ranges AS (SELECT user_id AS clip_id, event_id, event_type, s_us, s_us + CAST(round(value*100) AS BIGINT)*10000 AS e_us
  FROM (SELECT *, (epoch_us(ts) - 1704067200000000) // 400 AS s_us FROM events))"""

SPEECH_TYPES = ("click", "view", "purchase")


def clip_total(clip: str = "clip_id") -> Column:
    return (F.lit(6_000_000_000) - (F.col(clip) % 7) * 100_000_000).cast("bigint")


TOTAL = "(6000000000 - (clip_id % 7) * 100000000)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as the shots of an edit, dealt out by project; ``pos`` numbers them inside it, over all columns of a line."""
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    line = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    )
    pos = F.row_number().over(line).cast("bigint")
    in_us = (F.col("l_suppkey") % 10 * 1_000_000).cast("bigint")
    dur = (F.col("l_quantity") * 100_000).cast("bigint")
    return dealt(lines, "l_orderkey", lines.count(), TASK_LINES).select(
        F.col("l_orderkey").alias("project_id"), pos.alias("pos"), F.col("l_partkey").alias("clip_id"),
        in_us.alias("in_us"), (in_us + dur).alias("out_us"),
        F.when(F.col("l_returnflag") == "R", "xfade").when(F.col("l_returnflag") == "A", "fade").otherwise("cut").alias("transition"),
        F.when(F.col("l_returnflag").isin("R", "A"), (F.col("l_partkey") % 10) * 100_000).otherwise(0).cast("bigint").alias("transition_us"),
        ((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 3 == 0)).alias("muted"),
        F.when(F.col("l_linenumber") % 4 == 0, 2).otherwise(1).alias("speed"),
        (F.col("l_suppkey") % 5).cast("bigint").alias("beat_mod"),
    )


SEGMENTS = """segments AS (SELECT l_orderkey AS project_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
  l_returnflag, l_linestatus, l_shipdate) AS pos,
  l_partkey AS clip_id, l_suppkey % 10 * 1000000 AS in_us, l_suppkey % 10 * 1000000 + CAST(l_quantity * 100000 AS BIGINT) AS out_us,
  CASE l_returnflag WHEN 'R' THEN 'xfade' WHEN 'A' THEN 'fade' ELSE 'cut' END AS transition,
  CASE WHEN l_returnflag IN ('R','A') THEN (l_partkey % 10) * 100000 ELSE 0 END AS transition_us,
  (l_linestatus = 'F' AND l_linenumber % 3 = 0) AS muted, CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END AS speed,
  l_suppkey % 5 AS beat_mod FROM lineitem)"""
