"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.session import materialize


def _stratum(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def interleave_shards(docs: DataFrame, n_shards: int = 8, seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """Put every row of ``docs`` (doc_id, text, source) into shards whose mixture of sources is the corpus's.

    Rows are shuffled within their source by a seeded digest of doc_id, get the fractional rank (rank + 1/2) / n,
    are put in order of it, and the order is cut into shards whose row counts differ by one at most. Returns doc_id,
    source, size (UTF-8 bytes + 1), text_crc32, shard and slot (gapless from 0 in each shard).

    No source and no shard is ever one task: ranks are positions inside buckets of about ``bucket_rows`` rows (ranges
    of the digest, then of the fractional rank) plus the summed counts of the buckets before. A null source is a
    source of its own; null text has size 1; equal texts are ordinary rows and are spread; repeated rows get places
    of their own. An empty table gives no rows.
    """
    n = docs.count()
    parts = max(1, -(-n // bucket_rows))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    ids = docs.select("doc_id", "source", "text").withColumn("stratum", _stratum(F.col("source"))).withColumn("key", key)
    ids = ids.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * parts / (1 << 32)).cast("int"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = ids.groupBy("stratum", "bucket").agg(F.count("*").alias("c"))
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"), F.sum("c").over(Window.partitionBy("stratum")).alias("n_s"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = ids.select("doc_id", "source", "stratum", "key", "bucket", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["key", "doc_id", "text_crc32", "size"]
    within = F.row_number().over(Window.partitionBy("stratum", "bucket").orderBy(*order))
    rank = F.col("off") + F.col("within") - 1
    ranked = rows.withColumn("within", within).join(counts, ["stratum", "bucket"]).withColumn("frac", (rank * 2 + 1).cast("double") / (F.col("n_s") * 2).cast("double"))
    ranked = materialize(
        ranked.select("doc_id", "source", "stratum", "key", "size", "text_crc32", "frac", F.floor(F.col("frac") * parts).cast("int").alias("piece"))
    )
    pieces = ranked.groupBy("piece").agg(F.count("*").alias("c"))
    pieces = pieces.select("piece", F.coalesce(F.sum("c").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    at = F.col("off") + F.row_number().over(Window.partitionBy("piece").orderBy("frac", "stratum", *order)) - 1
    placed = ranked.join(pieces, "piece").withColumn("at", at)
    shard = F.floor(F.expr(f"at * {n_shards} div {max(n, 1)}")).cast("int")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).select("doc_id", "source", "size", "text_crc32", "shard", (F.col("at") - first).cast("bigint").alias("slot"))
