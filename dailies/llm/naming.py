"""Exact de-duplication by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailies.session import materialize

#: A run of white space other than one plain space; one plain space is already in normal form.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, normalised text (null: empty) and its SHA-256."""
    text = docs.select("doc_id", F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), RUNS, " ").alias("norm"))
    return text.withColumn("text_sha256", F.sha2("norm", 256))


def _names(values: DataFrame, *cols: str) -> DataFrame:
    """An integer for each distinct value, in sorted order within its hash partition; for one join on ``cols``, whose one result is written.

    A range-partitioned sort would send a sample of whole blocks to the driver; names need only be one for each value.
    Values stay in the partitions that the join needs, so they are neither written nor dealt out again.
    """
    return values.select(*cols).distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def identities(texts: DataFrame, block_bytes: int = 8192) -> DataFrame:
    """Collision-free identity of each text: doc_id, text_sha256, copies, n_blocks, name.

    Distinct blocks of fixed size are dealt by hash and get integer names, sorted within a partition; adjacent names
    are paired and named again, level by level, until one name is left. Texts with as many blocks are equal exactly
    when their last names are. Only rows whose texts still have several names take part in a level, and the number of levels is the logarithm
    of the longest text's blocks.
    """
    data = F.col("norm").cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("norm") / block_bytes)).cast("int")
    cut = texts.select("doc_id", "text_sha256", n.alias("n_blocks"), data.alias("data")).select(
        "doc_id", "text_sha256", "n_blocks", "data", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("i")
    )
    blocks = cut.select("doc_id", "text_sha256", "n_blocks", "i", F.expr(f"substring(data, i * {block_bytes} + 1, {block_bytes})").alias("block"))
    keys = ["doc_id", "text_sha256", "n_blocks"]
    named = blocks.join(_names(blocks, "block").hint("merge"), "block").groupBy(*keys, "i", "name").agg(F.count("*").alias("copies"))

    def regroup(rows: DataFrame) -> DataFrame:
        seq = F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"])
        return materialize(rows.groupBy(*keys).agg(F.max("copies").alias("copies"), seq.alias("names")))

    state, done = regroup(named), []
    longest = state.agg(F.max("n_blocks")).first()[0] or 0
    while longest > 1:
        done.append(state.filter(F.size("names") == 1))
        i = F.explode(F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))).alias("i")
        pairs = state.filter(F.size("names") > 1).select(*keys, "copies", "names", i).select(
            *keys, "copies", "i", F.get("names", F.col("i") * 2).alias("a"), F.coalesce(F.get("names", F.col("i") * 2 + 1), F.lit(-1)).alias("b")
        )
        state = regroup(pairs.join(_names(pairs, "a", "b").hint("merge"), ["a", "b"]))
        longest = (longest + 1) // 2
    for d in done:
        state = state.unionByName(d)
    return state.select(*keys, "copies", F.get("names", F.lit(0)).alias("name"))


def exact_dedup(docs: DataFrame, block_bytes: int = 8192) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after every run of white space becomes one space; null counts as empty. Of equal
    texts the smallest doc_id stays (null ids last; of repeated rows with that id one is kept). The blocks of all
    texts are named, and equality is decided by the names, never by the digest. Rows with equal doc_id and digest count
    as one row repeated. An empty table gives no rows.
    """
    ids = materialize(identities(normalised(docs), block_bytes))
    groups = ids.groupBy("n_blocks", "name").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    members = ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    )
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return members.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, block_bytes: int = 8192) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows with one doc_id the one of smallest raw text."""
    stay = exact_dedup(docs, block_bytes).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), RUNS, " "), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("__d"), sha.alias("__s"))
    rows = rows.join(stay, rows["__d"].eqNullSafe(stay["__id"]) & (rows["__s"] == stay["__sha"]))
    return rows.groupBy("__id", "__sha").agg(F.min_by("row", F.coalesce(F.col("row.text"), F.lit(""))).alias("row")).select("row.*")
