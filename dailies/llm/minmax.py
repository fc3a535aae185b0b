"""Near-duplicate search by min-max hashing, banding and confirmation on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.llm.common import ascii_lower, join_keyed, keyed
from dailies.session import materialize

#: Two numbers of each permutation; 40 bands of 5 miss a pair of similarity 0.8 once in 10 million.
BANDS, ROWS, SEED = 40, 5, 20231
#: Members of one bucket that the second round compares others with, and how many times as many each later round does.
TARGETS, GROWTH = 8, 256
#: Shingles that pass through numpy at a time.
CHUNK = 1 << 16


def shingle_set(text: Column, shingle: int) -> tuple[Column, Column]:
    """The words of a text, and (on a column ``words`` of them) the distinct 64-bit hashes of the runs of ``shingle`` words (white space apart, A-Z lower-cased); fewer words are one run."""
    words = F.regexp_extract_all(ascii_lower(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    last = F.greatest(F.lit(0), F.size("words") - shingle)
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(shingle)]))
    return words, F.when(F.size("words") > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def sets_of(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h and set, the distinct hashes of its shingles."""
    words, hashes = shingle_set(F.col("text"), shingle)
    return keyed(docs).withColumn("words", words).select("doc_id", "h", hashes.alias("set"))


def signatures(flat: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """Band hashes (documents x bands) of the sets that begin at ``starts`` of ``flat``; no set may be empty.

    Each permutation (multiplication by an odd number and addition, modulo 2^64) gives its minimum and its maximum,
    so ``bands * rows`` numbers need half as many permutations.
    """
    perms = -(-bands * rows // 2)
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, perms, dtype=np.uint64)
    sig = np.empty((len(starts), perms * 2), np.uint64)
    ends = np.append(starts[1:], len(flat))
    i = 0
    while i < len(starts):  # whole sets, about CHUNK shingles at a time, so that they stay in the cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        part, cuts = flat[starts[i] : ends[j - 1]], (starts[i:j] - starts[i])
        for p in range(perms):
            v = part * mul[p] + add[p]
            sig[i:j, 2 * p] = np.minimum.reduceat(v, cuts)
            sig[i:j, 2 * p + 1] = np.maximum.reduceat(v, cuts)
        i = j
    sig = sig[:, : bands * rows].reshape(len(starts), bands, rows)
    out = np.zeros((len(starts), bands), np.uint64)
    for r in range(rows):
        out = (out ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch.column("set")
            offsets = sets.offsets.to_numpy()
            flat = sets.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
            offsets = offsets.astype(np.int64) - offsets[0]
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            n = len(sizes)
            sums, mixed, hashes = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((len(full), bands), np.uint64)
            if len(full):
                starts = offsets[:-1][full]
                sums[full] = np.add.reduceat(flat, starts)
                z = (flat ^ (flat >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                mixed[full] = np.add.reduceat(z ^ (z >> np.uint64(27)), starts)
                hashes = signatures(flat, starts, bands, rows)
            counts = np.zeros(n, np.int64)
            counts[full] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(hashes.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(sizes), pa.array(sums.view(np.int64)), pa.array(mixed.view(np.int64)), lists],
                ["doc_id", "h", "n_shingles", "sum", "mix", "bands"],
            )

    return run


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node that each node of ``edges`` (a, b) can reach.

    Alternates two steps on the edge list until it is made of stars: every node's larger neighbours are linked to its
    smallest one, then its smaller ones are. No node's neighbours are ever gathered; each step is a join.
    """
    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(links)
    while True:
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = around.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # what is left of a node's neighbours are the ends of its stars, so a window over them is short
        down = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        links = materialize(small)
        before, state = state, _state(links)
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of near-duplicate texts: one row for each row of ``docs`` (doc_id, text).

    A text's set are its distinct runs of ``shingle`` words (fewer words: the whole sequence; none: no set, linked with
    nothing). Two texts are linked when 100 * |intersection| >= percent * |union|. Returns doc_id, h (hash of the
    text), n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id) and stays, true for one
    row of each component. A null id is the largest; a component of null ids has a null id. Repeated rows each give a
    row; an empty table gives none.

    Texts with one and the same set are one class and are never paired. Classes meet in buckets of min-max bands. In
    each bucket the class that shares most is compared with the others. Then, in buckets that still hold several
    components, classes outside the largest one are compared with 8 members of other components, and in each later
    round with 256 times as many, until they have met every member that is still apart. So no link between classes of
    different components is lost, classes already joined are not compared again, and only those that stay outside
    meet a whole bucket; such a pair leaves the join only if a bound from short forms of the sets allows a link. Every link is confirmed on the full sets, read only for classes that share a bucket.
    """
    signed = materialize(sets_of(docs, shingle).mapInArrow(_sign(bands, rows), "doc_id bigint, h bigint, n_shingles bigint, sum bigint, mix bigint, bands array<bigint>"))
    same = ["n_shingles", "sum", "mix"]
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min(rank).alias("rep"), F.any_value("bands").alias("bands"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    size = F.col("n_shingles").alias("n")
    posted = classes.select("cid", size, F.posexplode("bands").alias("band", "x")).select("cid", "n", F.xxhash64("band", "x").alias("key"))
    crowded = posted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = materialize(posted.join(crowded, "key").select("key", "cid", "n", "m"))
    wanted = classes.join(shared.select("cid").distinct(), "cid").select("cid", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h"))
    texts = keyed(docs)
    words, hashes = shingle_set(F.col("text"), shingle)
    full = materialize(join_keyed(texts, wanted).select("cid", "text").withColumn("words", words).select("cid", hashes.alias("set")))

    # 16 bits of each hash: what two sets share is at most what these share, plus what coincides within the set that loses less
    short = full.select("cid", F.array_distinct(F.transform("set", lambda x: (x.bitwiseAND(65535) - 32768).cast("smallint"))).alias("short"))

    def similar(n: str, other: str) -> Column:
        return F.least(n, other) * 100 >= F.greatest(n, other) * percent

    def confirm(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("cid").alias("a"), F.col("set").alias("set_a"))
        right = full.select(F.col("cid").alias("b"), F.col("set").alias("set_b"))
        both = F.size(F.array_intersect("set_a", "set_b"))
        linked = both * 100 >= (F.size("set_a") + F.size("set_b") - both) * percent
        return pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b").distinct()

    central = shared.groupBy("cid").agg(F.sum("m").alias("score"))
    hub = shared.join(central, "cid").groupBy("key").agg(F.max(F.struct("score", "cid", "n")).alias("hub"))
    first = shared.join(hub, "key").filter((F.col("cid") != F.col("hub.cid")) & similar("n", "hub.n"))
    links = materialize(confirm(first.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()))
    comps = components(links)
    keys_of = shared.filter("m > 2").groupBy("cid").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most one for each band
    open_keys, width = shared.filter("m > 2").select("key").distinct(), TARGETS
    while True:
        now = shared.join(open_keys, "key").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
        now = now.select("key", "cid", "n", "m", F.coalesce("comp", "cid").alias("label"))
        sizes = now.groupBy("key", "label").agg(F.count("*").alias("c"), F.max("m").alias("m"))
        mixed = sizes.groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.max("m").alias("m"))
        mixed = materialize(mixed.filter(F.col("top.c") < F.col("m")).select("key", "m", F.col("top.label").alias("top")))
        if mixed.isEmpty():
            break
        members = now.drop("m").join(mixed, "key").join(keys_of, "cid").join(short, "cid")
        turn = F.pmod(F.xxhash64("cid", "key"), F.lit(1 << 20)) * F.col("m") < F.lit(width << 20)
        outside = members.filter(F.col("label") != F.col("top")).select(*[F.col(c).alias(f"p_{c}") for c in ("key", "cid", "n", "label", "keys", "short")])
        targets = members.filter((F.col("m") <= width) | turn).select("key", "cid", "n", "label", "keys", "short")
        # a pair is taken up in the first bucket it shares, so once, and only if its 16-bit forms leave room for a link
        meet = (F.col("key") == F.col("p_key")) & (F.col("label") != F.col("p_label")) & similar("n", "p_n") & (F.get(F.array_intersect("keys", "p_keys"), F.lit(0)) == F.col("key"))
        most = F.size(F.array_intersect("short", "p_short")) + F.least(F.col("n") - F.size("short"), F.col("p_n") - F.size("p_short"))
        meet = meet & (most * 100 >= (F.col("n") + F.col("p_n") - most) * percent)
        fresh = confirm(outside.join(targets, meet).select(F.least("cid", "p_cid").alias("a"), F.greatest("cid", "p_cid").alias("b")).distinct())
        fresh = materialize(fresh)
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            comps = components(links)
        open_keys, width = mixed.filter(F.col("m") > width).select("key"), width * GROWTH
        if open_keys.isEmpty():
            break

    of_class = classes.select("cid", *same, "rep").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("comp", "cid"))
    of_class = of_class.select(*same, "label", "rep")
    firsts = of_class.groupBy("label").agg(F.min("rep").alias("head"))
    heads = of_class.join(firsts, "label").select(*same, "head")
    out = signed.select("doc_id", "h", *same).join(heads, same, "left")
    alone = F.col("head").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select(
        "doc_id", "h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("h") == F.col("head.h")))).alias("stays"),
    )
