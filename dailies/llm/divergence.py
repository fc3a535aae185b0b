"""How far the sources of a language differ in their use of its kept terms: exact recount through perfect hashes.

A first pass counts in how many documents of a language each term occurs and keeps the terms in enough of them. The
kept terms are put into minimal perfect hashes, one for each shard of about SHARD_KEYS terms of a language, which keep
the terms themselves, so that any other term is told apart. A second pass over the texts adds up counts in one dense
array of slots for each group (language and source).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.session import materialize

#: A-Z are lower-cased; bytes that stand in no term become blanks.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Terms of one shard, on average, and of one bucket of its hash.
SHARD_KEYS, BUCKET_KEYS = 4096, 4
#: Hashes of at most this many bytes (terms and 64 for each) are broadcast; with more, terms meet their slots in a shuffled join.
BROADCAST_BYTES = 64 << 20
#: Distinct terms, and slots of all groups, that a task holds before it hands its counts on.
HELD_TERMS, HELD_SLOTS = 400_000, 8_000_000
#: p is counted in units of one in so many.
UNIT = 1_000_000_000

GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _place(h: np.ndarray, d: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """Slot, of m, of hashes under displacements."""
    z = h + d.astype(np.uint64) * GOLDEN
    z = (z ^ (z >> np.uint64(30))) * MIX1
    z = (z ^ (z >> np.uint64(27))) * MIX2
    return ((z ^ (z >> np.uint64(31))) % np.asarray(m, np.uint64)).astype(np.int64)


def perfect_hash(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket and slot of each hash; as many slots as hashes, which must differ.

    Buckets are placed by falling size, each under the first displacement that leads its hashes to free slots; a bucket
    of one hash takes any free slot and names it (as -1 - slot).
    """
    m = len(h)
    buckets = -(-m // BUCKET_KEYS)
    of = (h >> np.uint64(32)) % np.uint64(max(1, buckets))
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64))
    shift, slots, taken = np.zeros(buckets, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    sizes = np.diff(starts)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[starts[b] : starts[b + 1]]
        if len(own) < 2:
            break
        first, width = 0, 32
        while True:
            tried = np.arange(first, first + width)
            at = _place(h[own][None, :], tried[:, None], m)
            good = ~taken[at].any(1) & (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
            if good.any():
                k = int(good.argmax())
                shift[b], slots[own] = tried[k], at[k]
                taken[at[k]] = True
                break
            first, width = first + width, min(width * 2, 8192)
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    shift[single], slots[order[starts[single]]] = -1 - free, free
    return shift, slots


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shifts, keys, hashed = [], [], []
        for found in batch.column("found").to_pylist():  # sorted by hash and term
            h = np.array([x["h"] for x in found], np.int64).view(np.uint64)
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            shift, slots = perfect_hash(h[new])
            ordered = [b""] * int(new.sum())
            for k, i in zip(slots.tolist(), np.flatnonzero(new).tolist()):
                ordered[k] = found[i]["term"]
            shifts.append(shift.tolist())
            hashed.append(len(ordered))
            keys.append(ordered + [found[i]["term"] for i in np.flatnonzero(~new).tolist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("shard"), pa.array(hashed, pa.int32()), pa.array(shifts, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.binary()))],
            ["lang", "shard", "hashed", "shifts", "keys"],
        )


def perfect_hashes(kept: DataFrame) -> DataFrame:
    """lang, shard, hashed (slots of the hash), shifts, and keys: the term of each slot, then terms whose 64-bit hash another has."""
    sized = kept.groupBy("lang").agg(F.ceil(F.count("*") / SHARD_KEYS).alias("shards"))
    sharded = kept.join(sized, "lang").withColumn("h", F.xxhash64("term")).withColumn("shard", F.pmod("h", "shards"))
    found = F.sort_array(F.collect_list(F.struct("h", "term"))).alias("found")
    return sharded.groupBy("lang", "shard").agg(found).mapInArrow(_build, "lang string, shard bigint, hashed int, shifts array<bigint>, keys array<binary>")


class Slots:
    """The perfect hashes of one language: term to slot over all its shards."""

    def __init__(self, shards: list[dict]):
        shards = sorted(shards, key=lambda x: x["shard"])
        self.hashed = np.array([x["hashed"] for x in shards], np.uint64)
        self.buckets = np.array([len(x["shifts"]) for x in shards], np.uint64)
        self.first_bucket = np.concatenate([[0], np.cumsum(self.buckets)[:-1]]).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(x["keys"]) for x in shards])]).astype(np.int64)
        self.shifts = np.concatenate([np.array(x["shifts"], np.int64) for x in shards])
        self.keys = [bytes(k) for x in shards for k in x["keys"]]
        self.spare = {bytes(k): int(self.first[i]) + j for i, x in enumerate(shards) for j, k in enumerate(x["keys"]) if j >= x["hashed"]}
        # shards of the whole range that hold no term have no row
        self.total = shards[0]["shards"]
        self.row = np.full(self.total, -1, np.int64)
        self.row[[x["shard"] for x in shards]] = np.arange(len(shards))
        self.shard = np.array([x["shard"] for x in shards], np.int64)

    def find(self, terms: list[bytes]) -> np.ndarray:
        """Slot of each term, -1 for terms that are not kept."""
        h = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in terms), np.uint64, len(terms))
        row = self.row[np.mod(h.view(np.int64), self.total)]
        there = np.flatnonzero(row >= 0)
        h, row = h[there], row[there]
        shift = self.shifts[self.first_bucket[row] + ((h >> np.uint64(32)) % self.buckets[row]).astype(np.int64)]
        slot = self.first[row] + np.where(shift < 0, -1 - shift, _place(h, np.maximum(shift, 0), self.hashed[row]))
        out = np.full(len(terms), -1, np.int64)
        keys, spare = self.keys, self.spare
        out[there] = [s if keys[s] == terms[i] else spare.get(terms[i], -1) for s, i in zip(slot.tolist(), there.tolist())]
        return out


def _texts(batch: pa.RecordBatch, names: tuple[str, ...]) -> dict[tuple, list[bytes]]:
    by = defaultdict(list)
    for *key, text in zip(*[batch.column(n).to_pylist() for n in (*names, "text")]):
        by[tuple(key)].append(text)
    return by


def _counted(names: tuple[str, ...], each: bool):
    """Rows (names..., term, n): occurrences, or documents with the term, as far as this task has met them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Counter] = defaultdict(Counter)

        def out():
            for key, counts in held.items():
                fixed = [pa.array([k] * len(counts), pa.string()) for k in key]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], [*names, "term", "n"])
            held.clear()

        for batch in batches:
            for key, texts in _texts(batch, names).items():
                held[key].update(chain.from_iterable(terms_of(t) if each else set(terms_of(t)) for t in texts))
            if sum(map(len, held.values())) > HELD_TERMS:
                yield from out()
        yield from out()

    return run


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang and term of the terms in at least ``least`` documents of the language."""
    found = docs.select("lang", "text").mapInArrow(_counted(("lang",), False), "lang string, term binary, n bigint")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term")


def _recount(spark, docs: DataFrame, tables: DataFrame) -> DataFrame:
    """Counts (lang, source, shard, slot, n) through the broadcast perfect hashes; tasks hand on what they hold when it grows."""
    by = defaultdict(list)
    for r in tables.collect():  # at most BROADCAST_BYTES
        by[r.lang].append(r.asDict())
    hashes = spark.sparkContext.broadcast({lang: Slots(shards) for lang, shards in by.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], np.ndarray] = {}

        def out():
            for (lang, source), slots in held.items():
                of, used = hashes.value[lang], np.flatnonzero(slots)
                row = np.searchsorted(of.first, used, "right") - 1
                columns = [pa.array([lang] * len(used), pa.string()), pa.array([source] * len(used), pa.string()), pa.array(of.shard[row]), pa.array(used - of.first[row]), pa.array(slots[used])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "shard", "slot", "n"])
            held.clear()

        for batch in batches:
            for key, texts in _texts(batch, ("lang", "source")).items():
                if (of := hashes.value.get(key[0])) is None:
                    continue
                counts = Counter(chain.from_iterable(map(terms_of, texts)))
                slots = of.find(list(counts))
                known = slots >= 0
                if key not in held:
                    if held and sum(map(len, held.values())) + len(of.keys) > HELD_SLOTS:
                        yield from out()
                    held[key] = np.zeros(len(of.keys), np.int64)
                held[key][slots[known]] += np.fromiter(counts.values(), np.int64, len(counts))[known]
        yield from out()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, shard bigint, slot bigint, n bigint")


def _recount_joined(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """The same counts for more terms than may be broadcast: counted terms meet their slots in a shuffled join."""
    found = docs.select("lang", "source", "text").mapInArrow(_counted(("lang", "source"), True), "lang string, source string, term binary, n bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(slots, ["lang", "term"]).select("lang", "source", "shard", "slot", "n")


def smoothed(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact: decimals hold the product."""
    return F.expr(f"1 + (cast({count} + 2 AS decimal(19, 0)) * {UNIT}) div cast({total} + 2 * {kept} AS decimal(19, 0))")


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); the square stays under 2^63."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over the slots of one shard of the distance of every two groups; rows without a slot give what an absent term has."""
    absent = rows[rows.slot < 0].sort_values("gid")
    present = rows[rows.slot >= 0]
    ids = absent.gid.to_numpy()
    p = np.repeat(absent.p.to_numpy(np.int64)[:, None], int(absent.slots.iloc[0]), axis=1)
    p[np.searchsorted(ids, present.gid.to_numpy()), present.slot.to_numpy()] = present.p.to_numpy(np.int64)
    parts = []
    for i in range(len(ids) - 1):
        d = p[i + 1 :] - p[i]
        parts.append(pd.DataFrame({"a": ids[i], "b": ids[i + 1 :], "value": (d * d // (p[i + 1 :] + p[i])).sum(1)}))
    out = pd.concat(parts) if parts else pd.DataFrame({"a": [], "b": [], "value": []}, dtype="int64")
    return out.assign(lang=rows.lang.iloc[0])[["lang", "a", "b", "value"]]


def divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """Distances of the sources of each language, and the terms each source uses more than its language.

    ``docs`` (text, lang, source); nulls are empty strings. A term is a run of letters A-Z, lower-cased, and signs beyond
    ASCII. Returns lang, source, part, item, value and rank. Part 'pair' has every other source of the language with the
    distance summed over all kept terms (0 without any), part 'term' the first ``top`` terms that the group uses at a
    higher rate than its language. Sources without terms take part; repeated rows count each; an empty table gives no
    row. The matrix of one shard is groups of a language x about SHARD_KEYS counts, its result has the size of the pairs.
    """
    spark = docs.sparkSession
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    kept = materialize(kept_terms(docs, least))
    tables = materialize(perfect_hashes(kept))
    slots = tables.select("lang", "shard", F.posexplode("keys").alias("slot", "term")).withColumn("slot", F.col("slot").cast("bigint"))
    sized = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.ceil(F.count("*") / SHARD_KEYS).alias("shards"))
    held = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    found = _recount(spark, docs, tables.join(sized.select("lang", "shards"), "lang")) if held <= BROADCAST_BYTES else _recount_joined(docs, slots)
    counts = materialize(found.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n")))

    zero = F.lit(0).cast("bigint")
    groups = docs.select("lang", "source").distinct().join(sized.select("lang", "kept"), "lang", "left").join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.select("lang", "source", F.coalesce("kept", zero).alias("kept"), F.coalesce("total", zero).alias("total"))
    groups = materialize(groups.withColumn("gid", F.row_number().over(Window.partitionBy("lang").orderBy("source"))))  # as many rows as sources
    rates = counts.join(groups, ["lang", "source"]).withColumn("p", smoothed("n", "total", "kept"))

    whole = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.first("kept").alias("kept"))
    common = whole.join(totals, "lang").select("lang", "shard", "slot", smoothed("n", "total", "kept").alias("q"))
    more = rates.join(common, ["lang", "shard", "slot"]).filter("p > q").withColumn("value", distance("p", "q")).join(slots, ["lang", "shard", "slot"])
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
    # each task keeps its first ranks of a group before rows are dealt out
    ranked = more.select("lang", "source", "term", "value").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    terms = ranked.select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), "value", "rank")

    absent = groups.join(tables.select("lang", "shard", F.size("keys").alias("slots")), "lang")
    absent = absent.select("lang", "shard", "gid", F.lit(-1).cast("bigint").alias("slot"), smoothed("0", "total", "kept").alias("p"), "slots")
    present = rates.select("lang", "shard", "gid", "slot", "p", F.lit(None).cast("int").alias("slots"))
    sums = absent.unionByName(present).groupBy("lang", "shard").applyInPandas(_pair_sums, "lang string, a int, b int, value bigint").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, other = groups.select("lang", "source", F.col("gid").alias("a")), groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"))
    pairs = one.join(other, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left").withColumn("value", F.coalesce("value", zero))
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    return pairs.unionByName(terms)
