"""Exact Jaccard join on word shingles: candidates share prefix tokens under three global orders of the tokens.

A set of n tokens that is linked with another shares a token of its first n - ceil(t n) + 1 ones, whatever the order.
Two of the orders put one half of all tokens (by a bit of their hash) first, rarest first, then the other half by hash;
the third puts all tokens by rarity. Tokens that stand in one text only can't be shared, so they are counted, never
posted, and a text whose prefix under any order is made of them leaves the search. Pairs come from the buckets of the third order and
are verified only if their prefixes meet under the other two as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.llm.common import keyed
from dailies.llm.minmax import components
from dailies.session import materialize

LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Bytes hashed together; words longer than LONG_WORD are hashed one by one.
CHUNK, LONG_WORD = 1 << 20, 512
#: Bits of a set's sketch (parities of the tokens that fall on each); sketches differ in no more bits than sets do in tokens.
SKETCH_BITS = 1024
#: Classes and tokens with at least this share of the rows are hot: at most 1 / HOT_CLASS classes, and 1 / HOT_TOKEN for each token of a mean text.
HOT_CLASS, HOT_TOKEN = 0.0005, 0.005
#: Texts from which hot tokens are told: they only come later in the orders and are dealt out more widely, which changes no result.
SAMPLE_TEXTS, SALTS = 4000, 256
#: Members of a bucket that the second round compares others with, and how many times as many each later round does.
TARGETS, GROWTH = 8, 64
#: Tokens handed on at a time.
HANDED = 1 << 18


class Tokens:
    """Sorted distinct 64-bit hashes of the runs of ``shingle`` words of texts (of the whole sequence if there are fewer).

    A word's hash is the sum of a random number for each byte, A-Z lower-cased, times powers of an odd number, so it is a
    difference of running sums over a whole chunk of texts.
    """

    def __init__(self, shingle: int):
        rng = np.random.default_rng(11)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shingle, self.factors, base = shingle, odd(shingle), int(odd(1)[0])
        self.table = odd(256)[np.frombuffer(LOWERED, np.uint8)]
        inverse = pow(base, -1, 1 << 64)
        self.powers, self.inverses = (np.cumprod(np.r_[np.uint64(1), np.full(CHUNK, x, np.uint64)], dtype=np.uint64) for x in (base, inverse))

    def words(self, buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of texts that begin at ``starts`` of ``buf``, which has at most CHUNK bytes."""
        word = ~SPACE[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cuts = starts[(starts > 0) & (starts < len(buf))]
        first[cuts] = word[cuts]
        last[cuts - 1] = word[cuts - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.powers[: len(buf)], out=sums[1:])
        h = (sums[e] - sums[s]) * self.inverses[s]
        for i in np.flatnonzero(e - s > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(buf[s[i] : e[i]].tobytes().translate(LOWERED))
        return s, h ^ (h >> np.uint64(32))

    def runs(self, h: np.ndarray, n: int) -> np.ndarray:
        s = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            s += h[k : len(h) - n + 1 + k] * self.factors[k]
            s ^= s >> np.uint64(31)
        s *= np.uint64(0x9E3779B97F4A7C15)
        return s ^ (s >> np.uint64(29))

    def _distinct(self, runs: np.ndarray) -> np.ndarray:
        runs = np.sort(runs)
        new = np.ones(len(runs), bool)
        new[1:] = runs[1:] != runs[:-1]
        return runs[new]

    def _long(self, text: bytes) -> np.ndarray:
        """Word hashes of a text over CHUNK bytes, taken in pieces of whole words."""
        found, piece, size = [], [], 0
        for w in [*text.split(), None]:
            if w is None or size + len(w) + 1 > CHUNK:
                joined = np.frombuffer(b" ".join(piece), np.uint8)
                if len(joined) > CHUNK:  # one word
                    h = np.uint64(xxhash.xxh64_intdigest(piece[0].translate(LOWERED)))
                    found.append(np.array([h ^ (h >> np.uint64(32))], np.uint64))
                elif piece:
                    found.append(self.words(joined, np.zeros(1, np.int64))[1])
                piece, size = [], 0
            if w is not None:
                piece.append(w)
                size += len(w) + 1
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def of(self, texts: pa.Array):
        """The tokens of each text, in order."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
            if j <= i:
                h, cuts, j = self._long(data[offsets[i] : offsets[i + 1]].tobytes()), None, i + 1
                cuts = np.array([0, len(h)])
            else:
                j = min(j, len(texts))
                starts = offsets[i : j + 1] - offsets[i]
                s, h = self.words(data[offsets[i] : offsets[j]], starts[:-1])
                cuts = np.searchsorted(s, starts)
            runs = self.runs(h, self.shingle) if len(h) >= self.shingle else h
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a >= self.shingle:
                    yield self._distinct(runs[a : b - self.shingle + 1])
                else:
                    yield self.runs(h[a:b], b - a) if b > a else h[:0]
            i = j


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the tokens on each bit, as 64-bit numbers."""
    odd = np.bincount((tokens >> np.uint64(1)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def class_key(text: bytes, seed: int) -> int:
    """128 bits for the text, A-Z lower-cased."""
    return xxhash.xxh128_intdigest(text.translate(LOWERED), seed)


def needed(n, percent: int):
    """Tokens that a set of n must share with any set it is linked with; also for arrays."""
    return (n * percent + 99) // 100


def _members(shingle: int, percent: int, seed: int):
    """One row for each text: its class (a hash, and a second one to check it), tokens, the half-orders' bounds and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shingle)
        for batch in batches:
            out, sketches = [], []
            for text, t in zip(batch.column("text").to_pylist(), tokens.of(batch.column("text"))):
                n, key = len(t), class_key(text, seed)
                second = (t & np.uint64(1)).astype(bool)
                size = [n - int(second.sum()), int(second.sum())]
                prefix, bounds = n - needed(n, percent) + 1, [None, None]
                for k, other in ((0, second), (1, ~second)):
                    if n and (more := prefix - size[k]) > 0:  # all of its own half, then these of the other
                        bounds[k] = int(np.sort(t[other].view(np.int64))[min(more, size[1 - k]) - 1]) if size[1 - k] else None
                out.append((_signed(key), _signed(key >> 64), n, size[0], bounds[0], bounds[1]))
                sketches.append(sketch(t))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)]
            flat = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (SKETCH_BITS // 64)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *columns, wide], ["doc_id", "h", "key", "check", "n", "first", "bound0", "bound1", "sketch"])

    return run


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _posted(shingle: int, half: int | None, seed: int, skip, hot):
    """(token, key, hot) of the tokens of one half; copies of hot classes but their first are left out, as are copies within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shingle)
        kept, late = (skip.value, hot.value) if skip is not None else ({}, np.zeros(0, np.uint64))
        for batch in batches:
            seen, keys, parts, held = set(), [], [], 0

            def out():
                t = np.concatenate(parts)
                sizes = [len(p) for p in parts]
                at = np.minimum(np.searchsorted(late, t), max(len(late) - 1, 0))
                is_hot = late[at] == t if len(late) else np.zeros(len(t), bool)
                return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(is_hot)], ["token", "key", "hot"])

            for doc, h, text, t in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "h", "text")], tokens.of(batch.column("text"))):
                key = _signed(class_key(text, seed))
                if not len(t) or key in seen or kept.get(key, (doc, h)) != (doc, h):
                    continue
                seen.add(key)
                keys.append(key)
                parts.append(t if half is None else t[(t & np.uint64(1)) == half])
                held += len(parts[-1])
                if held > HANDED:
                    yield out()
                    keys, parts, held = [], [], 0
            if parts:
                yield out()

    return run


def _recurring(texts: DataFrame, shingle: int, half: int, seed: int, skip, hot) -> DataFrame:
    """key and t: its tokens of one half that other texts have too, as structs (rank, token); a rank is the number of texts, or more than any for hot tokens."""
    rows = texts.mapInArrow(_posted(shingle, half, seed, skip, hot), "token bigint, key bigint, hot boolean")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0))
    token = Window.partitionBy("token", "salt")
    rows = rows.withColumn("again", F.lag("key").over(token.orderBy("key")).eqNullSafe(F.col("key"))).filter("NOT again")
    rows = rows.withColumn("rank", F.when(F.col("hot"), F.lit(1 << 40)).otherwise(F.count("*").over(token))).filter("rank > 1")
    return rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("rank", "token"))).alias("t"))


def written(df: DataFrame) -> DataFrame:
    """Materialize, and let the shuffle files behind the table go when it is written."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return materialize(df)
    finally:
        conf.set(name, before)


def _half(k: int, x: Column) -> Column:
    return x.bitwiseAND(F.lit(1)) == k


def token_lists(classes: DataFrame, texts: DataFrame, shingle: int, percent: int, seed: int, skip, hot) -> DataFrame:
    """key, n, t (shared tokens in the third order), prefix (how many of them are its prefix), and k0, k1, bound0, bound1 for the prefixes under the other two."""
    now = classes.withColumn("prefix", F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1).withColumn("t", F.array().cast("array<struct<rank:bigint,token:bigint>>"))
    for k in (0, 1):
        own = F.col("first") if k == 0 else F.col("n") - F.col("first")
        found = _recurring(texts, shingle, k, seed, skip, hot).withColumnRenamed("t", "more")
        now = now.join(found, "key", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<rank:bigint,token:bigint>>")))
        # tokens of no other text come first under every order
        left = F.when(own < F.col("prefix"), F.size("more")).otherwise(F.col("prefix") - own + F.size("more")).cast("int")
        now = now.withColumn(f"k{k}", left).filter((own < F.col("prefix")) | (F.col(f"k{k}") > 0)).withColumn("t", F.concat("t", "more")).drop("more")
        if k == 0:
            now = written(now)
    now = now.withColumn("prefix", (F.col("prefix") - F.col("n") + F.size("t")).cast("int")).filter("prefix > 0")
    return written(now.select("key", "n", F.transform(F.sort_array("t"), lambda x: x["token"]).alias("t"), "prefix", "k0", "k1", "bound0", "bound1", "sketch"))


def _prefix(side: str, k: int) -> Column:
    """Prefix under the order of one half: the first of that half, and those of the other up to the bound if the half doesn't suffice."""
    t = F.col(f"{side}.t")
    own = F.slice(F.filter(t, lambda x: _half(k, x)), F.lit(1), F.col(f"{side}.k{k}"))
    bound = F.col(f"{side}.bound{k}")
    return F.when(bound.isNull(), own).otherwise(F.concat(own, F.filter(t, lambda x: _half(1 - k, x) & (x <= bound))))


def links_of(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes meet under both half-orders and whose sets are similar enough."""
    parts = F.struct(*[c for c in lists.columns if c not in ("key", "sketch", "prefix")])
    one, two = lists.select(F.col("key").alias("a"), parts.alias("one")), lists.select(F.col("key").alias("b"), parts.alias("two"))
    both = F.size(F.array_intersect("one.t", "two.t"))
    enough = both * 100 >= (F.col("one.n") + F.col("two.n") - both) * percent
    met = F.lit(True)
    for k in (0, 1):
        met = met & F.arrays_overlap(_prefix("one", k), _prefix("two", k))
    return pairs.join(one, "a").join(two, "b").filter(F.when(met, enough).otherwise(F.lit(False))).select("a", "b").distinct()


def close(n: str, sketch: str, other_n: str, other_sketch: str, percent: int) -> Column:
    """Whether the sketches, which differ in no more bits than the sets in tokens, leave room for a link."""
    apart = sum((F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(other_sketch, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    both = F.col(n) + F.col(other_n)
    return (both - apart) * (100 + percent) >= both * (2 * percent)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked_classes(lists: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the classes with a link. Buckets are the tokens of the prefixes under the third order.

    Every class is first compared with one other: of its buckets' central members, the one in most buckets. Then, in
    buckets that hold several components, classes outside the largest one are compared with TARGETS members of other
    components, and in each later round with GROWTH times as many, until they have met every member that is still
    apart. So no link between different components is lost, and a crowd is never paired with itself.
    """
    posted = lists.select("key", "n", F.explode(F.slice("t", F.lit(1), F.col("prefix"))).alias("bucket"))
    crowded = written(posted.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"))
    shared = written(posted.join(crowded, "bucket"))

    def similar(n: str, other: str) -> Column:
        return F.least(n, other) * 100 >= F.greatest(n, other) * percent

    central = shared.groupBy("key").agg(F.count("*").alias("score"))
    scored = written(shared.join(central, "key"))
    hubs = written(scored.groupBy("bucket").agg(F.max(F.struct("score", F.col("key").alias("hub"), F.col("n").alias("hub_n"))).alias("h")).select("bucket", "h.*"))
    met = scored.drop("score").join(hubs, "bucket").filter((F.col("key") != F.col("hub")) & similar("n", "hub_n"))
    best = met.groupBy("key").agg(F.max(F.struct("score", "hub")).alias("x")).select(*_pair("key", "x.hub")).distinct()
    links = written(links_of(best, lists, percent))
    comps = components(links)
    open_buckets, width = crowded.select("bucket"), TARGETS
    while True:
        now = shared.join(open_buckets, "bucket").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("comp", "key")).drop("comp")
        now = written(now)
        sizes = now.groupBy("bucket", "label").agg(F.count("*").alias("c"), F.max("m").alias("m"))
        mixed = sizes.groupBy("bucket").agg(F.max(F.struct("c", "label")).alias("top"), F.max("m").alias("m")).filter("top.c < m")
        mixed = written(mixed.select("bucket", F.col("top.label").alias("top"), "m"))
        if mixed.isEmpty():
            return comps
        members = written(now.drop("m").join(mixed, "bucket").join(lists.select("key", "sketch"), "key"))
        turn = F.pmod(F.xxhash64("key", "bucket"), F.lit(1 << 20)) * F.col("m") < F.lit(width << 20)
        outside = members.filter("label <> top").select("bucket", *[F.col(c).alias(f"o_{c}") for c in ("key", "n", "label", "sketch")])
        targets = members.filter((F.col("m") <= width) | turn).select("bucket", "key", "n", "label", "sketch")
        meet = (F.col("label") != F.col("o_label")) & similar("n", "o_n") & close("n", "sketch", "o_n", "o_sketch", percent)
        pairs = outside.join(targets, "bucket").filter(meet).select(*_pair("key", "o_key")).distinct()
        fresh = written(links_of(pairs, lists, percent))
        if not fresh.isEmpty():
            links = links.unionByName(fresh)
            comps = components(links)
        open_buckets, width = mixed.filter(F.col("m") > width).select("bucket"), width * GROWTH
        if open_buckets.isEmpty():
            return comps


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Components of texts linked by 100 * |intersection| >= percent * |union| of their sets: one row for each row of ``docs`` (doc_id, text).

    A text's set are its distinct runs of ``shingle`` words (runs of other signs than white space, A-Z lower-cased);
    with fewer words the whole sequence; without words none, and it is linked with nothing. Returns doc_id, h (hash of
    the text), n_shingles and component_id, the smallest doc_id reachable. A null id is the largest, a component of
    null ids has a null id. Repeated rows each give a row, an empty table none. Tokens are 64-bit hashes of the shingles.
    Texts equal but for A-Z are one class; its hash is checked by a second one and taken anew if two classes share it.
    """
    spark = docs.sparkSession
    texts = keyed(docs).withColumn("text", F.col("text").cast("binary"))
    seed = 0
    while True:
        members = written(texts.mapInArrow(_members(shingle, percent, seed), "doc_id bigint, h bigint, key bigint, check bigint, n bigint, first bigint, bound0 bigint, bound1 bigint, sketch array<bigint>"))
        rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
        of_key = members.filter("n > 0").groupBy("key").agg(F.min(rank).alias("rep"), F.count("*").alias("copies"), F.min("check").alias("lo"), F.max("check").alias("hi"), *[F.first(c).alias(c) for c in ("n", "first", "bound0", "bound1", "sketch")])
        classes = written(of_key)
        if classes.filter("lo <> hi").isEmpty():
            break
        seed += 1
    total = members.count()
    hot_classes = classes.filter(F.col("copies") > max(8, int(total * HOT_CLASS))).select("key", "rep.doc_id", "rep.h").collect()  # at most 1 / HOT_CLASS
    skip = spark.sparkContext.broadcast({r.key: (r.doc_id, r.h) for r in hot_classes})
    part = texts.sample(min(1.0, SAMPLE_TEXTS / max(1, total)), seed=7).mapInArrow(_posted(shingle, None, seed, None, None), "token bigint, key bigint, hot boolean")
    often = part.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > max(8, int(min(total, SAMPLE_TEXTS) * HOT_TOKEN))).select("token").collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.token for r in often], np.int64).view(np.uint64)))

    lists = token_lists(classes.select("key", "n", "first", "bound0", "bound1", "sketch"), texts, shingle, percent, seed, skip, hot)
    comps = linked_classes(lists, percent)
    labelled = classes.select("key", "rep").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("comp", "key"))
    heads = labelled.groupBy("label").agg(F.min("rep").alias("head"))
    heads = written(labelled.join(heads, "label").select("key", F.col("head.doc_id").alias("component_id")))
    out = members.select("doc_id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key")).join(heads.withColumn("linked", F.lit(True)), "key", "left")
    return out.select("doc_id", "h", "n_shingles", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
