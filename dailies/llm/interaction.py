"""Which filter removes what, in every order: sorted posting lists of failing ids, merged by galloping search.

Each filter of a part has the list of the row ids that fail it. Lists are cut into ranges of ids, so no list grows with
the table; in each range the unions of all sets of filters are merged from the lists, and the sizes of unions and
differences, summed over the ranges, give every order of the filters.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.llm.common import UPPER
from dailies.session import materialize

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Ids of one range, as a power of two; longest step from which a search gallops.
RANGE_BITS, STRIDE = 16, 64
#: What is counted of each union: all of its rows, those of good documents, those of toxic ones.
KINDS = ("rows", "good", "toxic")


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of a text that is not null, given its words as the column ``words``."""
    n = F.size("words")
    capitals = F.char_length(text) - F.char_length(F.translate(text, UPPER, ""))
    return {"A": n < 50, "B": F.size(F.array_distinct("words")) * 100 < n * 65, "C": capitals * 100 > F.char_length(text) * 5, "D": text.rlike("[#$%&*|]")}


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """id, part, good, toxic and whether each filter fails (A to E), one row for each document row.

    ``id`` is a number of this result, in consecutive runs. E fails where an equal text (by SHA-256) has a smaller
    doc_id anywhere in the table; a null doc_id is smaller than none and has no smaller one. Good and toxic are what any
    label row of the doc_id says; a null doc_id has no label.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(k) for k, c in text_conditions(F.col("text")).items()])
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()))
    # written first, so that both sides of the join are plain exchanges, which Spark can split where one text is frequent
    first = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("digest", "first"))
    said = materialize(labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    out = rows.join(first, "digest", "left").join(said, "doc_id", "left")
    no = F.lit(False)
    return out.select("id", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), *FILTERS[:4], F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"))


def gallop(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of the first id at or above each wanted one; both are sorted, and the search is exponential.

    Every STRIDE-th wanted id is searched from the start; those between gallop from it: steps double until they pass
    the id, and the last step is halved down.
    """
    if not len(ids) or not len(wanted):
        return np.zeros(len(wanted), np.int64)
    low = np.repeat(np.searchsorted(ids, wanted[::STRIDE]), STRIDE)[: len(wanted)]
    step, open_ = np.ones(len(wanted), np.int64), np.arange(len(wanted))
    while len(open_):  # ids[low - 1] is below the wanted id; low + step - 1 is not yet known to be
        at = low[open_] + step[open_] - 1
        below = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] < wanted[open_])
        open_ = open_[below]
        low[open_] = at[below] + 1
        step[open_] *= 2
    high = np.minimum(low + step - 1, len(ids))
    while (wide := np.flatnonzero(low < high)).size:
        mid = (low[wide] + high[wide]) // 2
        below = ids[mid] < wanted[wide]
        low[wide[below]], high[wide[~below]] = mid[below] + 1, mid[~below]
    return low


def shared(ids: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted ids, and which of them are there."""
    at = gallop(ids, wanted)
    there = np.zeros(len(wanted), bool)
    inside = at < len(ids)
    there[inside] = ids[at[inside]] == wanted[inside]
    return at, there


def union(ids: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Both sorted lists as one: ids only in the shorter list are put at their places in the longer one."""
    long, short = (ids, more) if len(ids) >= len(more) else (more, ids)
    at, there = shared(long, short)
    return np.insert(long, at[~there], short[~there])


def union_sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sizes (2 ** filters x KINDS) of the unions of all sets of lists; bit i of the set says that list i is in it."""
    unions = [np.zeros(0, np.int64)]
    out = np.zeros((1 << len(lists), len(KINDS)), np.int64)
    for s in range(1, 1 << len(lists)):
        top = s.bit_length() - 1
        merged = union(unions[s - (1 << top)], lists[top])
        unions.append(merged)
        out[s] = len(merged), shared(merged, good)[1].sum(), shared(merged, toxic)[1].sum()
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = []
        for name in (*FILTERS, *KINDS[1:]):
            c = batch.column(name)
            columns.append((c.offsets.to_numpy(), c.values.to_numpy()))
        sizes = [union_sizes([v[o[i] : o[i + 1]] for o, v in columns[: len(FILTERS)]], *[v[o[i] : o[i + 1]] for o, v in columns[len(FILTERS) :]]).reshape(-1) for i in range(batch.num_rows)]
        each = len(sizes[0]) if sizes else 0
        flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * each), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("n"), flat], ["part", "n", "sizes"])


def part_sizes(rows: DataFrame) -> DataFrame:
    """part, n and u: sizes of the union of each set of filters, as structs of KINDS, at the number of the set."""
    posted = [F.sort_array(F.collect_list(F.when(F.col(c), F.col("id")))).alias(c) for c in (*FILTERS, *KINDS[1:])]
    # one row holds the lists of at most 2 ** RANGE_BITS ids of one part
    lists = rows.groupBy("part", F.shiftright("id", RANGE_BITS).alias("range")).agg(F.count("*").alias("n"), *posted).drop("range")
    sizes = lists.mapInArrow(_merge, "part string, n bigint, sizes array<bigint>")
    total = lambda s, k: F.sum(F.get("sizes", F.lit(s * len(KINDS) + k)))
    structs = [F.struct(*[total(s, k).alias(name) for k, name in enumerate(KINDS)]) for s in range(1 << len(FILTERS))]
    return sizes.groupBy("part").agg(F.sum("n").alias("n"), F.array(*structs).alias("u"))


def _set_of(letters: Column) -> Column:
    return sum((F.when(F.contains(letters, F.lit(f)), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source; null: empty string), order of the five filters and step.

    ``docs`` (doc_id, text, source), ``labels`` (doc_id, quality, toxic). Counts are of document rows, so repeated rows
    count each. Parts come from the documents; an empty table gives no row. A null text is empty; it fails A (no words)
    and, like any empty text, B, C and D never. Returns part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost and shapley (removals of the step's filter summed over all orders).
    """
    parts = part_sizes(failing(docs, labels))
    steps = parts.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    steps = steps.withColumn("letter", letter).withColumn("before", _set_of(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)))
    steps = steps.withColumn("own", _set_of(F.col("letter")))

    def size(s: Column, kind: str = "rows") -> Column:
        return F.coalesce(F.get("u", s)[kind], F.lit(0))

    upto, all_ = F.col("before") + F.col("own"), (1 << len(FILTERS)) - 1
    removed = size(upto) - size(F.col("before"))
    lost = {k: size(upto, k) - size(F.col("before"), k) for k in KINDS[1:]}
    out = steps.select(
        "part", "filter_order", "step", "letter", (F.col("n") - size(upto)).alias("kept"), removed.alias("removed"), (size(F.col("own")) - removed).alias("redundant"),
        (size(F.lit(all_)) - size(F.lit(all_) - F.col("own"))).alias("unique_fails"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"),
    )
    # 120 rows for each part and letter, whatever the table's size
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")
