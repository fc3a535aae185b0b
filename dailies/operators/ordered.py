"""Ordered computation per key: running windows that survive hot keys, and streamed folds.

A plain ``Window.partitionBy(key)`` puts a whole key in one task.  ``running`` gives the same
columns, but a key that holds a large share of the rows is cut into consecutive ranges of its
order column: each range is one window partition, and only one summary row per range has to be
put in order per key.  The cut points come from :func:`plan_splits`.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

BUCKET = "__range"


@dataclass(frozen=True)
class Splits:
    """Cut points of the hot keys: a DataFrame (keys..., ``__bounds`` ARRAY<BIGINT>, ``__cells`` INT).

    A key holds more than ``hot_share`` of the rows, so there are at most ``1 / hot_share`` of them, whatever the
    table's size; each has at most ``QUANTILES + 1`` bounds.
    """

    bounds: DataFrame
    keys: tuple[str, ...]

    def assign(self, df: DataFrame, order: str) -> DataFrame:
        """Add the range number of every row (0 for keys that are not hot): its quantile, cut into even cells."""
        marked = df.join(F.broadcast(self.bounds), list(self.keys), "left").withColumn("__q", F.size(F.filter("__bounds", lambda b: b <= F.col(order))))
        low, high = F.get("__bounds", F.col("__q") - 1), F.get("__bounds", F.col("__q"))
        width = F.greatest(F.lit(1), F.ceil((high - low) / F.col("__cells")))
        cell = F.coalesce(F.floor((F.col(order) - low) / width), F.lit(0))
        place = F.col("__q").cast("bigint") * F.col("__cells") + cell
        return marked.withColumn(BUCKET, F.when(F.col("__bounds").isNull(), 0).otherwise(place).cast("bigint")).drop("__bounds", "__cells", "__q")


QUANTILES = 256


def plan_splits(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    hot_share: float = 0.002,
    piece_rows: int = 1_000_000,
    sample_rows: int = 500_000,
) -> Splits | None:
    """Find keys holding more than ``hot_share`` of the rows and cut points inside them.

    ``df`` should be a scan or a cheap projection of one; its count sets the sampling rate. Only the choice of cut
    points uses the sample; results never depend on it, since any cut at an order value is valid. A key is cut at 256
    quantiles, and each of these into as many even cells as bring a piece to about ``piece_rows``, so pieces do not
    grow with the table. None where no key is hot: a plain window then deals the rows out well enough, at any size. The
    cut points, at most ``1 / hot_share`` rows, are found once and kept as local rows.
    """
    total = df.count()
    fraction = min(1.0, sample_rows / max(total, 1))
    base = df.select(*keys, F.col(order).alias("__o"))
    sample = base if fraction >= 1.0 else base.sample(fraction, seed=17)
    quantiles = [i / QUANTILES for i in range(QUANTILES + 1)]
    cells = F.greatest(F.lit(1), F.ceil(F.col("__n") / fraction / QUANTILES / piece_rows)).cast("int")
    hot = (
        sample.groupBy(*keys)
        .agg(F.count("*").alias("__n"), F.percentile_approx("__o", quantiles, 10_000).alias("__bounds"))
        .where(F.col("__n") > max(2, int(total * fraction * hot_share)))
        .select(*keys, F.array_distinct("__bounds").alias("__bounds"), cells.alias("__cells"))
    )
    found = hot.collect()  # at most 1 / hot_share
    return Splits(df.sparkSession.createDataFrame(found, hot.schema), tuple(keys)) if found else None


_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, 0)

#: kind -> (frame inside a range, frame over range summaries, looks ahead).  Looking ahead is done on
#: the reversed order, because a frame that ends at the last row is re-evaluated for every row.
_FRAMES = {
    "lag": (None, _BEFORE, False),
    "lead": (None, _BEFORE, True),
    "max_before": (_BEFORE, _BEFORE, False),
    "sum": (_UPTO, _BEFORE, False),
    "last": (_UPTO, _BEFORE, False),
    "last_before": (_BEFORE, _BEFORE, False),
    "next": (_UPTO, _BEFORE, True),
    "next_after": (_BEFORE, _BEFORE, True),
}


def _windows(keys: list[str], order: list[str]):
    base = Window.partitionBy(*keys)
    return base.orderBy(*order), base.orderBy(*[F.col(c).desc() for c in order])


def _local(kind: str, expr: Column, windows) -> Column:
    frame, _, ahead = _FRAMES[kind]
    if kind == "lag":
        return F.lag(expr).over(windows[0])
    if kind == "lead":
        return F.lead(expr).over(windows[0])
    framed = windows[1 if ahead else 0].rowsBetween(*frame)
    if kind == "max_before":
        return F.max(expr).over(framed)
    if kind == "sum":
        return F.sum(expr).over(framed)
    return F.last(expr, ignorenulls=True).over(framed)


def _summary(kind: str, expr: Column, order: Column) -> Column:
    if kind == "lag":
        return F.max_by(F.struct(expr.alias("v")), order)
    if kind == "lead":
        return F.min_by(F.struct(expr.alias("v")), order)
    if kind == "max_before":
        return F.max(expr)
    if kind == "sum":
        return F.sum(expr)
    known = F.when(expr.isNotNull(), order)
    return F.max_by(expr, known) if kind in ("last", "last_before") else F.min_by(expr, known)


def _carry(kind: str, name: str, windows) -> Column:
    _, frame, ahead = _FRAMES[kind]
    framed = windows[1 if ahead else 0].rowsBetween(*frame)
    col = F.col(name)
    if kind == "max_before":
        return F.max(col).over(framed)
    if kind == "sum":
        return F.sum(col).over(framed)
    return F.last(col, ignorenulls=True).over(framed)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    splits: Splits | None = None,
) -> DataFrame:
    """Add running columns per key in the given order.

    ``specs`` maps a new column to ``(kind, expression)``; kinds are lag, lead, max_before, sum,
    last, last_before, next and next_after (the last four skip nulls).  ``order`` must be unique
    within a key; its first column is the one that cut points refer to.
    """
    keys, order = list(keys), list(order)
    if splits is None:
        windows = _windows(keys, order)
        return df.select("*", *[_local(k, e, windows).alias(n) for n, (k, e) in specs.items()])

    ranged = splits.assign(df, order[0])
    place = F.struct(*order)
    summary = ranged.groupBy(*keys, BUCKET).agg(
        *[_summary(k, e, place).alias(n) for n, (k, e) in specs.items()]
    )
    over = _windows(keys, [BUCKET])
    carried = summary.select(
        *keys, BUCKET, *[_carry(k, n, over).alias(f"__c_{n}") for n, (k, _) in specs.items()]
    )
    windows = _windows([*keys, BUCKET], order)
    local = ranged.select(
        "*",
        *[
            _local(k, F.struct(e.alias("v")) if k in ("lag", "lead") else e, windows).alias(f"__l_{n}")
            for n, (k, e) in specs.items()
        ],
    ).join(carried, [*keys, BUCKET])
    out = []
    for name, (kind, _) in specs.items():
        here, before = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind in ("lag", "lead"):
            value = F.coalesce(here, before)["v"]
        elif kind == "max_before":
            value = F.greatest(here, before)
        elif kind == "sum":
            value = F.coalesce(here + before, here, before)
        else:
            value = F.coalesce(here, before)
        out.append(value.alias(name))
    return local.select(*df.columns, *out)


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    start: Callable[[], object],
    step: Callable[[object, object], tuple],
    outputs: str,
    *,
    spread: bool = True,
) -> DataFrame:
    """Run a stateful rule over each key's rows in order; append the columns it returns.

    Rows are shuffled by key, sorted inside the partition and streamed batch by batch with only
    the current key's state held, so no group is ever collected.  ``step(state, row)`` mutates
    the state and returns the output tuple.  Give safe restart points as an extra key to spread
    one key over many tasks. Without ``spread`` rows that are already dealt out by a part of the keys
    are only sorted where they lie. Values are exact: integers of 64 bits, None for null, dictionaries for structs.
    """
    keys, order = list(keys), list(order)
    added = StructType.fromDDL(", ".join(p.strip() for p in outputs.split(";")))
    schema = StructType([*df.schema, *added])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of = namedtuple("Row", names, rename=True)
        at = [names.index(k) for k in keys]
        kinds = [to_arrow_type(f.dataType) for f in added]
        current, state = object(), None
        for batch in batches:
            produced = []
            columns_in = batch.columns[: len(names)]
            for values in zip(*[c.to_pylist() for c in columns_in]):
                key = tuple(values[i] for i in at)
                if key != current:
                    current, state = key, start()
                produced.append(step(state, row_of(*values)))
            columns = zip(*produced) if produced else [[] for _ in kinds]
            more = [pa.array(list(v), t) for v, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*columns_in, *more], [*names, *added.names])

    if spread:
        lined = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    else:  # a window asks for its keys together and sorted, and moves nothing where they are together
        lined = df.select("*", F.row_number().over(_windows(keys, order)[0]).alias("__line"))
    return lined.mapInArrow(run, schema)
