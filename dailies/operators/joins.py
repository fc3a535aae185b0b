"""Interval and as-of joins as equi-joins and running windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.functions.arith import floor_div
from dailies.operators.ordered import Splits, running
from dailies.session import materialize


#: What a row is posted as: both intervals short (fine bins); the left one long; only the right one long (coarse bins).
BOTH_SHORT, LEFT_LONG, RIGHT_LONG = 0, 1, 2
COARSE_US = 3_600_000_000


def _posted(df: DataFrame, s: str, e: str, fine: int, coarse: int, short_as: list[int], long_as: list[int], limit: int) -> DataFrame:
    """One row per (role, bin) an interval touches; a role says which lengths meet there, so no pair meets in two roles."""

    def bins(role: int) -> Column:
        width = fine if role == BOTH_SHORT else coarse
        first, last = floor_div(F.col(s), width), floor_div(F.greatest(F.col(e) - 1, F.col(s)), width)
        return F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(role).alias("role"), b.alias("bin"), first.alias("first")))

    long_ = F.col(e) - F.col(s) > limit
    return df.withColumn("__b", F.explode(F.when(long_, F.concat(*map(bins, long_as))).otherwise(F.concat(*map(bins, short_as)))))


def longest(df: DataFrame, s: str, e: str) -> int:
    """Length of the longest interval (0 without any), for ``left_us`` or ``right_us`` of a side that is cheap to scan."""
    return df.agg(F.max(F.col(e) - F.col(s))).first()[0] or 0


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    *,
    bin_us: int = 60_000_000,
    coarse_us: int = COARSE_US,
    min_overlap: int = 0,
    left_us: int | None = None,
    right_us: int | None = None,
) -> DataFrame:
    """All pairs with equal keys and ``left.s < right.e and left.e > right.s`` (each pair once).

    Both sides are cut into time bins and equi-joined on keys + role + bin, so a hot key spreads over its bins and a
    hot bin is left to skew-join splitting. Two short intervals (up to 16 fine bins) meet only in fine bins; coarse
    bins hold pairs with a long interval. A pair is kept in the first bin both sides share, so nothing has to be
    de-duplicated. Right key columns are dropped; other column names must differ. ``left_us`` and ``right_us`` are
    lengths that no interval of that side exceeds, where the caller knows one: short ones need no posting for long ones.
    """
    keys = list(keys)
    limit = 16 * bin_us
    any_long = [] if left_us is not None and left_us <= limit else [LEFT_LONG]
    other_long = [] if right_us is not None and right_us <= limit else [RIGHT_LONG]
    ls, le = left_span
    rs, re_ = right_span
    a = _posted(left, ls, le, bin_us, coarse_us, [BOTH_SHORT, *other_long], [LEFT_LONG], limit).select(
        *[F.col(k).alias(f"__lk{i}") for i, k in enumerate(keys)], *left.columns, *[F.col(f"__b.{c}").alias(f"__l{c}") for c in ("role", "bin", "first")]
    )
    b = _posted(right, rs, re_, bin_us, coarse_us, [BOTH_SHORT, *any_long], [*any_long, RIGHT_LONG], limit).select(
        *[F.col(k).alias(f"__rk{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys], *[F.col(f"__b.{c}").alias(f"__r{c}") for c in ("role", "bin", "first")]
    )
    cond = (F.col("__lbin") == F.greatest("__lfirst", "__rfirst")) & (F.least(F.col(le), F.col(re_)) - F.greatest(F.col(ls), F.col(rs)) > min_overlap)
    for i in range(len(keys)):
        cond = cond & (F.col(f"__lk{i}") == F.col(f"__rk{i}"))
    cond = cond & (F.col("__lrole") == F.col("__rrole")) & (F.col("__lbin") == F.col("__rbin"))
    return a.join(b, cond, "inner").select(*left.columns, *[c for c in right.columns if c not in keys])


def within_reach(rows: DataFrame, spans: DataFrame, key: str, span: tuple[str, str], *, bin_us: int = 10_000_000) -> tuple[DataFrame, int]:
    """Rows with a time bin in common with a span (key, s, e) of their key, and the longest of them; none that overlaps a span is lost.

    To be asked before an interval join of many rows with spans that lie in a small part of them. Only the bins of each
    key move: rows that are dealt out by ``key`` stay where they are. Those found are written, so that their length is
    known and spans need no posting for long ones. Rows and spans without a length overlap nothing.
    """
    # interval_join lets a span without an end reach on in its own bins, the longest of which is an hour, and rows likewise
    end = F.coalesce("e", (floor_div(F.col("s"), COARSE_US) + 1) * COARSE_US)
    first, last = floor_div(F.col("s"), bin_us), floor_div(end - 1, bin_us)
    used = spans.where("s IS NOT NULL").where(end > F.col("s")).select(F.col(key).alias("__key"), F.explode(F.sequence(first, last)).alias("__bin")).groupBy("__key").agg(F.collect_set("__bin").alias("__bins"))
    low, high = span
    own = F.sequence(floor_div(F.col(low), bin_us), floor_div(F.greatest(F.col(high) - 1, F.col(low)), bin_us))
    met = F.arrays_overlap("__bins", own) | F.col(high).isNull()
    found = materialize(rows.join(used.hint("shuffle_hash"), (F.col(key) == F.col("__key")) & met, "left_semi"))
    return found, longest(found, low, high)


def overlapped(df: DataFrame, spans: DataFrame, keys: Sequence[str], span: tuple[str, str], name: str, *, splits: Splits | None = None) -> DataFrame:
    """``df`` with ``name``, whether one of the spans (keys..., s, e) of its key overlaps its own span; never null.

    Spans and rows go on one time line for each key, so that rows are never joined: they stay in their task where both
    sides are dealt out alike, and move once otherwise. Null keys and spans without a length overlap nothing.
    """
    keys, (low, high) = list(keys), span
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    long_ = spans.where("e > s").where(known).select(*keys, F.col("s").alias("__t"), F.lit(1).alias("__side"), F.col("e").alias("__to"))
    line = df.withColumns({"__t": F.col(high), "__side": F.lit(0)}).unionByName(long_, allowMissingColumns=True)
    # the furthest end of the spans that start before the row ends
    line = running(line, keys, ["__t", "__side"], {"__reach": ("max_before", F.col("__to"))}, splits).where(F.col("__side") == 0)
    return line.select(*df.columns, F.coalesce((F.col(high) > F.col(low)) & (F.col("__reach") > F.col(low)), F.lit(False)).alias(name))


def asof_join(
    probes: DataFrame,
    timeline: DataFrame,
    keys: Sequence[str],
    probe_t: str,
    timeline_t: str,
    payload: Sequence[str],
    *,
    direction: str = "backward",
    inclusive: bool = True,
    tie: Sequence[str] = (),
    splits: Splits | None = None,
) -> DataFrame:
    """Nearest earlier (``backward``) or later (``forward``) timeline row per probe.

    Timeline rows of one instant are first reduced to one (the last by ``tie`` when looking
    back, the first when looking ahead), then both sides are put on one time line and the
    payload is carried to the probes.  Payload columns are null where nothing qualifies.
    """
    keys, payload = list(keys), list(payload)
    pick = F.max_by if direction == "backward" else F.min_by
    packed = F.struct(*payload)
    line = timeline.groupBy(*keys, F.col(timeline_t).alias("__t")).agg(
        pick(packed, F.struct(*(tie or payload))).alias("__p")
    )
    first = direction == "backward"
    side = 0 if first == inclusive else 2
    fields = [c for c in probes.columns if c not in keys]
    both = line.select(*keys, "__t", F.lit(side).alias("__side"), "__p").unionByName(
        probes.select(*keys, F.col(probe_t).alias("__t"), F.lit(1).alias("__side"), F.struct(*fields).alias("__row")),
        allowMissingColumns=True,
    )
    kind = "last" if first else "next"
    found = running(both, keys, ["__t", "__side"], {"__hit": (kind, F.col("__p"))}, splits)
    return found.where(F.col("__side") == 1).select(
        *keys, *[F.col("__row")[c].alias(c) for c in fields], *[F.col("__hit")[c].alias(c) for c in payload]
    )


def nearest_times(
    probes: DataFrame, keys: Sequence[str], t: str, lines: dict[str, DataFrame], *, direction: str = "backward", splits: Splits | None = None
) -> DataFrame:
    """Latest instant at or before ``t`` (or earliest at or after it) of several time lines at once.

    ``lines`` maps a new column to (keys..., ``at``).  All lines share one shuffle and one sort with
    the probes; equal instants are reduced to one beforehand.
    """
    keys = list(keys)
    back = direction == "backward"
    fields = [c for c in probes.columns if c not in keys]
    both = probes.select(
        *keys, F.col(t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__line"), F.struct(*fields).alias("__row")
    )
    for name, line in lines.items():
        points = line.select(*keys, F.col("at").alias("__t")).distinct()
        both = both.unionByName(points.withColumns({"__side": F.lit(0 if back else 2), "__line": F.lit(name)}), allowMissingColumns=True)
    kind = "last" if back else "next"
    specs = {f"__n_{name}": (kind, F.when(F.col("__line") == name, F.col("__t"))) for name in lines}
    found = running(both, keys, ["__t", "__side"], specs, splits).where(F.col("__side") == 1)
    return found.select(*keys, *[F.col("__row")[c].alias(c) for c in fields], *[F.col(f"__n_{n}").alias(n) for n in lines])
