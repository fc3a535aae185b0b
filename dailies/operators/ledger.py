"""Cost ledger: roll-ups, estimates and budget admission (money in whole micro-dollars)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailies.functions.arith import round_div
from dailies.operators.ordered import Splits, ordered_fold, running
from dailies.session import materialize


def cost_summary(costs: DataFrame) -> DataFrame:
    """Spend by service and op with sub-totals per service and project."""
    return costs.rollup("project_id", "service", "op").agg(
        F.sum("usd_micro").alias("usd_micro"), F.count("*").alias("entries")
    ).where(F.col("project_id").isNotNull())


def remaining_budget(costs: DataFrame, budgets: DataFrame) -> DataFrame:
    spent = costs.groupBy("project_id").agg(F.sum("usd_micro").alias("spent_micro"))
    return budgets.join(spent, "project_id", "left").select(
        "project_id", "cap_micro", F.coalesce("spent_micro", F.lit(0)).alias("spent_micro"),
        F.greatest(F.col("cap_micro") - F.coalesce("spent_micro", F.lit(0)), F.lit(0)).alias("left_micro"),
    )


def estimate_cost(work: DataFrame, prices: DataFrame) -> DataFrame:
    """Price each piece of work; ``:free`` models cost nothing, ``:batch`` half, unknown ones 0.

    ``prices``: model, per (units one price covers), price_micro.  The join strategy is left to the
    optimizer, which knows the size of the price table.
    """
    model = F.regexp_replace("model", ":(free|batch)$", "")
    priced = work.withColumn("__m", model).join(prices.withColumnRenamed("model", "__m"), "__m", "left")
    full = round_div(F.col("units") * F.col("price_micro"), 1)
    cost = F.when(F.col("price_micro").isNull() | F.col("model").endswith(":free"), 0).when(
        F.col("model").endswith(":batch"), F.call_function("div", full, F.col("per") * 2)
    ).otherwise(F.call_function("div", full, F.col("per")))
    return priced.select(*work.columns, cost.cast("bigint").alias("usd_micro"))


#: Units that one price covers, by service and operation: hours, minutes, thousands of characters, millions of tokens, images, seconds.
UNITS = {("elevenlabs", "stt"): 3_600, ("elevenlabs", "music"): 60, ("elevenlabs", "tts"): 1_000, ("elevenlabs", "isolation"): 60, ("elevenlabs", "sfx"): 60, ("openrouter", "chat"): 1_000_000, ("fal", "image"): 1, ("fal", "video"): 1}


def estimate_work(work: DataFrame, prices: DataFrame) -> DataFrame:
    """Price work of every kind of unit; what has no price costs nothing.

    ``work``: service, op, model, units, units_out (completion tokens) and other columns; ``prices``: service, op, model (null
    for services priced by operation), price_micro, out_micro. Whole micro-dollars, rounded down.
    """
    kinds = [F.struct(F.lit(s).alias("service"), F.lit(o).alias("op"), F.lit(n).cast("bigint").alias("n")) for (s, o), n in UNITS.items()]
    per = F.get(F.filter(F.array(*kinds), lambda k: (k["service"] == F.col("service")) & (k["op"] == F.col("op"))), F.lit(0))["n"]
    by_op = F.col("service") == "elevenlabs"
    w = work.withColumns({"__per": per, "__m": F.when(by_op, F.lit("")).otherwise(F.coalesce("model", F.lit("")))})
    p = prices.select("service", "op", F.coalesce("model", F.lit("")).alias("__m"), "price_micro", "out_micro")
    w = w.join(p, ["service", "op", "__m"], "left")
    total = F.col("units") * F.coalesce("price_micro", F.lit(0)) + F.coalesce("units_out", F.lit(0)) * F.coalesce("out_micro", F.lit(0))
    return w.select(*work.columns, F.coalesce(F.call_function("div", total, F.col("__per")), F.lit(0)).cast("bigint").alias("usd_micro"))


def admit_charges(
    charges: DataFrame, keys: Sequence[str], order: Sequence[str], *, rounds: int = 2, splits: Splits | None = None
) -> DataFrame:
    """Accept a charge iff accepted spend so far plus the charge stays within ``cap_micro``.

    A refused charge does not count, so a running sum alone is wrong after the first refusal.  Each
    round settles what can be settled in parallel: charges whose running sum fits are accepted
    (sums only grow), and later ones above what is then left are refused (the rest only shrinks).
    The few undecided charges go through a streamed fold, which is exact. Keys with a credit (a negative charge) or
    with several caps are folded from the start, as sums prove nothing there.
    """
    keys, order = list(keys), list(order)
    start = charges.withColumn("__base", F.lit(0).cast("bigint"))
    odd = charges.groupBy(*keys).agg(F.min("usd_micro").alias("__low"), F.min("cap_micro").alias("__c0"), F.max("cap_micro").alias("__c1"))
    odd = materialize(odd.where((F.col("__low") < 0) | (F.col("__c0") != F.col("__c1"))).select(*keys))
    todo, whole = start.join(odd, keys, "left_anti"), start.join(odd, keys, "left_semi")
    settled = []
    for _ in range(rounds):
        summed = running(todo, keys, order, {"__run": ("sum", F.col("usd_micro"))}, splits)
        summed = summed.withColumn("__fits", F.col("__base") + F.col("__run") <= F.col("cap_micro"))
        spent = summed.where("__fits").groupBy(*keys).agg(F.max(F.col("__base") + F.col("__run")).alias("__spent"))
        settled.append(summed.where("__fits").select(*charges.columns, F.lit(True).alias("accepted")))
        rest = summed.where("not __fits").join(spent, keys, "left")
        rest = rest.withColumn("__base", F.coalesce("__spent", "__base"))
        over = F.col("__base") + F.col("usd_micro") > F.col("cap_micro")
        settled.append(rest.where(over).select(*charges.columns, F.lit(False).alias("accepted")))
        todo = materialize(rest.where(~over).select(*charges.columns, "__base"))

    def step(state, row):
        if state["spent"] is None:
            state["spent"] = row.base
        ok = state["spent"] + row.usd_micro <= row.cap_micro
        if ok:
            state["spent"] += row.usd_micro
        return (bool(ok),)

    todo = todo.unionByName(whole)
    folded = ordered_fold(todo.withColumnRenamed("__base", "base"), keys, order, lambda: {"spent": None}, step, "accepted boolean")
    out = folded.select(*charges.columns, "accepted")
    for part in settled:
        out = out.unionByName(part)
    return out


def latest_status(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last status per key, with the time it last started and finished; a restart clears the error."""
    latest = F.max_by(F.struct("status", "error", "ts"), F.struct(*order))
    return events.groupBy(*keys).agg(
        latest.alias("__l"),
        F.max_by("ts", F.when(F.col("status") == "running", F.struct(*order))).alias("started"),
        F.max_by("ts", F.when(F.col("status") == "done", F.struct(*order))).alias("finished"),
    ).select(*keys, F.col("__l.status").alias("status"), F.col("__l.error").alias("error"), "started", "finished")


def pending_work(items: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Items not recorded as done with the same content hash."""
    done = manifest.where(F.col("status") == "done").select(*keys, "content_hash")
    return items.join(done, [*keys, "content_hash"], "left_anti")
