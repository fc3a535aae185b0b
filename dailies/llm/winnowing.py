"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.llm.common import join_keyed, keyed, sized, word_array
from dailies.session import materialize

GRAM = 5


def _fingerprints(rows: DataFrame, span: int, sentinel: bool) -> DataFrame:
    """Explode ``words`` into fingerprints (j, fp): the smallest gram hash of the windows of ``span`` words from j on.

    Every run of ``span`` words that two texts share gives the same hash. A hash that several neighbouring windows
    choose comes once for up to as many windows as hold one gram, so the window of a hit starts at j or shortly
    after. With ``sentinel`` each row also gives one row with j = -1.
    """
    gram = min(GRAM, span)
    width = span - gram + 1
    keep = [c for c in rows.columns if c != "words"]
    n = F.size("words")
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.withColumn("n", n).withColumn("hashes", hashes)
    grams = F.transform(
        F.when(F.col("n") >= span, F.sequence(F.lit(0), F.col("n") - gram)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(gram)]),
    )
    rows = rows.select(*keep, "n", grams.alias("grams"))
    first = -1 if sentinel else 0
    none = F.array(F.lit(-1)) if sentinel else F.array().cast("array<int>")
    starts = F.when(F.col("n") >= span, F.sequence(F.lit(first), F.col("n") - span)).otherwise(none)
    rows = rows.select(*keep, "n", "grams", F.explode(starts).alias("j"))

    def low(shift: int) -> Column:
        got = [F.get("grams", F.col("j") + k + shift) for k in range(width)]
        return F.least(*got) if width > 1 else got[0]

    here = rows.withColumn("fp", low(0))
    new = (F.col("j") <= 0) | (F.col("j") % width == 0) | (F.col("fp") != low(-1))
    return here.filter(new).select(*keep, "n", "j", "fp")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, keys: bool = False) -> DataFrame:
    """Words of ``docs`` (doc_id, text) inside any occurrence of a window of ``benchmark`` (item_id, text), one row per row.

    A window is ``span`` consecutive words of an item; an item with fewer words is one window. Returns doc_id,
    n_words, n_hit, n_items, items_sha256, contaminated, and spans, the merged hit ranges [start, end) of words; with
    ``keys`` also h, a hash of the text.

    Both sides keep the smallest gram hash of every window of words (for short items, of their own length); equal
    fingerprints are joined, each hit is extended to the windows around it, and these are compared word by word with
    the items' windows, so no hit rests on a hash. Fingerprints of the items are broadcast only if they have been
    counted to be few. Short items cost one more pass for each length that occurs (at most span - 1).

    Null or empty texts have no words. Repeated rows (equal doc_id and text) each give a row. Item ids are compared as
    strings, a null id as the empty string; rows of one item_id are one item. An empty benchmark hits nothing.
    """
    items = materialize(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array(F.col("text")).alias("words")).filter(F.size("words") > 0))
    size = F.least(F.size("words"), F.lit(span))
    lengths = sorted(r[0] for r in items.select(size.alias("s")).distinct().collect())  # at most ``span`` numbers
    rows = keyed(docs).select("doc_id", "h", word_array(F.col("text")).alias("words"))
    prints = None
    for s in {span, *lengths}:
        part = _fingerprints(items.filter(size == s).select("words"), s, False).select(F.lit(s).alias("s"), "fp").distinct()
        prints = part if prints is None else prints.unionByName(part)
    prints = materialize(prints)
    n_prints = prints.count()
    found = None
    for s in {span, *lengths}:
        mine = _fingerprints(rows, s, s == span).withColumn("fp", F.when(F.col("j") >= 0, F.col("fp")).otherwise(F.xxhash64("doc_id", "h")))
        hit = sized(prints.filter(F.col("s") == s).select(F.col("fp").alias("print")), n_prints)
        part = mine.join(hit, mine["fp"] == hit["print"], "left").filter((F.col("j") < 0) | F.col("print").isNotNull())
        part = part.select("doc_id", "h", "n", F.when(F.col("j") >= 0, F.struct(F.lit(s).alias("s"), "j")).alias("hit"))
        found = part if found is None else found.unionByName(part)
    base = materialize(
        found.groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).alias("copies"), F.collect_set("hit").alias("hits"))
    )

    suspects = base.filter(F.size("hits") > 0).select("doc_id", "h", "hits")
    texts = keyed(docs)
    texts = join_keyed(texts, suspects).dropDuplicates(["doc_id", "h"]).select("doc_id", "h", "hits", word_array(F.col("text")).alias("words"))
    # up to the windows that hold one gram with the first one; none begins after the last whole window
    reach = F.transform(
        "hits", lambda x: F.transform(F.sequence(x["j"], F.least(x["j"] + x["s"] - F.least(x["s"], F.lit(GRAM)), F.size("words") - x["s"])), lambda j: F.struct(x["s"].alias("s"), j.alias("start")))
    )
    tried = texts.select("doc_id", "h", "words", F.explode(F.array_distinct(F.flatten(reach))).alias("w"))
    tried = tried.select("doc_id", "h", "w.s", "w.start", F.array_join(F.expr("slice(words, w.start + 1, w.s)"), " ").alias("window"))
    length = F.least(F.size("words"), F.lit(span))
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("start")
    owned = items.select("item", "words", length.alias("len"), starts).select("item", F.array_join(F.expr("slice(words, start + 1, len)"), " ").alias("window")).distinct()
    owned = materialize(owned)
    known = owned.select("window").distinct().withColumn("id", F.monotonically_increasing_id())
    known = materialize(known)
    n_known = known.count()
    hits = materialize(tried.join(sized(known, n_known), "window").select("doc_id", "h", "start", (F.col("start") + F.col("s")).alias("end"), "id").distinct())

    doc = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    runs = hits.select("doc_id", "h", "start", "end").distinct().withColumn("upto", F.max("end").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("start") <= F.col("upto"), 0).otherwise(1)).over(doc))
    runs = runs.groupBy("doc_id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("doc_id", "h").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    item_of = known.join(owned, "window").select("id", "item")
    named = hits.select("doc_id", "h", "id").distinct().join(item_of, "id").select("doc_id", "h", "item").distinct()
    named = named.groupBy("doc_id", "h").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list("item")), ","), 256).alias("items_sha256"))

    out = join_keyed(join_keyed(base.select("doc_id", "h", "n", "copies"), spans, "left"), named, "left")
    return out.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).select(
        "doc_id", *(["h"] if keys else []), F.col("n").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )
