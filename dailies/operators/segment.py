"""Cutting word streams into sentences, cues and keep-ranges.

Transcripts come as one row per clip with the words in an array, so rules that look at neighbouring
words are array expressions on that row: no shuffle, and no clip is ever larger than its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dailies.functions.text import closes_sentence, ends_sentence
from dailies.operators.ordered import Splits, running

CLIP = ("project_id", "clip_id")


def _pieces(first: Column, last: Column) -> Column:
    # by position: slicing inside a lambda would copy the clip's whole list of words for each piece
    texts = F.transform(F.sequence(first, last), lambda i: F.get("words", i)["text"])
    return F.struct(
        first.alias("first"), last.alias("last"), F.get("words", first)["s_us"].alias("s_us"),
        F.get("words", last)["e_us"].alias("e_us"), (last - first + 1).alias("n_words"),
        F.trim(F.array_join(texts, " ")).alias("text"),
    )


def _bounded(transcripts: DataFrame, keep: Sequence[str], pause_us: int, closing: bool) -> tuple[DataFrame, Column]:
    """Clips with their words, and the first and last word of each sentence."""
    ended = closes_sentence if closing else ends_sentence

    def fresh(i: Column) -> Column:
        w, p = F.get("words", i), F.get("words", i - 1)
        return (i == 0) | (w["s_us"] - p["e_us"] > pause_us) | ended(p["text"])

    # a clip without words gives no row; as a filter that would be pushed below the words and split the text twice
    starts = F.when(F.size("words") > 0, F.filter(F.sequence(F.lit(0), F.size("words") - 1), fresh)).otherwise(F.array().cast("array<int>"))
    doc = transcripts.select(*keep, "words", starts.alias("__st"))
    return doc, F.transform("__st", lambda st, k: F.struct(st.alias("a"), (F.coalesce(F.get("__st", k + 1), F.size("words")) - 1).alias("b")))


def split_sentences(
    transcripts: DataFrame,
    keep: Sequence[str] = CLIP,
    *,
    pause_us: int = 1_200_000,
    max_words: int | None = None,
    closing: bool = False,
) -> DataFrame:
    """Sentences of every clip: a pause over ``pause_us`` or a closing mark starts the next one.

    ``max_words`` also caps the length (counted from each sentence's own start); ``closing``
    accepts quotes and brackets after the mark.
    """
    doc, bounds = _bounded(transcripts, keep, pause_us, closing)
    if max_words is not None:
        bounds = F.flatten(F.transform(bounds, lambda x: F.transform(
            F.sequence(x["a"], x["b"], F.lit(max_words)),
            lambda s: F.struct(s.alias("a"), F.least(s + max_words - 1, x["b"]).alias("b")))))
    sents = F.transform(bounds, lambda x: _pieces(x["a"], x["b"]))
    out = doc.select(*keep, F.posexplode(sents).alias("k", "__s"))
    return out.select(*keep, (F.col("k") + 1).alias("n"), "__s.*")


def sentence_words(transcripts: DataFrame, keep: Sequence[str] = CLIP, *, pause_us: int = 1_200_000, closing: bool = False) -> DataFrame:
    """Words (keep..., n, pos, s_us, e_us, text) beside the number that :func:`split_sentences` gives their sentence, taken where they lie."""
    doc, bounds = _bounded(transcripts, keep, pause_us, closing)
    word = lambda i, n: F.struct(n.alias("n"), i.cast("bigint").alias("pos"), *[F.get("words", i)[c].alias(c) for c in ("s_us", "e_us", "text")])
    return doc.select(*keep, F.inline(F.flatten(F.transform(bounds, lambda x, k: F.transform(F.sequence(x["a"], x["b"]), lambda i: word(i, k + 1))))))


def sentence_ids(sentences: DataFrame) -> DataFrame:
    return sentences.withColumn("sentence_id", F.concat_ws("#", F.col("clip_id").cast("string"), F.col("n").cast("string")))


def _walk_cues(
    words: DataFrame, keys: list[str], order: Sequence[str], ends: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], np.ndarray], fresh_after: int | None,
) -> DataFrame:
    """Cut each key's words (keys..., order..., s_us, e_us, text, closing) into cues: keys..., cue, s_us, e_us, n_words, text, next_us.

    Words are dealt out by key once and sorted; a task reads them batch by batch and gives whole cues back. No cue reaches
    over a pause longer than ``fresh_after``. ``ends`` tells for each word where the next cue would start if one
    starts there, from the few words a cue may hold, so only the cues are walked one by one. Two cues are carried from one batch to the
    next; ``cue`` counts from 1, ``next_us`` is the start of the key's next one.
    """
    rows = words.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], "s_us", "e_us", "text", F.coalesce("closing", F.lit(False)).alias("closing"))
    names, places = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(order))]
    spread = rows.repartition(*names).sortWithinPartitions(*names, *places, "e_us", "text").drop(*places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counted = None, 0
        for batch in _then_none(batches):
            parts = [b for b in (held, batch) if b is not None and b.num_rows]
            if not parts:
                continue
            rows = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
            n = rows.num_rows
            s, e = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("s_us", "e_us"))
            closing = rows.column("closing").to_numpy(zero_copy_only=False)
            opens = np.zeros(n, bool)
            opens[0] = held is None
            for name in names:
                was, now = rows.column(name).slice(0, n - 1), rows.column(name).slice(1)
                same = pc.or_(pc.fill_null(pc.equal(was, now), False), pc.and_(pc.is_null(was), pc.is_null(now)))
                opens[1:] |= ~same.to_numpy(zero_copy_only=False)
            fresh = opens.copy()
            if fresh_after is not None:
                fresh[1:] |= s[1:] - e[:-1] > fresh_after
            follow, starts, at = ends(s, e, closing, fresh, n).tolist(), [], 0
            while at < n:
                starts.append(at)
                at = follow[at]
            starts = np.array(starts)
            number = np.where(opens[starts], np.arange(len(starts)), np.iinfo(np.int64).min)
            if held is not None:
                number[0] = 1 - counted
            number = np.arange(len(starts)) - np.maximum.accumulate(number) + 1
            low, high = np.minimum.reduceat(s, starts), e[np.append(starts[1:], n) - 1]
            done = len(starts) if batch is None else max(0, len(starts) - 2)
            if done:
                later = np.append(low[1:], 0)
                last = np.append(opens[starts[1:]], True)
                cuts = np.append(starts, n)
                text = rows.column("text")
                valid = np.append(0, np.cumsum(text.is_valid().to_numpy(zero_copy_only=False)))
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(valid[cuts[: done + 1]], pa.int32()), text.drop_null()), " ")
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c).take(pa.array(starts[:done])) for c in names], pa.array(number[:done], pa.int64()), pa.array(low[:done], pa.int64()), pa.array(high[:done], pa.int64()),
                     pa.array(np.diff(cuts)[:done], pa.int64()), texts, pa.array(later[:done], pa.int64(), mask=last[:done])],
                    [*names, "cue", "s_us", "e_us", "n_words", "text", "next_us"],
                )
            if done < len(starts):
                held, counted = rows.slice(int(starts[done])), int(number[done])

    schema = StructType([*[spread.schema[c] for c in names], *StructType.fromDDL("cue bigint, s_us bigint, e_us bigint, n_words bigint, text string, next_us bigint")])
    return spread.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, keys)))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def simple_cues(
    words: DataFrame, keys: Sequence[str] = CLIP, *, min_words: int = 3, max_words: int = 5,
    min_us: int = 1_000_000, max_us: int = 4_000_000, splits: Splits | None = None,
) -> DataFrame:
    """Cues of 3-5 words and 1-4 s; short ones are stretched without covering the next. The walk needs no ``splits``."""
    keys = list(keys)
    usable = words.where(F.trim("text") != "").select(*keys, "pos", "s_us", "e_us", "text", closes_sentence(F.col("text")).alias("closing"))

    def ends(s, e, closing, fresh, n):
        follow, open_ = np.full(n, n), np.ones(n, bool)
        for k in range(max_words):
            i, j = np.arange(max(0, n - k)), np.arange(k, max(n, k))
            if k:
                cut = open_[: len(i)] & fresh[j]
                follow[i[cut]], open_[i[cut]] = j[cut], False
            full = open_[: len(i)] & ((k + 1 >= max_words) | (e[j] - s[i] >= max_us) | (closing[j] & (k + 1 >= min_words)))
            follow[i[full]], open_[i[full]] = j[full] + 1, False
        return follow

    cues = _walk_cues(usable, keys, ["pos"], ends, None)
    limit = F.coalesce("next_us", F.col("e_us") + min_us)
    longer = F.least(F.greatest(F.col("e_us"), F.col("s_us") + min_us), F.greatest(limit, F.col("e_us")))
    end = F.when(F.col("e_us") - F.col("s_us") < min_us, longer).otherwise(F.col("e_us"))
    return cues.select(*keys, "cue", "s_us", F.greatest(end, F.col("s_us") + 50_000).alias("e_us"), "n_words", "text")


def gap_cues(
    words: DataFrame, keys: Sequence[str] = CLIP, *, min_words: int = 3, max_words: int = 5, min_us: int = 1_000_000,
    max_us: int = 4_000_000, gap_us: int = 800_000, splits: Splits | None = None, order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Cues that never span a pause. With ``splits`` the pauses spread the words of a hot key.

    ``order`` sorts a key's words; where it begins with the start, each cue's next one is known from the walk.
    """
    keys, scope = list(keys), list(keys)
    usable = words.select(*keys, *dict.fromkeys([*order, "s_us", "e_us", "text"]), F.col("text").rlike("[.!?]$").alias("closing"))
    if splits is not None:
        lined = running(usable, keys, order, {"__pe": ("lag", F.col("e_us"))}, splits)
        lined = lined.withColumn("__new", (F.col("__pe").isNull() | (F.col("s_us") - F.col("__pe") > gap_us)).cast("bigint"))
        usable, scope = running(lined, keys, order, {"island": ("sum", F.col("__new"))}, splits), [*keys, "island"]

    def ends(s, e, closing, fresh, n):
        follow, open_ = np.full(n, n), np.ones(n, bool)
        for k in range(1, max_words + 1):
            i, j = np.arange(max(0, n - k)), np.arange(k, max(n, k))
            cut = open_[: len(i)] & (fresh[j] | (e[j] - s[i] > max_us) | (k >= max_words))
            follow[i[cut]], open_[i[cut]] = j[cut], False
            if k >= min_words:
                shut = open_[: len(i)] & closing[j]
                follow[i[shut]], open_[i[shut]] = j[shut] + 1, False
        return follow

    cues = _walk_cues(usable, scope, order, ends, gap_us)
    if splits is not None or order[0] != "s_us":
        cues = cues.drop("next_us").withColumn("first_us", F.col("s_us"))
        cues = running(cues, keys, ["first_us"], {"next_us": ("lead", F.col("s_us"))}, splits)
    limit = F.coalesce("next_us", F.col("e_us") + min_us)
    end = F.when(
        F.col("e_us") - F.col("s_us") < min_us, F.least(F.col("s_us") + min_us, F.greatest("e_us", limit))
    ).otherwise(F.col("e_us"))
    return cues.select(*keys, "s_us", F.least(end, F.col("s_us") + max_us).alias("e_us"), "n_words", "text")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], fresh: Column, lags: dict[str, Column], splits: Splits | None = None) -> DataFrame:
    """Number runs of rows; ``fresh`` marks a run's first row and may use the lagged columns."""
    lined = running(df, keys, order, {n: ("lag", e) for n, e in lags.items()}, splits)
    lined = lined.withColumn("__new", F.coalesce(fresh, F.lit(True)).cast("bigint"))
    return running(lined, keys, order, {"run": ("sum", F.col("__new"))}, splits).drop("__new")


def keep_ranges(
    words: DataFrame, keys: Sequence[str] = CLIP, *, max_pause_us: int = 800_000, pause_keep_us: int = 500_000,
    pad_before_us: int = 300_000, pad_after_us: int = 450_000, splits: Splits | None = None,
) -> DataFrame:
    """Ranges of kept words: long pauses are shortened, a dropped word closes a range unpadded."""
    keys = list(keys)
    specs = {
        "__pk": ("lag", F.col("keep")), "__pe": ("lag", F.col("e_us")),
        "__nk": ("lead", F.col("keep")), "__ns": ("lead", F.col("s_us")),
    }
    mask = words.select(*keys, "pos", "s_us", "e_us", "keep")
    lined = running(mask, keys, ["pos"], specs, splits).where("keep")
    fresh = ~F.coalesce("__pk", F.lit(False)) | (F.col("s_us") - F.col("__pe") > max_pause_us)
    paused = F.coalesce(F.col("__nk") & (F.col("__ns") - F.col("e_us") > max_pause_us), F.lit(False))
    lined = lined.withColumn("__new", fresh.cast("bigint")).withColumn("__paused", paused)
    runs = running(lined, keys, ["pos"], {"n": ("sum", F.col("__new"))}, splits).groupBy(*keys, "n").agg(
        F.min("s_us").alias("s_us"), (F.max("e_us") + F.when(F.bool_or("__paused"), pause_keep_us).otherwise(0)).alias("e_us")
    )
    if splits is None:  # a key's ranges lie in one task already, so they need no join; one without a null in it has an end
        known = reduce(and_, [F.col(k).isNotNull() for k in keys])
        ended = runs.where(known).withColumn("__last", F.max("n").over(Window.partitionBy(*keys)))
    else:
        ended = runs.join(runs.groupBy(*keys).agg(F.max("n").alias("__last")), keys)
    return ended.select(
        *keys, "n", F.when(F.col("n") == 1, F.greatest(F.col("s_us") - pad_before_us, F.lit(0))).otherwise(F.col("s_us")).alias("s_us"),
        F.when(F.col("n") == F.col("__last"), F.col("e_us") + pad_after_us).otherwise(F.col("e_us")).alias("e_us"),
    )
