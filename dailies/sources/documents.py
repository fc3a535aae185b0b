"""Typed rows from the JSON documents a project folder holds (one document per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = (
    "clips map<string, struct<`order`:int, duration:double, has_audio:boolean, recorded_at:string>>, "
    "stages map<string, struct<status:string, ts:bigint>>, "
    "costs array<struct<ts:bigint, service:string, op:string, usd:decimal(18,6)>>, budget_usd double"
)
WORD = "struct<t:string, text:string, s:string, `start`:string, e:string, `end`:string, type:string, speaker:string>"
TRANSCRIPT = f"language_code string, duration double, words array<{WORD}>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (path, doc) rows, for the parsers below."""
    return spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("doc"))


def quarantine(docs: DataFrame, schema: str, doc: str = "doc") -> tuple[DataFrame, DataFrame]:
    """Split documents into parsed ones (column ``p``) and unreadable ones."""
    parsed = docs.withColumn("p", F.from_json(doc, schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("p").isNull() | F.col("p._corrupt_record").isNotNull()
    return parsed.where(~bad), parsed.where(bad).drop("p")


def clip_rows(state: DataFrame, key: str = "project_id") -> DataFrame:
    """Clip registry in screen order: by ``order`` (missing ones last), then id."""
    entries = F.map_entries(F.coalesce(F.from_json("doc", STATE)["clips"], F.create_map().cast("map<string,struct<`order`:int,duration:double,has_audio:boolean,recorded_at:string>>")))
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct(
        F.coalesce(e["value"]["order"], F.lit(1_000_000)).alias("order"), e["key"].alias("clip"), e["value"]["duration"].alias("d"))))
    return state.select(key, F.posexplode(ordered).alias("pos", "c")).select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("c.clip").alias("clip"), F.col("c.order").alias("clip_order"),
        F.round(F.col("c.d") * 1_000_000).cast("bigint").alias("duration_us"),
    )


def stage_rows(state: DataFrame, stages: Sequence[str], key: str = "project_id") -> DataFrame:
    """One row per known stage; a stage the document does not name is pending."""
    found = F.from_json("doc", STATE)["stages"]
    return state.select(key, found.alias("m"), F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage")).select(
        key, "stage", F.coalesce(F.try_element_at("m", F.col("stage"))["status"], F.lit("pending")).alias("status")
    )


def ledger_rows(state: DataFrame, key: str = "project_id") -> DataFrame:
    return state.select(key, F.posexplode(F.from_json("doc", STATE)["costs"]).alias("pos", "c")).select(
        key, F.col("pos").cast("bigint").alias("pos"), "c.ts", "c.service", "c.op", (F.col("c.usd") * 1_000_000).cast("bigint").alias("usd_micro")
    )


def _us(text: Column) -> Column:
    return F.round(text.try_cast("double") * 1_000_000).cast("bigint")


def _spoken(doc: str, min_kept: bool) -> Column:
    words = F.coalesce(F.from_json(doc, TRANSCRIPT)["words"], F.array().cast(f"array<{WORD}>"))
    plain = F.filter(words, lambda w: w["type"].isNull() | (w["type"] == "word"))
    timed = F.transform(plain, lambda w: F.struct(
        _us(F.coalesce(w["s"], w["start"])).alias("s_us"), _us(F.coalesce(w["e"], w["end"])).alias("e_us"),
        F.trim(F.coalesce(w["t"], w["text"], F.lit(""))).alias("text")))
    if min_kept:
        timed = F.filter(timed, lambda w: (w["text"] != "") & (w["e_us"] - w["s_us"] <= 3_000_000))
    return F.filter(timed, lambda w: w["s_us"].isNotNull() & w["e_us"].isNotNull() & (w["e_us"] > w["s_us"]))


def _explode_words(docs: DataFrame, words: Column, keys: Sequence[str]) -> DataFrame:
    # stable on document order, like the list the words come from
    ordered = F.sort_array(F.transform(words, lambda w, i: F.struct(w["s_us"].alias("s_us"), w["e_us"].alias("e_us"), i.alias("i"), w["text"].alias("text"))))
    return docs.select(*keys, F.posexplode(ordered).alias("pos", "w")).select(
        *keys, F.col("pos").cast("bigint").alias("pos"), "w.s_us", "w.e_us", "w.text"
    )


def word_rows(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spoken words in time order; other item types and unusable times are dropped."""
    return _explode_words(docs, _spoken("doc", False), keys)


def render_word_rows(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As :func:`word_rows`, without empty words and words longer than three seconds."""
    return _explode_words(docs, _spoken("doc", True), keys)


def transcript_headers(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Header row per provider answer: counts, speakers in first-seen order, duration, stub flag."""
    p = docs.select(*keys, F.from_json("doc", TRANSCRIPT).alias("p"))
    words = F.coalesce(F.col("p.words"), F.array().cast(f"array<{WORD}>"))
    real = F.filter(words, lambda w: F.coalesce(w["type"], F.lit("word")) == "word")
    events = F.filter(words, lambda w: w["type"] == "audio_event")
    speakers = F.array_distinct(F.filter(F.transform(real, lambda w: w["speaker"]), lambda s: s.isNotNull()))
    end = F.array_max(F.transform(real, lambda w: _us(F.coalesce(w["e"], w["end"]))))
    bare = F.transform(events, lambda w: F.trim(F.regexp_replace(F.coalesce(w["t"], w["text"]), "[()\\[\\]]", "")))
    return p.select(
        *keys, F.lower("p.language_code").alias("language"), F.size(real).alias("n_words"), F.array_join(bare, ",").alias("events"),
        F.array_join(speakers, ",").alias("speakers"), F.coalesce(F.round(F.col("p.duration") * 1_000_000).cast("bigint"), end, F.lit(0).cast("bigint")).alias("duration_us"),
        (F.size(real) == 0).alias("stub"),
    )


def normalize_refs(refs: DataFrame, beats: DataFrame) -> DataFrame:
    """References to beats by uid or display id, resolved to the uid; dangling ones stay as they are."""
    by_uid = beats.select("project_id", F.col("uid").alias("ref"), F.col("uid").alias("u1"))
    by_id = beats.groupBy("project_id", F.col("id").alias("ref")).agg(F.min_by("uid", "pos").alias("u2"))
    hit = refs.join(by_uid, ["project_id", "ref"], "left").join(by_id, ["project_id", "ref"], "left")
    return hit.select(*refs.columns, F.coalesce("u1", "u2", "ref").alias("beat_uid"), (F.col("u1").isNull() & F.col("u2").isNull()).alias("dangling"))


def display_ids(rows: DataFrame, prefix: str, *, splits=None) -> DataFrame:
    """``b001``.. in order inside each project; the stable uid is not touched."""
    from dailies.operators.ordered import running

    numbered = running(rows, ["project_id"], ["pos"], {"__n": ("sum", F.lit(1).cast("bigint"))}, splits)
    return numbered.withColumn("id", F.format_string(f"{prefix}%03d", F.col("__n"))).drop("__n")


def assign_clip_numbers(files: DataFrame, registry: DataFrame, *, splits=None) -> DataFrame:
    """Recording order and clip number of every file.

    Known files keep their number; new ones take the lowest numbers not in use, in recording order.
    The k-th free number is found per new file by an as-of lookup over the gaps between used numbers.
    """
    from dailies.operators.joins import asof_join
    from dailies.operators.ordered import running

    p = ["project_id"]
    known = files.join(registry.select("project_id", "source_file", "number"), ["project_id", "source_file"], "left")
    ranked = running(known, p, ["recorded", "source_file"], {"position": ("sum", F.lit(1).cast("bigint"))}, splits)
    fresh = F.when(F.col("number").isNull(), 1).otherwise(0).cast("bigint")
    ranked = running(ranked, p, ["recorded", "source_file"], {"k": ("sum", fresh)}, splits)
    # used number u with r used numbers up to it leaves u - r free numbers below it
    used = registry.select("project_id", "number").distinct()
    used = running(used, p, ["number"], {"r": ("sum", F.lit(1).cast("bigint"))}, splits)
    gaps = used.select("project_id", (F.col("number") - F.col("r")).alias("free_below"), "r")
    new = asof_join(
        ranked.where(F.col("number").isNull()).select("project_id", "source_file", "position", "k"),
        gaps, p, "k", "free_below", ["r"], inclusive=False, tie=["r"], splits=None,
    ).select("project_id", "source_file", "position", (F.col("k") + F.coalesce("r", F.lit(0))).alias("number"), F.lit(True).alias("is_new"))
    old = ranked.where(F.col("number").isNotNull()).select("project_id", "source_file", "position", "number", F.lit(False).alias("is_new"))
    return old.unionByName(new)


def answer_rows(answers: DataFrame) -> DataFrame:
    """Planner answers with alternate spellings brought to one shape; unreadable ones flagged."""
    v = F.try_parse_json("doc")
    pick = lambda names, kind: F.coalesce(*[F.try_variant_get("v", f"$.{n}", kind) for n in names])
    rows = answers.select("answer_id", v.alias("v"))
    hint = F.coalesce(F.try_variant_get("v", "$.frame", "string"), F.try_variant_get("v", "$.frame_hint", "string"))
    return rows.select(
        "answer_id", F.col("v").isNull().alias("corrupt"), pick(["clip", "clip_id", "source"], "string").alias("clip"),
        F.round(pick(["in", "start", "s"], "double") * 1_000_000).cast("bigint").alias("in_us"),
        F.round(pick(["out", "end", "e"], "double") * 1_000_000).cast("bigint").alias("out_us"),
        F.nullif(F.regexp_extract(hint, "^\\s*(\\w+)@([0-9.]+)$", 1), F.lit("")).alias("hint_clip"),
        F.round(F.regexp_extract(hint, "^\\s*(\\w+)@([0-9.]+)$", 2).try_cast("double") * 1_000_000).cast("bigint").alias("hint_us"),
    )


def recover_json(answers: DataFrame) -> DataFrame:
    """JSON inside prose: a fenced block if it parses, else the first balanced block that does."""
    import json

    def balanced(text: str) -> str | None:
        decoder = json.JSONDecoder()
        for at, ch in enumerate(text):
            if ch in "{[":
                try:
                    return text[at:decoder.raw_decode(text, at)[1]]
                except ValueError:
                    continue
        return None

    def scan(batches):
        for pdf in batches:
            pdf["found"] = [balanced(t) if t is not None else None for t in pdf["doc"]]
            yield pdf[["answer_id", "found"]]

    fence = F.regexp_extract("doc", "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    fenced = answers.withColumn("fence", fence)
    ok = (F.col("fence") != "") & F.try_parse_json("fence").isNotNull()
    easy = fenced.where(ok).select("answer_id", F.col("fence").alias("found"), F.lit("fence").alias("how"))
    hard = fenced.where(~F.coalesce(ok, F.lit(False))).select("answer_id", "doc").mapInPandas(scan, "answer_id bigint, found string")
    return easy.unionByName(hard.withColumn("how", F.when(F.col("found").isNull(), "failed").otherwise("scan")))
