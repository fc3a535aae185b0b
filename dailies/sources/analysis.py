"""Analysis documents as typed rows: lenient scan and clamping of times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of clips and other spellings of them.
KINDS = ("a-roll", "b-roll", "silent-broll", "audio-only", "instruction")
KIND_ALIASES = {"aroll": "a-roll", "broll": "b-roll", "silent": "silent-broll", "silent-b-roll": "silent-broll", "audio": "audio-only"}
SCHEMA = (
    "clip STRING, summary STRING, location STRUCT<name: STRING, city: STRING, country: STRING, confidence: DOUBLE>, kind STRING,"
    " instructions ARRAY<STRUCT<s: DOUBLE, e: DOUBLE, text: STRING, action: STRING>>,"
    " takes ARRAY<STRUCT<topic: STRING, attempts: ARRAY<STRUCT<s: DOUBLE, e: DOUBLE, text: STRING>>, keep: INT, reason: STRING>>,"
    " segments ARRAY<STRUCT<s: DOUBLE, e: DOUBLE, role: STRING, keep: BOOLEAN, text: STRING, quality: DOUBLE>>,"
    " background_music ARRAY<STRUCT<s: DOUBLE, e: DOUBLE, confidence: DOUBLE, suggest: STRING>>,"
    " visual STRUCT<quality: DOUBLE, issues: ARRAY<STRING>, best_frames: ARRAY<DOUBLE>, thumbnail_candidate: BOOLEAN>,"
    " hooks ARRAY<STRING>, numbers ARRAY<STRING>, topics ARRAY<STRING>"
)
LISTS = ("instructions", "takes", "segments", "background_music", "hooks", "numbers", "topics")


def known_kind(kind: Column) -> Column:
    """A clip kind in its own spelling; anything unknown is b-roll."""
    text = F.replace(F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lit("_"), F.lit("-"))
    for other, name in KIND_ALIASES.items():
        text = F.when(text == other, name).otherwise(text)
    return F.when(text.isin(*KINDS), text).otherwise("b-roll")


def _or(value: Column, default: object) -> Column:
    return F.coalesce(value, F.lit(default))


def analysis_documents(docs: DataFrame, *, body: str = "body") -> DataFrame:
    """Typed analyses of JSON documents, one row each: the other columns, the document's fields and ``broken``.

    Missing and null fields take their defaults, null lists are empty, unknown keys are left out. A document that is
    no JSON object is ``broken`` and has defaults only.
    """
    d = F.from_json(body, SCHEMA)
    rows = docs.select(*[c for c in docs.columns if c != body], F.get_json_object(body, "$").isNull().alias("broken"), d.alias("d"))
    lists = {n: F.coalesce(F.col(f"d.{n}"), F.array().cast(rows.select(f"d.{n}").schema[0].dataType)) for n in LISTS}
    lists["instructions"] = F.transform(lists["instructions"], lambda x: F.struct(_or(x["s"], 0.0).alias("s"), _or(x["e"], 0.0).alias("e"), _or(x["text"], "").alias("text"), _or(x["action"], "other").alias("action")))
    lists["takes"] = F.transform(
        lists["takes"],
        lambda x: F.struct(_or(x["topic"], "").alias("topic"), F.coalesce(x["attempts"], F.array().cast("array<struct<s:double,e:double,text:string>>")).alias("attempts"), _or(x["keep"], 0).alias("keep"), _or(x["reason"], "").alias("reason")),
    )
    lists["segments"] = F.transform(
        lists["segments"],
        lambda x: F.struct(_or(x["s"], 0.0).alias("s"), _or(x["e"], 0.0).alias("e"), _or(x["role"], "narration").alias("role"), _or(x["keep"], True).alias("keep"), _or(x["text"], "").alias("text"), _or(x["quality"], 0.0).alias("quality")),
    )
    lists["background_music"] = F.transform(lists["background_music"], lambda x: F.struct(_or(x["s"], 0.0).alias("s"), _or(x["e"], 0.0).alias("e"), _or(x["confidence"], 0.0).alias("confidence"), _or(x["suggest"], "mute").alias("suggest")))
    visual = F.struct(
        _or(F.col("d.visual.quality"), 0.0).alias("quality"), F.coalesce("d.visual.issues", F.array().cast("array<string>")).alias("issues"),
        F.coalesce("d.visual.best_frames", F.array().cast("array<double>")).alias("best_frames"), _or(F.col("d.visual.thumbnail_candidate"), False).alias("thumbnail_candidate"),
    )
    place = F.struct(*[F.col(f"d.location.{c}").alias(c) for c in ("name", "city", "country")], _or(F.col("d.location.confidence"), 0.0).alias("confidence"))
    return rows.select(
        *[c for c in rows.columns if c != "d"], _or(F.col("d.clip"), "").alias("clip"), _or(F.col("d.summary"), "").alias("summary"), known_kind(F.col("d.kind")).alias("kind"),
        place.alias("location"), visual.alias("visual"), *[c.alias(n) for n, c in lists.items()],
    )


def clamp_times(analysis: DataFrame, duration: str) -> DataFrame:
    """All spans inside ``[0, duration]`` seconds with ``e >= s``, to a millisecond; ``keep`` inside its attempts.

    A take is kept only with two attempts or more. A null duration or one of zero sets no upper limit.
    """
    limit = F.greatest(F.coalesce(duration, F.lit(0.0)), F.lit(0.0))

    def inside(t: Column) -> Column:
        low = F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0))
        return F.when(limit > 0, F.least(low, limit)).otherwise(low)

    def fixed(x: Column) -> Column:
        s = inside(x["s"])
        return x.withField("s", F.round(s, 3)).withField("e", F.round(F.greatest(inside(x["e"]), s), 3))

    def take(x: Column) -> Column:
        return x.withField("attempts", F.transform(x["attempts"], fixed)).withField("keep", F.greatest(F.lit(0), F.least(x["keep"], F.size(x["attempts"]) - 1)))

    spans = {n: F.transform(n, fixed) for n in ("instructions", "segments", "background_music")}
    takes = F.transform(F.filter("takes", lambda x: F.size(x["attempts"]) >= 2), take)
    frames = F.col("visual").withField("best_frames", F.transform("visual.best_frames", lambda t: F.round(inside(t), 3)))
    return analysis.withColumns({**spans, "takes": takes, "visual": frames})
