"""Chat formatting in budgeted windows with a reversible template and a loss mask."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.llm.common import join_keyed
from dailies.session import materialize

#: A turn is OPEN + role + SAID + text + CLOSE; the control strings are these marks' parts.
OPEN, SAID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"
TURN = r"(?s)<s>\[INST\](.*?)\[/INST\](.*?)</s>"
#: Tokens are counted as words and other signs, and so many for a turn's marks.
TOKEN, MARKS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", 4
#: Turn numbers of a conversation that are summed together.
STRETCH = 512


def escape(text: Column) -> Column:
    """Put one backslash more after the first sign of every control string, so that none is left."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, "$1$2$3")


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """Cut each conversation of ``turns`` (conv_id, turn, role, text) into formatted windows.

    Turns are ordered by turn (null first), role and text; null role and text are empty, a null conv_id is a
    conversation of its own, repeated rows are repeated turns. Prefix sums of token counts choose the spans: a turn
    belongs to the stride of tokens that its last token falls into, so spans are made of whole turns. A window
    holds, in order: the conversation's first turn if its role is ``system``, the turns before the span (of however many
    spans) that begin at most ``history`` tokens before it, and the span. The first two are repeated there and masked; the loss mask covers the texts of the
    span's ``assistant`` turns, so each is a target once. A window keeps to ``budget`` tokens unless one turn is longer
    than a stride (half of what system turn and history leave); a turn is never cut.

    Returns conv_id, window (grows along the conversation), formatted, loss (array of start, end in code points of
    formatted), n_repeated (leading turns that are repeated), n_turns (all turns in the window) and n_tokens. An empty
    table gives none. No conversation is gathered: sums run over stretches of turn numbers, and windows are bounded.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("tokens", (F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))) + MARKS).cast("bigint"))
    rows = rows.withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("tokens").alias("t")).select("conv_id", "stretch", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("off"))
    rows = join_keyed(rows.withColumn("upto", F.sum("tokens").over(inside)), sums, names=("conv_id", "stretch"))
    rows = rows.withColumn("upto", F.col("upto") + F.col("off"))
    system = rows.filter((F.col("upto") == F.col("tokens")) & (F.col("role") == "system")).select("conv_id", F.col("text").alias("system"), F.col("tokens").alias("system_tokens"))
    rows = join_keyed(rows.drop("turn", "stretch", "off"), system.drop("system"), "left", ("conv_id",))
    stride = F.greatest(F.lit(64), F.floor((F.lit(budget - history) - F.coalesce("system_tokens", F.lit(0))) / 2))
    rows = materialize(rows.select("conv_id", "role", "text", "tokens", "upto", F.floor((F.col("upto") - 1) / stride).alias("window")))

    history = max(history, 1)
    spans = materialize(rows.groupBy("conv_id", "window").agg(F.min(F.col("upto") - F.col("tokens")).alias("start"), F.max("upto").alias("stop")))
    # a span that starts at s repeats the turns within [s - history, s]; a turn meets such s in two cells of that width at most
    begun = F.col("upto") - F.col("tokens")
    first_system = (begun == 0) & (F.col("role") == "system")
    near = rows.filter((F.col("tokens") <= history) & ~first_system).withColumn("begun", begun).drop("window")
    near = near.withColumn("cell", F.explode(F.array(F.floor(F.col("begun") / history), F.floor(F.col("begun") / history) + 1)))
    follow = spans.filter("start > 0").select("conv_id", "window", F.col("start").alias("s"), F.floor(F.col("start") / history).alias("cell"))
    again = join_keyed(near, follow, names=("conv_id", "cell")).filter((F.col("upto") <= F.col("s")) & (F.col("s") - F.col("begun") <= history))
    again = again.select("conv_id", "window", F.lit(1).alias("part"), "upto", "role", "text", "tokens")
    head = join_keyed(spans.filter("start > 0"), system, names=("conv_id",))
    head = head.select("conv_id", "window", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("upto"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("tokens"))
    pieces = rows.select("conv_id", "window", F.lit(2).alias("part"), "upto", "role", "text", "tokens").unionByName(again).unionByName(head)

    opened = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAID))
    pieces = pieces.select("conv_id", "window", "part", "upto", "tokens", "role", opened.alias("opened"), escape(F.col("text")).alias("said"))
    whole = F.length("opened") + F.length("said") + len(CLOSE)
    upto = Window.partitionBy("conv_id", "window").orderBy("part", "upto").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("end", F.sum(whole).over(upto) - len(CLOSE))
    target = (F.col("part") == 2) & (F.col("role") == "assistant")
    loss = F.when(target, F.struct((F.col("end") - F.length("said")).alias("start"), F.col("end").alias("end")))
    turn = F.struct("part", "upto", F.concat("opened", "said", F.lit(CLOSE)).alias("s"))
    return pieces.groupBy("conv_id", "window").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["s"]), "").alias("formatted"), F.sort_array(F.collect_list(loss)).alias("loss"),
        F.sum((F.col("part") < 2).cast("int")).alias("n_repeated"), F.count("*").alias("n_turns"), F.sum("tokens").alias("n_tokens"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Turns and loss texts read back from ``formatted`` alone: conv_id, window, turns (array of role, text; repeated ones left out), loss_texts, formatted."""
    roles, texts = (F.regexp_extract_all("formatted", F.lit(TURN), F.lit(i)) for i in (1, 2))
    turns = F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x: F.struct(unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text")))
    own = F.slice(turns, F.col("n_repeated") + 1, F.greatest(F.lit(1), F.size(turns)))
    said = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    return windows.select("conv_id", "window", own.alias("turns"), said.alias("loss_texts"), "formatted")


def conversation_digests(read: DataFrame) -> DataFrame:
    """One row per conversation from its windows: a digest of its turns and of its loss texts, fed window by window.

    A digest of a whole text is sequential, so a conversation goes to one task; it streams by in order, and only the
    state of two hashes is held.
    """
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    rows = read.select(
        "conv_id", "window", F.size("turns").cast("bigint").alias("n"), lines.alias("lines"), lost.alias("lost"), F.length(lost).cast("bigint").alias("lost_chars"), F.length("formatted").cast("bigint").alias("chars")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None

        def close(done: list) -> pa.RecordBatch:
            got = [[x[0] for x in done], [x[1] for x in done], [x[2].hexdigest() for x in done], [x[3] for x in done], [x[4].hexdigest() for x in done], [x[5] for x in done]]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got, kinds)], names)

        for b in batches:
            done = []
            for conv, n, said, lost_text, lost_n, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "lines", "lost", "lost_chars", "chars"))):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += n
                state[2].update(said.encode())
                state[3] += lost_n
                state[4].update(lost_text.encode())
                state[5] += chars
            if done:
                yield close(done)
        if state is not None:
            yield close([state])

    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
