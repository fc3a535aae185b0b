"""Keyed streams that need order inside a key: budget admission, sentence closing, latest status.

Rows are held in state until the watermark has passed them, then handled in event-time order, so
the result does not depend on arrival order within the allowed delay.  Held rows are bounded by
what a key receives during that delay.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _release(held: list, frames: Iterator[pd.DataFrame], columns: list[str], watermark_ms: int, timed_out: bool) -> tuple[list, list]:
    """Rows the watermark has passed, in order, and the rows still held."""
    if not timed_out:
        for frame in frames:
            part = frame[columns].copy()
            part["__ms"] = frame["ts"].astype("int64") // (10**6 if str(frame["ts"].dtype).endswith("ns]") else 10**3)
            held.extend([int(ms), *[v.item() if hasattr(v, "item") else v for v in row]] for ms, *row in part[["__ms", *columns]].itertuples(index=False))
    held.sort(key=lambda r: (r[0], r[1]))
    ready = [r for r in held if r[0] <= watermark_ms]
    return ready, held[len(ready):]


def _wake(state: GroupState, watermark_ms: int, at_ms: int) -> None:
    state.setTimeoutTimestamp(max(at_ms, watermark_ms + 1))


def admit_stream(charges: DataFrame, *, delay: str = "10 minutes") -> DataFrame:
    """Streamed budget admission: project_id, charge, ts, usd_micro, cap_micro -> accepted.

    A charge is accepted iff accepted spend so far plus the charge stays within the cap; refused
    charges do not count.  Same rule as the batch ``admit_charges``.
    """

    def run(key, frames, state: GroupState):
        spent, text = state.get if state.exists else (0, "[]")
        wm = state.getCurrentWatermarkMs()
        ready, held = _release(json.loads(text), frames, ["charge", "usd_micro", "cap_micro"], wm, state.hasTimedOut)
        out = []
        for _, charge, usd, cap in ready:
            ok = spent + usd <= cap
            spent += usd if ok else 0
            out.append((key[0], charge, usd, ok))
        state.update((spent, json.dumps(held)))
        if held:
            _wake(state, wm, held[0][0])
        yield pd.DataFrame(out, columns=["project_id", "charge", "usd_micro", "accepted"])

    return (
        charges.withWatermark("ts", delay)
        .groupBy("project_id")
        .applyInPandasWithState(
            run, "project_id bigint, charge bigint, usd_micro bigint, accepted boolean", "spent bigint, held string",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def sentence_stream(words: DataFrame, *, delay: str = "10 seconds", pause_us: int = 1_200_000) -> DataFrame:
    """Sentences of arriving words: clip_id, pos, ts, s_us, e_us, text -> closed sentences.

    An end mark or a longer pause closes a sentence; an open one is flushed once the watermark is
    past its last word by more than the pause.
    """

    def run(key, frames, state: GroupState):
        n, text = state.get if state.exists else (0, '{"held": [], "open": []}')
        memo = json.loads(text)
        wm = state.getCurrentWatermarkMs()
        ready, held = _release(memo["held"], frames, ["pos", "s_us", "e_us", "text"], wm, state.hasTimedOut)
        current, out = memo["open"], []

        def close():
            nonlocal n
            n += 1
            out.append((key[0], n, current[0][2], current[-1][3], len(current), " ".join(w[4] for w in current)))
            current.clear()

        for word in ready:
            if current and word[2] - current[-1][3] > pause_us:
                close()
            current.append(word)
            if word[4].strip()[-1:] in (".", "?", "!", "…") and word[4].strip():
                close()
        if current and wm - current[-1][0] > (pause_us + current[-1][3] - current[-1][2]) // 1000 and not held:
            close()
        state.update((n, json.dumps({"held": held, "open": current})))
        if held:
            _wake(state, wm, held[0][0])
        elif current:
            _wake(state, wm, current[-1][0] + (pause_us + current[-1][3] - current[-1][2]) // 1000 + 1)
        yield pd.DataFrame(out, columns=["clip_id", "n", "s_us", "e_us", "n_words", "text"])

    return (
        words.withWatermark("ts", delay)
        .groupBy("clip_id")
        .applyInPandasWithState(
            run, "clip_id bigint, n bigint, s_us bigint, e_us bigint, n_words bigint, text string", "n bigint, memo string",
            "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def status_stream(updates: DataFrame) -> DataFrame:
    """Latest status per (clip, stage); run in update mode.  Only the last row per key is state."""
    return updates.groupBy("clip_id", "stage").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("ts")
    )
