"""Probe rows, audio blocks and noise statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dailies.functions.arith import idiv
from dailies.operators.ordered import Splits, running

# The usual frame rates.
STANDARD_RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 48.0, 50.0, 59.94, 60.0)


def rational(text: Column) -> Column:
    """``30000/1001`` as a number; zero when malformed or the denominator is zero."""
    num = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    den = F.when(text.contains("/"), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
    return F.coalesce(F.when(den != 0, num / den), F.lit(0.0))


def nearest_rate(fps: Column) -> Column:
    """Integer rate: the nearest standard one within 0.15, else plain rounding (at least 1)."""
    rates = F.array(*[F.lit(r) for r in STANDARD_RATES])
    near = F.array_min(F.transform(rates, lambda r: F.struct(F.abs(r - fps).alias("d"), r.alias("r"))))
    return F.when(fps <= 0, 30).when(near["d"] <= 0.15, F.bround(near["r"])).otherwise(F.greatest(F.bround(fps), F.lit(1.0))).cast("int")


def bit_depth(pix_fmt: Column) -> Column:
    found = F.regexp_extract(pix_fmt, "(?:p|gray|yuv\\d*p)(9|10|12|14|16)(?:le|be)?$", 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("int"), F.lit(8))


def normalize_probe(raw: DataFrame) -> DataFrame:
    """Typed probe rows from landed JSON documents (``clip_id``, ``doc``)."""
    schema = "codec string, pix_fmt string, r_frame_rate string, avg_frame_rate string, width int, height int, rotation double, transfer string"
    p = raw.select("clip_id", F.from_json("doc", schema).alias("p")).select("clip_id", "p.*")
    turn = F.pmod(F.bround(-F.coalesce("rotation", F.lit(0.0))).cast("int"), F.lit(360))
    p = p.withColumns({"rotation": turn, "fps": rational(F.col("avg_frame_rate")), "r_fps": rational(F.col("r_frame_rate"))})
    sideways = F.col("rotation").isin(90, 270)
    wide, high = F.when(sideways, F.col("height")).otherwise(F.col("width")), F.when(sideways, F.col("width")).otherwise(F.col("height"))
    hdr = F.when(F.col("transfer") == "arib-std-b67", "hlg").when(F.col("transfer") == "smpte2084", "pq")
    return p.select(
        "clip_id", "codec", "pix_fmt", bit_depth(F.col("pix_fmt")).alias("bit_depth"), nearest_rate(F.col("fps")).alias("fps_int"),
        "rotation", wide.alias("display_width"), high.alias("display_height"),
        F.when(high > wide, "portrait").otherwise("landscape").alias("orientation"), hdr.alias("hdr"),
        (F.abs(F.col("fps") - F.col("r_fps")) > F.greatest("fps", "r_fps") * 0.02).alias("rates_differ"),
    )


def mezzanine_reason(codec: str = "h264", pix_fmt: str = "yuv420p", width: int = 1920, height: int = 1080, fps: int = 30) -> Column:
    """First reason a clip has to be re-encoded, empty when it can be copied."""
    c = F.col
    size_ok = ((c("display_width") == width) & (c("display_height") == height)) | ((c("display_width") == height) & (c("display_height") == width))
    return (
        F.when(~c("codec").eqNullSafe(codec), F.concat(F.lit("codec "), "codec"))
        .when(~c("pix_fmt").eqNullSafe(pix_fmt), F.concat(F.lit("pix_fmt "), "pix_fmt"))
        .when(c("rotation") != 0, F.concat(F.lit("rotation "), c("rotation").cast("string")))
        .when(~size_ok, F.concat(F.lit("size "), c("display_width").cast("string"), F.lit("x"), c("display_height").cast("string")))
        .when(c("vfr"), "vfr")
        .when(c("hdr").isNotNull(), F.concat(F.lit("hdr "), "hdr"))
        .when(c("fps_milli") != fps * 1000, F.concat(F.lit("fps "), c("fps_milli").cast("string")))
        .otherwise("")
    )


def mezzanine_summary(clips: DataFrame) -> DataFrame:
    """Clips per mode and first word of the reason."""
    word = F.split_part("reason", F.lit(" "), F.lit(1))
    return clips.groupBy(F.when(F.col("reason") == "", "copy").otherwise("encode").alias("mode"), word.alias("cause")).agg(F.count("*").alias("clips"))


def variable_rate(packets: DataFrame, *, splits: Splits | None = None) -> DataFrame:
    """VFR verdict per clip from packet times: more than a tenth of the positive gaps off the median by a quarter."""
    gaps = running(packets.distinct(), ["clip_id"], ["pts_us"], {"__p": ("lag", F.col("pts_us"))}, splits)
    gaps = gaps.select("clip_id", (F.col("pts_us") - F.col("__p")).alias("d")).where(F.col("d") > 0)
    med = gaps.groupBy("clip_id").agg(F.percentile("d", 0.5).alias("med"))
    off = (F.abs(F.col("d") - F.col("med")) > F.col("med") * 0.25).cast("bigint")
    votes = gaps.join(med, "clip_id").groupBy("clip_id").agg(F.count("*").alias("gaps"), F.sum(off).alias("off"))
    n = packets.groupBy("clip_id").agg(F.count("*").alias("packets"))
    return n.join(votes, "clip_id", "left").select(
        "clip_id", "packets", ((F.col("packets") <= 12) | F.col("gaps").isNull() | (F.col("off") * 10 > F.col("gaps"))).alias("vfr")
    )


def noise_levels(words: DataFrame, blocks: DataFrame, *, edge_us: int = 1_000_000, min_words: int = 4, min_us: int = 500_000, splits: Splits | None = None) -> DataFrame:
    """Speech and gap level per clip from audio blocks (clip_id, s_us, e_us, sum_sq, n).

    Speech is the union of the words, gaps are what is left within a second around them.  A block
    belongs to the range that holds its start.
    """
    k = ["clip_id"]
    window = words.groupBy(*k).agg(
        F.greatest(F.min("s_us") - edge_us, F.lit(0)).alias("w0_us"), (F.max("e_us") + edge_us).alias("w1_us"), F.count("*").alias("n_words")
    ).where(F.col("n_words") >= min_words).drop("n_words")
    start = F.greatest("s_us", F.lit(0)).alias("s_us")
    line = words.where("e_us > s_us").select("clip_id", start, F.lit(0).alias("side"), "e_us").unionByName(
        blocks.select("clip_id", "s_us", F.lit(1).alias("side"), "sum_sq", "n"), allowMissingColumns=True
    ).where("clip_id is not null")
    # on one line by start, the furthest end so far tells what each word adds, each gap and where each block starts
    said, t, e, far = F.col("side") == 0, F.col("s_us"), F.col("e_us"), F.col("__far")
    lined = running(line, k, ["s_us", "side"], {"__far": ("max_before", e)}, splits).join(window, k, "left")
    spoken = ~said & (t < far)
    silent = ~said & (t >= F.coalesce(far, "w0_us")) & (t >= F.col("w0_us")) & (t < F.col("w1_us"))

    def level(here: Column) -> Column:
        sq, n = F.sum(F.when(here, F.col("sum_sq"))), F.sum(F.when(here, F.col("n")))
        return F.greatest(F.coalesce(F.log10(sq / n) * 10, F.lit(-90.0)), F.lit(-90.0))

    adds = F.when(said, F.greatest(e - F.greatest(t, F.coalesce(far, t)), F.lit(0)))
    between = F.coalesce(F.sum(F.when(said, F.greatest(t - far, F.lit(0)))), F.lit(0))
    head = F.coalesce(F.greatest(F.min(F.when(said, t)) - F.max("w0_us"), F.lit(0)), F.lit(0))
    tail = F.greatest(F.max("w1_us") - F.coalesce(F.max(e), F.max("w0_us")), F.lit(0))
    levels = lined.groupBy(*k).agg(
        F.coalesce(F.sum(adds), F.lit(0)).alias("speech_us"), F.when(F.max("w1_us").isNotNull(), head + between + tail).otherwise(0).alias("gap_us"),
        F.round(level(spoken), 2).alias("speech_db"), F.round(level(silent), 2).alias("gap_db"), F.bool_or(spoken | silent).alias("hit"),
    )
    return levels.where((F.col("speech_us") >= min_us) & (F.col("gap_us") >= min_us) & F.col("hit")).select(
        "clip_id", "speech_us", "gap_us", "speech_db", "gap_db", F.round(F.col("speech_db") - F.col("gap_db"), 2).alias("snr_db")
    )


def low_band_ratio(samples: DataFrame, keys: Sequence[str], *, rate: int, cutoff_hz: float = 150.0, max_s: float = 20.0) -> DataFrame:
    """Share of spectral energy below ``cutoff_hz`` in each stretch of ``max_s`` seconds of a clip's gap audio.

    ``pos`` is the position in the gap audio; ``stretch`` 0 holds the first ``max_s`` seconds. Every sample counts and
    a group never exceeds ``max_s * rate`` of them. A Hann window is applied, the mean stays in; fewer than two samples or
    silence give 0. The sums of every sample with every bin below the cutoff would be a billion terms for 20 s at 16 kHz,
    hence the FFT inside the task.
    """
    samples = samples.withColumn("stretch", idiv(F.col("pos"), int(max_s * rate)))
    keys = [*keys, "stretch"]

    def ratio(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["x"].to_numpy(dtype=float)
        power = np.abs(np.fft.rfft(x * np.hanning(x.size))) ** 2 if x.size > 1 else np.zeros(1)
        total = power.sum()
        low = power[np.fft.rfftfreq(x.size, 1.0 / rate) < cutoff_hz].sum()
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "low_band": round(float(low / total), 6) if total > 0 else 0.0}])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.schema if f.name in keys)
    return samples.groupBy(*keys).applyInPandas(ratio, f"{types}, low_band double")


def classify_noise(levels: DataFrame) -> DataFrame:
    """``windy`` (SNR under 2 and rumble over 0.80) before ``noisy`` (SNR under 4)."""
    flag = F.when((F.col("snr_db") < 2) & (F.col("low_band") > 0.80), "windy").when(F.col("snr_db") < 4, "noisy")
    return levels.withColumn("flag", flag)


def audio_blocks(files: DataFrame, *, block_ms: int = 10) -> DataFrame:
    """Per-block statistics from 16-bit PCM WAV bytes (``clip_id``, ``content``), file by file."""
    import io
    import wave

    def run(batches):
        for pdf in batches:
            for clip, raw in zip(pdf["clip_id"], pdf["content"]):
                with wave.open(io.BytesIO(raw)) as w:
                    rate, channels = w.getframerate(), w.getnchannels()
                    x = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, channels).mean(axis=1)
                size = max(1, rate * block_ms // 1000)
                starts = np.arange(0, x.size, size)
                if x.size == 0:
                    continue
                n = np.minimum(size, x.size - starts)
                yield pd.DataFrame({
                    "clip_id": clip, "block": np.arange(starts.size), "s_us": starts * 1_000_000 // rate,
                    "e_us": (starts + n) * 1_000_000 // rate, "n": n, "sum_sq": np.add.reduceat((x / 32768.0) ** 2, starts),
                    "lo": np.minimum.reduceat(x, starts), "hi": np.maximum.reduceat(x, starts),
                })

    return files.select("clip_id", "content").mapInPandas(
        run, "clip_id string, block bigint, s_us bigint, e_us bigint, n bigint, sum_sq double, lo double, hi double"
    )


def level_gain(loudness: DataFrame, *, target_db: float = -16.0, limit_db: float = 10.0, min_cover_ppm: int = 600_000) -> DataFrame:
    """Gain that brings a clip to the target level, within limits; none where too little is speech."""
    gain = F.greatest(F.least(F.lit(target_db) - F.col("measured_db"), F.lit(limit_db)), F.lit(-limit_db))
    cover = idiv(F.col("speech_us") * 1_000_000, F.greatest(F.col("span_us"), F.lit(1)))
    return loudness.withColumn("cover_ppm", cover).withColumn(
        "gain_db", F.when(F.col("cover_ppm") >= min_cover_ppm, F.round(gain, 2)).otherwise(0.0)
    )
