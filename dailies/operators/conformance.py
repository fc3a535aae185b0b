"""Rule sets on finished timelines and rendered files: one row for each broken rule, with its weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the rules ask for.
OPENING_ROLE = "(?i)cold-?open|hook|teaser"
END_SCREEN_US = 20_000_000
AAC_TARGET, AAC_FLOOR = 320_000, 192_000


def _found(df: DataFrame, ref: str, *rules: tuple[Column, str, Column | str]) -> DataFrame:
    level = lambda x: x if isinstance(x, Column) else F.lit(x)
    hits = F.array(*[F.when(broken, F.struct(F.lit(code).alias("code"), level(weight).alias("weight"))) for broken, code, weight in rules])
    return df.select("project_id", F.col(ref).cast("string").alias("ref"), F.inline(F.filter(hits, lambda x: x.isNotNull())))


def timeline_rules(placed: DataFrame, captions: DataFrame, clips: DataFrame) -> DataFrame:
    """Clean end screen, captions inside, vertical clips and the opening role: project_id, ref, code, weight.

    ``placed``: project_id, pos, clip_id, role, fit, zoom, end_us; ``captions``: project_id, item, s_us, e_us, style;
    ``clips``: clip_id, vertical, height.
    """
    total = placed.groupBy("project_id").agg(F.max_by("end_us", "pos").alias("total_us"), F.min_by(F.struct("pos", "role"), "pos").alias("first"))
    late = F.greatest("s_us", F.col("total_us") - END_SCREEN_US) < F.least("e_us", "total_us")
    said = _found(
        captions.join(total, "project_id"), "item",
        ((F.col("total_us") > END_SCREEN_US) & F.col("style").isin("subtitle", "hook") & late, "end_screen", "warn"),
        ((F.col("s_us") < 0) | (F.col("e_us") > F.col("total_us") + 1_000), "caption_outside", "error"),
    )
    hard = F.col("vertical") & (F.col("fit") == "cover") & (F.col("zoom") <= 1.0)
    shown = _found(placed.join(clips, "clip_id"), "pos", (hard & (F.col("height") >= 2160), "use_crop_pan", "warn"), (hard & (F.coalesce("height", F.lit(0)) < 2160), "use_blur_fill", "warn"))
    opening = _found(total.withColumn("pos", F.col("first.pos")), "pos", (~F.coalesce("first.role", F.lit("")).rlike(OPENING_ROLE), "opening_role", "warn"))
    return said.unionByName(shown).unionByName(opening)


def rendered_file_rules(files: DataFrame) -> DataFrame:
    """Codec, profile, colour, geometry, rate, sound and container rules of rendered files: project_id, ref, code, weight.

    ``files``: project_id, file, master, video STRUCT (codec, profile, pix_fmt, width, height, fps, primaries, transfer, space),
    audio STRUCT (codec, profile, rate, channels, bit_rate), canvas STRUCT (width, height, fps), faststart (null: no boxes
    found), shift_us (largest start time of a stream).
    """
    v, a, c, master = (lambda n: F.col(f"video.{n}")), (lambda n: F.col(f"audio.{n}")), (lambda n: F.col(f"canvas.{n}")), F.col("master")
    has_v, has_a = F.col("video").isNotNull(), F.col("audio").isNotNull()
    hard = F.when(master, "error").otherwise("warn")
    off_colour = F.greatest(*[(F.coalesce(v(n), F.lit("unknown")) != "bt709").cast("int") for n in ("primaries", "transfer", "space")]) == 1
    rate, channels, bits = (F.coalesce(a(n), F.lit(0)) for n in ("rate", "channels", "bit_rate"))
    aac = F.coalesce(a("codec"), F.lit("")) == "aac"
    return _found(
        files, "file",
        (~has_v, "no_video", "error"), (has_v & (F.coalesce(v("codec"), F.lit("")) != "h264"), "video_codec", "error"), (has_v & (F.coalesce(v("pix_fmt"), F.lit("")) != "yuv420p"), "pixel_format", "error"),
        (has_v & master & (F.lower(F.coalesce(v("profile"), F.lit(""))) != "high"), "video_profile", "error"),
        (has_v & (v("fps") > 0) & (c("fps") > 0) & (F.abs(v("fps") - c("fps")) > 0.05), "frame_rate", "warn"),
        (has_v & master & ((F.coalesce(v("width"), F.lit(0)) != c("width")) | (F.coalesce(v("height"), F.lit(0)) != c("height"))), "resolution", "warn"), (has_v & off_colour, "colour_tags", hard),
        (~has_a, "no_audio", "error"), (has_a & ~aac, "audio_codec", "error"), (has_a & aac & (F.coalesce(a("profile"), F.lit("")) != "") & ~F.upper(a("profile")).isin("LC", "AAC-LC"), "audio_profile", "warn"),
        (has_a & (rate != 48_000), "sample_rate", "error"), (has_a & (channels != 2), "channels", "warn"), (has_a & master & (bits > 0) & (bits < AAC_FLOOR), "audio_bitrate", "error"),
        (has_a & master & (bits >= AAC_FLOOR) & (bits < AAC_TARGET), "audio_bitrate", "warn"),
        (~F.col("faststart"), "faststart", hard), (F.col("faststart").isNull(), "no_boxes", "warn"), (F.abs("shift_us") > 1_000, "edit_list", "warn"),
    )
