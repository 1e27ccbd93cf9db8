"""Sizes, bit rates, streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fraction


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def fit(w: Column, h: Column, scale: Column, fit_w: Column, fit_h: Column) -> tuple[Column, Column]:
    """A scaled size, shrunk to fit a box if there is one; then even, and at least 2."""
    ow, oh = w * scale, h * scale
    over = (fit_w > 0) & (fit_h > 0) & ((ow > fit_w) | (oh > fit_h))
    ratio = F.least(fit_w / ow, fit_h / oh)
    even = lambda x: F.greatest(F.lit(2), F.floor(F.floor(x * ratio) / 2) * 2)
    return F.when(over, even(ow)).otherwise(ow).cast("long"), F.when(over, even(oh)).otherwise(oh).cast("long")


def height_at(width: Column, height: Column, wanted: int = 960) -> Column:
    """The height that keeps an image's shape at a wanted width, cut off; at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.floor(wanted * height / width))


def pad_to(x: Column, mod: int) -> Column:
    """How much is missing to a multiple."""
    return F.pmod(-x, F.lit(mod))


def bitrate_budget(target_mb: Column, seconds: Column, audio_kbps: Column) -> dict[str, Column]:
    """Two-pass rates (kbit/s) for a file size, 5 % under it; null if under 100 is left for the video."""
    bits = target_mb * 8 * 1_000_000 * 0.95 - audio_kbps * 1000 * seconds
    video = F.when((bits > 0) & (seconds > 0), F.floor(bits / 1000 / F.nullif(seconds, F.lit(0))))
    video = F.when(video >= 100, F.least(video, F.lit(100_000))).cast("long")
    return {
        "video_kbps": video,
        "max_kbps": F.when(video.isNotNull(), F.floor(F.least(video * 1.45, F.lit(120_000.0)))).cast("long"),
        "buffer_kbps": F.when(video.isNotNull(), F.least(video * 2, F.lit(200_000))).cast("long"),
    }


def frame_count(fps: Column, seconds: Column) -> Column:
    """Estimated number of frames, cut off."""
    return (fps * seconds).cast("long")


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def encode_threads(width: Column, height: Column, cores: Column) -> Column:
    return F.greatest(F.lit(2), F.least(cores, F.when(width * height >= 3840 * 2160, 4).otherwise(8)))


#: What a probe tells of a stream.
STREAM = "index int, codec_type string, codec_name string, width int, height int, avg_frame_rate string, sample_rate string, channels int, bit_rate string"


def streams(probe: Column) -> Column:
    """The streams of a probed file, a JSON object, as an array of structs: index, type, codec, width, height and fps (0 if unknown) of video, sample_rate and channels of audio, bit_rate. What a stream hasn't is null."""
    found = F.from_json(probe, f"streams array<struct<{', '.join(x.replace(' ', ': ', 1) for x in STREAM.split(', '))}>>")["streams"]

    def stream(s: Column) -> Column:
        video, audio = s["codec_type"] == "video", s["codec_type"] == "audio"
        only = lambda kind, x: F.when(kind, x)
        return F.struct(
            s["index"].alias("index"),
            s["codec_type"].alias("type"),
            s["codec_name"].alias("codec"),
            only(video, s["width"]).alias("width"),
            only(video, s["height"]).alias("height"),
            only(video, F.coalesce(fraction(s["avg_frame_rate"]), F.lit(0.0))).alias("fps"),
            only(audio, s["sample_rate"].try_cast("int")).alias("sample_rate"),
            only(audio, s["channels"]).alias("channels"),
            s["bit_rate"].try_cast("long").alias("bit_rate"),
        )

    return F.transform(found, stream)
