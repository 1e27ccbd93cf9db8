"""Small tables of fixed values: codecs, containers, audio modes. As DataFrames they are literals of a known size, so joins with them may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values. codec: (family, CPU encoder, GPU encoder or None, profile for export, profile elsewhere).
CODECS = {
    "h264_main": ("h264", "libx264", "h264_nvenc", "main", "main"),
    "h264_high": ("h264", "libx264", "h264_nvenc", "high", "high"),
    "h264_high10": ("h264", "libx264", None, "high10", "high10"),
    "h264_high422": ("h264", "libx264", None, "high422", "high422"),
    "h265_main": ("h265", "libx265", "hevc_nvenc", "main", "main"),
    "h265_main10": ("h265", "libx265", "hevc_nvenc", "main10", "main10"),
    "h265_main12": ("h265", "libx265", None, "main12", "main12"),
    "h265_main422_10": ("h265", "libx265", None, "main422-10", "main422-10"),
    "av1_main": ("av1", "libsvtav1", "av1_nvenc", "", ""),
    "prores_422_lt": ("prores", "prores_ks", None, "1", "0"),
    "prores_422": ("prores", "prores_ks", None, "2", "1"),
    "prores_422_hq": ("prores", "prores_ks", None, "3", "2"),
    "prores_4444": ("prores", "prores_ks", None, "4", "3"),
    "prores_4444_xq": ("prores", "prores_ks", None, "5", "4"),
}
#: Two sets of aliases that differ for h264.
EXPORT_ALIASES = {"h264": "h264_high", "h265": "h265_main", "hevc": "h265_main", "av1": "av1_main"}
ALIASES = {"h264": "h264_main", "h265": "h265_main", "hevc": "h265_main"}
#: Families that a container takes; other containers take all.
CONTAINERS = {"mp4": ("h264", "h265", "av1"), "mov": ("h264", "h265", "av1", "prores"), "mxf": ("prores",)}
#: Audio codecs that may be copied into a container; other containers take all.
MP4_AUDIO = ("aac", "ac3", "eac3", "mp3", "alac", "opus")
AUDIO_COPY = {
    "mp4": MP4_AUDIO,
    "m4v": MP4_AUDIO,
    "m4a": MP4_AUDIO,
    "mov": ("aac", "ac3", "eac3", "mp3", "alac", "pcm_s16le", "pcm_s16be", "pcm_s24le", "pcm_s24be", "pcm_s32le", "pcm_f32le", "qdm2"),
}
#: Quality presets (crf, x264 preset).
PRESETS = {"archival": (14, "slow"), "high": (17, "slow"), "balanced": (20, "medium"), "fast": (22, "veryfast"), "draft": (26, "ultrafast")}

#: Encoders that run on a GPU.
GPU_ENCODERS = ("h264_nvenc", "hevc_nvenc", "av1_nvenc")


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CODECS.items()], "codec string, family string, cpu string, gpu string, profile string, profile_elsewhere string")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], "preset string, crf int, x264 string")


def lookup(table: dict, key: Column) -> Column:
    """A literal map; null for what it doesn't have."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normalise(codec: Column, aliases: dict[str, str] = EXPORT_ALIASES) -> Column:
    return F.coalesce(lookup(aliases, codec), codec)


def is_hevc(codec: Column) -> Column:
    return F.coalesce(F.lower(F.trim(codec)) == "hevc", F.lit(False))


def family(codec: Column) -> Column:
    """Unknown codecs count as h264."""
    return F.coalesce(lookup({k: v[0] for k, v in CODECS.items()}, normalise(codec)), F.lit("h264"))


def compatible(codec: Column, container: Column) -> Column:
    takes = F.create_map(*[x for k, v in CONTAINERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(takes, container), family(codec)), F.lit(True))


def audio_copy_safe(codec: Column, container: Column) -> Column:
    """May a track be copied into a container? A track of unknown codec may."""
    name = F.lower(F.trim(F.coalesce(codec, F.lit(""))))
    takes = F.create_map(*[x for k, v in AUDIO_COPY.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return (name == "") | F.coalesce(F.array_contains(F.try_element_at(takes, container), name), F.lit(True))


def fallback_audio(container: Column) -> Column:
    return F.when(container.isin("mkv", "webm"), "copy").otherwise("aac")


def recommended_container(codec: Column) -> Column:
    return F.when(family(codec) == "prores", "mov").otherwise("mp4")


def codec_tag(codec: Column, extension: Column) -> Column:
    name, ext = normalise(codec), F.lower(extension)
    return F.when(ext.isin("mp4", "mov") & name.startswith("h265_"), "hvc1").when((ext == "mov") & (name == "av1_main"), "av01")


def stream_filter(codec: Column, container: Column) -> Column:
    """The bitstream filter that a copy needs outside of MP4-like containers."""
    name = F.lower(F.trim(F.coalesce(codec, F.lit(""))))
    return F.when(container.isin("mp4", "mov", "m4v", "m4a", "3gp", "3g2"), None).when(name.isin("h264", "avc", "avc1"), "h264_mp4toannexb").when(name.isin("hevc", "h265", "hvc1", "hev1"), "hevc_mp4toannexb")


def listed_encoders(listing: Column) -> Column:
    """The GPU encoders that a listing of all encoders names."""
    return F.filter(F.array(*[F.lit(e) for e in GPU_ENCODERS]), lambda e: listing.contains(e))


def use_cuda(hardware: Column, encoders: Column) -> Column:
    """For edges of scenes: unless the CPU was asked for, if the first GPU encoder is installed."""
    return F.coalesce((hardware != "cpu") & F.array_contains(encoders, GPU_ENCODERS[0]), F.lit(False))


def use_gpu(codec: Column, hardware: Column, cuda: Column, encoders: Column) -> Column:
    """Only if asked for (or auto with CUDA), if the codec has a GPU encoder, and if that is installed."""
    gpu = lookup({k: v[2] for k, v in CODECS.items() if v[2]}, normalise(codec))
    want = (hardware == "gpu") | ((hardware == "auto") & cuda)
    return F.coalesce((codec != "copy") & want & F.array_contains(encoders, gpu), F.lit(False))
