"""Selecting, joining and planning scenes for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boundary import by_video


def filter_reindex(scenes: DataFrame, least_us: int) -> DataFrame:
    """Scenes of at least a duration, numbered again; a video that loses none keeps its numbers. Neighbours aren't extended. Adds old_index."""
    n = F.count("*").over(W.partitionBy("video_id"))
    kept = scenes.withColumn("n", n).where(F.col("end_us") - F.col("start_us") >= least_us)
    left = F.count("*").over(W.partitionBy("video_id"))
    new = (F.row_number().over(by_video("scene_index")) - 1).cast("long")
    return kept.withColumn("left", left).withColumn("new", new).select("video_id", F.when(F.col("left") == F.col("n"), F.col("scene_index")).otherwise(F.col("new")).alias("scene_index"), F.col("scene_index").alias("old_index"), "start_us", "end_us")


def remap_pairs(pairs: DataFrame, renumbered: DataFrame) -> DataFrame:
    """Pairs (video_id, a, b) whose both ends are left, under the new numbers."""
    m = renumbered.select("video_id", F.col("old_index"), F.col("scene_index").alias("new"))
    out = pairs.join(m.withColumnsRenamed({"old_index": "a", "new": "na"}), ["video_id", "a"]).join(m.withColumnsRenamed({"old_index": "b", "new": "nb"}), ["video_id", "b"])
    return out.select("video_id", F.col("na").alias("a"), F.col("nb").alias("b"))


def selected_indices(text: Column, last: Column) -> Column:
    """"0,2,5-8" as an array of numbers; nothing or blank selects 0..last. Blank parts are skipped, ranges hold both ends, a falling range is empty."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")

    def numbers(p: Column) -> Column:
        a, b = F.trim(F.substring_index(p, "-", 1)).cast("long"), F.trim(F.substring_index(p, "-", -1)).cast("long")
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array_distinct(F.flatten(F.transform(parts, numbers))))


def resolve_jobs(scenes: DataFrame, clips: DataFrame) -> DataFrame:
    """The source of each scene: its clip if that was cut, else the whole video with a seek and a length in ms.

    scenes (video_id, scene_index, start_us, end_us), clips (video_id, scene_index, path, mode).
    """
    ok = F.col("path").isNotNull() & (F.col("mode") != "failed")
    ms = lambda us: F.bround(us / 1000, 0).cast("long")
    return scenes.join(clips, ["video_id", "scene_index"], "left").select(
        "video_id",
        "scene_index",
        F.when(ok, F.col("path")).otherwise(F.concat(F.lit("video_"), F.col("video_id"))).alias("input"),
        F.when(~F.coalesce(ok, F.lit(False)), ms(F.col("start_us"))).alias("seek_ms"),
        F.when(~F.coalesce(ok, F.lit(False)), ms(F.col("end_us") - F.col("start_us"))).alias("dur_ms"),
    )


def with_results(scenes: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes with the results of cutting; without one the path is empty and the mode failed."""
    return scenes.join(results, keys, "left").withColumns({"path": F.coalesce("path", F.lit("")), "mode": F.coalesce("mode", F.lit("failed"))})


def concat_offsets(clips: DataFrame, key: str, order: list, length: str) -> DataFrame:
    """Clips in order with their number and where each begins in the whole."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return clips.withColumn("ordinal", (F.row_number().over(w) - 1).cast("long")).withColumn("offset", before)


def layout(clips: DataFrame, key: str, codec: str, languages: str) -> DataFrame:
    """Do a group's clips share a codec (and is none unknown), and an audio layout?"""
    return clips.groupBy(key).agg(
        F.count("*").alias("n"),
        F.coalesce((F.min(codec) == F.max(codec)) & (F.count(codec) == F.count("*")), F.lit(False)).alias("same_codec"),
        F.coalesce(F.min(languages) == F.max(languages), F.lit(False)).alias("uniform_audio"),
    )


def hoisted(audio: Column, track: Column, count: Column) -> Column:
    """Is a chosen track moved to the front?"""
    return F.coalesce((audio != "none") & (track > 0) & (count > 1) & (track < count), F.lit(False))


def track_order(audio: Column, track: Column, count: Column) -> Column:
    """Track numbers in their order, the chosen one first if it is hoisted; none without audio."""
    all_ = F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(audio == "none", F.array().cast("array<bigint>")).when(hoisted(audio, track, count), F.concat(F.array(track), F.filter(all_, lambda i: i != track))).otherwise(all_)


def language_track(languages: Column, wanted: Column) -> Column:
    """Place of the first track in a language, or null."""
    return F.nullif(F.array_position(F.transform(languages, lambda x: F.lower(x)), F.lower(wanted)), F.lit(0)) - 1


def with_readiness(scenes: DataFrame, ready: DataFrame, keys: list[str]) -> DataFrame:
    """Scenes with whether their thumbnail is there."""
    return scenes.join(ready.select(*keys).distinct().withColumn("thumbnail_ready", F.lit(True)), keys, "left").withColumn("thumbnail_ready", F.coalesce("thumbnail_ready", F.lit(False)))


def posters(frames: DataFrame, keys: list[str], order: str, from_key: Column) -> DataFrame:
    """One frame for each key: its first keyframe where from_key says so (clips that were copied may begin between two) and there is one, else its first. frames (keys, order, is_key, ...). Partial minima go through the shuffle."""
    rest = F.struct(*[F.col(c) for c in frames.columns if c not in keys])
    first = F.coalesce(F.min_by(rest, F.when(from_key & F.col("is_key"), F.col(order))), F.min_by(rest, F.col(order)))
    return frames.groupBy(*keys).agg(first.alias("_f")).select(*keys, "_f.*")


def per_source(jobs: DataFrame, find_out, key: str) -> DataFrame:
    """Jobs with what find_out(sources: one row for each) says of their source, which is asked once however many jobs it has."""
    return jobs.join(find_out(jobs.select(key).distinct()), key)


def missing(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present, keys, "left_anti")


def dedup_first(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values of a key in order of their first appearance."""
    return rows.groupBy(key, value).agg(F.min(order).alias("first_at"))


def top(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)
