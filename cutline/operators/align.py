"""As-of alignment of times with keyframes, and the rules that choose how a scene is cut.

All legs of a lookup come from one sorted pass: points and keys are united and the last or first key is carried along
each video's order, so a video is shuffled once and never paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def neighbours(points: DataFrame, keys: DataFrame, id_cols: tuple[str, ...]) -> DataFrame:
    """points (video_id, *id_cols, t_us) with k_at_or_before, k_before, k_at_or_after, k_after: the nearest keys on each side.

    keys (video_id, t_us).
    """
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in id_cols]
    rows = points.select("video_id", *id_cols, "t_us", F.lit(None).cast("long").alias("k")).unionByName(keys.distinct().select("video_id", *none, "t_us", F.col("t_us").alias("k")))
    w = W.partitionBy("video_id")
    up, down = w.orderBy("t_us"), w.orderBy(F.desc("t_us"))
    # frames that only grow: going up for the legs before, going down for those after
    until = lambda o: o.rangeBetween(W.unboundedPreceding, 0)
    short_of = lambda o: o.rangeBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("k_at_or_before", F.max("k").over(until(up))).withColumn("k_before", F.max("k").over(short_of(up)))
    rows = rows.withColumn("k_at_or_after", F.min("k").over(until(down))).withColumn("k_after", F.min("k").over(short_of(down)))
    return rows.where("k is null").drop("k")


def nearest(t: Column, before: Column, at_or_after: Column) -> Column:
    """The nearer of the key before and the key at or after; a tie goes to the later one."""
    return F.when(before.isNull(), at_or_after).when(at_or_after.isNull(), before).when(t - before < at_or_after - t, before).otherwise(at_or_after)


def snap(t: Column, before: Column, at_or_after: Column, within_us: int) -> tuple[Column, Column]:
    """(key or null, distance): the nearest key if it is within the tolerance, and how far it is in any case."""
    key = nearest(t, before, at_or_after)
    gap = F.abs(key - t)
    return F.when(gap <= within_us, key), gap


def classify(scenes: DataFrame, keys: DataFrame, within_us: int) -> DataFrame:
    """scenes (video_id, scene_index, start_us, end_us) with snapped ends, distances, and mode by the start alone."""
    if within_us < 0:
        raise ValueError("the tolerance must not be negative")
    ends = scenes.select("video_id", "scene_index", F.inline(F.array(F.struct(F.lit("start").alias("side"), F.col("start_us").alias("t_us")), F.struct(F.lit("end").alias("side"), F.col("end_us").alias("t_us")))))
    near = neighbours(ends, keys, ("scene_index", "side"))
    key, gap = snap(F.col("t_us"), F.col("k_before"), F.col("k_at_or_after"), within_us)
    near = near.withColumn("key", key).withColumn("gap", gap)
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return (
        near.groupBy("video_id", "scene_index")
        .agg(*[pick(s, c).alias(f"{s}_{n}") for s in ("start", "end") for c, n in (("t_us", "us"), ("key", "snapped_us"), ("gap", "diff_us"))])
        .withColumn("mode", F.when(F.col("start_snapped_us").isNotNull(), "copy_candidate").otherwise("reencode_candidate"))
    )


def earlier_snap(t: Column, at_or_before: Column, after: Column, within_us: int, end: Column | None = None) -> Column:
    """The nearer of the key at or before and the key after (a tie goes to the earlier), if within the tolerance and before the end."""
    key = F.when(at_or_before.isNull(), after).when(after.isNull(), at_or_before).when(after - t < t - at_or_before, after).otherwise(at_or_before)
    ok = F.abs(key - t) <= within_us
    return F.when(ok & (key < end) if end is not None else ok, key)


def cut_mode(start: Column, end: Column, on_key: Column, snapped: Column, after: Column, hevc: Column, cuda: Column) -> Column:
    """How a scene is cut: on a keyframe it is copied; HEVC without CUDA is copied from a snapped keyframe; other codecs encode the head up to the next keyframe if that is under nine tenths; else all is encoded. Nothing is left of an empty scene."""
    head = (after - start) / (end - start)
    return (
        F.when(end <= start, "failed")
        .when(on_key, "copy")
        .when(hevc & ~cuda & snapped.isNotNull(), "snapped_copy")
        .when(~hevc & after.isNotNull() & (after < end) & (head < 0.9), "smartcut")
        .otherwise("reencode")
    )


def gop_trim(packets: DataFrame, most: int = 5) -> DataFrame:
    """video_id, n_packets, last_key, trim_to: where a trailing partial group begins, if at most `most` packets long. packets (video_id, i, is_key), i from 0."""
    out = packets.groupBy("video_id").agg(F.count("*").alias("n_packets"), F.count_if("is_key").alias("n_keys"), F.max(F.when(F.col("is_key"), F.col("i"))).alias("last_key"))
    trims = (F.col("n_keys") >= 2) & (F.col("last_key") > 0) & (F.col("n_packets") - F.col("last_key") <= most)
    return out.withColumn("trim_to", F.when(trims, F.col("last_key")))
