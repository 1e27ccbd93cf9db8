"""Videos as one object: what is known of them and their packets. Every method is a lazy plan over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media, text
from ..operators import align, boundary, selection
from ..sources import dims
from ..sources.files import SceneCache
from . import detect


class Videos:
    """facts (video_id, path, size: bytes, mtime_ns, rate, dimensions, seconds, codec: probed texts), packets (video_id, t_us, is_key, and what a method of detection needs)."""

    def __init__(self, facts: DataFrame, packets: DataFrame):
        self.facts, self.packets = facts, packets

    def with_prints(self) -> DataFrame:
        """facts with print, a fingerprint that changes with the file, under which a cache knows it."""
        return self.facts.withColumn("print", text.fingerprint(F.col("path"), F.col("size"), F.col("mtime_ns")))

    def keyframes(self) -> DataFrame:
        """video_id, t_us: distinct."""
        return self.packets.where(F.col("is_key") & F.col("t_us").isNotNull()).select("video_id", "t_us").distinct()

    def probe(self, cache: SceneCache | None = None) -> DataFrame:
        """One row for each video: name, width, height, fps, n_frames, duration_ms, hevc, n_keys, average_gap, print, cached. What can't be read is null."""
        width, height = text.dimensions(F.col("dimensions"))
        fps = text.fraction(F.col("rate"))
        known = self.with_prints().join(detect.keyframe_summary(self.keyframes()), "video_id", "left")
        rows = known.select(
            "video_id",
            text.path_name(F.col("path")).alias("name"),
            width.alias("width"),
            height.alias("height"),
            F.bround(fps, 3).alias("fps"),
            media.frame_count(fps, F.col("seconds").try_cast("double")).alias("n_frames"),
            text.duration_ms(F.col("seconds")).alias("duration_ms"),
            dims.is_hevc(F.col("codec")).alias("hevc"),
            F.coalesce("n", F.lit(0).cast("long")).alias("n_keys"),
            "average_gap",
            "print",
        )
        there = cache.listed() if cache else None
        if there is None:
            return rows.withColumn("cached", F.lit(False))
        return rows.join(there.select("print").distinct().withColumn("cached", F.lit(True)), "print", "left").select(*rows.columns, F.coalesce("cached", F.lit(False)).alias("cached"))

    def scenes(self, method: str = "keyframe", least_us: int = 0, **options) -> DataFrame:
        """detect.detect_scenes(), without those shorter than least_us; the others are numbered again."""
        found = detect.detect_scenes(self.packets, method, **options)
        return selection.filter_reindex(found, least_us).drop("old_index") if least_us > 0 else found

    def cuts(self, scenes: DataFrame, cuda: bool | Column = False, **options) -> DataFrame:
        """detect.plan_cuts() with each video's own codec; one without facts counts as another codec than HEVC."""
        kinds = self.facts.select("video_id", dims.is_hevc(F.col("codec")).alias("hevc"))
        rows = scenes.join(kinds, "video_id", "left").withColumn("hevc", F.coalesce("hevc", F.lit(False)))
        return detect.plan_cuts(rows, self.keyframes(), F.col("hevc"), cuda, **options).drop("hevc")

    def segments(self, ranges: DataFrame, longest_us: int) -> DataFrame:
        """Packets of ranges of time, the end excluded. ranges (video_id, ..., start_us, end_us), of about longest_us at most (longer ones cost more, and lose nothing)."""
        return boundary.frames_in(self.packets, ranges, longest_us)

    def frames_at(self, points: DataFrame) -> DataFrame:
        """points (video_id, t_us, ...) with frame_us, the first packet at or after them; those after the last packet go."""
        more = tuple(c for c in points.columns if c not in ("video_id", "t_us"))
        near = align.neighbours(points, self.packets.where("t_us is not null").select("video_id", "t_us"), more)
        return near.where("k_at_or_after is not null").select(*points.columns, F.col("k_at_or_after").alias("frame_us"))

    def materialise(self, items: DataFrame) -> DataFrame:
        """detect.materialise(); an item's source is a path."""
        sources = self.facts.select(F.col("path").alias("source"), dims.is_hevc(F.col("codec")).alias("hevc"), "video_id")
        keys = self.keyframes().join(sources.select("source", "video_id"), "video_id").select("source", "t_us")
        return detect.materialise(items, sources.select("source", "hevc"), keys)
