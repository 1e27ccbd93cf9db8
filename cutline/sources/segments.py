"""Segments as files: a sink that publishes all files of a job at once, and what reads them back.

`df.write.format("raw_segments")` takes rows (segment, px). Each task streams the frames of a segment into a staging file of
its own attempt. When every task has ended, the driver moves the files that the tasks it counts have reported to the job's
folder, and makes them visible by replacing one manifest. What a lost or repeated task has staged is in no report, so it is
never published and goes with the staging folder; if the job fails, all of it goes and the old manifest stays as it was.

Layout of a folder: _manifest.json (segments in order, with path, frames and bytes), job-<id>/<segment>.raw. Paths may be of
any file system that pyarrow opens; one that moves a file is enough.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .raw_frames import MANIFEST, _system, manifest_of, read_frames

SCHEMA = "segment string, px binary"
BLOCK = 256


@dataclass
class Staged(WriterCommitMessage):
    """(segment, staged path, frames, bytes) of what a task has written."""

    files: list[tuple[str, str, int, int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.system, self.root = _system(options["path"].rstrip("/"))
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.staging = f"{self.root}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        self.system.create_dir(f"{self.staging}/{attempt}")
        done: list[tuple[str, str, int, int]] = []
        names: set[str] = set()
        name, out, frames, size = None, None, 0, 0

        def close():
            if out is not None:
                out.close()
                done.append((name, path, frames, size))

        for batch in iterator:
            for segment, px in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if segment != name:
                    close()
                    if not segment or "/" in segment or segment in names:
                        raise ValueError(f"not a segment's name, or not in one piece: {segment!r}")
                    names.add(segment)
                    name, frames, size = segment, 0, 0
                    path = f"{self.staging}/{attempt}/{segment}.raw"
                    out = self.system.open_output_stream(path)
                out.write(px or b"")
                frames, size = frames + 1, size + len(px or b"")
        close()
        return Staged(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        staged = [f for m in messages if m is not None for f in m.files]
        names = [f[0] for f in staged]
        before = [] if self.overwrite else (manifest_of(self.system, self.root) or [])
        if len(set(names)) < len(names) or set(names) & {x["segment"] for x in before}:
            self.abort(messages)
            raise ValueError("a segment was written twice: deal its frames to one task, and choose new names when appending")
        folder = f"{self.root}/job-{self.job}"
        self.system.create_dir(folder)
        made = []
        for segment, path, frames, size in staged:
            target = f"{folder}/{segment}.raw"
            self.system.move(path, target)
            made.append({"segment": segment, "path": target, "frames": frames, "bytes": size})
        old = manifest_of(self.system, self.root) or []
        with self.system.open_output_stream(f"{self.staging}/{MANIFEST}") as f:
            f.write(json.dumps(before + sorted(made, key=lambda x: x["segment"])).encode())
        # from here on readers see the new segments, and all of them
        self.system.move(f"{self.staging}/{MANIFEST}", f"{self.root}/{MANIFEST}")
        self.system.delete_dir(self.staging)
        if self.overwrite:
            for gone in {os.path.dirname(x["path"]) for x in old}:
                self.system.delete_dir(gone)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        if self.system.get_file_info(self.staging).type != fs.FileType.NotFound:
            self.system.delete_dir(self.staging)


class RawSegments(DataSource):
    """Sink of rows (segment: a file's name without its ending, px: a frame's bytes); the frames of a segment come one after the other. Option: path."""

    @classmethod
    def name(cls) -> str:
        return "raw_segments"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def write_segments(frames: DataFrame, segments: DataFrame, path: str, pattern: str = "%s_%04d", mode: str = "append", first: int = 0) -> None:
    """A file for each segment of each video.

    frames (video_id, i, px), segments (video_id, segment_index, first, last: frames, both included; they don't overlap).
    pattern: of the video and of the segment's number, which counts from `first`. Frames meet segments by blocks of BLOCK
    frames, of which Spark broadcasts few, and are shuffled by segment, the unit of work: a segment's frames are streamed,
    never held.
    """
    spans = segments.select("video_id", "segment_index", "first", "last", F.explode(F.sequence(F.expr(f"first div {BLOCK}"), F.expr(f"last div {BLOCK}"))).alias("_b"))
    met = frames.withColumn("_b", F.expr(f"i div {BLOCK}")).join(spans, ["video_id", "_b"]).where("i between first and last")
    dealt = met.repartition("video_id", "segment_index").sortWithinPartitions("video_id", "segment_index", "i")
    frames.sparkSession.dataSource.register(RawSegments)
    name = F.format_string(pattern, F.col("video_id").cast("string"), F.col("segment_index") + first)
    dealt.select(name.alias("segment"), "px").write.format("raw_segments").mode(mode).option("path", path).save()


def read_segments(spark: SparkSession, path: str, **options) -> DataFrame:
    """The frames of all published segments: segment, path, i (from 0 in each), px. options: those of raw_frames."""
    return read_frames(spark, path, **options).select(F.regexp_extract("path", r"([^/]+)\.raw$", 1).alias("segment"), "path", "i", "px")


def cut_ranges(cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """Cuts at frames as segments. cuts (video_id, i: first frame of a new segment), totals (video_id, n: frames) -> video_id, segment_index, first, last. Cuts outside of the video are none."""
    starts = cuts.select("video_id", "i").unionByName(totals.select("video_id", F.lit(0).cast("long").alias("i"))).distinct().join(totals, "video_id").where("i >= 0 and i < n")
    w = W.partitionBy("video_id").orderBy("i")
    return starts.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("segment_index"), F.col("i").alias("first"), (F.coalesce(F.lead("i").over(w), F.col("n")) - 1).alias("last"))
