"""Decoded video in files of records of one size, as a data source: `spark.read.format("raw_frames")`.

A file is a run of frames of height x width x channels bytes, as decoders pipe them; what is left behind the last whole
frame is ignored. Files are cut into ranges of frames, so one long video is read by many tasks, and a task holds one
block of frames. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Frames of a transition model: rows, columns, channels.
HEIGHT, WIDTH, CHANNELS = 27, 48, 3
#: Bytes that a task reads, and that it holds at a time.
SPLIT, HELD = 64 << 20, 1 << 20
MANIFEST = "_manifest.json"


def _system(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifest_of(system, root: str) -> list[dict] | None:
    """The files that a folder's manifest names, if it has one: what a job hasn't published isn't there."""
    from pyarrow import fs

    path = f"{root.rstrip('/')}/{MANIFEST}"
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of the file, or of the folder's files, in order."""
    from pyarrow import fs

    system, root = _system(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type != fs.FileType.File and (listed := manifest_of(system, root)) is not None:
        return [(x["path"], x["bytes"]) for x in listed]
    infos = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((x.path, x.size) for x in infos if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


@dataclass
class FrameRange(InputPartition):
    path: str
    first: int
    count: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        shape = [int(options.get(k, d)) for k, d in (("height", HEIGHT), ("width", WIDTH), ("channels", CHANNELS))]
        if min(shape) < 1:
            raise ValueError("height, width and channels must be at least 1")
        self.size = shape[0] * shape[1] * shape[2]
        self.split = int(options.get("split", SPLIT))
        self.most = int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[FrameRange]:
        step = max(1, self.split // self.size)
        out = []
        for path, size in _files(self.root):
            n = size // self.size if self.most is None else min(size // self.size, self.most)
            out += [FrameRange(path, at, min(step, n - at)) for at in range(0, n, step)]
        return out or [FrameRange("", 0, 0)]

    def read(self, partition: FrameRange) -> Iterator:
        import pyarrow as pa

        if not partition.count:
            return
        system, _ = _system(self.root)
        step = max(1, HELD // self.size)
        with system.open_input_file(partition.path) as f:
            for at in range(partition.first, partition.first + partition.count, step):
                n = min(step, partition.first + partition.count - at)
                block = f.read_at(n * self.size, at * self.size)
                frames = pa.Array.from_buffers(pa.binary(self.size), n, [None, pa.py_buffer(block)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array(range(at, at + n), pa.int64()), frames], names=["path", "i", "px"])


class RawFrames(DataSource):
    """path, i (from 0 in each file), px (the frame's bytes). Options: path, height, width, channels, split (bytes of a task), limit (frames of a file at most, as an estimate of their number cuts them off)."""

    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return "path string, i long, px binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_frames(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(RawFrames)
    return spark.read.format("raw_frames").options(**options).load(path)
