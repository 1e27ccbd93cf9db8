"""Packets of videos in files with an index, as a data source that reads what a filter asks for: `spark.read.format("packets")`.

A file holds a video's packets as records of one size, in blocks, and behind them a copy of the records of keyframes and an
index: for each block its time range, and where its keyframes stand in that copy. The last bytes say where the index is.
Filters on is_key and on the time are taken over: blocks outside of the time range are never read, and for keyframes alone
the copy is read in place of the blocks. Spark needs `spark.sql.python.filterPushdown.enabled` for that; read_packets() sets it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from .raw_frames import _files, _system

#: A record: number, presentation time, decoding time, is it a keyframe? A missing time is the least number.
RECORD = [("seq", "<i8"), ("pts", "<i8"), ("dts", "<i8"), ("key", "u1")]
SIZE, NONE = 25, -(1 << 63)
#: Records of a block.
BLOCK = 4096
MAGIC = b"PKTS"
SCHEMA = "video string, seq long, pts_us long, dts_us long, t_us long, is_key boolean"


def write_packets(packets: DataFrame, path: str, block: int = BLOCK) -> None:
    """A file for each video: packets (video_id, seq, pts_us, dts_us, is_key), in the order of seq. One shuffle by video; a task holds a block, and the keyframes of a video. A file appears when it is whole; a repeated task writes it again."""

    def task(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, root = _system(path.rstrip("/"))
        system.create_dir(root, recursive=True)
        made: list[tuple[str, int]] = []

        def file(video, rows: Iterator[tuple]) -> None:
            temporary, held, keys, index, count, n_keys = f"{root}/_{video}.part", [], [], [], 0, 0
            with system.open_output_stream(temporary) as out:

                def flush() -> None:
                    nonlocal count, n_keys
                    block_ = np.array(held, dtype=RECORD)
                    t = np.where(block_["pts"] == NONE, block_["dts"], block_["pts"])
                    own = block_[block_["key"] > 0]
                    known = t[t != NONE]
                    index.append([count, len(held), n_keys, len(own), int(known.min()) if len(known) else None, int(known.max()) if len(known) else None])
                    out.write(block_.tobytes())
                    keys.append(own.tobytes())
                    count, n_keys = count + len(held), n_keys + len(own)
                    held.clear()

                for row in rows:
                    held.append(row)
                    if len(held) >= block:
                        flush()
                if held:
                    flush()
                out.write(b"".join(keys))
                tail = json.dumps({"records": count, "keys": n_keys, "blocks": index}).encode()
                out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
            system.move(temporary, f"{root}/{video}.packets")
            made.append((str(video), count))

        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        from itertools import groupby

        for video, rows in groupby(rows_of(), key=lambda r: r[0]):
            file(video, ((s, NONE if p is None else p, NONE if d is None else d, bool(k)) for _, s, p, d, k in rows))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["video", "n"])

    dealt = packets.select(F.col("video_id").cast("string"), "seq", "pts_us", "dts_us", "is_key").repartition("video_id").sortWithinPartitions("video_id", "seq")
    dealt.mapInArrow(task, "video string, n long").agg(F.sum("n")).collect()


@dataclass
class Records(InputPartition):
    """What a task reads: (path, first byte, records), of one file or of many small ones."""

    pieces: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.trace = options["path"], options.get("trace")
        self.split = int(options.get("split", 1 << 20))
        self.keys_only, self.low, self.high = False, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """is_key is answered whole, times by block: those are passed on to Spark too."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, EqualTo) and name == ("is_key",) and f.value is True:
                self.keys_only = True
                continue
            if name == ("t_us",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
            if isinstance(f, IsNotNull) and name == ("is_key",):
                continue
            yield f

    def _read(self, f, at: int, n: int) -> bytes:
        if self.trace:
            with open(self.trace, "a") as out:
                out.write(f"{n}\n")
        return f.read_at(n, at)

    def partitions(self) -> list[Records]:
        pieces, step = [], max(1, self.split // SIZE)
        system, _ = _system(self.root)
        for path, size in _files(self.root):
            with system.open_input_file(path) as f:
                end = self._read(f, size - 12, 12)
                if end[8:] != MAGIC:
                    raise ValueError(f"not a file of packets: {path}")
                n = int.from_bytes(end[:8], "little")
                index = json.loads(self._read(f, size - 12 - n, n))
            for first, count, first_key, n_keys, least, most in index["blocks"]:
                if (self.low is not None or self.high is not None) and (least is None or (self.high is not None and least > self.high) or (self.low is not None and most < self.low)):
                    continue
                at, count = (SIZE * (index["records"] + first_key), n_keys) if self.keys_only else (SIZE * first, count)
                if not count:
                    continue
                # blocks that follow each other are read as one
                if pieces and pieces[-1][0] == path and pieces[-1][1] + SIZE * pieces[-1][2] == at and pieces[-1][2] + count <= step:
                    pieces[-1] = (path, pieces[-1][1], pieces[-1][2] + count)
                else:
                    pieces.append((path, at, count))
        out, held = [Records([])], 0
        for piece in pieces:
            if held and held + piece[2] > step:
                out.append(Records([]))
                held = 0
            out[-1].pieces.append(piece)
            held += piece[2]
        return out

    def read(self, partition: Records) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system, _ = _system(self.root)
        long = lambda x: pa.array(x.astype(np.int64), pa.int64(), mask=x == NONE)
        for path, at, count in partition.pieces:
            with system.open_input_file(path) as f:
                rows = np.frombuffer(self._read(f, at, SIZE * count), dtype=RECORD)
            t = np.where(rows["pts"] == NONE, rows["dts"], rows["pts"])
            video = path.rsplit("/", 1)[-1].removesuffix(".packets")
            yield pa.RecordBatch.from_arrays([pa.array([video] * len(rows)), pa.array(rows["seq"].astype(np.int64)), long(rows["pts"]), long(rows["dts"]), long(t), pa.array(rows["key"] > 0)], names=[f.split()[0] for f in SCHEMA.split(", ")])


class Packets(DataSource):
    """SCHEMA; t_us is the presentation time, or else the decoding time. Options: path, split (bytes of a task), trace (a local file that gets the bytes of each read, for tests)."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_packets(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Packets)
    return spark.read.format("packets").options(**options).load(path)
