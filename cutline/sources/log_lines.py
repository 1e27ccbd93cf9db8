"""Log files that grow, as a streaming data source: `spark.readStream.format("log_lines")`.

An offset holds for each file how many of its bytes have been read. A look takes what has been added since, up to the last
line feed: a line that is still being written waits for its end. A file that has become shorter was begun anew and is read
from its start; so is one that appears. A batch is planned from two offsets alone, so a batch that is run again after a
restart has the same lines. Offsets grow with the number of files, not with their sizes; bytes of a task are bounded by SPLIT
and cut at line ends. Paths may be of any file system that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .raw_frames import _files, _system

#: Bytes of a task, about, and bytes that are looked through at a time for a line's end.
SPLIT, LOOK = 32 << 20, 1 << 16


@dataclass
class Lines(InputPartition):
    path: str
    start: int
    end: int


def last_line_end(f, start: int, end: int) -> int:
    """The place behind the last line feed of a file's bytes start .. end - 1, or start."""
    while end > start:
        at = max(start, end - LOOK)
        found = f.read_at(end - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return start


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix, self.split = options["path"], options.get("suffix", ""), int(options.get("split", SPLIT))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        try:
            files = _files(self.root)
        except FileNotFoundError:
            files = []
        system, _ = _system(self.root)
        now = {}
        for path, size in files:
            if not path.endswith(self.suffix):
                continue
            before = self.seen.get(path, 0)
            if size < before:
                before = 0
            with system.open_input_file(path) as f:
                now[path] = last_line_end(f, before, size)
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        out = []
        for path, upto in sorted(end.items()):
            at = start.get(path, 0)
            at = 0 if upto < at else at
            out += [Lines(path, a, min(a + self.split, upto)) for a in range(at, upto, self.split)]
        self.seen = self.seen or dict(end)
        return out

    def read(self, partition: Lines) -> Iterator:
        """Lines that begin in the range; the last of them may end behind it."""
        system, _ = _system(self.root)
        with system.open_input_file(partition.path) as f:
            at = partition.start
            if at and f.read_at(1, at - 1) != b"\n":
                # the line that goes on here began in the range before
                rest = self._line(f, at)
                at += len(rest)
            while at < partition.end:
                block = f.read_at(min(1 << 20, partition.end - at), at)
                if not block:
                    return
                if not block.endswith(b"\n"):
                    block += self._line(f, at + len(block))
                for line in block.removesuffix(b"\n").split(b"\n"):
                    yield (partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace"))
                    at += len(line) + 1

    @staticmethod
    def _line(f, at: int) -> bytes:
        out = b""
        while more := f.read_at(LOOK, at + len(out)):
            end = more.find(b"\n")
            if end >= 0:
                return out + more[: end + 1]
            out += more
        return out

    def commit(self, end: dict) -> None:
        pass


class LogLines(DataSource):
    """path, at (byte of the file at which the line begins), line. Options: path (a file or folder), suffix (of the files' names), split (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def read_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of the lines that are added to a file, or to the files of a folder."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").options(**options).load(path)
