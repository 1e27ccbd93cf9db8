"""Operators on ordered streams as Structured Streaming: one small state for each key, in the RocksDB state store.

greedy() and monotone() take input in time order for each key, or sort it within a micro-batch; what arrives late in a later
batch is judged against the state as it then is (a late boundary is dropped by the greedy fold). in_time() and what is made
of it wait for the watermark, so that events in any order give what a batch gives. State grows with the number of keys
only, except for ordered emission, which holds what waits for its turn.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions import text
from ..sources.log_lines import read_lines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _LastKept(StatefulProcessor):
    """Keeps a value of state: the last one passed on. pick(value, last) says whether a value is passed on."""

    def __init__(self, column: str, pick):
        self.column, self.pick = column, pick

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("v", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for pdf in sorted((r for part in rows for r in part[self.column].tolist())):
            if last is None or self.pick(pdf, last):
                last = pdf
                out.append(pdf)
        if out:
            self.last.update((last,))
        yield pd.DataFrame({"video_id": [key[0]] * len(out), self.column: out})

    def close(self) -> None:
        pass


def _run(events: DataFrame, column: str, pick) -> DataFrame:
    schema = f"video_id long, {column} long"
    return events.select("video_id", column).groupBy("video_id").transformWithStateInPandas(_LastKept(column, pick), schema, "append", "None")


def greedy(events: DataFrame, least_us: int, column: str = "t_us") -> DataFrame:
    """Times at least `least_us` after the last one passed on: merged boundaries, or throttled progress."""
    return _run(events, column, lambda value, last: value - last >= least_us)


def monotone(events: DataFrame, column: str) -> DataFrame:
    """Values above all before."""
    return _run(events, column, lambda value, last: value > last)


class _InOrder(StatefulProcessor):
    """Passes positions on without gaps: a position waits until all before it have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", StructType([StructField("v", LongType())]))
        self.waits = handle.getListState("waits", StructType([StructField("v", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        at = self.next.get()[0] if self.next.exists() else 0
        held = {r[0] for r in self.waits.get()} | {p for part in rows for p in part["pos"].tolist() if p >= at}
        out = []
        while at in held:
            held.remove(at)
            if at:
                out.append(at - 1)
            at += 1
        self.next.update((at,))
        self.waits.clear()
        if held:
            self.waits.put([(p,) for p in sorted(held)])
        yield pd.DataFrame({"video_id": [key[0]] * len(out), "a": out})

    def close(self) -> None:
        pass


def ordered_pairs(ready: DataFrame) -> DataFrame:
    """ready (video_id, pos) in any order -> pairs (a, a + 1) as soon as all positions up to a + 1 are there."""
    return ready.select("video_id", "pos").groupBy("video_id").transformWithStateInPandas(_InOrder(), "video_id long, a long", "append", "None")


class _Windows(StatefulProcessor):
    """Frames in, windows out: the first frame stands `pad` times before itself; after the one marked last it is repeated as often as the last window needs. State: the frames of a window that isn't full."""

    def __init__(self, window: int, stride: int):
        self.window, self.stride, self.pad = window, stride, (window - stride) // 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", StructType([StructField("v", DoubleType())]))
        self.counts = handle.getValueState("counts", StructType([StructField("seen", LongType()), StructField("made", LongType())]))

    def handleInputRows(self, key, rows, timerValues):
        seen, made = self.counts.get() if self.counts.exists() else (0, 0)
        held, out = [r[0] for r in self.held.get()], []
        for i, value, last in sorted(r for part in rows for r in zip(part["i"].tolist(), part["value"].tolist(), part["last"].tolist(), strict=True)):
            held += [value] * (self.pad + 1 if seen == 0 else 1)
            seen += 1
            if last:
                rest = seen % self.stride or self.stride
                held += [value] * (self.pad + self.stride - rest)
            while len(held) >= self.window:
                out.append((made, held[: self.window], min(self.stride, seen - made * self.stride) if last else self.stride))
                held, made = held[self.stride :], made + 1
        self.counts.update((seen, made))
        self.held.clear()
        if held:
            self.held.put([(v,) for v in held])
        yield pd.DataFrame({"video_id": [key[0]] * len(out), "w": [x[0] for x in out], "frames": [x[1] for x in out], "scored": [x[2] for x in out]})

    def close(self) -> None:
        pass


def sliding_windows(frames: DataFrame, window: int = 100, stride: int = 50) -> DataFrame:
    """frames (video_id, i, value: double, last: is it the video's last?) -> video_id, w, frames (of the window), scored (how many frames the window answers for), as soon as a window is full."""
    schema = "video_id long, w long, frames array<double>, scored long"
    return frames.select("video_id", "i", "value", "last").groupBy("video_id").transformWithStateInPandas(_Windows(window, stride), schema, "append", "None")


def log_tail(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The lines that are added to a log file, or to the files of a folder, each once and when it is whole: path, at, line, message (without its prefix), percent, done, error. Empty lines are left out. options: those of log_lines."""
    lines = read_lines(spark, folder, **options).where("line <> ''")
    line = F.col("line")
    return lines.select("path", "at", "line", text.log_message(line).alias("message"), F.when(text.progress(line) > 100, 100.0).otherwise(text.progress(line)).alias("percent"), text.completed(line).alias("done"), text.error(line).alias("error"))


class _Progress(StatefulProcessor):
    """State: the greatest percentage so far, and whether the work counts as done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("percent", DoubleType()), StructField("done", BooleanType())]))

    def handleInputRows(self, key, rows, timerValues):
        most, done = self.state.get() if self.state.exists() else (-1.0, False)
        out = []
        for at, percent, says_done, error in sorted(r for part in rows for r in zip(part["at"].tolist(), part["percent"].tolist(), part["done"].tolist(), part["error"].tolist(), strict=True)):
            rises = percent is not None and percent > most
            now_done = done or bool(says_done) or (rises and percent >= 99.5)
            if rises or now_done != done or error is not None:
                most = percent if rises else most
                done = now_done
                out.append((key[0], at, percent if rises else None, done, error))
        self.state.update((most, done))
        yield pd.DataFrame(out, columns=["path", "at", "percent", "done", "error"])

    def close(self) -> None:
        pass


def log_progress(lines: DataFrame) -> DataFrame:
    """What a log's reader is told: path, at, percent (where it rises), done (from 99.5 on, or where a line says so), error. lines: log_tail()."""
    return lines.select("path", "at", "percent", "done", "error").groupBy("path").transformWithStateInPandas(_Progress(), "path string, at long, percent double, done boolean, error string", "append", "None")


class _InTime(StatefulProcessor):
    """Rows of a key are held until the watermark has passed them, and then folded in the order of their times: fold(state, row) -> (state, row out or None). States and rows are JSON texts in the store."""

    def __init__(self, names: list[str], order: list[int], fold: Callable, out: list[str]):
        self.names, self.order, self.fold, self.out = names, order, fold, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text_ = StructType([StructField("v", StringType())])
        self.held, self.state = handle.getListState("held", text_), handle.getValueState("state", text_)

    def _release(self, key, upto_ms: int) -> pd.DataFrame:
        rows = [json.loads(r[0]) for r in self.held.get()]
        ready = sorted((r for r in rows if r[0] // 1000 <= upto_ms), key=lambda r: [r[i] for i in self.order])
        waits = [r for r in rows if r[0] // 1000 > upto_ms]
        state = json.loads(self.state.get()[0]) if self.state.exists() else None
        out = []
        for r in ready:
            state, made = self.fold(state, dict(zip(self.names, r, strict=True)))
            if made is not None:
                out.append((key[0], *made))
        if ready:
            self.state.update((json.dumps(state),))
        self.held.clear()
        if waits:
            self.held.put([(json.dumps(r),) for r in waits])
            self.handle.registerTimer(min(r[0] for r in waits) // 1000 + 1)
        return pd.DataFrame(out, columns=["video_id", *self.out])

    def handleInputRows(self, key, rows, timerValues):
        mark = timerValues.getCurrentWatermarkInMs()
        first = None
        for part in rows:
            for r in zip(*(part[c].tolist() for c in self.names), strict=True):
                r = [None if isinstance(x, float) and x != x else x for x in r]
                self.held.appendValue((json.dumps(r),))
                first = r[0] if first is None else min(first, r[0])
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, mark + 1))
        yield pd.DataFrame([], columns=["video_id", *self.out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def in_time(events: DataFrame, order: list[str], columns: list[str], fold: Callable, out: str, late: str = "10 seconds") -> DataFrame:
    """events (video_id, ts_us, ...) folded by video in the order of time, whatever micro-batch they come in, as a batch over all of them would: fold(state, row as a dict) -> (state, tuple of the columns of `out`, or None).

    Rows wait until the watermark, `late` behind the newest time of all videos, has passed them; what comes later than that
    is dropped. State: the rows that wait, and the fold's own (JSON values). order: of the columns, time first.
    """
    names = ["ts_us", *[c for c in columns if c != "ts_us"]]
    marked = events.select("video_id", *names, F.timestamp_micros("ts_us").alias("_ts")).withWatermark("_ts", late)
    processor = _InTime(names, [names.index(c) for c in order], fold, [c.split()[0] for c in out.split(", ")])
    return marked.groupBy("video_id").transformWithStateInPandas(processor, f"video_id long, {out}", "append", "EventTime", eventTimeColumnName="")


def previews(events: DataFrame, value: str, least: float, late: str = "10 seconds") -> DataFrame:
    """emission.previews() of a stream: events (video_id, ts_us, seq, value) -> video_id, ts_us, seq, value, number, slot."""

    def fold(state, r):
        if state is not None and r[value] - state[0] < least:
            return state, None
        n = (state[1] if state else 0) + 1
        return [r[value], n], (r["ts_us"], r["seq"], r[value], n, n % 2)

    return in_time(events, ["ts_us", "seq"], ["ts_us", "seq", value], fold, f"ts_us long, seq long, {value} double, number long, slot long", late)


def presence(events: DataFrame, detail: str, least_us: int, late: str = "10 seconds") -> DataFrame:
    """emission.changed_or_due() of a stream: events (video_id, ts_us, seq, detail)."""

    def fold(state, r):
        if state is not None and r["ts_us"] - state[0] < least_us and r[detail] == state[1]:
            return state, None
        return [r["ts_us"], r[detail] or ""], (r["ts_us"], r["seq"], r[detail])

    return in_time(events, ["ts_us", "seq"], ["ts_us", "seq", detail], fold, f"ts_us long, seq long, {detail} string", late)


def stable(polls: DataFrame, value: str, times: int, late: str = "10 seconds") -> DataFrame:
    """emission.stable() of a stream: polls (video_id, ts_us, i, value) -> video_id, stable_at, once for each video."""

    def fold(state, r):
        last, run, done = state or [None, 0, False]
        run = run + 1 if r[value] is not None and r[value] > 0 and r[value] == last else 0
        now = not done and run >= times
        return [r[value], run, done or now], ((r["i"],) if now else None)

    return in_time(polls, ["ts_us", "i"], ["ts_us", "i", value], fold, "stable_at long", late)


class ProgressListener(StreamingQueryListener):
    """Samples of a query's progress: rows in and rows a second, batch by batch; the newest `most` are kept."""

    def __init__(self, most: int = 1000):
        self.samples: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.samples.append((p.batchId, p.numInputRows, p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
