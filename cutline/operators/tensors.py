"""Models of windows of frames, on frames as they come from a decoder.

A video is cut into blocks of whole strides. Each block gets a halo of the frames around it that its windows read, so frames at
a block's edge are copied once and all others not at all, and a block needs nothing else. Blocks are dealt one after the other
to the tasks, so one long video is as parallel as it has blocks; a task holds one block and a batch of windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_scores(frames: DataFrame, totals: DataFrame, model: Callable, shape: tuple[int, int, int], window: int = 100, stride: int = 50, block: int = 20, batch: int = 8, parts: int | None = None) -> DataFrame:
    """Scores of frames by a model of windows: model(windows x window x height x width x channels, uint8) -> windows x window; a frame's score is that of the window in whose middle it stands. The first and the last frame are repeated around the video.

    frames (video_id, i, px: bytes), totals (video_id, n: frames) -> video_id, i, score. block: strides of a block, batch:
    windows of a model call. A frame of another size than shape is an error.
    """
    pad, step = (window - stride) // 2, stride * block
    parts = parts or int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    i, n = F.col("i"), F.col("n")
    known = frames.select("video_id", "i", "px").join(totals.select("video_id", "n"), "video_id")
    first = F.greatest(F.lit(0), F.floor((i - (window - stride - pad)) / step))
    last = F.least(F.floor((n - 1) / step), F.floor((i + pad) / step))
    spread = known.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    dealt = spread.repartitionById(parts, F.pmod(F.xxhash64("video_id") + F.col("block"), F.lit(parts)).cast("int")).sortWithinPartitions("video_id", "block", "i")
    height, width, channels = shape

    def task(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def scored(video, number: int, total: int, at: list[int], px: list[bytes]):
            if at[-1] - at[0] + 1 != len(at):
                raise ValueError(f"frames of video {video} are missing or repeated near {at[0]}")
            held = np.frombuffer(b"".join(px), np.uint8).reshape(len(px), height, width, channels)
            start, end = number * step, min(total, (number + 1) * step)
            windows = range(start // stride, -(-end // stride))
            for a in range(0, len(windows), batch):
                some = windows[a : a + batch]
                places = np.clip(np.array([[w * stride - pad + k for k in range(window)] for w in some]), 0, total - 1)
                made = np.asarray(model(held[places - at[0]]))[:, pad : pad + stride].ravel()
                own = np.arange(some[0] * stride, min(some[-1] * stride + stride, total))
                yield pa.RecordBatch.from_arrays([pa.array([video] * len(own), kind), pa.array(own), pa.array(made[: len(own)].astype(float))], names=["video_id", "i", "score"])

        now, at, px, total, kind = None, [], [], 0, None
        for part in batches:
            kind = part.column(0).type
            for video, number, place, frame, n_ in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if (video, number) != now:
                    if now is not None:
                        yield from scored(*now, total, at, px)
                    now, at, px = (video, number), [], []
                total = n_
                at.append(place)
                px.append(frame)
        if now is not None:
            yield from scored(*now, total, at, px)

    kind = dict(frames.dtypes)["video_id"]
    return dealt.select("video_id", "block", "i", "px", "n").mapInArrow(task, f"video_id {kind}, i long, score double")
