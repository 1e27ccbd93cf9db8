"""Keep/drop decisions along a sequence: smoothing, ranges, compaction, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boundary import by_video, runs

#: Motion in pixels, changed area, matches that follow one homography, and the shortest run of dead frames that is dropped.
FLOW, AREA, INLIER, CADENCE = 0.5, 0.15, 0.5, 3


def dead(mean_mag: Column, diff_fraction: Column, inlier_ratio: Column, frob_norm: Column, flow: Column, area: Column, inlier: float = INLIER, skip_homography: bool | Column = False, parallax: bool | Column = False) -> Column:
    """Is a frame a repeat of the one before? The rules apply in order: motion, camera movement, changed area; all strictly."""
    camera = ~F.lit(skip_homography) & (inlier_ratio > inlier) & F.coalesce(frob_norm > 1.0, F.lit(False))
    return F.when(mean_mag < flow, True).when(camera, ~F.lit(parallax)).otherwise(diff_fraction < area)


def _limits(flow: Column, area: Column, lock_flow: bool | Column | None, lock_area: bool | Column | None, of) -> tuple[Column, Column]:
    """Thresholds from the 20 % and 15 % percentiles of a video's statistics, where they aren't locked; of(aggregate, column) finds a video's value."""
    lock_flow, lock_area = flow < 0.1 if lock_flow is None else lock_flow, area < 0.01 if lock_area is None else lock_area
    clamp = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    enough = lambda c, lock: (of(F.count, c) >= 2) & ~F.lit(lock)
    share = lambda c, p: of(lambda x: F.percentile(x, p), c)
    return (
        F.when(enough("mean_mag", lock_flow), clamp(share("mean_mag", 0.2) * 0.6, 0.2, 2.0)).otherwise(flow),
        F.when(enough("diff_fraction", lock_area), clamp(share("diff_fraction", 0.15) * 0.4, 0.03, 0.25)).otherwise(area),
    )


def calibrate(stats: DataFrame, flow: float = FLOW, area: float = AREA, lock_flow: bool | None = None, lock_area: bool | None = None, sample: int = 0) -> DataFrame:
    """video_id, flow, area from exact percentiles of a video's statistics, of its first `sample` ones if above 0.

    The given thresholds stay with fewer than two values, or if locked: by default those below 0.1 and 0.01. An exact
    percentile holds the distinct values of one video in a task.
    """
    if sample:
        stats = stats.withColumn("_n", F.row_number().over(by_video("i"))).where(F.col("_n") <= sample)
    own_flow, own_area = _limits(F.lit(flow), F.lit(area), lock_flow, lock_area, lambda f, c: f(F.col(c)))
    return stats.groupBy("video_id").agg(own_flow.alias("flow"), own_area.alias("area"))


def with_limits(stats: DataFrame, flow: Column, area: Column, lock_flow: bool | Column | None = None, lock_area: bool | Column | None = None, sample: int = 0) -> DataFrame:
    """stats with the thresholds of calibrate() beside each row: one shuffle by video and no join, and what follows by video reuses it."""
    first = (F.col("_n") <= sample) if sample else F.lit(True)
    w = W.partitionBy("video_id")
    own_flow, own_area = _limits(flow, area, lock_flow, lock_area, lambda f, c: f(F.when(first, F.col(c))).over(w))
    rows = stats.withColumn("_n", F.row_number().over(by_video("i"))) if sample else stats
    return rows.withColumns({"flow": own_flow, "area": own_area}).drop("_n")


def smooth(decisions: DataFrame, cadence: int) -> DataFrame:
    """Runs of dropped frames shorter than the cadence are kept; without a cadence nothing changes. decisions (video_id, i, keep)."""
    if cadence <= 0:
        return decisions
    length = F.count("*").over(W.partitionBy("video_id", "run"))
    return runs(decisions, F.col("keep")).withColumn("keep", F.col("keep") | (length < cadence)).drop("flag", "run")


def keep_ranges(decisions: DataFrame) -> DataFrame:
    """Runs of kept frames: video_id, range_index, first, last (included)."""
    found = runs(decisions, F.col("keep")).where("flag").groupBy("video_id", "run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return found.select("video_id", (F.row_number().over(by_video("first")) - 1).cast("long").alias("range_index"), "first", "last")


def keep_segments(decisions: DataFrame, fps: float) -> DataFrame:
    """Runs of kept frames in seconds; the end is excluded."""
    return keep_ranges(decisions).select("video_id", F.col("range_index").alias("segment_index"), (F.col("first") / fps).alias("start_sec"), ((F.col("last") + 1) / fps).alias("end_sec"))


def compact(decisions: DataFrame, fps: float) -> DataFrame:
    """Kept frames numbered again without gaps, at a constant rate."""
    new = F.row_number().over(by_video("i")) - 1
    return decisions.where("keep").select("video_id", "i", new.cast("long").alias("new_i"), (new / fps).alias("new_sec"))


def min_max_bytes(value: str, key: str) -> Column:
    """A value scaled to 0..255 by the least and greatest of its key, cut to whole numbers; 0 where they are equal."""
    w = W.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.floor((F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 255), F.lit(0)).cast("long")


def expand(frames: DataFrame, factor: int) -> DataFrame:
    """Linear interpolation by a factor: between each two frames factor - 1 more. frames (video_id, i, score) -> video_id, out_i, alpha, score.

    The blend stands in for a model; blend_slot() takes one.
    """
    after = F.lead("score").over(by_video("i"))
    rows = frames.withColumn("next", after)
    steps = F.when(F.col("next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    rows = rows.withColumn("k", F.explode(steps)).withColumn("alpha", F.col("k") / factor)
    score = F.when(F.col("k") == 0, F.col("score")).otherwise(F.col("score") * (1 - F.col("alpha")) + F.col("next") * F.col("alpha"))
    return rows.select("video_id", (F.col("i") * factor + F.col("k")).alias("out_i"), "alpha", score.alias("score"))


def blend_slot(frames: DataFrame, factor: int, model) -> DataFrame:
    """expand() with a model in place of the blend: model(a, b, alpha) on numpy arrays of a batch."""
    after = F.lead("score").over(by_video("i"))
    steps = F.when(F.col("next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    rows = frames.withColumn("next", after).withColumn("k", F.explode(steps)).select("video_id", "i", "score", "next", "k")

    def run(batches):
        for pdf in batches:
            alpha = pdf["k"] / factor
            made = model(pdf["score"].to_numpy(), pdf["next"].fillna(pdf["score"]).to_numpy(), alpha.to_numpy())
            yield pdf.assign(out_i=pdf["i"] * factor + pdf["k"], alpha=alpha, score=made)[["video_id", "out_i", "alpha", "score"]]

    return rows.mapInPandas(run, "video_id long, out_i long, alpha double, score double")


def frame_slot(frames: DataFrame, model, pixels: str = "px", size: str = "array<double>") -> DataFrame:
    """Frames through a model of arrays, one Arrow batch at a time: model(n x k) -> n x m. The place for upscaling, depth or flow networks; other columns pass."""
    kinds = [(c, size if c == pixels else t) for c, t in frames.dtypes]

    def run(batches):
        import numpy as np

        for pdf in batches:
            if len(pdf):
                pdf = pdf.assign(**{pixels: list(model(np.stack(pdf[pixels].to_numpy())))})
            yield pdf

    return frames.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in kinds))


def pair_slot(frames: DataFrame, factor: int, model, height: int, width: int, multiple: int = 8) -> DataFrame:
    """expand() for images, with a model: model(a, b, alpha) on arrays n x height x width, padded with zeros to a multiple and cut back. frames (video_id, i, px) -> video_id, out_i, alpha, px."""
    after = F.lead("px").over(by_video("i"))
    steps = F.when(F.col("next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    rows = frames.withColumn("next", after).withColumn("k", F.explode(steps)).select("video_id", "i", "px", F.when(F.col("k") > 0, F.col("next")).alias("next"), "k")

    def run(batches):
        import numpy as np

        pad = lambda x: np.pad(np.stack(x.to_numpy()).reshape(-1, height, width), ((0, 0), (0, -height % multiple), (0, -width % multiple)))
        for pdf in batches:
            between = pdf["k"].to_numpy() > 0
            px = list(pdf["px"])
            if between.any():
                own = pdf[between]
                made = np.asarray(model(pad(own["px"]), pad(own["next"]), own["k"].to_numpy() / factor))[:, :height, :width].reshape(len(own), -1)
                for at, row in zip(np.flatnonzero(between), made, strict=True):
                    px[at] = row
            yield pdf.assign(out_i=pdf["i"] * factor + pdf["k"], alpha=pdf["k"] / factor, px=px)[["video_id", "out_i", "alpha", "px"]]

    return rows.mapInPandas(run, "video_id long, out_i long, alpha double, px array<double>")


def chain(frames: DataFrame, steps: list, keep: bool = False) -> DataFrame:
    """Operations one after the other, each on what the one before made; with keep, each on the frames given, and all results as one, with the operation's number."""
    if not keep:
        for step in steps:
            frames = frames.transform(step)
        return frames
    made = [frames.transform(step).withColumn("operation", F.lit(n)) for n, step in enumerate(steps)]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
