"""The library surface: whole detections as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import cosine
from ..operators import align, boundary, planning, runs, selection

METHODS = ("keyframe", "scores", "edges")


def window_scores(frames: DataFrame, model, window: int = 100, stride: int = 50) -> DataFrame:
    """Transition scores from a model of windows: model(n x window array) -> n x window scores; a frame's score is that of the window in whose middle it stands.

    frames (video_id, i, feature: double) -> video_id, i, score. Windows are groups of rows, so a video is as parallel as it has windows.
    """
    seen = boundary.sliding_windows(frames.select("video_id", "i", "feature"), window, stride)

    def score(pdf):
        pdf = pdf.sort_values("slot")
        pdf["score"] = model(pdf["feature"].to_numpy()[None, :])[0]
        return pdf.loc[pdf["scored"], ["video_id", "i", "score"]]

    return seen.groupBy("video_id", "w").applyInPandas(score, "video_id long, i long, score double")


def detect_scenes(packets: DataFrame, method: str = "keyframe", threshold: float = 0.5, least_us: int = 500_000, radius_us: int = 2_000_000, model=None) -> DataFrame:
    """Scenes of each video.

    packets (video_id, t_us, is_key, i, score). keyframe: cuts at keyframes; scores: runs of low transition scores, those
    of `model` over windows of the column feature if it is given; edges: scans around keyframes for changes of the
    column edges (an array: pooled edge images by cosine, empty ones skipped) or else of the score. -> video_id,
    scene_index, and start/end in us, or in frames for scores.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    if method == "scores":
        return boundary.score_scenes(window_scores(packets, model) if model else packets, threshold)
    keys = packets.where(F.col("is_key") & F.col("t_us").isNotNull()).select("video_id", "t_us").distinct()
    totals = packets.groupBy("video_id").agg(F.max("t_us").alias("total_us"))
    if method == "keyframe":
        return boundary.pack_scenes(boundary.keyframe_cuts(keys, least_us), totals.withColumnRenamed("total_us", "duration_us"), least_us)
    if "edges" in packets.columns:
        usable = F.exists("edges", lambda x: x != 0)
        feature, apart = F.col("edges"), F.abs(1 - cosine(F.col("feature"), F.col("before")))
    else:
        usable, feature, apart = F.col("score").isNotNull(), F.col("score"), F.abs(F.col("feature") - F.col("before"))
    frames = packets.select("video_id", "t_us", feature.alias("feature"), F.coalesce(usable, F.lit(False)).alias("usable"))
    scanned = boundary.join_windows(frames, boundary.windows_of(keys, radius_us), 2 * radius_us)
    return boundary.bounds_to_scenes(boundary.window_cuts(scanned, apart, threshold, least_us), totals)


def keyframe_times(packets: DataFrame, decoded: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """Keyframe times of each video, from its packets, or from its decoded keyframes where those of the packets are pathological. packets, decoded (video_id, t_us), durations (video_id, duration_us) -> video_id, t_us, decoded."""
    videos = packets.select("video_id").union(decoded.select("video_id")).distinct()
    known = videos.withColumn("duration_us", F.lit(0).cast("long")) if durations is None else videos.join(durations.select("video_id", "duration_us"), "video_id", "left")
    verdict = boundary.pathological(packets, known).select("video_id", "pathological")
    either = packets.select("video_id", "t_us", F.lit(False).alias("decoded")).unionByName(decoded.select("video_id", "t_us", F.lit(True).alias("decoded")))
    return either.join(verdict, "video_id").where((F.col("decoded") == F.col("pathological")) & (F.col("t_us") >= 0)).select("video_id", "t_us", "decoded").distinct()


def keyframe_summary(keys: DataFrame) -> DataFrame:
    """Keyframes of each video: number and average gap in seconds (null for one). keys (video_id, t_us)."""
    g = keys.groupBy("video_id").agg(F.count("*").alias("n"), (F.max("t_us") - F.min("t_us")).alias("span"))
    return g.select("video_id", "n", F.bround(F.try_divide("span", F.col("n") - 1) / 1e6, 3).alias("average_gap"))


def list_scenes(scenes: DataFrame, least_us: int = 0) -> DataFrame:
    """Scenes of at least a duration, under their own numbers."""
    return scenes.where(F.col("end_us") - F.col("start_us") >= least_us) if least_us > 0 else scenes


def plan_cuts(scenes: DataFrame, keys: DataFrame, hevc: bool | Column = False, cuda: bool | Column = False, within_us: int = 200_000, snap_us: int = 5_000_000) -> DataFrame:
    """Each scene with how it is cut, and from where. scenes (video_id, scene_index, start_us, end_us, ...); hevc and cuda may be columns of it. -> video_id, scene_index, start_us, end_us, mode, ..."""
    more = tuple(c for c in scenes.columns if c not in ("video_id", "scene_index", "start_us", "end_us"))
    points = scenes.select("video_id", "scene_index", "end_us", *more, F.col("start_us").alias("t_us"))
    near = align.neighbours(points, keys, ("scene_index", "end_us", *more))
    t = F.col("t_us")
    on_key = F.coalesce(t - F.col("k_before") <= within_us, F.lit(False)) | F.coalesce(F.col("k_at_or_after") - t <= within_us, F.lit(False))
    snap = align.earlier_snap(t, F.col("k_at_or_before"), F.col("k_after"), snap_us, F.col("end_us"))
    mode = align.cut_mode(t, F.col("end_us"), on_key, snap, F.col("k_after"), F.lit(hevc), F.lit(cuda))
    rows = near.withColumn("mode", mode).withColumn("snap", snap)
    return rows.select("video_id", "scene_index", F.when(F.col("mode") == "snapped_copy", F.col("snap")).otherwise(t).alias("start_us"), "end_us", "mode", *more)


def dead_frames(stats: DataFrame, auto: bool = False, flow: float = runs.FLOW, area: float = runs.AREA, keep_talking: bool = False, keep_camera: bool = False, safe: bool = False, small_movements: float | None = None, sample: int = 0, **rule) -> DataFrame:
    """Decisions for each frame: video_id, i, keep. stats (video_id, i from 1, mean_mag, diff_fraction, inlier_ratio, frob_norm); frame 0 is kept.

    The flags mean what planning.detector_options says; sample: how many of a video's first statistics are used for its
    thresholds (0: all). The statistics are read once, and dealt by video once.
    """
    flags = map(F.lit, (flow, area, keep_talking, keep_camera, safe, auto))
    options = planning.detector_options(*flags, F.lit(small_movements).cast("double"))
    if auto or keep_talking or keep_camera or safe:
        rows = runs.with_limits(stats, options["flow"], options["area"], options["lock_flow"], options["lock_area"], sample)
    else:
        rows = stats.withColumns({"flow": options["flow"], "area": options["area"]})
    is_dead = runs.dead(*[F.col(c) for c in ("mean_mag", "diff_fraction", "inlier_ratio", "frob_norm", "flow", "area")], **{"skip_homography": options["skip_homography"], **rule})
    own = F.struct(F.col("i").cast("long").alias("i"), (~is_dead).alias("keep"))
    zero = F.struct(F.lit(0).cast("long").alias("i"), F.lit(True).alias("keep"))
    head = F.row_number().over(boundary.by_video("i")) == 1
    return rows.withColumn("_d", F.when(head, F.array(zero, own)).otherwise(F.array(own))).select("video_id", F.inline("_d"))


def drop_dead_frames(stats: DataFrame, fps: float, auto: bool = False, cadence: int = runs.CADENCE, **options) -> DataFrame:
    """Kept frames as segments, by dead_frames()."""
    return runs.keep_segments(runs.smooth(dead_frames(stats, auto, **options), cadence), fps)


def dead_frame_outcome(decisions: DataFrame, fps: float) -> DataFrame:
    """What becomes of each video: video_id, total, kept, dropped, copied (nothing is dropped, or at most one frame would be left: the input is taken as it is), duration_after (of the segments). decisions (video_id, i, keep): smoothed."""
    g = decisions.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if("keep").alias("kept"))
    dropped = F.col("total") - F.col("kept")
    return g.select("video_id", "total", "kept", dropped.alias("dropped"), ((dropped == 0) | (F.col("kept") <= 1)).alias("copied"), (F.col("kept") / fps).alias("duration_after"))


def materialise(items: DataFrame, sources: DataFrame, keys: DataFrame) -> DataFrame:
    """How each item of a batch becomes a clip of its own; one that can't says why, and the others go on.

    items (item, clip, thumbnail, source, start_us, end_us): a clip that is there is copied, else a range of a source is
    cut. sources (source, hevc), keys (source, t_us) are asked for the sources in use only. -> item, how (copied, a mode
    of align.cut_mode, or null), start_us, poster (there, first_keyframe, first_frame), error.
    """
    has_clip = F.coalesce(F.col("clip") != "", F.lit(False))
    named = F.coalesce(F.col("source") != "", F.lit(False))
    kinds = sources.groupBy(F.col("source").alias("_source")).agg(F.bool_or(F.coalesce("hevc", F.lit(False))).alias("hevc"))
    known = items.join(kinds, F.col("source") == F.col("_source"), "left")
    span = F.col("start_us").isNotNull() & F.col("end_us").isNotNull()
    why = F.when(~named, "no source").when(F.col("hevc").isNull(), "unknown source").when(~span, "no range").when(F.col("end_us") <= F.col("start_us"), "empty range")
    known = known.withColumn("copied", has_clip).withColumn("error", F.when(~has_clip, why))
    # one pass over the items; those that aren't cut meet no keyframes, each under a name of its own
    cut = ~F.col("copied") & F.col("error").isNull()
    video = F.when(cut, F.concat(F.lit("="), "source")).otherwise(F.concat(F.lit("!"), F.monotonically_increasing_id().cast("string")))
    there = F.coalesce(F.col("thumbnail") != "", F.lit(False))
    points = known.select(video.alias("video_id"), F.col("item").alias("scene_index"), F.coalesce("start_us", F.lit(0)).cast("long").alias("start_us"), "end_us", F.coalesce("hevc", F.lit(False)).alias("hevc"), "copied", there.alias("there"), "error")
    planned = plan_cuts(points, keys.select(F.concat(F.lit("="), "source").alias("video_id"), "t_us"), F.col("hevc"))
    is_cut = ~F.col("copied") & F.col("error").isNull()
    poster = F.when(F.col("copied"), F.when(F.col("there"), "there").otherwise("first_keyframe")).when(is_cut, F.when(F.col("mode").isin("copy", "snapped_copy"), "first_keyframe").otherwise("first_frame"))
    return planned.select(F.col("scene_index").alias("item"), F.when(F.col("copied"), "copied").when(is_cut, F.col("mode")).alias("how"), F.when(is_cut, F.col("start_us")).alias("start_us"), poster.alias("poster"), "error")


def export_jobs(scenes: DataFrame, clips: DataFrame, select: str = "") -> DataFrame:
    """Selected scenes with their source."""
    last = scenes.groupBy("video_id").agg(F.max("scene_index").alias("last"))
    picks = last.select("video_id", F.explode(selection.selected_indices(F.lit(select), F.col("last"))).alias("scene_index"))
    return selection.resolve_jobs(scenes.join(picks, ["video_id", "scene_index"], "left_semi"), clips)


def merge(clips: DataFrame, settings: DataFrame, key: str) -> DataFrame:
    """How clips are merged: planning.merge_plan."""
    return planning.merge_plan(clips, settings, key)


def pipeline(frames: DataFrame, steps: list, keep: bool = False) -> DataFrame:
    """Several operations, at least two, one after the other, or each on the frames given: runs.chain."""
    if len(steps) < 2:
        raise ValueError("a pipeline has at least two operations")
    return runs.chain(frames, steps, keep)
