"""Boundaries, scenes and segments of ordered sequences. Everything is keyed by video_id; times are integer microseconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import bound

US = 1_000_000


def by_video(*order: str):
    return W.partitionBy("video_id").orderBy(*order)


def kept(rows: Column, keeps: Callable[[Column, Column], Column], chunk: int = 1024) -> Column:
    """Of an array in order, the first element and each for which keeps(last one kept, it). Folded chunk by chunk, so that what is appended to stays short."""
    none = F.get(rows, F.lit(-1))

    def fold(part: Column, last: Column) -> Column:
        start = F.struct(F.slice(part, 1, 0).alias("out"), last.alias("last"))
        step = lambda acc, r: F.when(acc["last"].isNull() | keeps(acc["last"], r), F.struct(F.concat(acc["out"], F.array(r)).alias("out"), r.alias("last"))).otherwise(acc)
        return F.aggregate(part, start, step)

    def add(acc: Column, part: Column) -> Column:
        return bound(fold(part, acc["last"]), lambda x: F.struct(F.concat(acc["parts"], F.array(x["out"])).alias("parts"), x["last"].alias("last")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / chunk)), lambda i: F.slice(rows, (i * chunk + 1).cast("int"), chunk))
    several = F.flatten(F.aggregate(chunks, F.struct(F.slice(F.array(rows), 1, 0).alias("parts"), none.alias("last")), add, lambda acc: acc["parts"]))
    return F.when(F.size(rows) == 1, rows).when(F.size(rows) <= chunk, fold(rows, none)["out"]).otherwise(several)


def islands(rows: DataFrame, order: list[str], always: Column) -> DataFrame:
    """rows by video and island as sorted arrays `rows` of structs: an island begins at the first row and wherever `always` holds. One shuffle by video, for the window and the arrays; a row holds one island."""
    w = by_video(*order)
    others = [c for c in rows.columns if c not in ("video_id", *order)]
    marked = rows.withColumn("_a", F.coalesce(always, F.lit(True)).cast("int")).withColumn("_i", F.sum("_a").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("video_id", "_i").agg(F.array_sort(F.collect_list(F.struct(*order, *others))).alias("rows"))


def walked(rows: DataFrame, order: list[str], always: Column, keeps: Callable[[Column, Column], Column]) -> DataFrame:
    """The rows of each video that are passed on: the first, and each for which keeps(last one passed on, it).

    always: what is sure to be passed on whatever came before, as windows along the order. A video is cut there, as what
    follows depends on that row alone, and each island is folded by itself. Columns are those of rows.
    """
    found = islands(rows, order, always).select("video_id", F.inline(kept(F.col("rows"), keeps)))
    return found.select(*rows.columns)


def runs(df: DataFrame, flag: Column, order: str = "i", key: str = "video_id") -> DataFrame:
    """df with `flag` and `run`, which grows by one wherever the flag changes along the order. One shuffle by key; windows that follow on the same key share it."""
    w = W.partitionBy(key).orderBy(order)
    changed = F.coalesce(F.col("flag") != F.lag("flag").over(w), F.lit(False))
    return df.withColumn("flag", flag).withColumn("_c", changed.cast("int")).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_c")


def score_scenes(frames: DataFrame, threshold: float) -> DataFrame:
    """Scenes from transition scores: a scene is a run of frames at or below the threshold, its end frame the first one after it (or the last frame); a video of transitions only is one scene.

    frames (video_id, i, score) -> video_id, scene_index, start_frame, end_frame. Frames without a score aren't transitions.
    """
    last = F.max("i").over(W.partitionBy("video_id"))
    marked = runs(frames.withColumn("last", last), F.coalesce(F.col("score") > threshold, F.lit(False)))
    found = (
        marked.groupBy("video_id", "run")
        .agg(F.first("flag").alias("cut"), F.min("i").alias("a"), F.max("i").alias("b"), F.first("last").alias("last"))
        .withColumn("all_cut", F.min("cut").over(W.partitionBy("video_id")))
        .where(~F.col("cut") | F.col("all_cut"))
    )
    return found.select(
        "video_id",
        (F.row_number().over(by_video("a")) - 1).cast("long").alias("scene_index"),
        F.when(F.col("all_cut"), 0).otherwise(F.col("a")).cast("long").alias("start_frame"),
        F.least(F.when(F.col("all_cut"), F.col("last")).otherwise(F.col("b") + 1), F.col("last")).cast("long").alias("end_frame"),
    )


def bounds_to_scenes(cuts: DataFrame, totals: DataFrame) -> DataFrame:
    """0, the cuts and the total, paired up. cuts (video_id, t_us), totals (video_id, total_us) -> video_id, scene_index, start_us, end_us."""
    ends = totals.select("video_id", F.explode(F.array(F.lit(0).cast("long"), F.col("total_us"))).alias("t_us"))
    all_ = cuts.select("video_id", "t_us").unionByName(ends).distinct()
    w = by_video("t_us")
    return all_.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("scene_index"), F.col("t_us").alias("start_us"), F.lead("t_us").over(w).alias("end_us")).where("end_us is not null")


def greedy_merge(bounds: DataFrame, least_us: int, col: str = "t_us") -> DataFrame:
    """Keeps a boundary if it is at least `least_us` after the last one kept; two boundaries or fewer stay as they are."""
    # with n <= 2 nothing is merged: each boundary is sure to stay
    n = F.count("*").over(W.partitionBy("video_id"))
    always = (F.col(col) - F.lag(col).over(by_video(col)) >= least_us) | (F.col("_n") <= 2)
    rows = bounds.select("video_id", F.col(col).cast("long").alias(col)).withColumn("_n", n)
    return walked(rows, [col], always, lambda last, r: r[col] - last[col] >= least_us).drop("_n")


def keyframe_cuts(keys: DataFrame, least_us: int) -> DataFrame:
    """Cuts from keyframe times: the first keyframe is dropped, whatever its time; 0 and the rest are merged; 0 goes. keys (video_id, t_us)."""
    rest = keys.distinct().withColumn("n", F.row_number().over(by_video("t_us"))).where("n > 1").select("video_id", "t_us")
    zero = rest.select("video_id", F.lit(0).cast("long").alias("t_us")).distinct()
    return greedy_merge(zero.unionByName(rest), least_us).where("t_us <> 0")


def pathological(times: DataFrame, videos: DataFrame) -> DataFrame:
    """Can a video's keyframe times not be used: fewer than two, one twice, more than ten a second of its duration, or an upper median gap below 50 ms?

    times (video_id, t_us): in any order, nulls don't count. videos (video_id, duration_us: null or 0 if unknown) ->
    video_id, n, pathological. The median is a row by its rank, so that no row holds a video.
    """
    known = times.where("t_us is not null")
    steps = known.select("video_id", (F.col("t_us") - F.lag("t_us").over(by_video("t_us"))).alias("delta"))
    # the first time has no gap and rank 0
    rank = F.row_number().over(W.partitionBy("video_id").orderBy(F.asc_nulls_first("delta"))) - 1
    ranked = steps.withColumn("rank", rank).withColumn("m", F.count("delta").over(W.partitionBy("video_id")))
    median = F.max(F.when(F.col("rank") == F.floor(F.col("m") / 2) + 1, F.col("delta")))
    g = ranked.groupBy("video_id").agg(F.count("*").alias("n"), F.min("delta").alias("least"), median.alias("median"))
    rows = videos.join(g, "video_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = F.col("n") * US > 10 * F.col("duration_us")
    bad = (F.col("n") < 2) | (F.col("least") <= 0) | (F.coalesce(F.col("duration_us") > 0, F.lit(False)) & dense) | (F.col("median") < 50_000)
    return rows.select("video_id", "n", F.coalesce(bad, F.lit(True)).alias("pathological"))


def pack_scenes(cuts: DataFrame, durations: DataFrame, least_us: int, eps_us: int = 1, shortest_us: int = 40_000) -> DataFrame:
    """Scenes from cuts that lie more than eps inside (0, duration); without a usable duration the last one gets the least length.

    cuts (video_id, t_us), durations (video_id, duration_us) -> video_id, scene_index, start_us, end_us.
    """
    inside = cuts.join(durations, "video_id").where((F.col("t_us") > eps_us) & ((F.col("duration_us") <= 0) | (F.col("t_us") < F.col("duration_us") - eps_us)))
    w = by_video("t_us")
    spaced = inside.withColumn("b", F.lag("t_us").over(w)).where(F.col("b").isNull() | (F.col("t_us") > F.col("b") + eps_us)).select("video_id", "t_us")
    starts = durations.select("video_id", F.lit(0).cast("long").alias("t_us")).unionByName(spaced)
    rows = starts.join(durations, "video_id").withColumn("next", F.lead("t_us").over(w))
    end = F.when(F.col("duration_us") > F.col("t_us") + eps_us, F.col("duration_us")).otherwise(F.col("t_us") + max(least_us, shortest_us))
    return rows.select("video_id", (F.row_number().over(w) - 1).cast("long").alias("scene_index"), F.col("t_us").alias("start_us"), F.coalesce("next", end).alias("end_us"))


def windows_of(keys: DataFrame, radius_us: int) -> DataFrame:
    """A scan window around each key time. keys (video_id, t_us) -> video_id, window_id, s_us, e_us."""
    return keys.distinct().select("video_id", (F.row_number().over(by_video("t_us")) - 1).cast("long").alias("window_id"), F.greatest(F.lit(0).cast("long"), F.col("t_us") - radius_us).alias("s_us"), (F.col("t_us") + radius_us).alias("e_us"))


def join_windows(frames: DataFrame, windows: DataFrame, bucket_us: int) -> DataFrame:
    """Frames in each window, both ends included: an equi-join on video and time bucket, so that no task pairs a whole video's frames with all its windows."""
    spread = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s_us") / bucket_us), F.floor(F.col("e_us") / bucket_us))))
    return frames.withColumn("bucket", F.floor(F.col("t_us") / bucket_us)).join(spread, ["video_id", "bucket"]).where(F.col("t_us").between(F.col("s_us"), F.col("e_us"))).drop("bucket")


def frames_in(frames: DataFrame, ranges: DataFrame, bucket_us: int) -> DataFrame:
    """Frames of each range (start_us, end_us), the end excluded."""
    return join_windows(frames, ranges.withColumnsRenamed({"start_us": "s_us", "end_us": "e_us"}), bucket_us).where("t_us < e_us").withColumnsRenamed({"s_us": "start_us", "e_us": "end_us"})


def window_cuts(scanned: DataFrame, dissimilarity: Column, threshold: float, least_us: int) -> DataFrame:
    """Cuts where neighbouring usable frames of a window differ by more than the threshold; cuts of all windows are united, 0 is added, and short scenes merged.

    scanned (video_id, window_id, t_us, feature, usable); dissimilarity: an expression over feature and `before`.
    """
    w = W.partitionBy("video_id", "window_id").orderBy("t_us")
    cuts = scanned.where("usable").withColumn("before", F.lag("feature").over(w)).where(F.col("before").isNotNull() & (dissimilarity > threshold))
    # 0 goes along with each cut, so that one distinct does for both
    both = cuts.select("video_id", F.explode(F.array("t_us", F.lit(0).cast("long"))).alias("t_us")).distinct()
    return greedy_merge(both, least_us).where("t_us > 0")


def sliding_windows(frames: DataFrame, window: int = 100, stride: int = 50) -> DataFrame:
    """Overlapping windows with edge replication: window w reads frames clamp(stride w - pad .. stride w - pad + window - 1) and answers for stride w .. stride w + stride - 1.

    frames (video_id, i, ...) -> video_id, w, slot (0 .. window - 1), i, scored, and the rest. Each frame is copied to the windows that read it; only the first and the last frame are repeated.
    """
    pad = (window - stride) // 2
    n = F.count("*").over(W.partitionBy("video_id"))
    rows = frames.withColumn("n", n)
    last_w = F.floor((F.col("n") - 1) / stride)
    first = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil((F.col("i") + pad - window + 1) / stride)))
    final = F.when(F.col("i") == F.col("n") - 1, last_w).otherwise(F.least(last_w, F.floor((F.col("i") + pad) / stride)))
    rows = rows.withColumn("w", F.explode(F.sequence(first.cast("long"), final.cast("long"))))
    at = F.col("i") - (F.col("w") * stride - pad)
    low = F.when(F.col("i") == 0, F.lit(0)).otherwise(at)
    high = F.when(F.col("i") == F.col("n") - 1, F.lit(window - 1)).otherwise(at)
    rows = rows.where((low <= window - 1) & (high >= 0)).withColumn("slot", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.lit(window - 1)).cast("long"))))
    own = F.col("w") * stride - pad + F.col("slot")
    scored = (own == F.col("i")) & (F.col("slot") >= pad) & (F.col("slot") < pad + stride)
    return rows.withColumn("scored", scored).drop("n")


def cut_points(scenes: DataFrame, fps: float) -> DataFrame:
    """End of every scene but the last, in seconds. scenes (video_id, scene_index, end_frame)."""
    more = F.lead("scene_index").over(by_video("scene_index"))
    return scenes.withColumn("more", more).where("more is not null").select("video_id", "scene_index", (F.col("end_frame") / fps).alias("cut_sec"))


def segment_batches(cuts: DataFrame, size: int = 1500) -> DataFrame:
    """Chunks of `size` cuts; times within a chunk are relative to its start, the last cut of the chunk before.

    cuts (video_id, t_us) -> video_id, chunk, n_cuts, start_us, end_us (null for the last), relative (array).
    """
    numbered = cuts.withColumn("chunk", F.floor((F.row_number().over(by_video("t_us")) - 1) / size))
    chunks = numbered.groupBy("video_id", "chunk").agg(F.count("*").alias("n_cuts"), F.max("t_us").alias("hi"), F.array_sort(F.collect_list("t_us")).alias("ts"))
    w = by_video("chunk")
    start = F.coalesce(F.lag("hi").over(w), F.lit(0).cast("long"))
    end = F.when(F.lead("chunk").over(w).isNotNull(), F.col("hi"))
    return chunks.withColumn("start_us", start).withColumn("end_us", end).select("video_id", "chunk", "n_cuts", "start_us", "end_us", F.transform("ts", lambda t: t - F.col("start_us")).alias("relative"))


def merge_similar(scenes: DataFrame, pairs: DataFrame, reindex: bool = False) -> DataFrame:
    """Greedy merge by position: a scene that starts pairs takes the nearest later scene that it is paired with, and all in between; the next scene after that is looked at next. Scenes that aren't merged keep the index they had, unless reindex.

    scenes (video_id, scene_index, start_us, end_us), pairs (video_id, a, b) -> video_id, scene_index, start_us, end_us.
    """
    partner = pairs.groupBy("video_id", F.col("a").alias("pos")).agg(F.min(F.when(F.col("b") > F.col("a"), F.col("b"))).alias("to"))
    n = F.count("*").over(W.partitionBy("video_id"))
    rows = scenes.select("video_id", *[F.col(c).cast("long").alias(c) for c in ("scene_index", "start_us", "end_us")]).withColumn("pos", (F.row_number().over(by_video("scene_index")) - 1).cast("long")).withColumn("n", n)
    rows = rows.join(partner, ["video_id", "pos"], "left").select("video_id", "pos", "scene_index", "start_us", "end_us", F.when(F.col("to") < F.col("n"), F.col("to")).alias("to"))
    # no earlier scene reaches a scene that is sure to be looked at, so its island holds all that it can take
    reach = F.max(F.coalesce("to", "pos")).over(by_video("pos").rowsBetween(W.unboundedPreceding, -1))
    found = islands(rows, ["pos"], F.col("pos") > reach)
    until = lambda r: F.coalesce(r["to"], r["pos"])
    with_end = lambda every: F.transform(kept(every, lambda last, r: r["pos"] > until(last)), lambda r: r.withField("end_us", F.get(every, (until(r) - F.get(every, F.lit(0))["pos"]).cast("int"))["end_us"]))
    left = found.select("video_id", F.inline(bound(F.col("rows"), with_end)))
    made = (F.row_number().over(by_video("pos")) - 1).cast("long")
    number = made if reindex else F.when(F.col("to").isNull(), F.col("scene_index")).otherwise(made)
    return left.select("video_id", number.alias("scene_index"), "start_us", "end_us")
