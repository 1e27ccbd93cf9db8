"""Queries over frames and pictures as such: segments in files, windows of tensors, changed areas, the image-level rule of dead frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import regions
from ..operators import boundary, runs, tensors
from ..sources import segments
from ..sources.files import shared_folder
from ..sources.proxies import table
from .registry import query
from .vector_queries import SQL_IMAGES, images

H = WIDTH = 8
#: Frames of a segment.
CUT = 7

#: Frames of bytes: embeddings as pictures, a video for each label.
SQL_BYTES = f"""{SQL_IMAGES}, bytes AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, [greatest(0, least(255, floor(128 + 90 * x)))::BIGINT for x in px] AS px FROM images)"""


def byte_frames(spark: SparkSession, sf: str) -> DataFrame:
    """video_id, i, px (64 bytes)."""
    level = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 90 * x)))
    px = F.unhex(F.array_join(F.transform("px", lambda x: F.lpad(F.hex(level(x)), 2, "0")), ""))
    at = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    return images(spark, sf).select(F.col("label").cast("long").alias("video_id"), at.cast("long").alias("i"), px.alias("px"))


@query(f"WITH {SQL_BYTES} SELECT label || '_' || printf('%04d', i // {CUT}) AS segment, i % {CUT} AS i, list_sum(px)::BIGINT AS total FROM bytes")
def segments_written(spark: SparkSession, sf: str) -> DataFrame:
    """Frames cut into files, a segment each, and read back from what was published."""
    frames = byte_frames(spark, sf)
    totals = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    cuts = totals.select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + 3 * CUT, F.lit(CUT).cast("long"))).alias("i"))
    path = shared_folder(spark, "segments")
    segments.write_segments(frames, segments.cut_ranges(cuts, totals), path)
    read = segments.read_segments(spark, path, height=H, width=WIDTH, channels=1)
    byte = lambda k: F.conv(F.hex(F.substring("px", k, 1)), 16, 10).cast("long")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(H * WIDTH)), byte), F.lit(0).cast("long"), lambda s, x: s + x)
    return read.select("segment", "i", total.alias("total"))


WINDOW, STRIDE, THRESHOLD = 20, 10, 0.02


@query(
    f"""WITH {SQL_BYTES}, f AS (SELECT label AS video_id, i, list_sum(px) / 64 / 255::DOUBLE AS m FROM bytes), n AS (SELECT video_id, count(*) AS n FROM f GROUP BY 1),
    slots AS (SELECT *, unnest(range({WINDOW})) AS slot FROM (SELECT video_id, n, unnest(range((n + {STRIDE - 1}) // {STRIDE})) AS w FROM n)),
    rd AS (SELECT video_id, w, greatest(0, least(n - 1, {STRIDE} * w - 5 + slot)) AS i, slot BETWEEN 5 AND 14 AND {STRIDE} * w - 5 + slot < n AS scored FROM slots),
    avgs AS (SELECT video_id, w, avg(m) AS a FROM rd JOIN f USING (video_id, i) GROUP BY 1, 2),
    frames AS (SELECT video_id, i, abs(m - a) AS score FROM rd JOIN f USING (video_id, i) JOIN avgs USING (video_id, w) WHERE scored),
    bits AS (SELECT video_id, i, score > {THRESHOLD} AS cut, max(i) OVER (PARTITION BY video_id) AS n1 FROM frames),
    marks AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, cut ORDER BY i) AS g FROM bits),
    quiet AS (SELECT video_id, min(i) AS a, least(max(i) + 1, any_value(n1)) AS b FROM marks WHERE NOT cut GROUP BY video_id, g),
    everything AS (SELECT * FROM quiet UNION ALL SELECT video_id, 0, any_value(n1) FROM bits GROUP BY video_id HAVING bool_and(cut))
    SELECT video_id::BIGINT AS video_id, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS scene_index, a::BIGINT AS start_frame, b::BIGINT AS end_frame FROM everything"""
)
def tensor_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """From files of raw frames to scenes in one plan: blocks of frames with their halo, windows of tensors to a model in batches, runs of low scores. The model's stand-in is the distance of a frame's brightness from its window's."""
    frames = byte_frames(spark, sf)
    every = frames.groupBy("video_id").agg(F.count("*").alias("n")).select("video_id", F.lit(0).cast("long").alias("segment_index"), F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"))
    path = shared_folder(spark, "videos")
    segments.write_segments(frames, every, path, pattern="%s.%d")
    read = segments.read_segments(spark, path, height=H, width=WIDTH, channels=1, split=16 * H * WIDTH)
    read = read.select(F.split_part("segment", F.lit("."), F.lit(1)).cast("long").alias("video_id"), "i", "px")

    def model(x):
        bright = x.reshape(*x.shape[:2], -1).mean(axis=2) / 255
        return abs(bright - bright.mean(axis=1, keepdims=True))

    totals = read.groupBy("video_id").agg(F.count("*").alias("n"))
    return boundary.score_scenes(tensors.window_scores(read, totals, model, (H, WIDTH, 1), WINDOW, STRIDE, block=2, batch=3), THRESHOLD)


#: Gray levels from the embeddings; every seventh image is dark, every eleventh flat.
SQL_GRAY = f"""{SQL_IMAGES}, gray AS (SELECT label, vec_id, [CASE WHEN vec_id % 7 = 0 THEN 60 ELSE 128 END + CASE WHEN vec_id % 11 = 0 THEN 1 ELSE 90 END * x for x in px] AS g FROM images),
    pair AS (SELECT * FROM (SELECT *, lag(g) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM gray) WHERE b IS NOT NULL)"""
#: Changed cells, closed by the ellipse, without holes; regions by the least cell that reaches them; areas by their corners.
SQL_AREA = f"""kernel AS (SELECT a.i - 2 AS dr, b.i - 2 AS dc FROM range(5) a(i), range(5) b(i) WHERE abs(a.i - 2) < 2 OR b.i = 2),
    spots AS (SELECT label, vec_id, cell // 8 AS r, cell % 8 AS c, abs(g[cell + 1] - b[cell + 1]) > {regions.CHANGED} AS changed FROM (SELECT *, unnest(range(64)) AS cell FROM pair)),
    grown AS (SELECT DISTINCT vec_id, r + dr AS r, c + dc AS c FROM spots, kernel WHERE changed AND r + dr BETWEEN 0 AND 7 AND c + dc BETWEEN 0 AND 7),
    shrunk AS (SELECT s.vec_id, s.r, s.c FROM spots s CROSS JOIN kernel LEFT JOIN grown g ON g.vec_id = s.vec_id AND g.r = s.r + dr AND g.c = s.c + dc
      GROUP BY ALL HAVING bool_and(g.vec_id IS NOT NULL OR s.r + dr NOT BETWEEN 0 AND 7 OR s.c + dc NOT BETWEEN 0 AND 7)),
    around AS (SELECT v.vec_id, a.i - 1 AS r, b.i - 1 AS c FROM (SELECT DISTINCT vec_id FROM spots) v, range(10) a(i), range(10) b(i) WHERE NOT EXISTS (SELECT 1 FROM shrunk k WHERE k.vec_id = v.vec_id AND k.r = a.i - 1 AND k.c = b.i - 1)),
    outside AS (SELECT vec_id, -1::BIGINT AS r, -1::BIGINT AS c FROM (SELECT DISTINCT vec_id FROM spots) UNION SELECT a.vec_id, a.r, a.c FROM outside o JOIN around a ON a.vec_id = o.vec_id AND abs(a.r - o.r) + abs(a.c - o.c) = 1),
    solid AS (SELECT vec_id, r, c FROM spots s WHERE NOT EXISTS (SELECT 1 FROM outside o WHERE o.vec_id = s.vec_id AND o.r = s.r AND o.c = s.c)),
    reach AS (SELECT vec_id, r * 8 + c AS source, r, c FROM solid UNION SELECT s.vec_id, e.source, s.r, s.c FROM reach e JOIN solid s ON s.vec_id = e.vec_id AND abs(s.r - e.r) <= 1 AND abs(s.c - e.c) <= 1),
    region AS (SELECT vec_id, r, c, min(source) AS region FROM reach GROUP BY ALL),
    squares AS (SELECT s.vec_id, s.r, s.c, count(*) AS n, min(x.region) AS region FROM spots s JOIN region x ON x.vec_id = s.vec_id AND x.r - s.r IN (0, 1) AND x.c - s.c IN (0, 1) WHERE s.r < 7 AND s.c < 7 GROUP BY ALL HAVING count(*) >= 3),
    areas AS (SELECT vec_id, region, sum((n - 2) / 2::DOUBLE) AS area FROM squares GROUP BY ALL)"""


def gray_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """label, vec_id, b, g: each image and the one before of its label."""
    level, spread = F.when(F.col("vec_id") % 7 == 0, 60.0).otherwise(128.0), F.when(F.col("vec_id") % 11 == 0, 1.0).otherwise(90.0)
    gray = images(spark, sf).withColumn("level", level).withColumn("spread", spread).select("label", "vec_id", F.transform("px", lambda x: F.col("level") + F.col("spread") * x).alias("g"))
    return gray.withColumn("b", F.lag("g").over(W.partitionBy("label").orderBy("vec_id"))).where("b is not null")


@query(f"WITH RECURSIVE {SQL_GRAY}, {SQL_AREA} SELECT p.vec_id, coalesce(sum(area) FILTER (area > 4), 0) / 64 AS changed FROM pair p LEFT JOIN areas a ON a.vec_id = p.vec_id GROUP BY 1")
def changed_area(spark: SparkSession, sf: str) -> DataFrame:
    """The share of each image that differs from the one before, in regions above four cells."""
    return gray_pairs(spark, sf).select("vec_id", regions.changed_area(F.col("b"), F.col("g"), H, WIDTH, least=4).alias("changed"))


SQL_TOLD = f"""{SQL_GRAY}, {SQL_AREA}, m AS (SELECT *, [(g[k] + b[k]) / 2 for k in range(1, 65)] AS mid FROM pair),
    grads AS (SELECT vec_id, g[cell + 1] - b[cell + 1] AS t, (mid[cell // 8 * 8 + least(7, cell % 8 + 1) + 1] - mid[cell // 8 * 8 + greatest(0, cell % 8 - 1) + 1]) / 2 AS x,
      (mid[least(7, cell // 8 + 1) * 8 + cell % 8 + 1] - mid[greatest(0, cell // 8 - 1) * 8 + cell % 8 + 1]) / 2 AS y FROM (SELECT *, unnest(range(64)) AS cell FROM m)),
    sums AS (SELECT vec_id, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x * t) AS xt, sum(y * t) AS yt FROM grads GROUP BY 1),
    shift AS (SELECT vec_id, usable, CASE WHEN usable THEN (xy * yt - yy * xt) / det ELSE 0 END AS u, CASE WHEN usable THEN (xy * xt - xx * yt) / det ELSE 0 END AS v FROM (SELECT *, xx * yy - xy * xy AS det, xx * yy - xy * xy > 1e-6 AS usable FROM sums)),
    moved AS (SELECT s.vec_id, any_value(sqrt(u * u + v * v)) AS length, CASE WHEN any_value(usable) THEN avg((abs(t + x * u + y * v) < {regions.RESIDUAL})::INT) ELSE 0 END AS inliers FROM shift s JOIN grads USING (vec_id) GROUP BY 1),
    area AS (SELECT vec_id, sum(area) / 64 AS area FROM areas WHERE area > 4 GROUP BY 1),
    told AS (SELECT p.label, p.vec_id, list_avg(b) AS mean_before, list_avg(g) AS mean, list_avg([pow(x - list_avg(g), 2) for x in g]) AS variance, length, inliers, coalesce(area, 0) AS area FROM pair p JOIN moved USING (vec_id) LEFT JOIN area USING (vec_id)),
    stats AS (SELECT label, vec_id, mean_before, mean, variance, CASE WHEN ok THEN length ELSE 0 END AS mean_mag, CASE WHEN ok THEN area ELSE 0 END AS diff_fraction, CASE WHEN ok THEN inliers ELSE 0 END AS inlier_ratio, CASE WHEN ok THEN length END AS frob_norm
      FROM (SELECT *, abs(mean - mean_before) <= {regions.JUMP} AND variance >= {regions.FLAT} AS ok FROM told))"""


def told(spark: SparkSession, sf: str) -> DataFrame:
    return gray_pairs(spark, sf).select("label", "vec_id", regions.pair_stats(F.col("b"), F.col("g"), H, WIDTH, least=4).alias("s")).select("label", "vec_id", "s.*")


@query("WITH RECURSIVE " + SQL_TOLD + " SELECT label, vec_id, " + ", ".join(f"round_even({c}, 6) AS {c}" for c in ("mean_before", "mean", "variance", "mean_mag", "diff_fraction", "inlier_ratio", "frob_norm")) + " FROM stats")
def image_pair_stats(spark: SparkSession, sf: str) -> DataFrame:
    """What neighbouring images tell: brightness, variance, motion, changed area, and how much of the image follows the motion."""
    s = told(spark, sf)
    return s.select("label", "vec_id", *[F.bround(c, 6).alias(c) for c in s.columns[2:]])


@query(
    f"WITH RECURSIVE {SQL_TOLD} SELECT label, vec_id, CASE WHEN mean_mag < 0.5 THEN true WHEN inlier_ratio > 0.5 AND frob_norm > 1.0 THEN true ELSE diff_fraction < 0.15 END AS dead FROM stats"
)
def image_dead_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Is an image a repeat of the one before? All that the rule asks comes from the two images."""
    s = told(spark, sf)
    return s.select("label", "vec_id", runs.dead(*[F.col(c) for c in ("mean_mag", "diff_fraction", "inlier_ratio", "frob_norm")], F.lit(runs.FLOW), F.lit(runs.AREA)).alias("dead"))
