"""Queries over sequences: boundaries, alignment, runs, emission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from ..functions.vector import average_pool, cosine_of, with_norm
from ..operators import align, boundary, emission, runs, selection
from ..sources.proxies import SQL_FRAMES, SQL_PACKETS, SQL_STATS, frames, packets, pair_stats, table
from . import detect
from .registry import query

FPS, THRESHOLD = 25.0, 60.0
HOUR = 3_600_000_000
START = 1_704_067_200_000_000  # 2024-01-01
#: Scenes of a video run from each fourth frame to the next; times count from START.
SCENE_EVERY = 4


def clock(df: DataFrame) -> DataFrame:
    return df.withColumn("t_us", F.col("ts_us") - START)


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return clock(packets(spark, sf)).where("is_key").select("video_id", "t_us").distinct()


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """video_id, scene_index, start_us, end_us."""
    w = W.partitionBy("video_id").orderBy("i")
    at = clock(frames(spark, sf)).where(F.col("i") % SCENE_EVERY == 0).withColumn("end_us", F.lead("t_us").over(w))
    return at.where("end_us is not null").select("video_id", F.floor(F.col("i") / SCENE_EVERY).alias("scene_index"), F.col("t_us").alias("start_us"), "end_us")


SQL_KEYS = SQL_FRAMES + f", keys AS (SELECT DISTINCT video_id, ts_us - {START} AS t_us FROM packets WHERE is_key)"
SQL_SCENES = (
    SQL_KEYS
    + f""", scenes AS (SELECT * FROM (SELECT video_id, i // {SCENE_EVERY} AS scene_index, ts_us - {START} AS start_us,
    lead(ts_us) OVER (PARTITION BY video_id ORDER BY i) - {START} AS end_us FROM frames WHERE i % {SCENE_EVERY} = 0) WHERE end_us IS NOT NULL)"""
)
SQL_ISLANDS = (
    SQL_FRAMES
    + f""", bits AS (SELECT video_id, i, score > {THRESHOLD} AS cut, max(i) OVER (PARTITION BY video_id) AS n1 FROM frames),
    marks AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, cut ORDER BY i) AS g FROM bits),
    quiet AS (SELECT video_id, min(i) AS a, least(max(i) + 1, any_value(n1)) AS b FROM marks WHERE NOT cut GROUP BY video_id, g),
    everything AS (SELECT * FROM quiet UNION ALL SELECT video_id, 0, any_value(n1) FROM bits GROUP BY video_id HAVING bool_and(cut)),
    islands AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY a) - 1 AS scene_index, a::BIGINT AS start_frame, b::BIGINT AS end_frame FROM everything)"""
)


@query(f"WITH {SQL_ISLANDS} SELECT * FROM islands")
def scene_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes from transition scores."""
    return boundary.score_scenes(frames(spark, sf), THRESHOLD)


@query(
    f"""WITH {SQL_ISLANDS}, s AS (SELECT *, round_even(start_frame / {FPS}::DOUBLE, 2) AS start_sec, round_even(end_frame / {FPS}::DOUBLE, 2) AS end_sec FROM islands)
    SELECT video_id, scene_index, start_sec, end_sec, round_even(greatest(0, end_sec - start_sec), 6) AS duration_sec, start_frame, end_frame FROM s"""
)
def scene_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes in seconds and frames."""
    s = boundary.score_scenes(frames(spark, sf), THRESHOLD)
    s = s.withColumn("start_sec", F.bround(F.col("start_frame") / FPS, 2)).withColumn("end_sec", F.bround(F.col("end_frame") / FPS, 2))
    return s.select("video_id", "scene_index", "start_sec", "end_sec", F.bround(F.greatest(F.lit(0.0), F.col("end_sec") - F.col("start_sec")), 6).alias("duration_sec"), "start_frame", "end_frame")


@query(
    f"""WITH {SQL_KEYS}, totals AS (SELECT video_id, max(ts_us) - {START} AS total_us FROM packets GROUP BY 1),
    b AS (SELECT * FROM keys UNION SELECT video_id, 0 FROM totals UNION SELECT * FROM totals),
    s AS (SELECT video_id, row_number() OVER w - 1 AS scene_index, t_us AS start_us, lead(t_us) OVER w AS end_us FROM b WINDOW w AS (PARTITION BY video_id ORDER BY t_us))
    SELECT *, round_even((end_us - start_us) / 1e6::DOUBLE, 3) AS duration FROM s WHERE end_us IS NOT NULL"""
)
def boundaries_to_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """0, cuts and the total as scenes."""
    totals = clock(packets(spark, sf)).groupBy("video_id").agg(F.max("t_us").alias("total_us"))
    s = boundary.bounds_to_scenes(keys(spark, sf), totals)
    return s.withColumn("duration", F.bround((F.col("end_us") - F.col("start_us")) / 1e6, 3))


@query(f"WITH {SQL_PACKETS} SELECT DISTINCT video_id, round_even((ts_us - {START + 240 * HOUR}) / 1e6::DOUBLE, 6) AS ts FROM packets WHERE is_key AND ts_us >= {START + 240 * HOUR}")
def keyframe_scan_v1(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframe times from the tenth day on, to six places, each once."""
    ts = (F.col("ts_us") - (START + 240 * HOUR)) / 1e6
    return packets(spark, sf).where("is_key").select("video_id", exact_round(ts, 6).alias("ts")).where("ts >= 0").distinct()


@query(
    f"""WITH {SQL_PACKETS}, n AS (SELECT video_id, coalesce(CASE WHEN value >= 5 THEN ts_us // 5000 * 5000 END, ts_us - 40000) - {START} AS n FROM packets WHERE is_key),
    -- the exact value of the double against the tie that its text is: its fraction has at most 52 bits
    x AS (SELECT *, n / 1e6::DOUBLE AS x, ((n / 1e6::DOUBLE - floor(n / 1e6::DOUBLE)) * 4503599627370496::DOUBLE)::HUGEINT * 1000000 - (((n % 1000000) + 1000000) % 1000000)::HUGEINT * 4503599627370496 AS over FROM n)
    SELECT DISTINCT video_id, CASE WHEN abs(n) % 10000 <> 5000 THEN round_even(x, 2) WHEN over > 0 THEN ((n + 5000) // 10000) / 100::DOUBLE WHEN over < 0 THEN ((n - 5000) // 10000) / 100::DOUBLE ELSE round_even(x, 2) END AS ts FROM x"""
)
def keyframe_scan_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframe times to two places, rounded by their exact value; half of all presentation times, cut to 5 ms, are ties. The decoding time stands in for a missing presentation time."""
    pts = F.when(F.col("value") >= 5, F.expr("ts_us div 5000 * 5000"))
    return packets(spark, sf).where("is_key").select("video_id", exact_round((F.coalesce(pts, F.col("ts_us") - 40_000) - START) / 1e6, 2).alias("ts")).distinct()


SQUEEZE = 600_000
SQL_SQUEEZED = f"""{SQL_PACKETS}, dur AS (SELECT video_id, CASE WHEN video_id % 5 > 0 THEN (max(ts_us) - min(ts_us)) // {SQUEEZE} ELSE 0 END AS duration FROM packets GROUP BY 1),
    k AS (SELECT video_id, seq, (ts_us + seq % 3 * 150000000000) // {SQUEEZE} AS t FROM packets WHERE is_key),
    gaps AS (SELECT video_id, t, t - lag(t) OVER (PARTITION BY video_id ORDER BY t) AS delta FROM k),
    sums AS (SELECT video_id, count(*) AS n, bool_or(delta <= 0) AS again, list_sort(list(delta) FILTER (delta IS NOT NULL)) AS deltas FROM gaps GROUP BY 1),
    verdict AS (SELECT d.video_id, coalesce(n, 0) AS n, coalesce(n, 0) < 2 OR again OR (duration > 0 AND n / (duration / 1e6::DOUBLE) > 10) OR deltas[len(deltas) // 2 + 1] < 50000 AS pathological FROM dur d LEFT JOIN sums s USING (video_id))"""


def squeezed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Keyframe times that come out of order, and durations that every fifth video lacks, on a scale where all rules take part."""
    rows = packets(spark, sf)
    t = rows.where("is_key").select("video_id", "seq", F.expr(f"(ts_us + seq % 3 * 150000000000) div {SQUEEZE}").alias("t_us"))
    span = F.expr(f"(max(ts_us) - min(ts_us)) div {SQUEEZE}")
    return t, rows.groupBy("video_id").agg(span.alias("d")).select("video_id", F.when(F.col("video_id") % 5 > 0, F.col("d")).otherwise(0).cast("long").alias("duration_us"))


@query(f"WITH {SQL_SQUEEZED} SELECT * FROM verdict")
def keyframe_pathology(spark: SparkSession, sf: str) -> DataFrame:
    """Which videos' keyframe times can't be used."""
    return boundary.pathological(*squeezed(spark, sf))


@query(
    f"""WITH {SQL_SQUEEZED}, d AS (SELECT video_id, ts_us // {SQUEEZE} AS t FROM packets WHERE kind <> 'view')
    SELECT DISTINCT video_id, t AS t_us, pathological AS decoded FROM verdict JOIN (SELECT video_id, t, false AS own FROM k UNION ALL SELECT video_id, t, true FROM d) USING (video_id) WHERE own = pathological AND t >= 0"""
)
def keyframe_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Keyframe times, decoded ones where those of the packets can't be used; here the decoder finds every event but the views."""
    times, durations = squeezed(spark, sf)
    decoded = packets(spark, sf).where("kind <> 'view'").select("video_id", F.expr(f"ts_us div {SQUEEZE}").alias("t_us"))
    return detect.keyframe_times(times, decoded, durations)


@query(f"WITH {SQL_KEYS} SELECT video_id, t_us, t_us - lag(t_us) OVER (PARTITION BY video_id ORDER BY t_us) AS gap_us FROM keys")
def keyframe_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Time since the keyframe before."""
    return keys(spark, sf).withColumn("gap_us", F.col("t_us") - F.lag("t_us").over(boundary.by_video("t_us")))


@query(f"WITH {SQL_KEYS} SELECT video_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round_even((max(t_us) - min(t_us)) / (count(*) - 1) / 1e6::DOUBLE, 3) END AS average_gap FROM keys GROUP BY 1")
def keyframe_gap_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Number of keyframes and their average gap in seconds."""
    g = keys(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"), (F.max("t_us") - F.min("t_us")).alias("span"))
    return g.select("video_id", "n", F.bround(F.try_divide("span", F.col("n") - 1) / 1e6, 3).alias("average_gap"))


def sql_merge(source: str, least: int) -> str:
    """A recursive expression: the next boundary kept after each one kept."""
    return f"""src AS ({source}), sizes AS (SELECT video_id, count(*) AS n, min(t_us) AS first FROM src GROUP BY 1),
    walk AS (SELECT video_id, first AS t_us FROM sizes WHERE n > 2
      UNION ALL SELECT w.video_id, (SELECT min(s.t_us) FROM src s WHERE s.video_id = w.video_id AND s.t_us >= w.t_us + {least}) AS t_us FROM walk w WHERE w.t_us IS NOT NULL),
    merged AS (SELECT * FROM walk WHERE t_us IS NOT NULL UNION ALL SELECT s.* FROM src s JOIN sizes z USING (video_id) WHERE z.n <= 2)"""


MERGE = 14 * HOUR


@query(f"WITH RECURSIVE {SQL_PACKETS}, {sql_merge(f'SELECT DISTINCT video_id, ts_us - {START} AS t_us FROM packets', MERGE)} SELECT * FROM merged")
def greedy_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Boundaries at least 14 hours apart."""
    return boundary.greedy_merge(clock(packets(spark, sf)).select("video_id", "t_us").distinct(), MERGE)


SQL_REST = "SELECT video_id, t_us FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t_us) AS rn FROM keys) WHERE rn > 1"


@query(f"WITH RECURSIVE {SQL_KEYS}, rest AS ({SQL_REST}), {sql_merge('SELECT * FROM rest UNION SELECT DISTINCT video_id, 0 FROM rest', 30 * HOUR)} SELECT * FROM merged WHERE t_us <> 0")
def keyframe_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts from keyframes."""
    return boundary.keyframe_cuts(keys(spark, sf), 30 * HOUR)


@query(
    f"""WITH {SQL_KEYS}, dur AS (SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 0 ELSE max(ts_us) - {START} - {60 * HOUR} END AS duration_us FROM packets GROUP BY 1),
    c AS (SELECT k.* FROM keys k JOIN dur d USING (video_id) WHERE t_us > 1 AND (duration_us <= 0 OR t_us < duration_us - 1)),
    s AS (SELECT * FROM c UNION ALL SELECT video_id, 0 FROM dur)
    SELECT video_id, row_number() OVER w - 1 AS scene_index, t_us AS start_us,
      coalesce(lead(t_us) OVER w, CASE WHEN duration_us > t_us + 1 THEN duration_us ELSE t_us + 500000 END)::BIGINT AS end_us
    FROM s JOIN dur USING (video_id) WINDOW w AS (PARTITION BY video_id ORDER BY t_us)"""
)
def keyframe_scenes_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes from cuts within a duration that some videos lack."""
    durations = clock(packets(spark, sf)).groupBy("video_id").agg(F.max("t_us").alias("m")).select("video_id", F.when(F.col("video_id") % 5 == 0, F.lit(0)).otherwise(F.col("m") - 60 * HOUR).cast("long").alias("duration_us"))
    return boundary.pack_scenes(keys(spark, sf), durations, 500_000)


RADIUS = 6 * HOUR


@query(
    f"""WITH RECURSIVE {SQL_KEYS}, wins AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_us) - 1 AS window_id, greatest(0, t_us - {RADIUS}) AS s, t_us + {RADIUS} AS e FROM keys),
    edges AS (SELECT vec_id, list(a ORDER BY k) AS pooled FROM (SELECT vec_id, (i // 16) * 4 + i % 8 // 2 AS k, avg(embedding[i + 1]::DOUBLE) AS a FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
    seen AS (SELECT w.video_id, w.window_id, f.ts_us - {START} AS t, pooled FROM frames f JOIN wins w ON f.video_id = w.video_id AND f.ts_us - {START} BETWEEN w.s AND w.e JOIN edges ON vec_id = f.seq % (SELECT count(*) FROM embeddings) WHERE f.score >= 5),
    steps AS (SELECT *, lag(pooled) OVER (PARTITION BY video_id, window_id ORDER BY t) AS b FROM seen),
    cuts AS (SELECT DISTINCT video_id, t AS t_us FROM steps WHERE b IS NOT NULL AND abs(1 - list_cosine_similarity(pooled, b)) > 1.1),
    {sql_merge('SELECT * FROM cuts UNION SELECT DISTINCT video_id, 0 FROM cuts', 2 * HOUR)} SELECT * FROM merged WHERE t_us > 0"""
)
def edge_window_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts from scans around keyframes, where pooled edge images of neighbours differ; frames of low score have no edges and are skipped."""
    wins = boundary.windows_of(keys(spark, sf), RADIUS)
    images = table(spark, sf, "embeddings")
    edges = images.select("vec_id", with_norm(average_pool(F.col("embedding"), 8, 8, 2)).alias("feature"))
    f = clock(frames(spark, sf)).where("score >= 5").withColumn("vec_id", F.col("seq") % images.count()).join(edges, "vec_id").select("video_id", "t_us", "feature", F.lit(True).alias("usable"))
    scanned = boundary.join_windows(f, wins, 2 * RADIUS)
    return boundary.window_cuts(scanned, F.abs(1 - cosine_of(F.col("feature"), F.col("before"))), 1.1, 2 * HOUR)


@query(
    f"""WITH {SQL_KEYS}, wins AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_us) - 1 AS window_id, greatest(0, t_us - {RADIUS}) AS s, t_us + {RADIUS} AS e FROM keys)
    SELECT w.video_id, window_id, count(*) AS n, sum(f.i)::BIGINT AS sum_i FROM frames f JOIN wins w ON f.video_id = w.video_id AND f.ts_us - {START} BETWEEN w.s AND w.e GROUP BY 1, 2"""
)
def window_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of each scan window."""
    wins = boundary.windows_of(keys(spark, sf), RADIUS)
    seen = boundary.join_windows(clock(frames(spark, sf)).select("video_id", "t_us", "i"), wins, 2 * RADIUS)
    return seen.groupBy("video_id", "window_id").agg(F.count("*").alias("n"), F.sum("i").alias("sum_i"))


@query(
    f"""WITH {SQL_FRAMES}, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1),
    wins AS (SELECT video_id, n, unnest(range((n + 49) // 50)) AS w FROM n), slots AS (SELECT *, unnest(range(100)) AS slot FROM wins),
    rd AS (SELECT video_id, w, slot, greatest(0, least(n - 1, 50 * w - 25 + slot)) AS i, slot BETWEEN 25 AND 74 AND 50 * w - 25 + slot < n AS scored FROM slots),
    avgs AS (SELECT video_id, w, count(*) AS m, avg(score) AS a FROM rd JOIN frames USING (video_id, i) GROUP BY 1, 2)
    SELECT video_id, w, i, m AS read, round_even(score - a, 6) AS prediction FROM rd JOIN frames USING (video_id, i) JOIN avgs USING (video_id, w) WHERE scored"""
)
def sliding_center_crop(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame scored once, in the centre of its window; the model's stand-in is the distance from the window's mean."""
    seen = boundary.sliding_windows(frames(spark, sf).select("video_id", "i", "score"))
    w = W.partitionBy("video_id", "w")
    made = seen.withColumn("a", F.avg("score").over(w)).withColumn("read", F.count("*").over(w))
    return made.where("scored").select("video_id", "w", "i", "read", F.bround(F.col("score") - F.col("a"), 6).alias("prediction"))


@query(f"WITH {SQL_ISLANDS} SELECT video_id, scene_index, end_frame / {FPS}::DOUBLE AS cut_sec FROM islands QUALIFY lead(scene_index) OVER (PARTITION BY video_id ORDER BY scene_index) IS NOT NULL")
def cut_points(spark: SparkSession, sf: str) -> DataFrame:
    """Ends of all scenes but the last."""
    return boundary.cut_points(boundary.score_scenes(frames(spark, sf), THRESHOLD), FPS)


# alignment

TOLERANCE = 4 * HOUR


@query(
    f"""WITH {SQL_KEYS}, p AS (SELECT video_id, seq, ts_us - {START} AS t_us FROM packets WHERE NOT is_key),
    x AS (SELECT p.*, a.t_us AS up, b.t_us AS down FROM p ASOF LEFT JOIN keys a ON p.video_id = a.video_id AND p.t_us <= a.t_us
      ASOF LEFT JOIN keys b ON p.video_id = b.video_id AND p.t_us > b.t_us),
    y AS (SELECT *, CASE WHEN down IS NULL OR up - t_us <= t_us - down THEN up ELSE coalesce(down, up) END AS k FROM x)
    SELECT video_id, seq, CASE WHEN abs(k - t_us) <= {TOLERANCE} THEN k END AS key_us, abs(k - t_us) AS diff_us FROM y"""
)
def nearest_asof(spark: SparkSession, sf: str) -> DataFrame:
    """The keyframe nearest to each packet, within four hours; the later one of two."""
    points = clock(packets(spark, sf)).where("not is_key").select("video_id", "seq", "t_us")
    near = align.neighbours(points, keys(spark, sf), ("seq",))
    key, gap = align.snap(F.col("t_us"), F.col("k_before"), F.col("k_at_or_after"), TOLERANCE)
    return near.select("video_id", "seq", key.alias("key_us"), gap.alias("diff_us"))


SQL_NEAR = """(SELECT k.t_us FROM keys k WHERE k.video_id = s.video_id ORDER BY abs(k.t_us - {0}), k.t_us DESC LIMIT 1)"""


@query(
    f"""WITH {SQL_SCENES}, x AS (SELECT s.*, {SQL_NEAR.format('s.start_us')} AS a, {SQL_NEAR.format('s.end_us')} AS b FROM scenes s)
    SELECT video_id, scene_index, start_us, end_us, CASE WHEN abs(a - start_us) <= {TOLERANCE} THEN a END AS start_snapped_us, CASE WHEN abs(b - end_us) <= {TOLERANCE} THEN b END AS end_snapped_us,
    abs(a - start_us) AS start_diff_us, abs(b - end_us) AS end_diff_us, CASE WHEN abs(a - start_us) <= {TOLERANCE} THEN 'copy_candidate' ELSE 'reencode_candidate' END AS mode FROM x"""
)
def classify_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with their ends snapped to keyframes."""
    out = align.classify(scenes(spark, sf), keys(spark, sf), TOLERANCE)
    return out.select("video_id", "scene_index", "start_us", "end_us", "start_snapped_us", "end_snapped_us", "start_diff_us", "end_diff_us", "mode")


@query(f"WITH {SQL_SCENES} SELECT s.video_id, s.scene_index, k.t_us AS next_us FROM scenes s ASOF LEFT JOIN keys k ON s.video_id = k.video_id AND s.start_us < k.t_us")
def next_keyframe(spark: SparkSession, sf: str) -> DataFrame:
    """The first keyframe after each scene's start."""
    points = scenes(spark, sf).select("video_id", "scene_index", F.col("start_us").alias("t_us"))
    return align.neighbours(points, keys(spark, sf), ("scene_index",)).select("video_id", "scene_index", F.col("k_after").alias("next_us"))


SQL_SNAP = f"""CASE WHEN d IS NULL THEN u WHEN u IS NULL THEN d WHEN u - start_us < start_us - d THEN u ELSE d END"""
SQL_SNAPPED = f"""{SQL_SCENES}, near AS (SELECT s.*, d.t_us AS d, u.t_us AS u, b.t_us AS b, f.t_us AS f FROM scenes s ASOF LEFT JOIN keys d ON s.video_id = d.video_id AND s.start_us >= d.t_us
    ASOF LEFT JOIN keys u ON s.video_id = u.video_id AND s.start_us < u.t_us ASOF LEFT JOIN keys b ON s.video_id = b.video_id AND s.start_us > b.t_us ASOF LEFT JOIN keys f ON s.video_id = f.video_id AND s.start_us <= f.t_us),
    snapped AS (SELECT *, CASE WHEN abs(({SQL_SNAP}) - start_us) <= {8 * HOUR} AND ({SQL_SNAP}) < end_us THEN {SQL_SNAP} END AS snap FROM near)"""


@query(f"WITH {SQL_SNAPPED} SELECT video_id, scene_index, snap AS snap_us FROM snapped")
def hevc_snap(spark: SparkSession, sf: str) -> DataFrame:
    """The keyframe to which a scene's start may move; the earlier one of two."""
    points = scenes(spark, sf).select("video_id", "scene_index", "end_us", F.col("start_us").alias("t_us"))
    near = align.neighbours(points, keys(spark, sf), ("scene_index", "end_us"))
    snap = align.earlier_snap(F.col("t_us"), F.col("k_at_or_before"), F.col("k_after"), 8 * HOUR, F.col("end_us"))
    return near.select("video_id", "scene_index", snap.alias("snap_us"))


@query(
    f"""WITH {SQL_SNAPPED} SELECT video_id, scene_index, CASE WHEN end_us <= start_us THEN 'failed' WHEN coalesce(start_us - b <= {HOUR}, false) OR coalesce(f - start_us <= {HOUR}, false) THEN 'copy'
    WHEN video_id % 2 = 0 AND video_id % 3 > 0 AND snap IS NOT NULL THEN 'snapped_copy' WHEN video_id % 2 = 1 AND u < end_us AND (u - start_us) / (end_us - start_us)::DOUBLE < 0.9 THEN 'smartcut' ELSE 'reencode' END AS mode FROM snapped"""
)
def cut_mode(spark: SparkSession, sf: str) -> DataFrame:
    """How each scene is cut; half of the videos are HEVC, a third has CUDA."""
    points = scenes(spark, sf).select("video_id", "scene_index", "end_us", F.col("start_us").alias("t_us"))
    near = align.neighbours(points, keys(spark, sf), ("scene_index", "end_us"))
    t = F.col("t_us")
    on_key = F.coalesce(t - F.col("k_before") <= HOUR, F.lit(False)) | F.coalesce(F.col("k_at_or_after") - t <= HOUR, F.lit(False))
    snap = align.earlier_snap(t, F.col("k_at_or_before"), F.col("k_after"), 8 * HOUR, F.col("end_us"))
    mode = align.cut_mode(t, F.col("end_us"), on_key, snap, F.col("k_after"), F.col("video_id") % 2 == 0, F.col("video_id") % 3 == 0)
    return near.select("video_id", "scene_index", mode.alias("mode"))


@query(
    f"""WITH {SQL_FRAMES}, g AS (SELECT video_id, count(*) AS n_packets, count(*) FILTER (is_key) AS k, max(i) FILTER (is_key) AS last_key FROM frames GROUP BY 1)
    SELECT video_id, n_packets, last_key, CASE WHEN k >= 2 AND last_key > 0 AND n_packets - last_key <= 5 THEN last_key END AS trim_to FROM g"""
)
def gop_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Where a trailing partial group of packets begins."""
    return align.gop_trim(frames(spark, sf)).drop("n_keys")


# decisions

FLOW, AREA = 0.4, 0.06
SQL_DEAD = "CASE WHEN mean_mag < {0} THEN true WHEN inlier_ratio > 0.5 AND frob_norm > 1.0 THEN true ELSE diff_fraction < {1} END"
SQL_DECIDED = f"""{SQL_STATS}, decided AS (SELECT f.video_id, f.i, coalesce(NOT ({SQL_DEAD.format(FLOW, AREA)}), true) AS keep FROM frames f LEFT JOIN stats s ON f.video_id = s.video_id AND f.i = s.i)"""


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """video_id, i, keep; the first frame is kept."""
    stats = pair_stats(spark, sf)
    is_dead = runs.dead(F.col("mean_mag"), F.col("diff_fraction"), F.col("inlier_ratio"), F.col("frob_norm"), F.lit(FLOW), F.lit(AREA))
    first = frames(spark, sf).where("i = 0").select("video_id", "i", F.lit(True).alias("keep"))
    return first.unionByName(stats.select("video_id", "i", (~is_dead).alias("keep")))


def sql_smooth(cadence: int) -> str:
    return f"""{SQL_DECIDED}, g AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, keep ORDER BY i) AS grp FROM decided),
    smooth AS (SELECT video_id, i, keep OR count(*) OVER (PARTITION BY video_id, keep, grp) < {cadence} AS keep FROM g),
    g2 AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, keep ORDER BY i) AS grp FROM smooth),
    ranges AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY min(i)) - 1 AS range_index, min(i) AS first, max(i) AS last FROM g2 WHERE keep GROUP BY video_id, grp)"""


CADENCE = 2


@query(f"WITH {SQL_DECIDED} SELECT * FROM decided")
def dead_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Which frames are kept."""
    return decisions(spark, sf)


@query(f"WITH {sql_smooth(CADENCE)} SELECT * FROM smooth")
def run_smoothing(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions without short gaps."""
    return runs.smooth(decisions(spark, sf), CADENCE)


@query(f"WITH {sql_smooth(CADENCE)} SELECT * FROM ranges")
def run_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Kept frames as ranges."""
    return runs.keep_ranges(runs.smooth(decisions(spark, sf), CADENCE))


@query(f"WITH {sql_smooth(CADENCE)} SELECT video_id, range_index AS segment_index, first / {FPS}::DOUBLE AS start_sec, (last + 1) / {FPS}::DOUBLE AS end_sec FROM ranges")
def run_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Kept frames as segments of time."""
    return runs.keep_segments(runs.smooth(decisions(spark, sf), CADENCE), FPS)


@query(f"WITH {sql_smooth(CADENCE)} SELECT video_id, string_agg('between(n,' || first || ',' || last || ')', '+' ORDER BY first) AS expression FROM ranges GROUP BY 1")
def select_expression(spark: SparkSession, sf: str) -> DataFrame:
    """Kept ranges as one expression."""
    r = runs.keep_ranges(runs.smooth(decisions(spark, sf), CADENCE))
    parts = r.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("rs"))
    return parts.select("video_id", F.array_join(F.transform("rs", lambda x: F.concat(F.lit("between(n,"), x["first"].cast("string"), F.lit(","), x["last"].cast("string"), F.lit(")"))), "+").alias("expression"))


@query(f"WITH {sql_smooth(CADENCE)} SELECT video_id, i, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS new_i, (row_number() OVER (PARTITION BY video_id ORDER BY i) - 1) / {FPS}::DOUBLE AS new_sec FROM smooth WHERE keep")
def cfr_compaction(spark: SparkSession, sf: str) -> DataFrame:
    """Kept frames, numbered again."""
    return runs.compact(runs.smooth(decisions(spark, sf), CADENCE), FPS)


@query(f"WITH {sql_smooth(CADENCE)} SELECT video_id, count(*) AS total, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, count(*) FILTER (keep) / {FPS}::DOUBLE AS duration_after FROM smooth GROUP BY 1")
def kept_dropped_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of frames kept and dropped, and the time left."""
    s = runs.smooth(decisions(spark, sf), CADENCE)
    return s.groupBy("video_id").agg(F.count("*").alias("total"), F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("dropped"), (F.count_if("keep") / FPS).alias("duration_after"))


@query(
    f"""WITH {sql_smooth(CADENCE)} SELECT video_id, count(*) AS total, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped,
    count(*) FILTER (NOT keep) = 0 OR count(*) FILTER (keep) <= 1 AS copied, count(*) FILTER (keep) / {FPS}::DOUBLE AS duration_after FROM smooth GROUP BY 1"""
)
def dead_frame_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each video: cut, or copied as it is."""
    return detect.dead_frame_outcome(runs.smooth(decisions(spark, sf), CADENCE), FPS)


SQL_CALIBRATED = f"""{SQL_STATS}, c AS (SELECT video_id, CASE WHEN count(*) >= 2 THEN greatest(0.2, least(2.0, quantile_cont(mean_mag, 0.2) * 0.6)) ELSE 0.5 END::DOUBLE AS flow,
    CASE WHEN count(*) >= 2 THEN greatest(0.03, least(0.25, quantile_cont(diff_fraction, 0.15) * 0.4)) ELSE 0.15 END::DOUBLE AS area FROM stats GROUP BY 1)"""


@query(f"WITH {SQL_CALIBRATED} SELECT video_id, round_even(flow, 6) AS flow, round_even(area, 6) AS area FROM c")
def auto_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds from each video's own statistics."""
    return runs.calibrate(pair_stats(spark, sf)).select("video_id", F.bround("flow", 6).alias("flow"), F.bround("area", 6).alias("area"))


@query(f"WITH {SQL_CALIBRATED} SELECT s.video_id, count(*) AS n, count(*) FILTER ({SQL_DEAD.format('flow', 'area')}) AS n_dead FROM stats s JOIN c USING (video_id) GROUP BY 1")
def calibrated_dead_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames dropped under calibrated thresholds, which stand beside each row: one shuffle."""
    is_dead = runs.dead(F.col("mean_mag"), F.col("diff_fraction"), F.col("inlier_ratio"), F.col("frob_norm"), F.col("flow"), F.col("area"))
    rows = runs.with_limits(pair_stats(spark, sf), F.lit(runs.FLOW), F.lit(runs.AREA))
    return rows.groupBy("video_id").agg(F.count("*").alias("n"), F.count_if(is_dead).alias("n_dead"))


@query(
    f"""WITH {SQL_FRAMES}, m AS (SELECT *, min(score) OVER (PARTITION BY video_id) AS lo, max(score) OVER (PARTITION BY video_id) AS hi FROM frames)
    SELECT video_id, i, CASE WHEN hi > lo THEN floor((score - lo) / (hi - lo) * 255) ELSE 0 END::BIGINT AS level FROM m"""
)
def minmax_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """Scores scaled to bytes by video."""
    return frames(spark, sf).select("video_id", "i", runs.min_max_bytes("score", "video_id").alias("level"))


@query(
    f"""WITH {SQL_FRAMES}, n AS (SELECT *, lead(score) OVER (PARTITION BY video_id ORDER BY i) AS nx FROM frames),
    e AS (SELECT *, unnest(CASE WHEN nx IS NULL THEN [0] ELSE [0, 1, 2] END) AS k FROM n)
    SELECT video_id, i * 3 + k AS out_i, k / 3.0::DOUBLE AS alpha, round_even(CASE WHEN k = 0 THEN score ELSE score * (1 - k / 3.0::DOUBLE) + nx * (k / 3.0::DOUBLE) END, 6) AS score FROM e"""
)
def interp_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Threefold interpolation."""
    return runs.expand(frames(spark, sf), 3).withColumn("score", F.bround("score", 6))


# emission


@query(f"WITH {SQL_PACKETS}, m AS (SELECT video_id, seq, value, max(value) OVER (PARTITION BY video_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM packets) SELECT video_id, seq, value FROM m WHERE b IS NULL OR value > b")
def monotone_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress that never falls."""
    return emission.monotone(packets(spark, sf), "value", ["ts_us", "seq"]).select("video_id", "seq", "value")


@query(
    f"""WITH RECURSIVE {SQL_PACKETS}, w AS (SELECT video_id, min(ts_us) AS t FROM packets GROUP BY 1
    UNION ALL SELECT w.video_id, (SELECT min(p.ts_us) FROM packets p WHERE p.video_id = w.video_id AND p.ts_us >= w.t + {20 * HOUR}) FROM w WHERE w.t IS NOT NULL)
    SELECT p.video_id, p.ts_us, min(p.seq) AS seq FROM w JOIN packets p ON p.video_id = w.video_id AND p.ts_us = w.t GROUP BY 1, 2"""
)
def throttled_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress at most every 20 hours."""
    return emission.throttled(packets(spark, sf), 20 * HOUR, "ts_us", "seq")


SQL_READY = f"""{SQL_FRAMES}, ready AS (SELECT video_id, i AS pos, ts_us + (seq * 7919) % 400000 * 1000000 AS ready_us FROM frames)"""


def ready(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("video_id", F.col("i").alias("pos"), (F.col("ts_us") + F.col("seq") * 7919 % 400_000 * 1_000_000).alias("ready_us"))


@query(
    f"""WITH {SQL_READY}, b AS (SELECT video_id, max(ready_us) FILTER (pos < 24) AS batch, max(pos) AS n FROM ready GROUP BY 1)
    SELECT r.video_id, r.pos AS a, greatest(max(x.ready_us), any_value(batch)) AS emit_us FROM ready r JOIN ready x ON r.video_id = x.video_id AND x.pos <= r.pos + 1 JOIN b ON b.video_id = r.video_id WHERE r.pos < n GROUP BY 1, 2"""
)
def ordered_emission(spark: SparkSession, sf: str) -> DataFrame:
    """When pairs may be passed on in order."""
    return emission.pair_emission(ready(spark, sf), 24)


@query(
    f"""WITH {SQL_FRAMES}, p AS (SELECT video_id, i, (score / 20)::DOUBLE AS s FROM frames), q AS (SELECT video_id, i, floor(s) AS v FROM p),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, v ORDER BY i) AS grp FROM q),
    r AS (SELECT video_id, min(i) + 3 AS fourth FROM g WHERE v > 0 GROUP BY video_id, v, grp HAVING count(*) >= 4) SELECT video_id, min(fourth) AS stable_at FROM r GROUP BY 1"""
)
def stable_size_run(spark: SparkSession, sf: str) -> DataFrame:
    """The first time that a size has been the same for three polls after the one that first saw it."""
    polls = frames(spark, sf).select("video_id", "i", F.floor(F.col("score") / 20).alias("v"))
    return emission.stable(polls, "v", 3)


@query(f"WITH {SQL_KEYS} SELECT video_id, seq, ts_us, lead(ts_us) OVER (PARTITION BY video_id ORDER BY ts_us, seq) AS finished_us FROM packets WHERE is_key")
def segment_finished(spark: SparkSession, sf: str) -> DataFrame:
    """When each segment is complete."""
    return emission.finished(packets(spark, sf).where("is_key").select("video_id", "seq", "ts_us"), ["ts_us", "seq"])


@query(
    f"""WITH RECURSIVE {SQL_PACKETS}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts_us, seq) AS i FROM packets),
    walk AS (SELECT video_id, i, ts_us, kind FROM p WHERE i = 1
      UNION ALL SELECT n.video_id, n.i, n.ts_us, n.kind FROM (SELECT w.video_id, (SELECT min(p.i) FROM p WHERE p.video_id = w.video_id AND p.i > w.i AND (p.ts_us - w.ts_us >= {15 * HOUR} OR p.kind <> w.kind)) AS i FROM walk w) x JOIN p n ON n.video_id = x.video_id AND n.i = x.i)
    SELECT w.video_id, p.seq, p.kind FROM walk w JOIN p ON p.video_id = w.video_id AND p.i = w.i"""
)
def presence_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Updates that differ from the last one sent, or are due."""
    return emission.changed_or_due(packets(spark, sf), "kind", 15 * HOUR).select("video_id", "seq", "kind")


@query(f"WITH {SQL_PACKETS} SELECT video_id, seq, count(*) FILTER (kind = 'view') OVER w AS done_views, count(*) OVER w AS done FROM packets WINDOW w AS (PARTITION BY video_id ORDER BY ts_us, seq ROWS UNBOUNDED PRECEDING)")
def phase_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Running counts of two phases."""
    w = boundary.by_video("ts_us", "seq").rowsBetween(W.unboundedPreceding, 0)
    return packets(spark, sf).select("video_id", "seq", F.sum((F.col("kind") == "view").cast("long")).over(w).alias("done_views"), F.count("*").over(w).alias("done"))


@query(
    f"""WITH RECURSIVE {SQL_FRAMES}, p AS (SELECT video_id, i, sum(score::DECIMAL(18, 6)) OVER (PARTITION BY video_id ORDER BY i) AS pct FROM frames),
    walk AS (SELECT video_id, i, pct, 1 AS number FROM p WHERE i = 0
      UNION ALL SELECT n.video_id, n.i, n.pct, x.number FROM (SELECT w.video_id, w.number + 1 AS number, (SELECT min(p.i) FROM p WHERE p.video_id = w.video_id AND p.i > w.i AND p.pct - w.pct >= 150) AS i FROM walk w) x JOIN p n ON n.video_id = x.video_id AND n.i = x.i)
    SELECT video_id, i, number::BIGINT AS number, number::BIGINT % 2 AS slot FROM walk"""
)
def preview_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Previews whenever progress has grown by 150, into two slots in turn."""
    pct = F.sum(F.col("score").cast("decimal(18,6)")).over(boundary.by_video("i").rowsBetween(W.unboundedPreceding, 0))
    return emission.previews(frames(spark, sf).select("video_id", "i", pct.alias("pct")), "pct", 150, ["i"]).select("video_id", "i", "number", "slot")


# scenes and pairs

SQL_RENUMBERED = f"""{SQL_SCENES}, n AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM scenes), k AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS m, row_number() OVER (PARTITION BY video_id ORDER BY scene_index) - 1 AS rn FROM n WHERE end_us - start_us >= {18 * HOUR}),
    renumbered AS (SELECT video_id, CASE WHEN n = m THEN scene_index ELSE rn END AS scene_index, scene_index AS old_index, start_us, end_us FROM k),
    pairs AS (SELECT video_id, scene_index AS a, scene_index + 1 + (scene_index * 7 + video_id) % 2 AS b FROM scenes WHERE (scene_index * 5 + video_id) % 3 = 0)"""


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, v = F.col("scene_index"), F.col("video_id")
    return scenes(spark, sf).where((a * 5 + v) % 3 == 0).select("video_id", a.alias("a"), (a + 1 + (a * 7 + v) % 2).alias("b"))


@query(f"WITH {SQL_RENUMBERED} SELECT * FROM renumbered")
def filter_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of at least 18 hours."""
    return selection.filter_reindex(scenes(spark, sf), 18 * HOUR)


@query(f"WITH {SQL_RENUMBERED} SELECT p.video_id, x.scene_index AS a, y.scene_index AS b FROM pairs p JOIN renumbered x ON p.video_id = x.video_id AND p.a = x.old_index JOIN renumbered y ON p.video_id = y.video_id AND p.b = y.old_index")
def pair_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs after scenes are numbered again."""
    return selection.remap_pairs(pairs(spark, sf), selection.filter_reindex(scenes(spark, sf), 18 * HOUR))


@query(
    f"""WITH RECURSIVE {SQL_RENUMBERED}, c AS (SELECT video_id, count(*) AS n FROM scenes GROUP BY 1),
    walk AS (SELECT video_id, 0::BIGINT AS pos, -1::BIGINT AS taken, n FROM c
      UNION ALL SELECT w.video_id, coalesce(p.b, w.pos) + 1, CASE WHEN p.b IS NULL THEN w.taken ELSE w.taken END + 1, w.n FROM walk w LEFT JOIN (SELECT p.* FROM pairs p JOIN c USING (video_id) WHERE p.b < c.n) p ON p.video_id = w.video_id AND p.a = w.pos WHERE w.pos < w.n)
    SELECT w.video_id, CASE WHEN p.b IS NULL THEN w.pos ELSE w.taken + 1 END AS scene_index, s.start_us, e.end_us FROM walk w LEFT JOIN (SELECT p.* FROM pairs p JOIN c USING (video_id) WHERE p.b < c.n) p ON p.video_id = w.video_id AND p.a = w.pos
    JOIN scenes s ON s.video_id = w.video_id AND s.scene_index = w.pos JOIN scenes e ON e.video_id = w.video_id AND e.scene_index = coalesce(p.b, w.pos)"""
)
def merge_similar(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes merged along pairs."""
    return boundary.merge_similar(scenes(spark, sf), pairs(spark, sf))


@query(f"WITH {SQL_RENUMBERED} SELECT s.video_id, s.scene_index FROM scenes s WHERE EXISTS (SELECT 1 FROM pairs p WHERE p.video_id = s.video_id AND p.a = s.scene_index)")
def phase_split_semi(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of the first phase."""
    return scenes(spark, sf).join(pairs(spark, sf).withColumnRenamed("a", "scene_index"), ["video_id", "scene_index"], "left_semi").select("video_id", "scene_index")


@query(f"WITH {SQL_RENUMBERED} SELECT s.video_id, s.scene_index FROM scenes s WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.video_id = s.video_id AND p.a = s.scene_index)")
def phase_split_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes of the second phase."""
    return scenes(spark, sf).join(pairs(spark, sf).withColumnRenamed("a", "scene_index"), ["video_id", "scene_index"], "left_anti").select("video_id", "scene_index")


@query(f"WITH {SQL_SCENES} SELECT video_id, count(*) AS n, sum(end_us - start_us)::BIGINT AS total_us FROM scenes WHERE end_us - start_us >= {10 * HOUR} GROUP BY 1")
def scene_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Number and total time of scenes of at least ten hours."""
    s = scenes(spark, sf).where(F.col("end_us") - F.col("start_us") >= 10 * HOUR)
    return s.groupBy("video_id").agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


SQL_CHUNKS = f"""{SQL_PACKETS}, cuts AS (SELECT DISTINCT video_id, ts_us - {START} AS t_us FROM packets), c AS (SELECT *, (row_number() OVER (PARTITION BY video_id ORDER BY t_us) - 1) // 15 AS chunk FROM cuts),
    g AS (SELECT video_id, chunk, count(*) AS n_cuts, max(t_us) AS hi, list(t_us ORDER BY t_us) AS ts FROM c GROUP BY 1, 2),
    x AS (SELECT video_id, chunk, n_cuts, coalesce(lag(hi) OVER w, 0) AS start_us, CASE WHEN lead(chunk) OVER w IS NOT NULL THEN hi END AS end_us, ts FROM g WINDOW w AS (PARTITION BY video_id ORDER BY chunk))"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return boundary.segment_batches(clock(packets(spark, sf)).select("video_id", "t_us").distinct(), 15)


@query(f"WITH {SQL_CHUNKS} SELECT video_id, chunk, n_cuts, start_us, end_us, list_sum([t - start_us for t in ts])::BIGINT AS relative_sum FROM x")
def segment_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Cuts in chunks of 15."""
    return chunks(spark, sf).withColumn("relative_sum", F.aggregate("relative", F.lit(0).cast("long"), lambda s, x: s + x)).drop("relative")


@query(
    f"""WITH {SQL_CHUNKS} SELECT video_id, chunk, array_to_string([rtrim(rtrim(printf('%d.%06d', greatest(0, t - start_us - 1000) // 1000000, greatest(0, t - start_us - 1000) % 1000000), '0'), '.') for t in ts], ',') AS times FROM x"""
)
def segment_times_render(spark: SparkSession, sf: str) -> DataFrame:
    """Cut times of each chunk as text."""
    from ..functions.text import segment_times

    return chunks(spark, sf).select("video_id", "chunk", segment_times(F.col("relative")).alias("times"))


@query(f"WITH {SQL_PACKETS} SELECT video_id, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value DESC, seq) AS r FROM packets) WHERE r <= 5")
def top_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest values of each video."""
    return selection.top(packets(spark, sf), "video_id", [F.desc("value"), "seq"], 5).select("video_id", "seq", "value")
