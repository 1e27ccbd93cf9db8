"""Queries of whole commands: probing, dead frames with a user's flags, batches of clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.proxies import SQL_STATS, packets, pair_stats
from . import detect
from .registry import query
from .sequence_queries import FPS, SQL_DEAD, SQL_KEYS, SQL_SCENES, clock, scenes
from .videos import Videos

SECOND = 1_000_000
CODECS = ("h264", "HEVC ", "hevc", "av1")


def videos(spark: SparkSession, sf: str) -> Videos:
    """Users of events as videos; their facts are texts made from the number."""
    v = F.col("video_id")
    rows = packets(spark, sf)
    text = lambda c: c.cast("string")
    facts = rows.select("video_id").distinct().select(
        "video_id",
        F.concat(F.lit("/in/v"), text(v), F.lit(".mkv")).alias("path"),
        (v * 1000).alias("size"),
        (v * 7).alias("mtime_ns"),
        F.when(v % 5 > 0, "24000/1001").otherwise("25").alias("rate"),
        F.when(v % 7 > 0, F.concat_ws("x", text(v % 4000), text(v % 2000))).otherwise("N/A").alias("dimensions"),
        F.concat(text(v % 5000), F.lit(".25")).alias("seconds"),
        F.get(F.array(*map(F.lit, CODECS)), (v % 4).cast("int")).alias("codec"),
    )
    return Videos(facts, clock(rows))


@query(
    f"""WITH {SQL_KEYS}, k AS (SELECT video_id, count(*) AS n, CASE WHEN count(*) > 1 THEN round_even((max(t_us) - min(t_us)) / (count(*) - 1) / 1e6::DOUBLE, 3) END AS gap FROM keys GROUP BY 1), v AS (SELECT DISTINCT video_id FROM packets)
    SELECT v.video_id, 'v' || v.video_id || '.mkv' AS name, CASE WHEN v.video_id % 7 > 0 THEN v.video_id % 4000 END AS width, CASE WHEN v.video_id % 7 > 0 THEN v.video_id % 2000 END AS height,
    CASE WHEN v.video_id % 5 > 0 THEN 23.976::DOUBLE END AS fps, CASE WHEN v.video_id % 5 > 0 THEN floor(24000 / 1001.0::DOUBLE * (v.video_id % 5000 + 0.25::DOUBLE))::BIGINT END AS n_frames, (v.video_id % 5000) * 1000 + 250 AS duration_ms,
    v.video_id % 4 IN (1, 2) AS hevc, coalesce(n, 0) AS n_keys, gap AS average_gap, substr(sha1('/in/v' || v.video_id || '.mkv|' || (v.video_id * 1000) || '|' || (v.video_id * 7)), 1, 12) AS print, false AS cached FROM v LEFT JOIN k USING (video_id)"""
)
def probe_report(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of each video."""
    return videos(spark, sf).probe()


# camera movement is kept, so the rule in the middle is off
@query(
    f"""WITH {SQL_STATS}, c AS (SELECT video_id, CASE WHEN count(*) >= 2 THEN greatest(0.2, least(2.0, quantile_cont(mean_mag, 0.2) * 0.6)) ELSE 0.5 END::DOUBLE AS flow, CASE WHEN count(*) >= 2 THEN greatest(0.03, least(0.25, quantile_cont(diff_fraction, 0.15) * 0.4)) ELSE 0.15 END::DOUBLE AS area FROM stats GROUP BY 1),
    decided AS (SELECT video_id, i, NOT (mean_mag < flow OR diff_fraction < area) AS keep FROM stats JOIN c USING (video_id) UNION ALL SELECT DISTINCT video_id, 0, true FROM stats),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, keep ORDER BY i) AS grp FROM decided), s AS (SELECT video_id, i, keep OR count(*) OVER (PARTITION BY video_id, keep, grp) < 2 AS keep FROM g),
    h AS (SELECT *, i - row_number() OVER (PARTITION BY video_id, keep ORDER BY i) AS grp FROM s)
    SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY min(i)) - 1 AS segment_index, min(i) / {FPS}::DOUBLE AS start_sec, (max(i) + 1) / {FPS}::DOUBLE AS end_sec FROM h WHERE keep GROUP BY video_id, grp"""
)
def dead_frame_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments left with calibrated thresholds when camera movement is kept."""
    return detect.drop_dead_frames(pair_stats(spark, sf), FPS, auto=False, cadence=2, keep_camera=True)


@query(
    f"""WITH {SQL_STATS}, c AS (SELECT video_id, CASE WHEN count(*) >= 2 THEN greatest(0.2, least(2.0, quantile_cont(mean_mag, 0.2) * 0.6)) ELSE 0.5 END::DOUBLE AS flow FROM stats WHERE i <= 5 GROUP BY 1)
    SELECT video_id, i, NOT ({SQL_DEAD.format('coalesce(flow, 0.5)', '0.005')}) AS keep FROM stats LEFT JOIN c USING (video_id) UNION ALL SELECT DISTINCT video_id, 0, true FROM stats"""
)
def sampled_dead_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions with a flow threshold from each video's first five statistics, and an area that is too small to be calibrated."""
    return detect.dead_frames(pair_stats(spark, sf), auto=True, area=0.005, sample=5)


_EARLIER = "CASE WHEN d IS NULL THEN u WHEN u IS NULL THEN d WHEN u - start_us < start_us - d THEN u ELSE d END"


@query(
    f"""WITH {SQL_SCENES}, items AS (SELECT video_id, video_id * 1000 + scene_index AS item, CASE WHEN scene_index % 7 = 3 THEN 'c' END AS clip, scene_index % 2 = 0 AS thumb, scene_index % 11 > 0 AS named, start_us, CASE WHEN scene_index % 5 = 2 THEN start_us ELSE end_us END AS end_us FROM scenes),
    near AS (SELECT s.*, d.t_us AS d, u.t_us AS u, b.t_us AS b, f.t_us AS f FROM items s ASOF LEFT JOIN keys d ON s.video_id = d.video_id AND s.start_us >= d.t_us
      ASOF LEFT JOIN keys u ON s.video_id = u.video_id AND s.start_us < u.t_us ASOF LEFT JOIN keys b ON s.video_id = b.video_id AND s.start_us > b.t_us ASOF LEFT JOIN keys f ON s.video_id = f.video_id AND s.start_us <= f.t_us),
    x AS (SELECT *, CASE WHEN abs(({_EARLIER}) - start_us) <= {5 * SECOND} AND ({_EARLIER}) < end_us THEN {_EARLIER} END AS snap, CASE WHEN clip IS NOT NULL THEN NULL WHEN NOT named THEN 'no source' WHEN video_id % 17 = 0 THEN 'unknown source' WHEN end_us <= start_us THEN 'empty range' END AS error FROM near),
    y AS (SELECT *, CASE WHEN clip IS NOT NULL THEN 'copied' WHEN error IS NOT NULL THEN NULL WHEN coalesce(start_us - b <= 200000, false) OR coalesce(f - start_us <= 200000, false) THEN 'copy' WHEN video_id % 4 IN (1, 2) AND snap IS NOT NULL THEN 'snapped_copy'
      WHEN video_id % 4 NOT IN (1, 2) AND u < end_us AND (u - start_us) / (end_us - start_us)::DOUBLE < 0.9 THEN 'smartcut' ELSE 'reencode' END AS how FROM x)
    SELECT item, how, CASE WHEN how = 'copied' OR error IS NOT NULL THEN NULL WHEN how = 'snapped_copy' THEN snap ELSE start_us END AS start_us,
    CASE WHEN error IS NOT NULL THEN NULL WHEN how = 'copied' AND thumb THEN 'there' WHEN how IN ('copied', 'copy', 'snapped_copy') THEN 'first_keyframe' ELSE 'first_frame' END AS poster, error FROM y"""
)
def materialise_batch(spark: SparkSession, sf: str) -> DataFrame:
    """How each item of a batch becomes a clip, and why some can't."""
    n, v = F.col("scene_index"), F.col("video_id")
    items = scenes(spark, sf).select(
        (v * 1000 + n).alias("item"),
        F.when(n % 7 == 3, "c").alias("clip"),
        F.when(n % 2 == 0, "t").alias("thumbnail"),
        F.when(n % 11 > 0, F.concat(F.lit("/in/v"), v.cast("string"), F.lit(".mkv"))).alias("source"),
        "start_us",
        F.when(n % 5 == 2, F.col("start_us")).otherwise(F.col("end_us")).alias("end_us"),
    )
    known = videos(spark, sf)
    known.facts = known.facts.where(v % 17 > 0)
    return known.materialise(items)
