"""The given tables in the roles of sequences: which column stands for what is all that these decide."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, seq, ts_us, is_key, value, kind: a packet for each event, a video for each user; sign-ups are keyframes."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"),
        F.col("event_id").alias("seq"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        (F.col("event_type") == "signup").alias("is_key"),
        "value",
        F.col("event_type").alias("kind"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i (from 0, in time order), score, ts_us, seq, is_key."""
    at = F.row_number().over(W.partitionBy("video_id").orderBy("ts_us", "seq")) - 1
    return packets(spark, sf_dir).select("video_id", at.cast("long").alias("i"), F.col("value").alias("score"), "ts_us", "seq", "is_key")


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, i, mean_mag, diff_fraction, inlier_ratio, frob_norm (null for some): statistics of a frame and the one before, from i = 1."""
    df = frames(spark, sf_dir)
    before = F.lag("score").over(W.partitionBy("video_id").orderBy("i"))
    return df.withColumn("before", before).where("before is not null").select(
        "video_id",
        "i",
        (F.abs(F.col("score") - F.col("before")) / 50).alias("mean_mag"),
        (F.col("score") / 500).alias("diff_fraction"),
        (F.pmod("seq", F.lit(10)) / 10.0).alias("inlier_ratio"),
        F.when(F.pmod("seq", F.lit(3)) > 0, F.pmod("seq", F.lit(7)) / 3.0).alias("frob_norm"),
    )


#: The same roles in DuckDB's SQL, as common table expressions.
SQL_PACKETS = "packets AS (SELECT user_id AS video_id, event_id AS seq, epoch_us(ts) AS ts_us, event_type = 'signup' AS is_key, value, event_type AS kind FROM events)"
SQL_FRAMES = SQL_PACKETS + ", frames AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts_us, seq) - 1 AS i, value AS score, ts_us, seq, is_key FROM packets)"
SQL_STATS = (
    SQL_FRAMES
    + """, stats AS (SELECT video_id, i, abs(score - b) / 50 AS mean_mag, score / 500 AS diff_fraction, (seq % 10) / 10.0::DOUBLE AS inlier_ratio,
    CASE WHEN seq % 3 > 0 THEN (seq % 7) / 3.0::DOUBLE END AS frob_norm FROM (SELECT *, lag(score) OVER (PARTITION BY video_id ORDER BY i) AS b FROM frames) WHERE b IS NOT NULL)"""
)
