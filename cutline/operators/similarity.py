"""Likeness of neighbouring scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vector import cosine


def adjacent(scenes: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """Each scene with the next of its key: key, a, b, cosine. One sorted pass, no self-join."""
    w = W.partitionBy(key).orderBy(order)
    rows = scenes.select(key, F.col(order).alias("a"), F.lead(order).over(w).alias("b"), F.col(vector).alias("va"), F.lead(vector).over(w).alias("vb"))
    return rows.where("b is not null").select(key, "a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def similar(likeness: Column, threshold: float) -> Column:
    """Strictly within the threshold; unknown likeness isn't similar."""
    return F.coalesce((1 - likeness) < threshold, F.lit(False))


def mark(scenes: DataFrame, pairs: DataFrame, key: str, index: str) -> DataFrame:
    """Is a scene in any pair?"""
    members = pairs.select(key, F.explode(F.array("a", "b")).alias(index)).distinct().withColumn("in_pair", F.lit(True))
    return scenes.join(members, [key, index], "left").withColumn("in_pair", F.coalesce("in_pair", F.lit(False)))
