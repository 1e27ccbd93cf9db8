"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014).

Every round is a table in the shared folder, so a lost executor costs one round at most, and plans stay short. Links
never reach the driver, which sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, look_up, write_shared

MOST_ROUNDS = 60


def _link(u: str, v: str) -> Column:
    return F.struct(F.col(u).alias("u"), F.col(v).alias("v"))


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) -> (u, v, m): m the least of u and its neighbours v. The minima of the largest hubs are broadcast, so that a hub's rows need not meet in a task."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return look_up(pairs, "u", least, ["v"]).select("u", "v", F.least("u", F.col("found")["m"]).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(_link("u", "v"), _link("v", "u"))))
    return _least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    joined = _least(edges)
    return joined.select(F.inline(F.array(_link("v", "m"), _link("u", "m")))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v: long) -> (node, component): the least node that can be reached, for every node that is not the least of its own."""
    spark = links.sparkSession
    now, path = write_shared(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == last or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = tuple(state)
        old = path
        now, path = write_shared(_small(_large(now)), "links")
        drop_shared(spark, old)
    raise RuntimeError("components did not settle")
