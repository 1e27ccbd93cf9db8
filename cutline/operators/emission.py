"""Which events of an ordered stream are passed on: the batch form; cutline.streaming has the stateful one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boundary import by_video, walked


def monotone(events: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Events whose value is above all before."""
    most = F.max(value).over(by_video(*order).rowsBetween(W.unboundedPreceding, -1))
    return events.withColumn("most", most).where(F.col("most").isNull() | (F.col(value) > F.col("most"))).drop("most")


def throttled(events: DataFrame, least: int, order: str, tie: str) -> DataFrame:
    """Events at least `least` after the last one passed on; the first is."""
    apart = F.col(order) - F.lag(order).over(by_video(order, tie)) >= least
    return walked(events.select("video_id", order, tie), [order, tie], apart, lambda last, r: r[order] - last[order] >= least)


def previews(events: DataFrame, value: str, least: float, order: list[str]) -> DataFrame:
    """Previews passed on when a value has grown by `least` since the last one: video_id, the order, the value, number (from 1), slot (1 and 0 in turn)."""
    most = F.max(value).over(by_video(*order).rowsBetween(W.unboundedPreceding, -1))
    sent = walked(events.select("video_id", *order, value), order, F.col(value) - most >= least, lambda last, r: r[value] - last[value] >= least)
    number = F.row_number().over(by_video(*order)).cast("long")
    return sent.withColumn("number", number).withColumn("slot", F.col("number") % 2)


def pair_emission(ready: DataFrame, first: int) -> DataFrame:
    """When the pair (a, a + 1) may be passed on: once both and all before are ready, and not before the first batch of `first` is.

    ready (video_id, pos, ready_us) -> video_id, a, emit_us.
    """
    upto = F.max("ready_us").over(by_video("pos").rowsBetween(W.unboundedPreceding, 1))
    batch = F.max(F.when(F.col("pos") < first, F.col("ready_us"))).over(W.partitionBy("video_id"))
    n = F.max("pos").over(W.partitionBy("video_id"))
    return ready.withColumn("emit_us", F.greatest(upto, batch)).withColumn("n", n).where(F.col("pos") < F.col("n")).select("video_id", F.col("pos").alias("a"), "emit_us")


def stable(polls: DataFrame, value: str, times: int) -> DataFrame:
    """The first poll of each key at which a value above 0 has been the same as at the poll before for `times` polls in a row, so that it was seen once more than that. polls (video_id, i, value)."""
    w = by_video("i")
    same = F.col(value) > 0
    for k in range(1, times + 1):
        same = same & F.coalesce(F.col(value) == F.lag(value, k).over(w), F.lit(False))
    return polls.withColumn("same", same).where("same").groupBy("video_id").agg(F.min("i").alias("stable_at"))


def finished(opened: DataFrame, order: list[str]) -> DataFrame:
    """A segment is finished when the next one is opened; the last one at the end (null)."""
    return opened.withColumn("finished_us", F.lead("ts_us").over(by_video(*order)))


def changed_or_due(events: DataFrame, detail: str, least_us: int) -> DataFrame:
    """Updates passed on: a detail that differs from that of the last one passed on, or `least_us` since that one. A null detail always differs, as it is held as an empty one. -> video_id, ts_us, seq, detail."""
    at = by_video("ts_us", "seq")
    always = (F.col("ts_us") - F.lag("ts_us").over(at) >= least_us) | F.col(detail).isNull()
    differs = lambda last, r: r[detail].isNull() | (r[detail] != F.coalesce(last[detail], F.lit("")))
    return walked(events.select("video_id", "ts_us", "seq", detail), ["ts_us", "seq"], always, lambda last, r: (r["ts_us"] - last["ts_us"] >= least_us) | differs(last, r))
