"""Quality classifier by importance resampling (DSIR: Xie et al., 2023).

Two bags of hashed n-grams (words and word pairs, lower case) are counted: one over all documents, one over the target,
documents labelled good and not toxic. A document's log weight is the sum over its n-grams of the log ratio of the two
smoothed models. Gumbel top-k takes k documents without replacement in proportion to their weights: k is the share of
target documents among the labelled, times all documents.

Counts are summed within tasks before the shuffle; a model has BUCKETS numbers at most, whatever the input. The target
is fitted on at most TARGET_LABELS labelled ids (those with the least hash). The k-th key is found by narrowing ranges
of the keys, and of the ids where more keys are equal, with aggregates until at most NARROW rows are left; no more ever
reach the driver.

Null texts count as empty (weight 0). Texts of any length count whole; columns but the id and the text are ignored. Equal keys are taken by id, null ids first, equal ids together. Without labels of the target every
weight is 0 and all documents are kept. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, text_or_empty, write_shared

#: Half for words, half for pairs.
BUCKETS = 1 << 17
TARGET_LABELS = 20_000
SMOOTHING = 0.5
NARROW = 10_000
SEED = 11


class Hasher:
    """n-grams of texts as buckets; the hashes of words are remembered, at most `most`."""

    def __init__(self, buckets: int, most: int = 300_000):
        self.half, self.most, self.known = buckets // 2, most, {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.lower().encode("utf-8", "surrogatepass").split()
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w) >> 1
        h = np.array([known[w] for w in words], np.int64)
        pairs = (h[:-1] * 3 ^ (h[1:] >> 7)) * 0x2545F4914F6CDD1D
        return np.concatenate([h % self.half, self.half + (pairs >> 20) % self.half])


def counts(docs: DataFrame, target: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all rows (id, text), and of those whose id is in target."""
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(frozenset(target))

    def task(batches):
        import pyarrow as pa

        hasher, n = Hasher(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.bincount(hasher(t.as_py()), minlength=buckets) if len(t.as_py()) > 1 << 16 else None
                for row in (0, 1) if i in ids.value else (0,):
                    if got is None:
                        np.add.at(n[row], hasher(t.as_py()), 1)
                    else:
                        n[row] += got
        at = np.flatnonzero(n[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0][at]), pa.array(n[1][at])], names=["b", "n", "m"])

    total = docs.mapInArrow(task, "b long, n long, m long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toPandas()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    raw[total["b"]], good[total["b"]] = total["n"], total["m"]
    ids.unpersist()
    return raw, good


def log_ratio(raw: np.ndarray, good: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    out = np.zeros(len(raw))
    for part in (slice(0, len(raw) // 2), slice(len(raw) // 2, None)):
        if good[part].sum():
            p, q = good[part] + smoothing, raw[part] + smoothing
            out[part] = np.log(p / p.sum()) - np.log(q / q.sum())
    return out


def weigh(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """docs (id, text) -> doc_id, n_grams, log_weight."""
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def task(batches):
        import pyarrow as pa

        hasher, r = Hasher(len(ratio_of(model))), ratio_of(model)
        for batch in batches:
            n, w = [], []
            for t in batch.column(1):
                at = hasher(t.as_py())
                n.append(len(at))
                w.append(float(r[at].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(w, pa.float64())], names=["doc_id", "n_grams", "log_weight"])

    return docs.mapInArrow(task, "doc_id long, n_grams long, log_weight double")


def ratio_of(model):
    return model.value


def gumbel(*cols: F.Column) -> F.Column:
    """Standard Gumbel noise from a hash of the columns."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_key(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """The k-th largest (key, smaller id first) of keys (key double, doc_id long); None if there are no more than k."""
    total, low, high = keys.agg(F.count("*"), F.min("key"), F.max("key")).first()
    if total <= k:
        return None
    above = 0  # keys > high
    while True:
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        rows = small(inside.select("key", "doc_id"), NARROW)
        if rows is not None:
            order = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
            return tuple(order[k - above - 1]) if k > above else (np.nextafter(high, np.inf), None)
        if low == high:  # more than NARROW equal keys
            return low, kth_id(inside, k - above)
        width = (high - low) / 1024
        slice_ = F.least(F.floor((F.col("key") - low) / width), F.lit(1023))
        n = {r[0]: (r[1], r[2], r[3]) for r in inside.groupBy(slice_.alias("s")).agg(F.count("*"), F.min("key"), F.max("key")).collect()}
        for s in sorted(n, reverse=True):
            if above + n[s][0] >= k:
                low, high = n[s][1], n[s][2]
                break
            above += n[s][0]


def kth_id(rows: DataFrame, k: int) -> int | None:
    """The k-th smallest doc_id, null ids first (None: a null one)."""
    nulls, low, high = rows.agg(F.count_if(F.col("doc_id").isNull()), F.min("doc_id"), F.max("doc_id")).first()
    below = nulls  # ids < low
    if k <= below:
        return None
    while low < high:
        width = (high - low) // 1024 + 1
        slice_ = F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("int")
        n = {r[0]: (r[1], r[2], r[3]) for r in rows.where(F.col("doc_id").between(low, high)).groupBy(slice_.alias("s")).agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).collect()}
        for s in sorted(n):
            if below + n[s][0] >= k:
                low, high = n[s][1], n[s][2]
                break
            below += n[s][0]
    return low


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", share: float | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, kept for each row. share: of the rows to keep; by default that of the target among the labelled."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(((F.min("quality") > 0) & (F.coalesce(F.max("toxic"), F.lit(0)) == 0)).alias("good"))
    good, labelled = known.agg(F.count_if("good"), F.count("*")).first()
    target = [r[0] for r in known.where("good").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_LABELS).select("doc_id").collect()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
    ratio = log_ratio(*counts(rows, target, buckets))
    keyed, _ = write_shared(weigh(rows, ratio).withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"))), "resample")
    if share is None:
        share = good / labelled if good else 1.0
    end = kth_key(keyed.select(F.col("sample_key").alias("key"), "doc_id"), round(share * keyed.count()))
    if end is None:
        return keyed.withColumn("kept", F.lit(True))
    key, last = F.col("sample_key"), end[1]
    tie = F.col("doc_id").isNull() if last is None else F.col("doc_id").isNull() | (F.col("doc_id") <= last)
    return keyed.withColumn("kept", (key > end[0]) | ((key == end[0]) & tie))


def op10_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document, and whether the sample takes it."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
