"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target number of words. As many whole epochs as fit come first: every document of the source is taken
that often. The rest of the target is filled by weighted sampling without replacement: a document's key is u ** (1 / w)
with u uniform from a hash of its id and w its quality weight; documents are taken by falling key until the budget is
full, the last of them in part.

The prefix sums are found in two steps, so that no task ever holds a whole source: sizes are summed by source and slice
of the key's range (partial sums before the shuffle), the slice where each budget ends is found from those sums, and
only the documents of that slice are ordered. What goes back to all documents is one row for each source; it is
broadcast if there are at most BROADCAST_SOURCES of them, else joined.

A document's weight is the probability that it is good, as learned from the labels: naive Bayes over the bins of four
statistics of its text, fitted on all labelled documents by one aggregation. Where nothing can be learned all weights are 1.

Null texts have size 0; texts of any length are read whole; a null source is a source, after all others. Equal ids with equal sizes share what is left at
the cut evenly (rounded down). An empty table gives no rows; a source without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import GAP, WORD, fresh, small, table, text_or_empty, write_shared

#: Slices of the keys' range, at least; with more than SLICES ** 2 documents, the square root of their number.
SLICES = 4096
BROADCAST_SOURCES = 10_000
#: A target stops at so many times its source's size.
REPEATS = 3
#: Statistics that quality is learned from, with the number of their bins: shares of plain characters, of different words
#: and of capitals, and the mean length of words.
FEATURES = {"plain": 21, "distinct": 11, "capital": 11, "length": 13}
LEAST_WEIGHT = 0.02
MOST_ROUNDS = 1000


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """`words`, and for each of FEATURES the text's bin."""
    w = F.array_remove(F.split(text, GAP), "")
    n, length = F.size(w), F.length(text)
    bin_of = lambda x, of, bins: F.when(of > 0, F.least(F.lit(bins - 1), F.floor(x / of))).otherwise(0).cast("int")
    share = lambda x, of, bins: bin_of(x * (bins - 1), of, bins)
    return {
        "words": n.cast("long"),
        "plain": share(length - F.length(F.regexp_replace(text, r"[\p{L}\p{N}\x20]++", "")), length, FEATURES["plain"]),
        "distinct": share(F.size(F.array_distinct(w)), n, FEATURES["distinct"]),
        "capital": share(5 * F.regexp_count(text, F.lit(r"\p{Lu}")), length, FEATURES["capital"]),
        "length": bin_of(length, n, FEATURES["length"]),
    }


def learned_quality(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Column:
    """The probability that a document is good, by the labels: naive Bayes over the bins of FEATURES, at least LEAST_WEIGHT. 1 for all where labels have but one kind.

    measured: a table with the id and the bins. What the driver gets is one row for each bin.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_l")).agg((F.min("quality") > 0).alias("_good"))
    held = measured.join(good, F.col(f"`{id_col}`") == F.col("_l"))
    each = held.select("_good", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("bin")) for f in FEATURES])))
    seen = {(r.feature, r.bin): (r.good, r.bad) for r in each.groupBy("feature", "bin").agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).collect()}
    # each labelled row has one bin of each feature
    n_good, n_bad = (sum(v[k] for (f, _), v in seen.items() if f == "plain") for k in (0, 1))
    if not n_good or not n_bad:
        return F.lit(1.0)
    odds = F.lit(math.log((n_good + 1) / (n_bad + 1)))
    for f, bins in FEATURES.items():
        table_ = [math.log((g + 1) / (n_good + bins)) - math.log((b + 1) / (n_bad + bins)) for g, b in (seen.get((f, k), (0, 0)) for k in range(bins))]
        odds = odds + F.get(F.array(*map(F.lit, table_)), F.col(f"`{f}`"))
    return F.greatest(F.lit(LEAST_WEIGHT), 1 / (1 + F.exp(-odds)))


def uniform(*cols: Column, seed: int = 7) -> Column:
    """In the open interval from 0 to 1, from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def shares(sizes: DataFrame) -> DataFrame:
    """source_size by source -> target. Weights 1, 2, 3, repeating, by code point order of the source, null last.

    The excess of capped sources is dealt again by weight until no target is above its cap. As a larger common factor caps
    a superset of sources, the end of that is the factor for which the capped targets and the others' add up: sources are
    ordered by cap / weight, and the first k are capped for the smallest k at which the factor is below the next one's.
    """
    cap = F.col("source_size") * REPEATS
    everything = W.partitionBy()
    by_ratio = W.orderBy("ratio", "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = ranked.withColumn("weight", F.col("rank") % 3 + 1).withColumn("ratio", cap / F.col("weight"))
    capped, open_weight = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in (cap, F.col("weight")))
    factor = (F.sum("source_size").over(everything) - capped) / (F.sum("weight").over(everything) - open_weight)
    ranked = ranked.withColumn("factor", factor)
    ends = F.min(F.when(F.col("factor") <= F.col("ratio"), F.struct("ratio", "rank", "factor"))).over(everything)
    return ranked.withColumn("common", ends["factor"]).select("source", "source_size", F.least(cap.cast("double"), F.col("common") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and taken. Its own columns of these names are replaced; others may have any name."""
    own = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c.lower() not in own]
    key, plan_source, plan_of = fresh(docs.columns, "key", "plan_source", "plan_of")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], size.alias("size"), F.pow(uniform(F.col(f"`{id_col}`")), 1 / weight).alias(key))
    slim, _ = write_shared(rows.select(F.col(f"`{source_col}`").alias("source"), F.col(f"`{id_col}`").alias("id"), "size", F.col(key).alias("key")), "mix")
    slices = max(SLICES, math.isqrt(slim.count()))
    slim = slim.withColumn("slice", F.floor(F.col("key") * slices).cast("int"))

    by_slice = slim.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    sources = shares(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("epochs", whole).withColumn("budget", (F.round("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    falling = W.partitionBy("source").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = (
        by_slice.withColumn("upto", F.sum("words").over(falling))
        .join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .where((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")) & (F.col("words") > 0))
        .groupBy("source")
        .agg(F.max("slice").alias("cut_slice"), F.max_by(F.col("budget") - (F.col("upto") - F.col("words")), "slice").alias("room"))
    )
    # the documents of the slice where the budget ends, equal ones together
    edge = (
        slim.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("cut_slice")))
        .groupBy("source", "room", "key", "id", "size")
        .agg(F.count("*").alias("n"))
    )
    order = W.partitionBy("source").orderBy(F.desc("key"), F.asc_nulls_first("id"), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = (
        edge.withColumn("upto", F.sum(F.col("size") * F.col("n")).over(order))
        .where(F.col("upto") > F.col("room"))
        .groupBy("source")
        .agg(F.min_by(F.struct("key", "id", "size", F.floor((F.col("room") - F.col("upto") + F.col("size") * F.col("n")) / F.col("n")).alias("part")), "upto").alias("end"))
    )
    per_source = plan.join(end.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    per_source = per_source.select(F.col("source").alias(plan_source), F.struct("source_size", "target", "epochs", "end").alias(plan_of))
    known = small(per_source, BROADCAST_SOURCES)
    if known is not None:
        per_source = F.broadcast(docs.sparkSession.createDataFrame(known, per_source.schema))
    plan_ = F.col(plan_of)
    e = plan_["end"]
    id_of, at = F.col(f"`{id_col}`"), F.col(key)
    ahead = (at > e["key"]) | ((at == e["key"]) & ((id_of.isNull() & e["id"].isNotNull()) | (id_of < e["id"]) | (id_of.eqNullSafe(e["id"]) & (F.col("size") < e["size"]))))
    same = (at == e["key"]) & id_of.eqNullSafe(e["id"]) & (F.col("size") == e["size"])
    extra = F.when(e.isNull(), 0).when(F.coalesce(same, F.lit(False)), e["part"]).when(F.coalesce(ahead, F.lit(False)), F.col("size")).otherwise(0)
    return rows.join(per_source, F.col(f"`{source_col}`").eqNullSafe(F.col(plan_source))).select(
        *[F.col(f"`{c}`") for c in kept],
        "size",
        plan_["source_size"].cast("long").alias("source_size"),
        plan_["target"].alias("target"),
        (plan_["epochs"] * F.col("size") + extra).cast("long").alias("taken"),
    )


def measured(docs: DataFrame, text: Column) -> DataFrame:
    """docs with statistics() of a text; the names must be free."""
    return docs.select("*", *[c.alias(n) for n, c in statistics(text).items()])


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    docs = table(spark, sf_dir, "documents")
    sized, _ = write_shared(docs.select("doc_id", "source", *[c.alias(n) for n, c in statistics(text_or_empty()).items()]), "sizes")
    weight = learned_quality(sized, table(spark, sf_dir, "labels"))
    return mix(sized, F.col("words"), weight).select("doc_id", "size", "source_size", "target", "taken")
