"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose score is above a cutoff. Labelled documents are the holdout: for each stratum (language)
and rule, cutoffs are tried from lenient to strict. A cutoff is certified if the exact binomial upper bound of its share
of rejected good documents stays within RISK / number of rules at confidence 1 - DELTA / (strata x rules) (Bonferroni);
along one rule's cutoffs testing stops at the first that fails (fixed sequence), so no further correction is due. Of the
certified cutoffs the most lenient that rejects most bad documents is used; where none is certified, or none rejects bad
documents, the rule is off. Every stratum with labels has its own guarantee; those without any use the cutoffs of the
labelled documents without a stratum.

The statistics are computed in one scan without a shuffle and kept as a narrow table; only that is joined with the
labels. The cutoffs are a table with a row for each stratum that has labels, broadcast if there are at most
BROADCAST_STRATA, else joined by shuffle.

Null texts have no words (and so fail the base rules). Texts of any length are measured whole. Of cutoffs that reject equally
many bad documents the most lenient is used; a score that is equal to its cutoff passes. Columns named as FEATURES are
replaced, others of any name pass. Repeated rows count as often as they come. An empty table gives no
rows, empty labels leave the base rules alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, GAP, broadcast_if, fresh, table, text_or_empty, write_shared

WINDOW = 8
BROADCAST_STRATA = 100_000
RISK, DELTA = 0.03, 0.05
#: Share of words in repeated windows, and number of words, beyond which a document fails without any label.
BASE_REPEAT, BASE_WORDS = 30, 20
#: Each rule's score as SQL (null: the rule doesn't apply), and its cutoffs from lenient to strict.
RULES = {
    "symbols": ("n_symbols / n_words", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.9, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / n_words", (30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    "short_words": ("- word_chars / n_words", (-1.0, -1.5, -2.0, -2.5, -3.0, -3.5)),
    "few_words": ("- n_words", (-5.0, -10.0, -20.0, -30.0, -40.0, -50.0)),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def features(docs: DataFrame, text: Column) -> DataFrame:
    """docs and the columns FEATURES of text; columns of docs with such names are replaced."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in FEATURES]
    t, w_, l_, h_, s_, p_ = fresh(docs.columns, "t", "w", "l", "h", "s", "p")
    none = F.array().cast("array<bigint>")
    df = docs.select(*keep, text.alias(t))
    df = df.select(
        *keep,
        F.filter(F.split(t, GAP), lambda w: w != "").alias(w_),
        F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias(l_),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *keep,
        "n_symbols",
        F.size(w_).cast("long").alias("n_words"),
        F.length(F.array_join(w_, "")).cast("long").alias("word_chars"),
        F.size(l_).cast("long").alias("n_lines"),
        (F.size(l_) - F.size(F.array_distinct(l_))).cast("long").alias("n_dup_lines"),
        F.when(F.size(w_) > WINDOW, F.transform(w_, lambda w: F.xxhash64(w))).otherwise(none).alias(h_),
    )

    def joined(name: str, step: int) -> Column:
        """Hashes of twice as long windows from those of windows of `step` words."""
        n = F.greatest(F.size(name) - step, F.lit(0))
        return F.zip_with(F.slice(name, 1, n), F.slice(name, step + 1, n), lambda a, b: F.xxhash64(a, b))

    df = df.withColumn(h_, joined(h_, 1)).withColumn(h_, joined(h_, 2)).withColumn(h_, joined(h_, 4))
    twice = F.size(h_) > F.size(F.array_distinct(h_))
    df = df.withColumn(s_, F.when(twice, F.sort_array(F.transform(h_, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    at = F.get
    same = lambda i, x: F.coalesce(at(s_, i)["h"] == x["h"], F.lit(False))
    df = df.withColumn(p_, F.sort_array(F.filter(F.transform(s_, lambda x, i: F.when(same(i - 1, x) | same(i + 1, x), x["i"])), lambda p: p.isNotNull())))
    covered = F.transform(p_, lambda p, i: F.least(F.coalesce(at(p_, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0).cast("long")))
    # behind a generator, filters on the statistics are not pushed down and written out in full
    return df.select(*keep, F.inline(F.array(F.struct(*FEATURES))))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X binomial (n, p), exactly for k <= np; 1 above that."""
    log_pmf = (
        F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i))
        + k * math.log(p)
        + (n - k) * math.log1p(-p)
    )
    down = F.when(k > 0, F.sequence(k, F.lit(1).cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    below = F.aggregate(
        down,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("term"), (s["sum"] + s["term"] * i / (n - i + 1) * ((1 - p) / p)).alias("sum")),
    )["sum"]
    return F.when(k > n * p, 1.0).otherwise(F.exp(log_pmf) * below)


def score(rule: str) -> Column:
    return F.when(F.col("n_words") > 0, F.try_divide(F.expr(RULES[rule][0].split(" / ")[0]).cast("double"), F.expr(RULES[rule][0].split(" / ")[1]).cast("double")) if " / " in RULES[rule][0] else F.expr(RULES[rule][0]).cast("double"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))


def calibrate(held_out: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (in the order of RULES; null: off): a row for each stratum with labels, null among them.

    held_out: FEATURES, stratum (string), good (boolean); a written table.
    """
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), (F.coalesce(score(r), F.lit(float("-inf"))) > c).alias("rejected")) for r, (_, cutoffs) in RULES.items() for i, c in enumerate(cutoffs)]
    tried = (
        held_out.select("stratum", "good", F.inline(F.array(*tests)))
        .groupBy("stratum", "rule", "step", "cutoff")
        .agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("rejected")).alias("k"), F.count_if(~F.col("good") & F.col("rejected")).alias("bad"))
    )
    strata = held_out.select("stratum").distinct().count()
    along = W.partitionBy("stratum", "rule").orderBy("step").rowsBetween(W.unboundedPreceding, W.currentRow)
    usable = F.col("certified") & (F.col("bad") > 0)
    chosen = (
        tried.withColumn("passes", binomial_tail(F.col("n"), F.col("k"), risk / len(RULES)) <= delta / len(RULES) / max(1, strata))
        .withColumn("certified", F.min("passes").over(along))
        .groupBy("stratum", "rule")
        .agg(F.max_by(F.when(usable, F.col("cutoff")), F.when(usable, F.struct("bad", (-F.col("step")).alias("step")))).alias("cutoff"))
    )
    by_rule = F.map_from_entries(F.collect_list(F.struct("rule", "cutoff")))
    return chosen.groupBy("stratum").agg(by_rule.alias("m")).select("stratum", F.array(*[F.try_element_at("m", F.lit(r)) for r in RULES]).alias("cutoffs"))


def with_verdict(measured: DataFrame, cutoffs: DataFrame, name: str = "kept", stratum: str = "stratum") -> DataFrame:
    """measured with a column: is a document kept, by the base rules and its stratum's cutoffs? cutoffs: a written table. Column names of measured are to differ from `own` and `own_cutoffs`."""
    pool = cutoffs.where("stratum is null").first()
    pooled = F.array(*[F.lit(x).cast("double") for x in (pool["cutoffs"] if pool else [None] * len(RULES))])
    named = broadcast_if(cutoffs.where("stratum is not null").select(F.col("stratum").alias("own"), F.col("cutoffs").alias("own_cutoffs")), BROADCAST_STRATA)
    out = base_failed()
    for i, r in enumerate(RULES):
        limit = F.when(F.col("own").isNotNull(), F.get("own_cutoffs", F.lit(i))).otherwise(F.get(pooled, F.lit(i)))
        out = out | F.coalesce(score(r) > limit, F.lit(False))
    return measured.join(named, F.col(stratum) == F.col("own"), "left").withColumn(name, ~out).drop("own", "own_cutoffs")


def held_out(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """measured (doc_id, stratum, FEATURES) with its labels."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_d")).agg((F.min("quality") > 0).alias("good"))
    return measured.join(good, F.col("doc_id") == F.col("_d")).select("stratum", "good", *FEATURES)


def cutoffs_for(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """The cutoffs of measured documents (a written table) by their labels, as a written table."""
    held, _ = write_shared(held_out(measured, labels), "held-out")
    return write_shared(calibrate(held), "cutoffs")[0]


def op8_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum"), "text")
    measured, _ = write_shared(features(docs, text_or_empty()).drop("text"), "quality")
    judged = with_verdict(measured, cutoffs_for(measured, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), "kept")
