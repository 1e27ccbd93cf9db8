"""Audit of how filters interact: what each removes behind every set of others, in every order.

Orders of the filters form a trie. It is walked depth first: each state is the DataFrame of the rows that survive the
filters applied so far, persisted while its subtrees are walked, and each edge counts what its filter really removes from
the survivors. Which rows survive doesn't depend on the order of a prefix, so a state is computed once for each set of
filters (2 ** k states, k * 2 ** (k - 1) edges) and not once for each of the k! orders; at most k + 1 states are persisted
at a time. Survivors are narrow rows (part, flags, marks) that come from a table in the shared folder, so what is lost
with an executor is filtered again. Counts by edge go to a table too; the driver sees none.

Everything reported comes from edges: what a filter would fail but others took before is its edge from the empty set less
its edge here, and what it fails alone is its edge behind all others.

Null texts count as empty, null languages as the empty string. Words are compared by case. A document without an id is
never a copy, and nothing is a copy of it; rows of one id with the same text aren't copies of each other. Labels of a
repeated id count once: a document is good or toxic if any of its labels says so. Texts of any length are read whole. An
empty table gives no rows.
"""

from __future__ import annotations

import uuid
from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, look_up, shared_table, table, text_or_empty, write_shared

FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
FILTERS = ("A", "B", "C", "D", "E")
MARKS = ("good", "toxic")


def copies(rows: DataFrame, id_col: str, digest: str) -> DataFrame:
    """rows with `copy`: does a smaller id have the same digest anywhere? Only digests that occur twice are joined back, the frequent ones by broadcast."""
    texts = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(digest).alias("k")).agg(F.count("*").alias("n"), F.min(id_col).alias("least"))
    known, _ = write_shared(texts.where("n > 1"), "same-texts")
    found = look_up(rows, digest, known, [id_col])
    return found.withColumn("copy", F.coalesce(F.col(id_col) > F.col("found")["least"], F.lit(False))).drop("found")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text), labels (doc_id, quality, toxic) -> part, what each filter says, good, toxic. Texts are read once, and only digests and flags are shuffled."""
    text = text_or_empty()
    words = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t")).withColumn("w", F.array_remove(F.split("t", GAP), ""))
    n, t = F.size("w"), F.col("t")
    flags = words.select(
        "doc_id",
        "part",
        F.sha2("t", 256).alias("digest"),
        (n < FEWEST_WORDS).alias("A"),
        (100 * F.size(F.array_distinct("w")) < LEAST_DISTINCT * n).alias("B"),
        (100 * F.regexp_count(t, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(t)).alias("C"),
        t.rlike(SYMBOLS).alias("D"),
    )
    flags, _ = write_shared(flags, "flags")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_l")).agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    judged = copies(flags, "doc_id", "digest").withColumnRenamed("copy", "E").join(marks, F.col("doc_id") == F.col("_l"), "left")
    return judged.select("part", *FILTERS, *[F.coalesce(m, F.lit(False)).alias(m) for m in MARKS])


def edges(judged: DataFrame, filters: tuple[str, ...], marks: tuple[str, ...] = ()) -> DataFrame:
    """judged (part, a boolean for each filter: does the row fail it, a boolean for each mark) -> part, done (bits of the filters before), filter, survivors, removed, and {mark}_lost: rows with the mark among the removed. Parts without survivors of a state have no edges there."""
    spark = judged.sparkSession
    base, _ = write_shared(judged.select("part", *[F.coalesce(c, F.lit(False)).alias(c) for c in (*filters, *marks)]), "judged")
    counted, path = shared_table(spark, f"edges-{uuid.uuid4().hex}")
    seen = set()

    def count(rows: DataFrame, done: int, todo: list[str]) -> DataFrame:
        def edge(f: str):
            return F.struct(F.lit(f).alias("filter"), F.count_if(f).alias("removed"), *[F.count_if(F.col(f) & F.col(m)).alias(f"{m}_lost") for m in marks])

        per_part = rows.groupBy("part").agg(F.count("*").alias("survivors"), F.array(*[edge(f) for f in todo]).alias("out"))
        return per_part.select("part", F.lit(done).alias("done"), "survivors", F.inline("out"))

    def visit(rows: DataFrame, done: int) -> None:
        seen.add(done)
        todo = [f for i, f in enumerate(filters) if not done >> i & 1]
        if not todo:
            return
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        count(rows, done, todo).write.mode("append").parquet(path)
        for f in todo:
            after = done | 1 << filters.index(f)
            if after not in seen:
                visit(rows.where(~F.col(f)), after)
        rows.unpersist()

    visit(base, 0)
    return counted(f"part string, done int, survivors long, filter string, removed long{''.join(f', {m}_lost long' for m in marks)}")


def audit(judged: DataFrame, filters: tuple[str, ...], marks: tuple[str, ...] = ()) -> DataFrame:
    """edges() unrolled: a row for each part, order of the filters and step, zeros included -> part, filter_order, step, kept, removed, redundant, unique_fails, {mark}_lost, shapley."""
    spark, k = judged.sparkSession, len(filters)
    found = edges(judged, filters, marks)
    # so many orders have just these filters before
    weight = F.get(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), F.bit_count("done"))
    own = F.get(F.array(*[F.lit(1 << i) for i in range(k)]), (F.array_position(F.array(*map(F.lit, filters)), F.col("filter")) - 1).cast("int"))
    others = F.lit((1 << k) - 1) - own
    total = found.groupBy(F.col("part").alias("_p"), F.col("filter").alias("_f")).agg(
        F.max(F.when(F.col("done") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.max(F.when(F.col("done") == others, F.col("removed"))), F.lit(0)).cast("long").alias("unique_fails"),
        F.sum(F.col("removed") * weight).cast("long").alias("shapley"),
    )
    steps = []
    for order in permutations(range(k)):
        for at, i in enumerate(order):
            steps.append((len(steps), "".join(filters[j] for j in order), at + 1, sum(1 << j for j in order[:at]), filters[i]))
    steps_ = F.broadcast(spark.createDataFrame(steps, "n int, filter_order string, step int, _done int, _filter string"))
    parts = found.where("done = 0").select(F.col("part").alias("_part")).distinct()
    grid = parts.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(steps_, "n")
    grid = grid.join(total, (F.col("_part") == F.col("_p")) & (F.col("_filter") == F.col("_f")))
    grid = grid.join(found, (F.col("_part") == F.col("part")) & (F.col("_done") == F.col("done")) & (F.col("_filter") == F.col("filter")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return grid.select(
        F.col("_part").alias("part"),
        "filter_order",
        "step",
        zero(F.col("survivors") - F.col("removed")).alias("kept"),
        zero(F.col("removed")).alias("removed"),
        (F.col("fails") - zero(F.col("removed"))).alias("redundant"),
        "unique_fails",
        *[zero(F.col(f"{m}_lost")).alias(f"{m}_lost") for m in marks],
        "shapley",
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, for each language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return audit(judge(docs, table(spark, sf_dir, "labels")), FILTERS, MARKS)
