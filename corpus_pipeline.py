"""A corpus from raw documents to packed sequences: quality rules, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever other columns those have: a stage works on
columns that it names itself, and gives the given names back. An empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.llm import op4_packing as packing
from cutline.llm import op5_lines as line_dedup
from cutline.llm import op7_mixing as mixing
from cutline.llm import op8_quality as quality
from cutline.llm import op9_simhash as simhash
from cutline.llm.common import BLANKS, broadcast_if, drop_shared, numbered_columns, scratch, shared_dir, table, text_or_empty, write_shared


#: Labelled ids that are broadcast.
LABELLED = 1_000_000


def _columns(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """docs under names that can't clash, and what the given names have become."""
    return numbered_columns(docs), [f"c{docs.columns.index(n)}" for n in names]


def _with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """rows (docs under other names, and more) as docs again, with a new text and its length."""
    out = [F.col(f"c{i}") for i in range(len(docs.columns))]
    out[docs.columns.index("text")] = text
    out[docs.columns.index("n_chars")] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return rows.select(*out).toDF(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules keep.

    Only the narrow statistics of labelled documents are stored (of all, where there are more than LABELLED ids to tell
    them by); the verdict is computed with statistics again, which costs CPU but moves no texts.
    A null text has no words and goes; a null language uses the cutoffs of labelled documents without one; repeated rows
    share their fate; labels of a repeated id count once for each of its rows.
    """
    rows, (doc_id, lang, text) = _columns(docs, "doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels")
    held = rows.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("stratum"), text)
    ids = labels.where("doc_id is not null and quality is not null").select("doc_id").distinct()
    if ids.limit(LABELLED + 1).count() <= LABELLED:
        held = held.join(F.broadcast(ids), "doc_id", "left_semi")
    measured, _ = write_shared(quality.features(held, text_or_empty(text)).drop(text), "quality")
    cutoffs = quality.cutoffs_for(measured, labels)
    judged = quality.with_verdict(quality.features(rows, text_or_empty(text)), cutoffs, stratum=lang)
    return judged.where("kept").select(rows.columns).toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before, exactly or nearly; those left without a line go.

    Null texts stay null. Rows of one id are one document: where they hold the same line at the same place it stays in
    each. Of rows without an id the lines count as the first.
    """
    rows, (doc_id, text) = _columns(docs, "doc_id", "text")
    return _with_text(line_dedup.dedup_lines(rows, doc_id, text, min_chars=line_dedup.EVERY_LINE), docs, F.col(text))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates (without any id: the least digest), once.

    A document is an id with a text: rows that repeat both are copies and one of them stays; other texts of an id stay or
    go with their own groups. Null texts count as empty, and all empty ones are copies.
    """
    rows, (doc_id, text) = _columns(docs, "doc_id", "text")
    digest = F.xxhash64(text_or_empty(text))
    found, _ = write_shared(simhash.fingerprints(rows.withColumn("digest", digest), doc_id, text, keep=("digest",)), "simhash")
    # one row for each document, and of each group the first
    found = simhash.near_duplicates(found).groupBy("doc_id", "digest").agg(F.first("cls").alias("cls"), F.count("*").alias("n"), F.first("component_id").alias("component_id"))
    found, _ = write_shared(found, "documents")
    # only groups of several documents of the id that stays, or of none, need a choice by digest
    ties = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("cls").alias("_c")).agg(F.min("digest").alias("first"), F.count("*").alias("m")).where("m > 1")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "digest")
    also = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).join(ties, F.col("cls") == F.col("_c")).where(F.col("digest") != F.col("first")).select("doc_id", "digest")
    gone, _ = write_shared(gone.unionByName(also).select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone_digest")), "gone")
    left = rows.join(broadcast_if(gone, 1_000_000), F.col(doc_id).eqNullSafe(F.col("gone_id")) & (digest == F.col("gone_digest")), "left_anti")
    twice, _ = write_shared(found.where("n > 1").select(F.col("doc_id").alias("twice_id"), F.col("digest").alias("twice_digest")), "twice")
    if not twice.isEmpty():
        again = F.col(doc_id).eqNullSafe(F.col("twice_id")) & (digest == F.col("twice_digest"))
        twice = broadcast_if(twice, 1_000_000)
        some = left.join(twice, again, "left_semi")
        once = some.withColumn("digest", digest).dropDuplicates([doc_id, "digest"]).drop("digest")
        left = left.join(twice, again, "left_anti").unionByName(once)
    return left.toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the one where a source's budget ends comes with its first words only.

    Which ones come when not all can is decided by the quality that is learned from the labels. Documents without a word,
    null texts among them, have nothing to take and go. A null source is a source. Repeated rows are taken alike; equal
    ids of equal size share what is left at the cut. Texts of any length come whole, but for the one at the cut.
    """
    rows, (doc_id, source, text) = _columns(docs, "doc_id", "source", "text")
    # texts go along, so that their statistics are found once for learning, for the cut and for the documents
    rows, _ = write_shared(mixing.measured(rows, text_or_empty(text)), "measured")
    weight = mixing.learned_quality(rows, table(spark, sf_dir, "labels"), doc_id)
    mixed = mixing.mix(rows, F.col("words"), weight, doc_id, source).where("taken > 0").drop("words")
    part = (F.col("taken") % F.col("size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    taken = mixed.withColumn("words", F.explode(copies))
    cut = F.array_join(F.slice(F.filter(F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), lambda w: F.btrim(w, F.lit(BLANKS)) != ""), 1, F.col("words")), "")
    return _with_text(taken, docs, F.when(F.col("words") == 0, F.col(text)).otherwise(cut))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, with their ids. Null texts count as empty; repeated rows are packed as often as they come. Texts of any length are cut; of sizes with the same score the one that came first is placed."""
    return packing.pack_texts(docs, packing.tokenizer_path(), keep_ids=True)


STAGES = [
    ("quality rules", keep_good),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: The stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's tables, and its predecessor's rows, are deleted once its own rows are written."""
    import uuid

    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if last:
            drop_shared(spark, last)
        docs, last = spark.read.schema(made.schema).parquet(path), path
    return docs
