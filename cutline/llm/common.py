"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset in local mode (tests), one is set here; on a cluster that is an error."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cutline-shared-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


#: Tables of the innermost scratch() block of this context; a thread has a context of its own.
_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def _new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/cutline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (own := _written.get()) is not None:
        own.append(path)
    return path


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a Parquet table in the shared folder and read again (this cuts its lineage), and the table's path."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def shared_table(spark: SparkSession, name: str) -> tuple[Callable[[str], DataFrame], str]:
    """A path in the shared folder for a table that several jobs append to, and what reads it with a schema."""
    path = _new_path(spark, name)
    return lambda schema: spark.read.schema(schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if (own := _written.get()) and path in own:
        own.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that this context (thread) writes within are deleted at the end. What is read from them has to be written elsewhere by then: a query's result is lazy, so its own tables stay until its caller leaves such a block, or expire() is called."""
    own: list[str] = []
    token = _written.set(own)
    try:
        yield
    finally:
        _written.reset(token)
        for path in own:
            drop_shared(spark, path)


def expire(spark: SparkSession, application: str | None = None) -> None:
    """Deletes all tables that an application (by default this one) has left in the shared folder."""
    drop_shared(spark, f"{shared_dir(spark)}/cutline-{application or spark.sparkContext.applicationId}")


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind as make it differ from all that are taken, in any case."""
    have = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out


def numbered_columns(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ..., which no operator uses: columns of any name go through one and come back by toDF(*df.columns)."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def small(df: DataFrame, most: int) -> list | None:
    """The rows of df, or None if there are more than `most`; the driver never gets more than that."""
    rows = df.limit(most + 1).collect()
    return rows if len(rows) <= most else None


def broadcast_if(df: DataFrame, most: int) -> DataFrame:
    """df, a written table, marked for broadcast if it has at most `most` rows; else Spark joins it by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Keys that are joined by broadcast because they are the most frequent.
HOT_KEYS = 10_000


def look_up(rows: DataFrame, key: str, known: DataFrame, spread: list[str]) -> DataFrame:
    """rows, each with the row of `known` for its key, as the struct `found` (null where there is none).

    known: a written table (k: unique, n: how many rows have that key, and more). The HOT_KEYS most frequent keys are
    broadcast, so of the others, which are joined by shuffle, none has more than 1 / HOT_KEYS of the rows. Rows of the
    frequent keys and rows without a key are dealt by the columns `spread` in that shuffle.
    """
    hot = known.orderBy(F.desc("n"), "k").limit(HOT_KEYS).select(F.col("k").alias("_hk"), F.struct("*").alias("_hot"))
    rows = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    if known.limit(HOT_KEYS + 1).count() <= HOT_KEYS:
        return rows.withColumnRenamed("_hot", "found").drop("_hk")
    cold = known.select(F.col("k").alias("_ck"), F.struct("*").alias("_cold"))
    open_ = F.col(key).isNotNull() & F.col("_hk").isNull()
    rows = rows.withColumn("_open", open_).withColumn("_deal", F.when(open_, F.col(key)).otherwise(F.xxhash64(*spread).cast(rows.schema[key].dataType)))
    rows = rows.join(cold, (F.col("_deal") == F.col("_ck")) & F.col("_open"), "left")
    return rows.withColumn("found", F.coalesce("_hot", "_cold")).drop("_hk", "_hot", "_ck", "_cold", "_open", "_deal")


def map_rows(df: DataFrame, make, schema: str, rows: int = 2048) -> DataFrame:
    """mapInArrow without pandas. make() runs once in each task and returns a function from the columns of a batch (lists) to the columns of the result (lists)."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_parse_datatype_string(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = each(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(got, out, strict=True)], schema=out)

    return df.mapInArrow(task, schema)


def text_or_empty(name: str = "text") -> F.Column:
    return F.coalesce(F.col(name), F.lit(""))
