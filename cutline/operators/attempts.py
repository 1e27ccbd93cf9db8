"""Work that can fail, row by row: what a callable makes of each row, or why it couldn't, and ladders of callables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.files import written


def attempt(rows: DataFrame, action: Callable[[dict], str | None], name: str = "made") -> DataFrame:
    """rows with `name`: what action(row as a dict) returned, and `error`: the message of the exception that it raised. A row that fails doesn't fail its task; a task that is run again runs its actions again, so these have to bear that."""
    plain = rows.drop("error", name)
    schema = StructType([*plain.schema.fields, StructField(name, StringType()), StructField("error", StringType())])

    def task(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            made, errors = [], []
            for row in batch.to_pylist():
                try:
                    made.append(action(row))
                    errors.append(None)
                except Exception as e:  # whatever a row's action raises is that row's result
                    made.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string()), pa.array(errors, pa.string())], names=[*batch.schema.names, name, "error"])

    return plain.mapInArrow(task, schema)


def ladder(rows: DataFrame, rungs: list[tuple[str, Callable[[dict], str | None], F.Column | None]], folder: str) -> DataFrame:
    """Rows tried rung by rung: (name, action, condition). A rung takes the rows that the last one that tried them failed (the first rung that takes a row: all of it), where its condition holds (over the columns and `error`, the message so far).

    -> the columns of rows, how (the rung that made it, or null), made, error (of the last attempt, null if it was made or
    never tried). What a rung has made is written to the folder before the next one sees the rest, so no action is run twice
    for a row but for a task's own repeats.
    """
    left, done = rows.withColumn("error", F.lit(None).cast("string")), []
    for k, (name, action, condition) in enumerate(rungs):
        takes = F.lit(True) if condition is None else F.coalesce(condition, F.lit(False))
        tried = written(attempt(left.where(takes), action), f"{folder}/rung={k}")
        done.append(tried.where("error is null").withColumn("how", F.lit(name)))
        left = left.where(~takes).unionByName(tried.where("error is not null").drop("made"))
    out = left.withColumn("made", F.lit(None).cast("string")).withColumn("how", F.lit(None).cast("string"))
    for d in done:
        out = out.unionByName(d)
    return out.select(*rows.columns, "how", "made", "error")


def failures(tried: DataFrame) -> DataFrame:
    """How often each message came: error, n."""
    return tried.where("error is not null").groupBy("error").agg(F.count("*").alias("n"))
