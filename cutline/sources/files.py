"""Manifests, presets and cached scenes as tables in folders that Spark reads."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path that driver and executors share: in spark.checkpoint.dir, or in local mode where that is unset in a folder of the machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cutline-shared-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/cutline-{sc.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df written as a Parquet table and read again, which cuts its lineage."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SCENE = "scene_index long, index long, start double, end double, duration double, path string, thumbnail string, original_file string"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Scenes of JSON manifests, each a list of scenes or an object with one; numbers under either name."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SCENE.split(', '))}>>")
    inner = F.from_json("value", f"struct<scenes: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SCENE.split(', '))}>>>")["scenes"]
    rows = raw.select(F.inline(F.when(F.ltrim("value").startswith("["), listed).otherwise(inner)))
    return rows.withColumn("scene_index", F.coalesce("scene_index", "index")).drop("index")


def write_manifest(scenes: DataFrame, path: str) -> None:
    """One JSON line for each scene."""
    scenes.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of JSON files, each one array of texts and objects: scene_index (the place in the array where an object names none), input, seek_ms, dur_ms. Objects without an input are skipped."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    each = raw.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("pos", F.col("value").alias("item"))
    is_text = F.schema_of_variant("item") == "STRING"
    of = lambda name, kind: F.when(~is_text, F.try_variant_get("item", f"$.{name}", kind))
    number = lambda name: F.when(F.schema_of_variant(F.try_variant_get("item", f"$.{name}", "variant")) != "STRING", of(name, "double"))
    start, end = number("start_sec"), number("end_sec")
    ms = lambda x: F.bround(x * 1000, 0).cast("long")
    rows = each.select(
        F.coalesce(of("scene_index", "long"), F.col("pos").cast("long")).alias("scene_index"),
        F.when(is_text, F.try_variant_get("item", "$", "string")).otherwise(of("input", "string")).alias("input"),
        ms(start).alias("seek_ms"),
        ms(end - start).alias("dur_ms"),
    )
    return rows.where("input <> ''")


def save_preset(spark: SparkSession, folder: str, name: str, operations: list[str], options: dict[str, str]) -> None:
    row = spark.createDataFrame([(name, operations, options)], "name string, operations array<string>, options map<string,string>")
    row.write.mode("overwrite").json(f"{folder}/name={name}")


def presets(spark: SparkSession, folder: str) -> DataFrame:
    """Presets by name; runnable: at least two operations."""
    df = spark.read.schema("name string, operations array<string>, options map<string,string>").json(folder)
    return df.withColumn("runnable", F.size("operations") >= 2)


def delete_preset(spark: SparkSession, folder: str, name: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/name={name}")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class SceneCache:
    """Scenes by fingerprint of their source and the parameters that made them.

    Each add() writes a batch of its own, which counts once Spark has marked it as committed; batches are never changed. Of
    a fingerprint and method that several batches hold, as two writers or a repeated job add them, the earliest committed
    batch counts, so readers see one set of scenes, and whole ones, whatever else is being written. compact() drops the rest.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def key(*parts: Column) -> Column:
        return F.substring(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12)

    def _listed(self, pattern: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
        return sorted(s.getPath().toString() for s in found) if found else []

    def _delete(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _rows(self) -> DataFrame | None:
        """The rows of all committed batches, with the batch."""
        from pyspark.errors import AnalysisException

        batches = [p.removesuffix("/_SUCCESS") for p in self._listed("batch=*/_SUCCESS")]
        batches = [b for b in batches if self._listed(f"{b.rsplit('/', 1)[1]}/method=*")]
        if not batches:
            return None
        try:
            return self.spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(*batches)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def read(self) -> DataFrame | None:
        rows = self._rows()
        if rows is None:
            return None
        first = F.min("batch").over(W.partitionBy("print", "method"))
        return rows.withColumn("_first", first).where(F.col("batch") == F.col("_first")).drop("_first", "batch")

    def split(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """wanted (print, ...) that are cached, and that are not."""
        there = self._rows()
        if there is None:
            return wanted.limit(0), wanted
        keys = there.select("print").distinct()
        return wanted.join(keys, "print", "left_semi"), wanted.join(keys, "print", "left_anti")

    def add(self, scenes: DataFrame) -> None:
        """scenes (print, method, ...): rows of new fingerprints and methods are added."""
        there = self._rows()
        new = scenes if there is None else scenes.join(there.select("print", "method").distinct(), ["print", "method"], "left_anti")
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        new.write.partitionBy("method").parquet(f"{self.path}/batch={name}")

    def compact(self) -> None:
        """One batch of what counts in place of those that are there now."""
        rows, old = self.read(), self._listed("batch=*/_SUCCESS")
        if rows is None:
            return
        # earlier than what a writer may add meanwhile, and later than all that it replaces
        last = old[-1].removesuffix("/_SUCCESS").rsplit("batch=", 1)[1]
        rows.write.partitionBy("method").parquet(f"{self.path}/batch={last}-compact")
        for path in old:
            self._delete(path.removesuffix("/_SUCCESS"))

    def listed(self) -> DataFrame | None:
        """Scenes of each fingerprint and method."""
        there = self.read()
        return None if there is None else there.groupBy("print", "method").agg(F.count("*").alias("n_scenes"))

    def clear(self, method: str | None = None) -> bool:
        """Deletes what a method has made, or everything; was there anything?"""
        if method is None:
            return self._delete(self.path)
        return any([self._delete(p) for p in self._listed(f"batch=*/method={method}")])


def write_job(spark: SparkSession, path: str, scenes: DataFrame, job: DataFrame) -> None:
    """One JSON object for each job, with its scenes in order inside.

    job (job, video, cache, detector, warnings: array of strings, error: null where it went well), scenes (job,
    scene_index, start, end, path, thumbnail). A job without scenes has an empty list.
    """
    each = F.struct("scene_index", "start", "end", F.round(F.col("end") - F.col("start"), 6).alias("duration"), "path", "thumbnail")
    listed = scenes.groupBy("job").agg(F.array_sort(F.collect_list(each)).alias("scenes"))
    rows = job.join(listed, "job", "left")
    whole = F.struct("job", "video", "cache", "detector", F.coalesce("scenes", F.array().cast(rows.schema["scenes"].dataType)).alias("scenes"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "error", F.col("error").isNull().alias("ok"))
    rows.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
