"""A store of features that grows task by task.

Rows are only ever added: each build writes a folder of its own and, once its rows are complete, lines of
a manifest that name the tasks and granularities it holds. Readers take each task's rows from its latest
build, so other tasks stay as they are, a failed build is never seen, and a rebuild replaces its tasks
at the moment its manifest appears. ``compact`` gathers the current rows in one build.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.plans import features
from tidegauge.sources.files import FEATURES

KEYS = ["task_id", "granularity"]
MANIFEST = "task_id string, granularity string, n long, build string"
ROWS = "task_id string, channel_id string, window_start timestamp_ntz, window_end timestamp_ntz, min_val double, max_val double, avg_val double, std_val double, slope double, sax_len int, sax string, build string, granularity string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, granularity, n, build): the latest build of each task's granularity and its rows."""
    at = f"{path}/manifest"
    if not _exists(spark, at):
        return spark.createDataFrame([], MANIFEST)
    latest = F.max_by(F.struct("n", "build"), "build").alias("x")
    return spark.read.schema(MANIFEST).parquet(at).groupBy(*KEYS).agg(latest).select(*KEYS, "x.n", "x.build")


def add_features(rows: DataFrame, path: str, replaced: DataFrame | None = None) -> str:
    """Add ``rows`` (the columns FEATURES) as a build, and give its name.

    They replace what the store has of the tasks and granularities that they hold, and of those that
    ``replaced`` (task_id, granularity) names besides.
    """
    if sorted(rows.columns) != sorted(FEATURES):
        raise ValueError(f"features need the columns {FEATURES}")
    spark, build = rows.sparkSession, f"{time.time_ns() // 1000:017d}-{uuid.uuid4().hex[:8]}"
    at = f"{path}/rows/build={build}"
    rows.select(FEATURES).write.partitionBy("granularity").parquet(at)
    stored = spark.read.schema(ROWS).option("basePath", f"{path}/rows").parquet(at)
    counts = stored.groupBy(*KEYS).agg(F.count("*").alias("n"))
    if replaced is not None:
        counts = counts.unionByName(replaced.select(*KEYS).distinct().join(counts, KEYS, "left_anti").withColumn("n", F.lit(0).cast("long")))
    counts.withColumn("build", F.lit(build)).write.mode("append").parquet(f"{path}/manifest")
    return build


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The current features of all tasks.

    Builds that nothing has replaced are read as they are, those replaced altogether aren't read; only rows of
    builds replaced in part are joined with the manifest. There are as many builds as runs since ``compact``.
    """
    known = manifest(spark, path)
    all_ = spark.read.schema(ROWS).parquet(f"{path}/rows") if _exists(spark, f"{path}/rows") else spark.createDataFrame([], ROWS)
    if not _exists(spark, f"{path}/manifest"):
        return all_.filter("false").select(FEATURES)
    current = {r.build: r.n for r in known.filter("n > 0").groupBy("build").agg(F.count("*").alias("n")).collect()}
    written = {r.build: r.n for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter("n > 0").groupBy("build").agg(F.count("*").alias("n")).collect()}
    whole = [b for b, n in current.items() if n == written[b]]
    parts = [b for b in current if b not in whole]
    out = all_.filter(F.col("build").isin(whole))
    if parts:
        out = out.unionByName(all_.filter(F.col("build").isin(parts)).join(known.select(*KEYS, "build"), [*KEYS, "build"], "left_semi"))
    return out.select(FEATURES)


def complete(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, n) of the tasks that have rows at every scale."""
    own = manifest(spark, path).filter("n > 0").groupBy("task_id").agg(F.sum("n").alias("n"), F.count_distinct("granularity").alias("scales"))
    return own.filter(F.col("scales") == len(features.SCALES)).select("task_id", "n")


def build(readings: DataFrame, tasks: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """Build the features of those ``tasks`` (task_id) that the store lacks, all of them if ``rebuild``.

    Gives (task_id, status, n): skipped (it was complete), built, partial (some scale has no rows, so the
    next run tries again) or empty (no reading, or never two in a window). Readings of complete tasks
    aren't aggregated again. A task with other features before keeps none of them.
    """
    spark = readings.sparkSession
    tasks = tasks.select("task_id").distinct()
    # the listing of the manifest's files is taken here: what is added below doesn't change it
    done = tasks.filter("false").withColumn("n", F.lit(0).cast("long")) if rebuild else complete(spark, path)
    skipped = tasks.join(done, "task_id").select("task_id", F.lit("skipped").alias("status"), "n")
    todo = tasks.join(done, "task_id", "left_anti")
    if not todo.take(1):
        return skipped
    scales = F.explode(F.array(*map(F.lit, features.SCALES))).alias("granularity")
    name = add_features(features.build(readings.join(todo, "task_id", "left_semi")), path, todo.select("task_id", scales))
    own = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").filter(F.col("build") == name)
    own = own.groupBy("task_id").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("scales"))
    status = F.when(F.col("n") == 0, "empty").when(F.col("scales") < len(features.SCALES), "partial").otherwise("built")
    return skipped.unionByName(own.select("task_id", status.alias("status"), "n"))


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The current features as one build of a new store at ``to``."""
    add_features(read_features(spark, path), to)
