"""Readers of readings, tasks and predictions; writers of features, predictions and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["granularity", "task_id", "channel_id", "window_start", "window_end", "min_val", "max_val", "avg_val", "std_val", "slope", "sax_len", "sax"]
TASK = "id string, level int, category string, subtask string, question string, eval_metric string, channel string, ground_truth string, answer string"


def csv_readings(spark: SparkSession, path: str) -> DataFrame:
    """Wide readings of CSV files with one header: all strings, task_id from the file's name.

    Raises if the files have different headers, as cells are read by position; ``csv.csv_long`` reads each
    file by its own.
    """
    from tidegauge.sources.csv import csv_headers

    headers = [r.header for r in csv_headers(spark, path).select("header").filter("header is not null").distinct().limit(2).collect()]
    if len(headers) > 1:
        raise ValueError(f"{path}: files have different headers, such as {headers[0]!r} and {headers[1]!r}; csv_long reads them")
    df = spark.read.csv(path, header=True, inferSchema=False)
    if "timestamp" not in df.columns or len(df.columns) < 2:
        raise ValueError(f"{path}: a timestamp column and at least one channel are needed")
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.csv)?$", 1).alias("task_id"), *df.columns)


def normal_times(df: DataFrame, column: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(rows with ts cut to seconds, rows whose time can't be read)."""
    ts = F.date_trunc("second", F.try_to_timestamp(F.col(column))).cast("timestamp_ntz")
    out = df.withColumn("ts", ts)
    return out.filter("ts is not null").drop(column), out.filter("ts is null").drop("ts")


def numeric(value) -> F.Column:
    """A cell as a number; null if it isn't one, or is NaN."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that repeat or are null, and how often."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | missing)


def long_readings(wide: DataFrame) -> DataFrame:
    """(task_id, channel_id, ts, value) of wide rows (task_id, ts, channels); nulls go."""
    channels = [c for c in wide.columns if c not in ("task_id", "ts")]
    cast = wide.select("task_id", "ts", *(numeric(F.col(f"`{c}`")).alias(c) for c in channels))
    return cast.unpivot(["task_id", "ts"], [F.col(f"`{c}`") for c in channels], "channel_id", "value").filter("value is not null").select("task_id", "channel_id", "ts", "value")


def _array_file(spark: SparkSession, path: str, element: str) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", f"array<struct<{element}>>"))).select("pos", "col.*")


def tasks_json(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with pos, their place in the list; task_id is what the file calls id."""
    return _array_file(spark, path, ", ".join(f"{n}:{t}" for n, t in (f.split(" ") for f in TASK.split(", ")))).withColumnRenamed("id", "task_id").withColumnRenamed("pos", "id")


def predictions_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction): the last entry of each id that is a number."""
    return latest(_array_file(spark, path, "id:string, prediction:string"), "pos")


def jsonl_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction) of an append-only file; blank and broken lines are skipped, the last wins."""
    lines = spark.read.text(path).select("value", F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("pos"))
    parsed = lines.select("pos", F.from_json("value", "id string, prediction string").alias("r")).select("pos", "r.*")
    return latest(parsed, "pos")


def latest(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("id", F.col("id").try_cast("bigint")).filter("id is not null").groupBy("id").agg(F.max_by(F.coalesce("prediction", F.lit("")), order).alias("prediction"))


def dense_predictions(predictions: DataFrame, n: int) -> DataFrame:
    """One row for each id from 0 to n - 1; an empty text where there is none."""
    return predictions.sparkSession.range(n).join(predictions, "id", "left").select("id", F.coalesce("prediction", F.lit("")).alias("prediction"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    """(table, n) of catalog tables; 0 for those that don't exist."""
    out = spark.createDataFrame([], "table string, n long")
    for name in names:
        one = spark.table(name) if spark.catalog.tableExists(name) else spark.range(0)
        out = out.union(one.agg(F.lit(name).alias("table"), F.count("*").alias("n")))
    return out


def status_totals(builds: DataFrame) -> DataFrame:
    """(status, tasks, n): tasks and rows of each status, and of all together (status null)."""
    return builds.rollup("status").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
