"""Readings, tasks and predictions as views over the supplied tables; and the same in SQL.

Readings are long: task_id, channel_id, ts, value. One row is one value of one channel.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What identifies a series.
SERIES = ["task_id", "channel_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores: a file is read by as many tasks as it has row groups at
    most, which may be one, and what each row takes later would be done there."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value is not null").select(F.lit("events").alias("task_id"), F.col("event_type").alias("channel_id"), "ts", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return events(spark, sf_dir).groupBy("task_id", "channel_id", hour.alias("ts")).agg(F.round(F.avg("value"), 5).alias("value"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("channel_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    return out.agg(F.round(F.sum("o_totalprice"), 2).alias("value")).select(F.lit("orders").alias("task_id"), "channel_id", "ts", "value")


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily`` with companions ``<channel>_hist_mean``: the mean of the calendar day over the years."""
    day = daily(spark, sf_dir)
    mean = day.groupBy("task_id", "channel_id", F.date_format("ts", "MM-dd").alias("day")).agg(F.round(F.avg("value"), 4).alias("value"))
    back = day.select("task_id", "channel_id", "ts", F.date_format("ts", "MM-dd").alias("day")).join(mean, ["task_id", "channel_id", "day"])
    return day.unionByName(back.select("task_id", F.concat("channel_id", F.lit("_hist_mean")).alias("channel_id"), "ts", "value"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels ``orders_up_1996`` (order totals) and ``orders_down_1996`` (line prices) per day."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), "o_totalprice")
    up = orders.groupBy("ts").agg(F.round(F.sum("o_totalprice"), 2).alias("value")).withColumn("channel_id", F.lit("orders_up_1996"))
    down = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("k")).groupBy("ts").agg(F.round(F.sum("l_extendedprice"), 2).alias("value")).withColumn("channel_id", F.lit("orders_down_1996"))
    return up.unionByName(down).select(F.lit("orders").alias("task_id"), "channel_id", "ts", "value")


#: The views as common table expressions.
SQL = {
    "ev": "ev AS (SELECT event_type AS channel_id, ts, value FROM events WHERE value IS NOT NULL)",
    "hr": "hr AS (SELECT event_type AS channel_id, date_trunc('hour', ts) AS ts, round(avg(value), 5) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2)",
    "dy": "dy AS (SELECT o_orderpriority AS channel_id, CAST(o_orderdate AS TIMESTAMP) AS ts, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)",
    "hm": "hm AS (SELECT channel_id, strftime(ts, '%m-%d') AS d, round(avg(value), 4) AS base FROM dy GROUP BY 1, 2)",
    "pr": "pr AS (SELECT u.ts, u.up, d.down FROM (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, round(sum(o_totalprice), 2) AS up FROM orders GROUP BY 1) u JOIN (SELECT CAST(o_orderdate AS TIMESTAMP) AS ts, round(sum(l_extendedprice), 2) AS down FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) d ON u.ts = d.ts)",
}


def sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; a local one in local mode."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return os.path.join(at, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what uses it often doesn't make it again."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
