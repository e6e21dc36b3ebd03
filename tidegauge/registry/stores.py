"""Files with headers of their own, and the feature store that grows task by task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge import views as V
from tidegauge.sources import csv, store

ENTRIES: dict = {}
#: Headers of three kinds of files: other channels, another order, a missing one.
HEADERS = [["timestamp", "click", "error"], ["view", "timestamp", "click", "login"], ["error", "purchase", "timestamp"]]


def own_headers(spark, d) -> list[str]:
    """Folders of files of the hourly readings: those of an hour go to the header of its number modulo 3."""
    hours, at = V.hourly(spark, d).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), []
    for i, header in enumerate(HEADERS):
        channels = [c for c in header if c != "timestamp"]
        wide = hours.filter(F.hour("ts") % 3 == i).groupBy("timestamp").pivot("channel_id", channels).agg(F.first(F.format_string("%.9f", "value")))
        at.append(V.scratch(spark, f"csv{i}"))
        wide.filter(F.coalesce(*channels).isNotNull()).select(header).write.option("header", True).csv(at[-1])
    return at


def csv_long(spark, d) -> DataFrame:
    return csv.csv_long(spark, own_headers(spark, d))[0].select("channel_id", "ts", F.round("value", 8).alias("value"))


def csv_headers(spark, d) -> DataFrame:
    found = csv.csv_headers(spark, own_headers(spark, d)).filter("header is not null")
    return found.groupBy("header", F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.lit(1).alias("seen")).select("header", "problem")


OF_HOUR = " OR ".join(f"(hour(ts) % 3 = {i} AND channel_id IN ({', '.join(repr(c) for c in h if c != 'timestamp')}))" for i, h in enumerate(HEADERS))
ENTRIES["src_csv_own_headers"] = (csv_long, V.sql("hr") + f" SELECT channel_id, ts, round(value, 8) AS value FROM hr WHERE {OF_HOUR}")
ENTRIES["src_csv_headers"] = (csv_headers, "SELECT header, problem FROM (VALUES " + ", ".join(f"({i}, '{','.join(h)}', 'none')" for i, h in enumerate(HEADERS)) + ") v(i, header, problem) WHERE EXISTS (SELECT 1 FROM events WHERE value IS NOT NULL AND hour(ts) % 3 = i)")


def grown(spark, d) -> tuple[str, DataFrame]:
    """A store of each channel as a task: two built, then all asked for; then readings of one changed and it is
    built again. (path, statuses of the second run)"""
    readings, at = V.hourly(spark, d).withColumn("task_id", F.col("channel_id")), V.scratch(spark, "store")
    tasks = readings.select("task_id").distinct()
    store.build(readings, tasks.filter("task_id in ('click', 'error')"), at)
    second = store.build(readings, tasks.unionByName(spark.createDataFrame([("absent",)], "task_id string")), at)
    store.build(readings.withColumn("value", F.col("value") + 1), tasks.filter("task_id = 'view'"), at, rebuild=True)
    return at, second


def stored(spark, d) -> DataFrame:
    return store.read_features(spark, grown(spark, d)[0]).groupBy("task_id", "granularity").agg(F.count("*").alias("n"), F.round(F.sum("max_val"), 5).alias("top"))


WINDOWS = " UNION ALL ".join(f"SELECT channel_id AS task_id, '{g}' AS granularity, CAST(date_trunc('{u}', ts) AS TIMESTAMP) AS w, max(value) + CASE channel_id WHEN 'view' THEN 1 ELSE 0 END AS m FROM hr GROUP BY 1, 2, 3, channel_id HAVING count(*) > 1" for g, u in (("yearly", "year"), ("monthly", "month"), ("daily", "day")))
ENTRIES["incremental_store_features"] = (stored, V.sql("hr") + f" SELECT task_id, granularity, count(*) AS n, round(sum(m), 5) AS top FROM ({WINDOWS}) GROUP BY 1, 2")
ENTRIES["incremental_store_status"] = (lambda s, d: grown(s, d)[1], V.sql("hr") + f" SELECT task_id, CASE WHEN task_id IN ('click', 'error') THEN 'skipped' ELSE 'built' END AS status, count(*) AS n FROM ({WINDOWS}) GROUP BY 1 UNION ALL SELECT 'absent', 'empty', 0")
