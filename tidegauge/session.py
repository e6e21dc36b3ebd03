"""A local session for tests and the benchmark; clusters bring their own settings."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.local.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
