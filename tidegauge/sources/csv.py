"""CSV files of readings that each have a header of their own, as long readings.

Rows are read as text, so a large file is split over many tasks; each file's header is found in its
first block and joined back by the file's path. No channel list is shared by the files: one may
name them in another order, lack some, or have others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge import views
from tidegauge.sources.files import normal_times, numeric

TIME = "timestamp"
#: Files named in an error at most.
NAMED = 20
#: Up to so many names of columns in all headers together, the headers are broadcast to the rows.
BROADCAST = 1_000_000


def task_of(file: Column) -> Column:
    """The name of a file without its folder and ending."""
    return F.url_decode(F.regexp_replace(F.regexp_extract(file, r"([^/]*?)(?:\.csv)?$", 1), r"\+", "%2B"))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).text(path)
    block = F.col("_metadata.file_block_start")
    return text.select(F.col("_metadata.file_path").alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), "value").filter(F.length(F.trim("value")) > 0)


def _cells(line: Column, width: int) -> Column:
    """The cells of a line as an array, quotes heeded; null where there are fewer, none beyond ``width``."""
    row = F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    return F.array(*(row[f"c{i}"] for i in range(width)))


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, task_id, header, columns, problem) of every file; problem is null where it can be read.

    The header is the first line that isn't blank. Files without a line, without a ``timestamp``
    column or without another column have a problem and no readings; the other files aren't affected.
    Spark's readers pass over files of no bytes, so these have no row.
    """
    # the content isn't asked for, so this is a listing
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("_metadata.file_path").alias("file"))
    first, at = _lines(spark, path).filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header")), views.scratch(spark, "headers")
    first.write.parquet(at)  # so that the files are searched for their headers once
    first = spark.read.schema(first.schema).parquet(at)
    width = first.agg(F.max(F.size(F.split("header", ",")))).head()[0] or 1
    names = F.transform(_cells(F.regexp_replace("header", "^\ufeff", ""), width), lambda c: F.trim(c))
    out = files.join(first.select("file", "header", names.alias("columns")), "file", "left")
    channels = F.filter("columns", lambda c: c.isNotNull() & (c != "") & (c != TIME))
    problem = (
        F.when(F.col("header").isNull(), "no line")
        .when(~F.array_contains(F.filter("columns", lambda c: c.isNotNull()), TIME), "no timestamp column")
        .when(F.size(channels) == 0, "no channel column")
        .when(F.size(F.array_distinct(channels)) < F.size(channels), "a channel twice")
    )
    return out.select("file", task_of(F.col("file")).alias("task_id"), "header", "columns", problem.alias("problem"))


def csv_long(spark: SparkSession, path: str | list[str], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readings: task_id, channel_id, ts, value; rows whose time can't be read: task_id, channel_id, cell,
    timestamp) of all files, each by its own header.

    Cells that aren't numbers, empty ones and NaN give no reading. A line equal to its file's header is a
    header again. Cells beyond the header's last name are left out, missing ones are empty. A quoted line break
    ends the row, as files are split by lines. Files with a problem (``csv_headers``) give no rows; with ``strict``
    they raise an error that names up to NAMED of them.
    """
    headers = csv_headers(spark, path)
    if strict and (bad := headers.filter("problem is not null").orderBy("file").limit(NAMED).collect()):
        raise ValueError("; ".join(f"{r.file}: {r.problem}" for r in bad))
    sound = headers.filter("problem is null").select("file", "task_id", "header", "columns")
    width, n = sound.agg(F.coalesce(F.max(F.size("columns")), F.lit(1)), F.count("*")).head()
    if n * width <= BROADCAST:  # else a shuffle by file, of which Spark splits the large ones
        sound = F.broadcast(sound)
    rows = _lines(spark, path).select("file", "value").join(sound, "file").filter(F.col("value") != F.col("header")).withColumn("cells", _cells(F.col("value"), width))
    time = F.element_at("cells", F.array_position("columns", TIME).cast("int"))
    named = F.filter(F.arrays_zip(F.col("columns").alias("name"), F.col("cells").alias("cell")), lambda x: x["name"].isNotNull() & (x["name"] != "") & (x["name"] != TIME))
    long = rows.select("task_id", time.alias(TIME), F.explode(named).alias("x")).select("task_id", TIME, F.col("x.name").alias("channel_id"), F.col("x.cell").alias("cell"))
    readable, unreadable = normal_times(long.withColumn("_time", F.col(TIME)), "_time")
    readings = readable.withColumn("value", numeric(F.col("cell"))).filter("value is not null").select("task_id", "channel_id", "ts", "value")
    return readings, unreadable.select("task_id", "channel_id", "cell", TIME)
