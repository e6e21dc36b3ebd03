"""Connected components of links between ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import settle


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b); component is the least id reachable.

    Each round every id points to its least neighbour or itself, pointers are followed once more,
    and edges are contracted to the ids pointed to. Only aggregates and joins on ids: no group is
    gathered, nothing goes to the driver but a row count, and rounds grow with the logarithm of the
    longest path.
    """
    spark = edges.sparkSession
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    label = None
    while edges.take(1):
        least = edges.select(F.col("b").alias("id"), F.col("a").alias("to")).union(edges.select("a", "a")).groupBy("id").agg(F.min("to").alias("to"))
        least = settle(least, "least")
        # follow once: every id pointed to is itself an id with a pointer
        parent = settle(least.join(least.select(F.col("id").alias("to"), F.col("to").alias("further")), "to").select("id", F.col("further").alias("to")), "parent")
        if label is None:
            label = parent
        else:
            label = settle(label.join(parent.select(F.col("id").alias("to"), F.col("to").alias("further")), "to", "left").select("id", F.coalesce("further", "to").alias("to")), "label")
        left = edges.join(parent.select(F.col("id").alias("a"), F.col("to").alias("pa")), "a").join(parent.select(F.col("id").alias("b"), F.col("to").alias("pb")), "b")
        edges = settle(left.filter("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    if label is None:
        return spark.createDataFrame([], "id long, component long")
    return label.select("id", F.col("to").alias("component"))
