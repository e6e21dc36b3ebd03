"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.registry import basics, questions, scores, series, stores

Entry = tuple[Callable[[SparkSession, str], DataFrame], str | None]


def entries() -> dict[str, Entry]:
    return basics.ENTRIES | series.ENTRIES | questions.ENTRIES | scores.ENTRIES | stores.ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql}
