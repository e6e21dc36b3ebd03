"""The corpus pipeline: stages over ``documents``, each reading what its predecessor wrote.

Language identification, fuzzy line dedup, MinHash near-dedup, surrogates for personal data, packing.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import langid, lines, minhash, packing, pii
from tidegauge.llm.queries import SURROGATE_KEY, WORD_BPE, document_languages
from tidegauge.llm.tables import read, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the others go. Rows with a null id stay, as nothing tells
    which row was rejected; rows that repeat an id with its text stay or go together."""
    # those that go are few and broadcast, so that no text is shuffled
    gone = document_languages(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).filter("not kept").select(F.col("doc_id").alias("id"))
    return minhash.among(docs.select(COLUMNS), gone, "left_anti")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that occur before in the corpus, nearly or exactly. A row
    with a null id goes by a hash of its text."""
    return renewed(lines.without_repeated_lines(docs.select(COLUMNS), distance=None), "deduplicated")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates (five-word shingles); of
    rows that repeat an id, one. Of rows with a null id, one of each text stays."""
    kept = minhash.near_duplicates(docs).filter("kept").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").select(COLUMNS)
    # a row is dropped only where its id comes again, so no text is shuffled for ids that occur once
    again = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    once = known.join(again, "doc_id", "left_anti").union(known.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return once.union(docs.filter("doc_id is null").select(COLUMNS).dropDuplicates(["text"]))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by surrogates; null ids are no exception."""
    return renewed(pii.with_surrogates(docs.select(COLUMNS), SURROGATE_KEY), "redacted")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens along the curve."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


def renewed(out: DataFrame, text: str) -> DataFrame:
    return out.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


STAGES = [("language identification", identify), ("line dedup", dedup_lines), ("near dedup", dedup_documents), ("personal data", surrogates), ("packing", pack)]
#: No SQL: SimHash, MinHash and tokenisation aren't SQL functions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        at = os.path.join(scratch(spark), f"pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
