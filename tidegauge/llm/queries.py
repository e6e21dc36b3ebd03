"""The queries of this folder's operators, each with production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import bytebpe, jpeg, langid, lines, minhash, negatives, packing, pii, repeats, resampling, search, toxicity, wordbpe
from tidegauge.llm.tables import read

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"
#: The key of surrogates; a user sets their own secret.
SURROGATE_KEY = "tidegauge"


def document_languages(docs: DataFrame) -> DataFrame:
    """Languages of ``documents``: lang is what they declare, source is their host."""
    model = langid.train(docs, "text", "lang", "doc_id")
    return langid.identify(docs, model, F.col("text"), F.col("lang"), F.lit(None).cast("string"), F.col("source"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_languages(read(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))


def op2_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over web pages, with declared markup language, address suffix and host."""
    model = langid.train(read(spark, sf_dir, "documents"), "text", "lang", "doc_id")
    found = langid.page_evidence(read(spark, sf_dir, "pages"))
    out = langid.identify(found, model, F.col("text"), F.col("declared"), F.col("suffix"), F.col("host"), id_col="page_id")
    return out.withColumnRenamed("doc_id", "page_id").withColumn("probability", F.round("probability", 6))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(read(spark, sf_dir, "documents"), length=400)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.with_surrogates(read(spark, sf_dir, "documents"), SURROGATE_KEY)
    return out.select("doc_id", "n_entities", F.col("redacted").alias("text"))


def op5_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.to_media(read(spark, sf_dir, "documents")))


def op7_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), n=2, percent=80)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_repeated_lines(read(spark, sf_dir, "documents"), distance=None)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("deduplicated", F.lit("")), 256).alias("kept_sha256"))


def op8_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return search.top_k(docs, docs.filter("doc_id % 20 = 0"), k=10, n_terms=None)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, learn = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), toxicity.fold(F.col("doc_id")) != 0
    out = toxicity.score(docs, toxicity.train(docs, labels, learn))
    return out.withColumn("held_out", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=1)


#: Integer inner products of whole vectors, ranked; and the CRC of words by a table of 256 remainders.
SQL = {
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), p AS (
            SELECT a.vec_id AS anchor_id, a.label, a.c, b.vec_id AS positive_id, CAST(list_dot_product(a.c, b.c) AS BIGINT) AS positive_score
            FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
            QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, b.vec_id) <= 5
        )
        SELECT anchor_id, positive_id, v.vec_id AS negative_id, positive_score, CAST(list_dot_product(p.c, v.c) AS BIGINT) AS negative_score,
            CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, v.vec_id) AS INTEGER) AS rank
        FROM p JOIN v ON p.label <> v.label AND 30 * positive_score <= 100 * list_dot_product(p.c, v.c) AND 100 * list_dot_product(p.c, v.c) <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op13_importance_resampling": r"""
        WITH remainders AS (
            SELECT list(r ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) b(i))
        ), texts AS (
            SELECT 0 AS target, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), words AS (
            SELECT target, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
        ), grams AS (SELECT target, id, unnest(w) AS word FROM words
        ), hashes AS (
            SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(word)), 2), lambda i: CAST('0x' || substr(hex(encode(word)), i, 2) AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
            FROM (SELECT DISTINCT word FROM grams), remainders
        ), counted AS (SELECT target, id, bucket, count(*) AS n FROM grams JOIN hashes USING (word) GROUP BY ALL
        ), totals AS (
            SELECT bucket, CAST(coalesce(sum(n) FILTER (target = 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (target = 1), 0) AS DOUBLE) AS t FROM counted GROUP BY 1
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM totals
        ), weighed AS (
            SELECT id, sum(n) AS n, sum(n * gain) AS total FROM counted JOIN gains USING (bucket) WHERE target = 0 GROUP BY 1
        ), scored AS (
            SELECT w.id AS doc_id, len(w.w) AS n_features, coalesce(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT), 0) AS weight,
                weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || w.id)[1:8] AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
            FROM words w LEFT JOIN weighed USING (id) WHERE target = 0
        ), placed AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS fit FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * fit / 100) THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_language_id, op2_language_id_pages, op3_suffix_repeats, op4_pii_surrogates, op5_media_jpeg, op6_fuzzy_lines, op7_minhash_near_duplicates, op8_bm25_topk, op9_byte_bpe, op10_curve_packing, op11_toxicity, op12_hard_negatives, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
