"""Language identification by Bayesian evidence fusion.

Evidence about a document's language: its text (byte trigrams under a model of each language), the
language that its markup declares, and where it was found. The host's prior is smoothed towards that
of its address suffix, and this towards the corpus's. What declarations, suffixes and hosts say is
counted over all documents by grouped aggregation of the languages that the texts alone suggest.
"Unknown" (``und``) competes as a language whose trigrams are all equally likely.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import settle, small_batches

UNKNOWN = "und"
#: Rows of the labelled table that train the text model; the rows with the least hash are taken.
SAMPLE = 4000
#: Hashed trigrams; a text counts for as many trigrams as it has, but ``WORTH`` at most, since they
#: aren't independent; pseudo-counts of a level of the prior's hierarchy and of declarations.
BUCKETS, WORTH, STRENGTH, DECLARED = 1 << 15, 60.0, 20.0, 2.0
#: Prior share of unknown.
RARE = 1e-4


def trigrams(text: str) -> np.ndarray:
    """The bucket of each byte trigram of the lower-cased text, digits and punctuation as spaces."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
    code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
    return (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)


_PLAIN = bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


class TextModel:
    """Log probabilities of trigram buckets for each language, smoothed by adding one half."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        rows = np.log(counts + 0.5) - np.log((counts + 0.5).sum(axis=1, keepdims=True))
        self.logs = np.vstack([rows, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32)

    def evidence(self, text: str) -> np.ndarray:
        """Log likelihood of each language, as of ``WORTH`` trigrams at most."""
        own = trigrams(text)
        return self.logs[:, own].mean(axis=1, dtype=np.float64) * min(len(own), WORTH)


def train(labelled: DataFrame, text: str, label: str, key: str, sample: int = SAMPLE) -> TextModel:
    """A model from at most ``sample`` rows of ``labelled`` with a label and a text.

    Only counts by language come to the driver: a fixed number of partitions times languages.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(text).alias("text"))
    chosen = rows.select("key").orderBy(F.xxhash64("key"), "key").limit(sample)
    picked = rows.join(F.broadcast(chosen.distinct()), "key", "left_semi").select("label", "text")
    small_batches(spark, rows=200, mb=4)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for label_, t in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                counts[label_] = counts.get(label_, 0) + np.bincount(trigrams(t.as_py()), minlength=BUCKETS)
            for name, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], ["label", "bucket", "n"])

    summed = picked.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    by_label = summed.groupBy("label").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).collect()
    languages = sorted(r.label for r in by_label)
    counts = np.zeros((len(languages), BUCKETS))
    for r in by_label:
        counts[languages.index(r.label), r.buckets] = r.n
    return TextModel(languages, counts)


def identify(docs: DataFrame, model: TextModel, text: Column, declared: Column, suffix: Column, host: Column, id_col: str = "doc_id", accepted: set[str] | None = None) -> DataFrame:
    """doc_id, language, probability, declared, text_language and kept of every document.

    ``declared``, ``suffix`` and ``host`` may be null and then say nothing. A null or empty text says
    nothing either; without any evidence the corpus's prior decides. kept: the language isn't
    unknown and is in ``accepted`` (unset: any). Equal probabilities go to the first language by
    name. Repeated ids get a row each; other columns are ignored.
    """
    small_batches(docs.sparkSession, rows=500, mb=4)
    languages = model.languages
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            rows = [own.evidence(t) if t else np.zeros(len(own.languages)) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "declared", "suffix", "host")), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "declared", "suffix", "host", "evidence"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(declared).alias("declared"), F.lower(suffix).alias("suffix"), F.lower(host).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    scored = settle(source.mapInArrow(run, "doc_id long, declared string, suffix string, host string, evidence array<double>"), "evidence")
    indexes = F.sequence(F.lit(0), F.lit(len(languages) - 1))
    first_best = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    scored = scored.withColumn("best", first_best(F.col("evidence")))
    each = [F.coalesce(F.sum(F.when(F.col("best") == i, 1.0).otherwise(0.0)), F.lit(0.0)) for i in range(len(languages))]

    # hosts, then suffixes, then all: counts of each language as the texts alone have it
    hosts = settle(scored.filter("host is not null").groupBy("suffix", "host").agg(F.array(*each).alias("counts")), "hosts")
    suffixes = scored.filter("suffix is not null").groupBy("suffix").agg(F.array(*each).alias("counts"))
    total = scored.agg(F.array(*each).alias("counts")).first().counts or [0.0] * len(languages)
    flat = [(c + 1) / (sum(total) + len(languages)) for c in total]
    flat = [p * (1 - RARE) / (1 - flat[-1]) for p in flat[:-1]] + [RARE]
    corpus = F.array(*map(F.lit, flat))
    smoothed = lambda counts, prior: F.zip_with(counts, prior, lambda c, p: (c + STRENGTH * p) / (F.aggregate(counts, F.lit(0.0), lambda s, x: s + x) + STRENGTH))
    suffixes = suffixes.select("suffix", smoothed(F.col("counts"), corpus).alias("suffix_prior"))
    hosts = hosts.join(suffixes, "suffix", "left").select("suffix", "host", smoothed(F.col("counts"), F.coalesce("suffix_prior", corpus)).alias("host_prior"))

    # P(declaration | language), smoothed towards the declaration's share of all declarations
    said = scored.filter("declared is not null").groupBy("declared").agg(F.array(*each).alias("counts"))
    whole = scored.filter("declared is not null").agg(F.array(*each).alias("counts")).first().counts or [0.0] * len(languages)
    share = F.aggregate("counts", F.lit(0.0), lambda s, x: s + x) / max(sum(whole), 1.0)
    said = said.select("declared", F.zip_with("counts", F.array(*(F.lit(float(w)) for w in whole)), lambda c, w: F.log((c + DECLARED * share) / (w + DECLARED))).alias("declaration"))

    joined = scored.join(said, "declared", "left").join(suffixes, "suffix", "left")
    joined = joined.join(hosts.withColumnsRenamed({"suffix": "s", "host": "h"}), (F.col("host") == F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
    prior = F.coalesce("host_prior", "suffix_prior", corpus)
    at = lambda a, i: F.get(F.col(a), i)
    log_post = F.transform(indexes, lambda i: at("evidence", i) + F.coalesce(at("declaration", i), F.lit(0.0)) + F.log(F.get(prior, i)))
    out = joined.withColumn("posterior", log_post)
    top = F.array_max("posterior")
    out = out.withColumn("winner", first_best(F.col("posterior"))).withColumn("probability", 1 / F.aggregate(F.transform("posterior", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x))
    name = lambda i: F.get(F.array(*map(F.lit, languages)), i)
    out = out.select("doc_id", name(F.col("winner")).alias("language"), "probability", "declared", name(F.col("best")).alias("text_language"))
    good = F.col("language") != UNKNOWN
    return out.withColumn("kept", good & F.col("language").isin(sorted(accepted)) if accepted is not None else good)


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with text, declared (the html element's lang), host and suffix
    (the host's last label, and the first path segment if it is two letters)."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host = F.nullif(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    path = F.regexp_extract("url", r"^[^:]+://[^/]+/([a-zA-Z]{2})(?:/|$)", 1)
    declared = F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1), F.lit(""))
    return pages.select("page_id", plain.alias("text"), declared.alias("declared"), host.alias("host"), F.concat_ws("/", F.regexp_extract(host, r"([^.]+)$", 1), F.nullif(path, F.lit(""))).alias("suffix"))
