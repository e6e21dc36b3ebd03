"""Fused language evidence against a plain recomputation: host and suffix priors, declarations, posteriors."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import langid, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"), "text", "lang", "doc_id")


def plain(model, rows):
    """(key, language, probability, declared, text_language) of (key, text, declared, suffix, host) rows."""
    n = len(model.languages)
    low = lambda x: None if x is None else x.lower()
    rows = [(k, t, low(d), low(s), low(h)) for k, t, d, s, h in rows]
    evidence = [model.evidence(t) if t else np.zeros(n) for _, t, *_ in rows]
    best = [int(np.argmax(e)) for e in evidence]
    hosts, suffixes, said = (collections.defaultdict(lambda: np.zeros(n)) for _ in range(3))
    total = np.zeros(n)
    for b, (_, _, d, s, h) in zip(best, rows, strict=True):
        total[b] += 1
        for table, name in ((hosts, None if h is None else (s, h)), (suffixes, s), (said, d)):
            if name is not None:
                table[name][b] += 1
    corpus = (total + 1) / (total.sum() + n)
    corpus = np.append(corpus[:-1] * (1 - langid.RARE) / (1 - corpus[-1]), langid.RARE)
    smooth = lambda c, prior: (c + langid.STRENGTH * prior) / (c.sum() + langid.STRENGTH)
    all_said = sum(said.values(), np.zeros(n))
    out = []
    for e, b, (k, _, d, s, h) in zip(evidence, best, rows, strict=True):
        prior = corpus if s is None else smooth(suffixes[s], corpus)
        prior = prior if h is None else smooth(hosts[s, h], prior)
        posterior = e + np.log(prior)
        if d is not None:
            posterior = posterior + np.log((said[d] + langid.DECLARED * said[d].sum() / max(all_said.sum(), 1)) / (all_said + langid.DECLARED))
        win = int(np.argmax(posterior))
        out.append((k, model.languages[win], 1 / np.exp(posterior - posterior[win]).sum(), d, model.languages[b]))
    return out


def agree(got, wanted):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or "", r[2]))
    got, wanted = order(got), order(wanted)
    assert [(*r[:2], *r[3:]) for r in got] == [(*r[:2], *r[3:]) for r in wanted]
    assert np.allclose([r[2] for r in got], [r[2] for r in wanted], atol=2e-6)


def test_documents_equal_plain_recomputation(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = [(r.doc_id, r.language, r.probability, r.declared, r.text_language) for r in queries.op2_language_id(spark, SF).collect()]
    agree(got, plain(model, [(r.doc_id, r.text, r.lang, None, r.source) for r in docs]))


def test_pages_equal_plain_recomputation(spark, model):
    pages = langid.page_evidence(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert any(r.declared for r in pages) and any("/" in r.suffix for r in pages)
    got = [(r.page_id, r.language, r.probability, r.declared, r.text_language) for r in queries.op2_language_id_pages(spark, SF).collect()]
    agree(got, plain(model, [(r.page_id, r.text, r.declared, r.suffix, r.host) for r in pages]))


def test_odd_rows(spark, model):
    """Null ids, texts and evidence, repeated rows, ties of empty texts, a very long text, clashing columns."""
    text = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first().text
    rows = [(1, text, "EN", "com", "A.com", 0), (1, text, "EN", "com", "A.com", 0), (None, text, None, None, "b.org", 0), (2, None, "de", "com", None, 0), (3, "", None, None, None, 0), (4, "", None, None, None, 0), (5, text * 500, "zz", "de", "c.de", 0), (6, " \n\t", "de", "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, said string, suffix string, host string, language int")
    found = langid.identify(df, model, F.col("text"), F.col("said"), F.col("suffix"), F.col("host")).collect()
    agree([tuple(r)[:5] for r in found], plain(model, [r[:5] for r in rows]))
    assert len({tuple(r) for r in found if r.doc_id == 1}) == 1 and len({r.language for r in found if r.doc_id in (3, 4)}) == 1
