"""The corpus pipeline: each stage, on what its predecessor wrote, against brute force."""

import collections
import itertools
import re

import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_languages import plain
from test_operators import components_of
from tokenizers import Tokenizer

from tidegauge.llm import langid, lines, pii
from tidegauge.llm.queries import WORD_BPE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark):
    """What each stage read, and the pieces at the end."""
    seen, stages = [], corpus_pipeline.STAGES

    def noted(stage):
        def run(spark, docs, sf_dir):
            seen.append(docs)
            return stage(spark, docs, sf_dir)

        return run

    corpus_pipeline.STAGES = [(name, noted(stage)) for name, stage in stages]
    try:
        pieces = corpus_pipeline.run(spark, SF).collect()
    finally:
        corpus_pipeline.STAGES = stages
    assert all(d.columns == corpus_pipeline.COLUMNS for d in seen)
    return [{r.doc_id: r for r in d.collect()} for d in seen], pieces


def test_languages_that_are_known_stay(spark, written):
    docs, kept = written[0][:2]
    model = langid.train(spark.read.parquet(f"{SF}/documents.parquet"), "text", "lang", "doc_id")
    known = {r[0] for r in plain(model, [(r.doc_id, r.text, r.lang, None, r.source) for r in docs.values()]) if r[1] != langid.UNKNOWN}
    assert set(kept) == known and all(kept[d] == docs[d] for d in known)


def test_lines_lose_later_occurrences(spark, written):
    """Every line with one of edit similarity 0.8 or more before it in its group goes, no other line."""
    docs, kept = written[0][1:3]
    own = [(d, i, f.decode()) for d, r in docs.items() for i, x in enumerate((r.text or "").split("\n")) if (f := lines.normal(x))]
    forms = spark.createDataFrame([(f, len(f)) for f in sorted({f for _, _, f in own})], "f string, n int").repartition(32)
    side = lambda x: forms.select(F.col("f").alias(x), F.col("n").alias(f"n_{x}"))
    most = "cast(floor(greatest(n_a, n_b) * 20 / 100) as int)"
    near = side("a").join(F.broadcast(side("b")), F.expr(f"a < b and abs(n_a - n_b) <= {most}")).filter(F.expr(f"levenshtein(a, b, {most}) >= 0"))
    group, first = components_of([f for _, _, f in own], [(r.a, r.b) for r in near.select("a", "b").collect()]), {}
    for d, i, f in own:
        first[group[f]] = min(first.get(group[f], (d, i)), (d, i))
    gone = {(d, i) for d, i, f in own if first[group[f]] != (d, i)}
    for d, r in docs.items():
        text = "\n".join(x for i, x in enumerate((r.text or "").split("\n")) if (d, i) not in gone)
        assert kept[d].text == text and kept[d].n_chars == len(text)
    assert set(kept) == set(docs) and gone


def test_one_document_of_each_group_stays(written):
    docs, kept = written[0][2:4]
    sets = {}
    for d, r in docs.items():
        w = r.text.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * (i := len(sets[a] & sets[b])) >= 80 * (len(sets[a]) + len(sets[b]) - i)]
    group = components_of(sets, linked)
    assert set(kept) == set(group.values()) and all(kept[d] == docs[d] for d in kept)


def test_personal_data_is_replaced(written):
    docs, kept = written[0][3:5]
    assert set(kept) == set(docs)
    addresses = re.compile(pii.PATTERNS["email"])
    old = {m for r in docs.values() for m in addresses.findall(r.text)}
    assert old and not any(m in r.text for r in kept.values() for m in old)
    for d, r in docs.items():
        if not re.search(r"[@\d]|\b(M|H|F|S|D|P)\S* [A-Z]|(?i:token|passw|secret|api_?key)", r.text):
            assert kept[d].text == r.text
        assert len(addresses.findall(kept[d].text)) == len(addresses.findall(r.text))


def test_packing_holds_every_token_once(written):
    docs, pieces = written[0][4], written[1]
    tok = Tokenizer.from_file(P.path(WORD_BPE))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(docs)
    for d, r in docs.items():
        own = sorted(by_doc[d], key=lambda p: p.start)
        n = len(tok.encode(r.text, add_special_tokens=False).ids) + 1
        assert all(p.doc_tokens == n for p in own) and sum(p.length for p in own) == n
        assert [p.start for p in own] == list(itertools.accumulate([0, *(p.length for p in own[:-1])]))
    assert all(sum(p.length for p in own) <= 4096 for own in by_sequence.values())


def test_empty_documents_and_odd_rows(spark, tmp_path):
    """No rows give no pieces; null ids and texts, repeated rows and empty texts come through."""
    none = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], none).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    some = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"))
    odd = spark.createDataFrame([(None, "Mail z.y@c.example.com please, thank you all.", "en", "s", 1), (None, None, None, None, None), (900_000, "", "en", "s", 0), (900_001, None, "en", "s", None)], none)
    some.union(some.limit(2)).union(odd).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    first = [p.doc_id for p in pieces if p.start == 0 and p.doc_id is not None]
    assert len(first) == len(set(first)) and first


def test_languages_are_told_without_a_shuffle_of_texts(spark):
    """Rejected ids go by a broadcast; those that are null or known stay."""
    noise = "zq xw 0x9f " * 3
    good = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    docs = spark.createDataFrame([*good, (None, good[0][1], None, None, 1), (None, noise, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.identify(spark, docs, SF)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {tuple(r) for r in out.collect()}
        known = {r.doc_id for r in corpus_pipeline.document_languages(docs).filter("kept and doc_id is not null").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {r[0] for r in rows} == known | {None} and sum(r[0] is None for r in rows) == 2
