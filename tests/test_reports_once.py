"""Reports are parsed, aligned and scored as before, each text once."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tests.conftest import SF
from tidegauge.functions import text as T
from tidegauge.plans import scoring
from tidegauge.registry import scores


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_of_sentences_with_odd_spaces_and_words(spark):
    texts = [
        "From  2022-01-01T00:00:00\tto\n2022-01-09 01:02:03 ,\n the trend  showed\ra Rapid\x0b\f Rise; from 2022-02-30 00:00:00 to 2022-03-01 00:00:00, the trend showed a slow fall.",
        "éfrom 2022-01-01 00:00:00 to 2022-01-09 00:00:00the trend showed a steady stable2",
        "from 2022-01-01 00:00:00 to 2022-01-09 00:00:00, the trend showed a rapid",
        "",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    pattern = re.compile(rf"(?ia)from\s+({T.TIMESTAMP})\s+to\s+({T.TIMESTAMP})\s*,?\s*the\s+trend\s+showed\s+a\s+([a-zA-Z]+)\s+([a-zA-Z]+)")
    want = [None if t is None else [(a.replace("T", " "), b.replace("T", " "), c.lower(), d.lower()) for a, b, c, d in pattern.findall(t) if "02-30" not in a] for t in texts]
    got = [r.s for r in df.select("i", T.parse_report(F.col("t"))[0].alias("s")).orderBy("i").collect()]
    assert [None if g is None else [(str(x.start), str(x.end), x.adj, x.kind) for x in g] for g in got] == want
    assert len(want[0]) == 1 and len(want[1]) == 1


def test_alignment_equals_difflib(spark):
    lists = [["rise", "fall"], ["fall", "rise", "rise"], [], None, ["rise", None], [None, "stable", "rise", "fall"], ["é", "fall"]]
    rows = [(i, j, lists[i], lists[j]) for i in range(len(lists)) for j in range(len(lists))] * 3
    df = spark.createDataFrame(rows, "i int, j int, a array<string>, b array<string>")
    kinds = lambda c: F.transform(c, lambda x: F.struct(x.alias("kind")))
    for r in df.select("i", "j", scoring.aligned(kinds("a"), kinds("b")).alias("m")).collect():
        blocks = SequenceMatcher(None, lists[r.i] or [], lists[r.j] or []).get_matching_blocks()
        assert [tuple(x) for x in r.m] == [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]


def test_segments_are_aligned_once(spark):
    assert plan(scores.ENTRIES["join_segment_align"][0](spark, SF)).count("ArrowEvalPython") == 1


def test_a_report_is_searched_once_for_its_segments(spark):
    df = spark.createDataFrame([("a", "b")], "prediction string, ground_truth string")
    shown = plan(scoring.report_parts(df, "prediction", "ground_truth").select("breakdown.trend"))
    assert shown.count("the\\s+trend\\s+showed") <= 3  # of the prediction, of the truth, and of an object without segments


def test_intervals_are_parsed_once_for_all_their_uses(spark):
    df = spark.createDataFrame([("iou", "a", "b")], "eval_metric string, prediction string, ground_truth string")
    shown = plan(scoring.score(df).filter("eval_metric = 'iou'").select("score"))
    assert shown.count("regexp_extract_all") <= 30 and shown.count("array_min") <= 2
