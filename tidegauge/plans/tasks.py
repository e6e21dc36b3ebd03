"""Answers to a table of questions in one job: slots from their words, detectors by subtask, text by metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import sax, text
from tidegauge.operators import aggregates, joins, topk, windows
from tidegauge.plans import detect, features, insight, scoring
from tidegauge.views import SERIES, stored

DAY, HOUR = 86400.0, 3600.0
SHAPE_WORDS = {"depression": "depression|low plateau|bottom(s|ed|ing)? out", "plateau": "plateau|stable period", "spike": "spike", "valley": "valley", "step_up": "step[- _]?up|ascent", "step_down": "step[- _]?down|descent"}
# The first that fits names the statistic asked for.
STATISTICS = {"std": "standard deviation|\\bstd\\b", "count": "how many|number of (readings|samples|values|records|points|observations|entries)|\\bcount\\b", "sum": "\\btotal\\b|\\bsum\\b", "avg": "average|\\bmean\\b", "min": "minimum|lowest|smallest|\\bmin\\b", "max": "maximum|highest|largest|peak|\\bmax\\b"}
SPREADS = {"std": "standard deviation|\\bstd\\b", "var": "variance|\\bvar\\b", "range": "\\brange\\b", "mean": ""}


# How numbers, months and comparisons are said.
NUMBERS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
ABOVE = "above|over|exceeds?|exceeding|more than|greater than|higher than|larger than"
BELOW = "below|under|less than|lower than|fewer than|smaller than"
#: Days that a trend question asks for if it doesn't say how many.
TOP = 5


def first_fit(low: Column, patterns: dict[str, str]) -> Column:
    return F.coalesce(*(F.when(low.rlike(p), F.lit(name)) for name, p in patterns.items()))


def digits(low: Column) -> Column:
    """Numbers up to ten in words as digits."""
    for i, word in enumerate(NUMBERS, 1):
        low = F.regexp_replace(low, rf"\b{word}\b", str(i))
    return low


def spoken_range(q: Column, low: Column) -> tuple[Column, Column]:
    """The range a question names, both ends included: two full times, else two dates (whole days), a month by
    name or number, a date, a year. Null if it names none."""
    times = F.transform(text.question_times(q), text.full_time)
    dates = F.transform(text.all_matches(q, rf"(?<![\d-]){text.DATE}(?![\d-])"), lambda d: d.try_cast("timestamp_ntz"))
    named = F.regexp_extract(low, rf"\b({MONTHS})[a-z]*\.?,?\s+(\d{{4}})\b", 0)
    name = F.substring(F.regexp_extract(named, r"^([a-z]+)", 1), 1, 3)
    number = F.floor((F.instr(F.lit(MONTHS), name) - 1) / 4) + 1
    month = F.when(named != "", F.concat_ws("-", F.regexp_extract(named, r"(\d{4})", 1), F.lpad(number.cast("string"), 2, "0"), F.lit("01")))
    month = F.coalesce(month, F.concat(F.nullif(F.regexp_extract(q, r"(?<![\d-])(\d{4}-\d{2})(?![\d-])", 1), F.lit("")), F.lit("-01"))).try_cast("timestamp_ntz")
    year = F.concat(F.nullif(F.regexp_extract(q, r"\b((?:19|20)\d{2})\b", 1), F.lit("")), F.lit("-01-01")).try_cast("timestamp_ntz")
    at = lambda array, i: F.get(array, F.lit(i))
    upto = lambda t, unit: t + F.expr(f"interval 1 {unit}") - F.expr("interval 1 microsecond")
    two, days = F.size(times) >= 2, F.size(dates) >= 2
    first, last = F.least(at(dates, 0), at(dates, 1)), F.greatest(at(dates, 0), at(dates, 1))
    a = F.when(two, F.least(at(times, 0), at(times, 1))).when(days, first).otherwise(F.coalesce(month, at(dates, 0), year))
    b = F.when(two, F.greatest(at(times, 0), at(times, 1))).when(days, upto(last, "day")).otherwise(F.coalesce(upto(month, "month"), upto(at(dates, 0), "day"), upto(year, "year")))
    return a, b


def slots(tasks: DataFrame) -> DataFrame:
    """``tasks`` with what their questions ask for.

    a, b: the range; c, d: a second range, of two more full times; statistic, spread, high, op and threshold,
    days, k, shape, sign, mode, kinds and target. What isn't said, or not in words known here, is null, or
    has the default of its parser.
    """
    q = F.coalesce("question", F.lit(""))
    low = digits(F.lower(q))
    times = F.transform(text.question_times(q), text.full_time)
    time = lambda i: F.get(times, F.lit(i))
    condition = rf"\b({ABOVE}|{BELOW})\s+(-?\d[\d,]*(?:\.\d+)?)"
    word = F.regexp_extract(low, condition, 1)
    whole = lambda pattern: F.regexp_extract(low, pattern, 1).try_cast("int")
    a, b = spoken_range(q, F.lower(q))
    return tasks.withColumns({
        "a": a,
        "b": b,
        "c": F.least(time(2), time(3)),
        "d": F.greatest(time(2), time(3)),
        "statistic": first_fit(low, STATISTICS),
        "spread": first_fit(low, SPREADS),
        "high": ~low.rlike("lowest|minimum|smallest|(?<!at )\\bleast|\\bmin\\b"),
        "op": F.when(word.rlike(f"^({BELOW})$"), "<").when(word != "", ">"),
        "threshold": F.replace(F.regexp_extract(low, condition, 2), F.lit(","), F.lit("")).try_cast("double"),
        "days": F.coalesce(whole(r"(\d+)[- ]days?\b"), whole(r"(\d+)[- ]weeks?\b") * 7),
        "k": F.coalesce(whole(r"\b(?:top|which|best|the|find|list)\s+(\d{1,3})\s+(?:\w+\s+)?(?:days|dates)\b"), F.lit(TOP)),
        "shape": first_fit(low, SHAPE_WORDS),
        "sign": text.direction(q),
        "mode": text.anomaly_mode(q),
        "kinds": F.regexp_extract_all(low, F.lit(r"\b(rise|fall|stable)\b(?!\s+(?:segment|period))"), F.lit(1)),
        "target": text.trend_target(low),
    })


#: Slots without which a question of a subtask has no answer.
NEEDED = {"Global Aggregation": ["statistic"], "Interval Discovery": ["op", "threshold"], "Shape Identification": ["shape"], "Subsequence Matching": ["a", "c", "d"], "Composite Trend": ["kinds"], "Causal Anomaly": ["a", "mode"]}


def asked_readings(asked: DataFrame, readings: DataFrame, a: str = "a", b: str = "b", keep: tuple[str, ...] = ()) -> DataFrame:
    """Each question's readings as a series of its own: its task_id is the question's id.

    Questions with a range meet the calendar months it touches; one without a range gets all readings.
    """
    own = asked.select(F.col("id").cast("string").alias("_id"), "task_id", F.col("channel").alias("channel_id"), F.col(a).alias("a"), F.col(b).alias("b"), *keep)
    columns = [F.col("_id").alias("task_id"), "channel_id", "ts", "value", *keep]
    ranged = joins.task_readings(own.filter("a is not null"), readings).select(*columns)
    return ranged.unionByName(own.filter("a is null").join(readings, SERIES).select(*columns))


def interval(found: DataFrame) -> DataFrame:
    return found.select("task_id", text.fmt_interval(F.col("start"), F.col("end")).alias("prediction"))


def number(found: DataFrame, column: str) -> DataFrame:
    return found.select("task_id", text.fmt_scalar(F.col(column).cast("double")).alias("prediction"))


def global_aggregation(asked: DataFrame, readings: DataFrame) -> DataFrame:
    series = asked_readings(asked, readings, keep=("statistic",))
    return number(aggregates.global_aggregate(series, F.col("statistic")), "answer")


def temporal_localization(asked: DataFrame, readings: DataFrame) -> DataFrame:
    series = asked_readings(asked, readings, keep=("high",)).withColumn("size", F.when(F.col("high"), F.col("value")).otherwise(-F.col("value")))
    return topk.arg_extreme(series, "size", True).select("task_id", text.fmt_timestamp(F.col("ts")).alias("prediction"))


def interval_discovery(asked: DataFrame, readings: DataFrame) -> DataFrame:
    series = asked_readings(asked, readings, keep=("op", "threshold"))
    on = F.when(F.col("op") == ">", F.col("value") > F.col("threshold")).when(F.col("op") == "<", F.col("value") < F.col("threshold"))
    return interval(windows.longest_run(windows.position(series).withColumn("on", F.coalesce(on, F.lit(False))), "on"))


def sliding_window(asked: DataFrame, readings: DataFrame) -> DataFrame:
    days = F.coalesce("days", F.lit(1))
    series = asked_readings(asked.withColumn("days", days), readings, keep=("days", "spread", "high"))
    step = aggregates.median_step(series).filter("step > 0")
    widths = series.select(*SERIES, "days").distinct().join(step, SERIES)
    n = widths.select(*SERIES, F.greatest(F.lit(1), F.bround(F.col("days") * DAY / F.col("step")).cast("int")).alias("n"))
    return interval(detect.widest(series.join(n, SERIES)))


def shapes(asked: DataFrame, readings: DataFrame) -> DataFrame:
    plans = {
        "plateau": detect.plateau,
        "depression": lambda r: detect.plateau(r, True),
        "spike": detect.spike,
        "valley": detect.valley,
        "step_up": lambda r: detect.by_width(r, [(3 * HOUR, 8)], lambda s, n: detect.step(s, n, True)),
        "step_down": lambda r: detect.by_width(r, [(3 * HOUR, 8)], lambda s, n: detect.step(s, n, False)),
    }
    there = {r[0] for r in asked.select("shape").distinct().collect()}  # of six names
    parts = [interval(plan(asked_readings(asked.filter(F.col("shape") == name), readings))) for name, plan in plans.items() if name in there]
    return union(parts, asked)


def periodicity(asked: DataFrame, readings: DataFrame) -> DataFrame:
    return number(detect.periodicity(asked_readings(asked, readings)), "period")


def subsequence_matching(asked: DataFrame, readings: DataFrame) -> DataFrame:
    """The first range is the query, the second the search."""
    query = windows.position(asked_readings(asked.filter("c is not null"), readings)).select(*SERIES, F.col("pos").alias("offset"), F.col("value").alias("q"))
    return interval(detect.subsequence(query, asked_readings(asked.filter("c is not null"), readings, "c", "d")))


def composite_trend(asked: DataFrame, readings: DataFrame) -> DataFrame:
    """The days whose word holds the kinds in order, and then others, ranked by the target segment."""
    series = asked_readings(asked, readings)
    of = asked.select(F.col("id").cast("string").alias("task_id"), F.col("channel").alias("channel_id"), sax.kind_pattern(F.col("kinds")).alias("pattern"), F.col("target.kind").alias("kind"), text.descending(F.col("target.superlative"), F.col("target.kind"), F.col("target.adj")).alias("descending"), "k")
    words = features.day_words(series).join(of, SERIES)
    hits = words.filter((F.col("pattern") != "") & sax.matches(F.col("sax"), F.col("pattern"))).select(*SERIES, F.to_date("window_start").alias("day"))
    kinds = ("rise", "fall", "stable")
    days = union([detect.day_metric(series.join(of.filter(F.col("kind") == kind).select(*SERIES), SERIES, "left_semi"), kind) for kind in kinds], asked).join(of, SERIES)
    floor = days.groupBy(*SERIES).agg(F.percentile("metric", 0.5).alias("half"), F.percentile("metric", 0.8).alias("most"))
    tall = days.join(floor, SERIES).filter(F.round("metric", 6) >= F.round(F.when(F.col("descending"), F.col("half")).otherwise(F.col("most")), 6))
    signed = joins.flagged(tall, hits, [*SERIES, "day"]).withColumn("metric", F.when(F.col("descending"), F.col("metric")).otherwise(-F.col("metric")))
    best = topk.pool_first(signed, "metric", True, F.col("k")).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "day"))).alias("days"))
    return best.select("task_id", text.fmt_date_set(F.transform("days", lambda x: x["day"])).alias("prediction"))


def contextual_anomaly(asked: DataFrame, readings: DataFrame) -> DataFrame:
    base = readings.filter(F.col("channel_id").endswith("_hist_mean"))
    companions = asked.withColumn("channel", F.concat("channel", F.lit("_hist_mean")))
    both = asked_readings(asked, readings).unionByName(asked_readings(companions, base))
    paired = joins.with_companion(both)
    parts = []
    for sign in (1, -1):
        own = paired.join(asked.filter(F.col("sign") == sign).select(F.col("id").cast("string").alias("task_id")), "task_id", "left_semi")
        parts.append(interval(detect.by_width(own, [(DAY, 1)], lambda s, n, sign=sign: detect.contextual_anomaly(s, n, sign))))
    return union(parts, asked)


def causal_anomaly(asked: DataFrame, readings: DataFrame) -> DataFrame:
    """``channel`` is the pair's name: its sides are <channel>_up_<year> and <channel>_down_<year>."""
    sides = asked.withColumn("side", F.explode(F.array(F.lit("up"), F.lit("down")))).withColumn("channel", F.concat_ws("_", "channel", "side", F.date_format("a", "yyyy")))
    pairs = joins.causal_pairs(asked_readings(sides, readings)).withColumn("value", F.col("down"))
    plans = {"inverse": detect.causal_inverse, "flat": detect.causal_flatline}
    parts = []
    for mode, plan in plans.items():
        own = pairs.join(asked.filter(F.col("mode") == mode).select(F.col("id").cast("string").alias("task_id")), "task_id", "left_semi")
        parts.append(interval(detect.by_width(own, [(6 * HOUR, 4), (2 * DAY, 2)], plan)))
    return union(parts, asked)


def insight_synthesis(asked: DataFrame, readings: DataFrame) -> DataFrame:
    found = detect.by_width(asked_readings(asked, readings), [(4 * HOUR, 4), (5 * DAY, 4)], insight.report)
    return found.select("task_id", text.fmt_report(F.col("trend_segments"), F.col("outliers")).alias("prediction"))


#: The names of the subtasks.
SUBTASKS = {
    "Global Aggregation": global_aggregation,
    "Temporal Localization": temporal_localization,
    "Interval Discovery": interval_discovery,
    "Sliding Window": sliding_window,
    "Shape Identification": shapes,
    "Periodicity Detection": periodicity,
    "Subsequence Matching": subsequence_matching,
    "Composite Trend": composite_trend,
    "Contextual Anomaly": contextual_anomaly,
    "Causal Anomaly": causal_anomaly,
    "Insight Synthesis": insight_synthesis,
}


def union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if out is not None else like.select(F.lit("").alias("task_id"), F.lit("").alias("prediction")).filter(F.lit(False))


def explained(tasks: DataFrame, readings: DataFrame) -> DataFrame:
    """(id, prediction, status): the answer to each of ``tasks`` (id, task_id, channel, subtask, question) as text.

    status says why an answer is empty: unknown subtask, not understood (and which slots are
    missing), or nothing found (no readings, too few, or none that fit); else ok. Questions of one subtask
    share a plan, whatever their parameters; plans of subtasks that aren't asked aren't made. Ids are
    unique.
    """
    said = slots(tasks)
    there = {r[0] for r in said.select("subtask").distinct().filter(F.col("subtask").isin(list(SUBTASKS))).collect()}
    kinds = {n: F.size(n) == 0 if n == "kinds" else F.col(n).isNull() for names in NEEDED.values() for n in names}
    missing = F.coalesce(*(F.when(F.col("subtask") == name, F.concat_ws(", ", *(F.when(kinds[n], n) for n in names))) for name, names in NEEDED.items()), F.lit(""))
    # a row a question; parsed once, as every plan below reads its slots
    said = stored(said.withColumn("_missing", missing), "slots")
    parts = [plan(said.filter((F.col("subtask") == name) & (F.col("_missing") == "")), readings) for name, plan in SUBTASKS.items() if name in there]
    found = union(parts, tasks).groupBy("task_id").agg(F.first("prediction", ignorenulls=True).alias("prediction"))
    known = F.coalesce(F.col("subtask").isin(list(SUBTASKS)), F.lit(False))
    own = said.select("id", F.col("id").cast("string").alias("task_id"), F.when(~known, "unknown subtask").when(F.col("_missing") != "", F.concat(F.lit("not understood: "), "_missing")).alias("why"))
    prediction = F.coalesce("prediction", F.lit(""))
    status = F.coalesce("why", F.when(prediction.isin("", "[]"), "nothing found").otherwise("ok"))
    return own.join(found, "task_id", "left").select("id", prediction.alias("prediction"), status.alias("status"))


def answer(tasks: DataFrame, readings: DataFrame) -> DataFrame:
    """(id, prediction) of ``explained``: an empty text where there is no answer."""
    return explained(tasks, readings).select("id", "prediction")


def scored(tasks: DataFrame, readings: DataFrame) -> DataFrame:
    """Tasks with their answers and scores against ``ground_truth``."""
    return scoring.score(joins.with_predictions(tasks, answer(tasks, readings)))
