"""Typed answers as text, and back; slots in questions. All are column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# How times, dates and numbers are written.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
DATE = r"\d{4}-\d{2}-\d{2}"
NUMBER = r"[-+]?\d+\.\d+|[-+]?\d+"
# Words that name a direction or an order.
UP_WORDS = ["flood", "surge", "spike", "elevated", "above-normal", "historically high", "high water", "wet"]
DOWN_WORDS = ["drought", "dry-out", "dry", "dip", "depression", "below-normal", "historically low", "low water"]
DESCENDING = ["fastest", "biggest", "largest", "strongest", "highest", "deepest", "most", "sharpest", "steepest"]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` in the plan once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def parse_float(text: Column) -> Column:
    """The last number in the text."""
    return F.try_element_at(all_matches(text, NUMBER), F.lit(-1)).try_cast("double")


def full_time(text: Column) -> Column:
    """``text``, a full time, with a fraction of a second or without; null if there is no such time."""
    return F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def parse_timestamp(text: Column) -> Column:
    """The first full time anywhere in the text, else the whole text as a time in any of four formats;
    quotes, brackets, T and Z are tolerated."""
    full = full_time(F.regexp_extract(text, rf"{TIMESTAMP}(?:\.\d+)?", 0))
    bare = F.trim(F.regexp_replace(F.translate(text, "'\"[]()", ""), "(?<=\\d)[TZ]", " "))
    tries = [F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]
    return F.coalesce(full, F.coalesce(*tries).cast("timestamp_ntz"))


def interval(text: Column) -> Column:
    """A struct of start and end, the first two full times in order; null if there aren't two."""
    ends = bound(all_matches(text, rf"{TIMESTAMP}(?:\.\d+)?"), lambda found: F.transform(F.slice(found, 1, 2), full_time))
    whole = lambda e: F.when((F.size(e) == 2) & F.get(e, F.lit(0)).isNotNull() & F.get(e, F.lit(1)).isNotNull(), F.struct(F.array_min(e).alias("start"), F.array_max(e).alias("end")))
    return bound(ends, whole)


def parse_interval(text: Column) -> tuple[Column, Column]:
    """The first two full times, in order; null if there aren't two."""
    both = interval(text)
    return both["start"], both["end"]


def parse_date_set(text: Column) -> Column:
    """The distinct dates in the text."""
    return F.array_distinct(all_matches(text, DATE))


def parse_report(text: Column) -> tuple[Column, Column]:
    """Trend segments (start, end, adj, kind) and outlier times of a report."""
    # Fixed value: the sentence of a trend segment.
    pattern = rf"(?i)from\s+{TIMESTAMP}\s+to\s+{TIMESTAMP}\s*,?\s*the\s+trend\s+showed\s+a\s+[a-zA-Z]+\s+[a-zA-Z]+"
    # the text is searched once; a sentence's parts lie at known places once its white space is trimmed
    after = lambda s, n: F.ltrim(F.substr(s, F.lit(n + 1)))
    ends = lambda s: bound(after(s, len("from")), lambda a: F.struct(F.left(a, F.lit(19)).alias("start"), F.left(after(after(a, 19), len("to")), F.lit(19)).alias("end")))
    words = lambda s: bound(F.struct(s.alias("s"), F.substring_index(s, " ", -1).alias("kind")), lambda x: F.struct(F.substring_index(F.rtrim(F.left(x["s"], F.length(x["s"]) - F.length(x["kind"]))), " ", -1).alias("adj"), x["kind"].alias("kind")))
    parts = F.transform(all_matches(text, pattern), lambda m: bound(F.translate(m, "\t\n\x0b\f\r", "     "), lambda s: F.struct(ends(s).alias("t"), words(s).alias("w"))))
    segments = F.transform(parts, lambda x: F.struct(full_time(x["t"]["start"]).alias("start"), full_time(x["t"]["end"]).alias("end"), F.lower(x["w"]["adj"]).alias("adj"), F.lower(x["w"]["kind"]).alias("kind")))
    outliers = F.transform(all_matches(text, rf"(?i)detected\s+at\s+({TIMESTAMP})", 1), full_time)
    return F.filter(segments, lambda x: x["start"].isNotNull() & x["end"].isNotNull()), F.filter(outliers, lambda x: x.isNotNull())


def question_times(text: Column) -> Column:
    """All full times in a question, in order."""
    return all_matches(text, TIMESTAMP)


def question_month(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2})", 1), F.lit(""))


def trend_kinds(text: Column) -> Column:
    """"rapid rise, then slow fall" -> [rise, fall]: the last word of each part."""
    parts = F.filter(F.transform(F.split(F.replace(F.lower(text), F.lit("then"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.element_at(F.split(x, r"\s+"), -1))


def trend_target(text: Column) -> Column:
    """The target segment's adjective, kind and superlative."""
    pattern = r"the (\w+) (rise|fall|stable) segment is the (\w+)"
    get = lambda i, default: F.coalesce(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")), F.lit(default))
    return F.struct(get(1, "rapid").alias("adj"), get(2, "rise").alias("kind"), get(3, "fastest").alias("superlative"))


def descending(superlative: Column, kind: Column, adj: Column) -> Column:
    """Whether a superlative asks for the largest; steady stable segments never do."""
    return superlative.isin(DESCENDING) & ~((kind == "stable") & (adj == "steady"))


def direction(text: Column) -> Column:
    """+1 or -1 by the words of a question; +1 if as many."""
    low = F.lower(text)
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    return F.when(count(UP_WORDS) >= count(DOWN_WORDS), 1).otherwise(-1)


def anomaly_mode(text: Column) -> Column:
    return F.when(F.lower(text).rlike("flat|constant|still"), "flat").otherwise("inverse")


def fmt_scalar(x: Column) -> Column:
    """Six decimals at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def fmt_timestamp(t: Column) -> Column:
    return F.substring_index(t.cast("timestamp_ntz").cast("string"), ".", 1)  # without a fraction of a second


def fmt_interval(a: Column, b: Column) -> Column:
    return F.concat(F.lit("["), fmt_timestamp(a), F.lit(", "), fmt_timestamp(b), F.lit("]"))


def fmt_date_set(dates: Column) -> Column:
    """['d1', 'd2']; [] for null."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(dates, F.array().cast("array<string>")), lambda d: F.concat(F.lit("'"), d.cast("string"), F.lit("'"))), ", "), F.lit("]"))


def fmt_report(segments: Column, outliers: Column) -> Column:
    """The two-line text of a report; "None." for an empty part."""
    seg = F.array_join(F.transform(segments, lambda s: F.concat(F.lit("from "), fmt_timestamp(s["start"]), F.lit(" to "), fmt_timestamp(s["end"]), F.lit(", the trend showed a "), s["adj"], F.lit(" "), s["kind"])), "; ")
    out = F.array_join(F.transform(outliers, lambda o: F.concat(F.lit("A significant spike was detected at "), fmt_timestamp(o["timestamp"]), F.when(o["value"].isNotNull(), F.format_string(" (value: %.2f)", o["value"])).otherwise(""))), ". ")
    line = lambda c: bound(c, lambda x: F.when(F.coalesce(x, F.lit("")) == "", "None.").otherwise(F.concat(x, F.lit("."))))
    return F.concat(F.lit("1. Trend Segmentation: "), line(seg), F.lit("\n2. Outlier Audit: "), line(out))


def fmt_answer(metric: Column, number: Column, time: Column, start: Column, end: Column, dates: Column, report: Column) -> Column:
    """An answer as text, by its metric; empty if it is null."""
    out = F.when(metric == "rel_acc", fmt_scalar(number)).when(metric == "hit", fmt_timestamp(time)).when(metric == "iou", fmt_interval(start, end)).when(metric == "set_f1", fmt_date_set(dates)).when(metric == "report", report)
    return F.coalesce(out, F.lit(""))


def result_status(metric: Column, text: Column) -> Column:
    """ok, or shape_mismatch if a result's text doesn't have the shape that its metric asks for."""
    start, end = parse_interval(text)
    n = F.size(all_matches(text, DATE))
    good = F.when(metric == "rel_acc", F.trim(text).rlike(rf"^(?:{NUMBER})$")).when(metric == "hit", parse_timestamp(text).isNotNull()).when(metric == "iou", start.isNotNull() & (text.rlike(r"^\[.*\]$"))).when(metric == "set_f1", (n <= 50) & text.rlike(r"^\[.*\]$")).when(metric == "report", F.length(F.trim(text)) > 0)
    return F.when(F.coalesce(good, F.lit(False)), "ok").otherwise("shape_mismatch")
