"""Typed answers held as JSON text: a number, a flag, a time, a list or an object. All are column expressions.

Text that isn't JSON, such as a bare time, counts as a text; a null, and JSON's null, as no answer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import text
from tidegauge.functions.text import bound

# The names under which parts of an answer may come.
STARTS = ["start", "begin", "from"]
ENDS = ["end", "stop", "to"]
DATE_LISTS = ["dates", "result", "answer", "top_k", "topk"]
# The shape of the result that each metric asks for.
SHAPES = {"rel_acc": "scalar", "hit": "timestamp", "iou": "interval", "set_f1": "date_set", "report": "report_dict"}
MOST_DATES = 50
REPORT = (
    "trend_segments array<struct<start:string,end:string,adj:string,adjective:string,kind:string,type:string,trend:string>>, "
    "segments array<struct<start:string,end:string,adj:string,adjective:string,kind:string,type:string,trend:string>>, "
    "outliers array<struct<timestamp:string,time:string,at:string,value:string>>, "
    "anomalies array<struct<timestamp:string,time:string,at:string,value:string>>"
)


def kind(value: Column) -> Column:
    """none, flag, number, text, list or object."""
    return bound(F.trim(value), _kind)


def _kind(t: Column) -> Column:
    first = F.left(t, F.lit(1))
    out = F.when(t.isNull() | (t == "null"), "none").when(F.try_parse_json(t).isNull(), "text")
    return out.when(first == "[", "list").when(first == "{", "object").when(first == '"', "text").when(t.isin("true", "false"), "flag").otherwise("number")


def part(value: Column, path: str) -> Column:
    return F.get_json_object(value, path)


def first_of(value: Column, names: list[str]) -> Column:
    """The first of an object's members of these names that isn't missing or empty."""
    return F.coalesce(*(F.nullif(part(value, f"$.{n}"), F.lit("")) for n in names))


def bare(value: Column) -> Column:
    """A text without its JSON quotes; anything else as it is."""
    return bound(value, _bare)


def _bare(value: Column) -> Column:
    quoted = (kind(value) == "text") & F.trim(value).startswith('"')
    return F.when(quoted, part(F.trim(value), "$")).otherwise(value)


def single(value: Column) -> Column:
    """The element of a list of one; anything else as it is."""
    return bound(value, _single)


def _single(value: Column) -> Column:
    return F.when((kind(value) == "list") & (F.json_array_length(value) == 1), part(value, "$[0]")).otherwise(value)


def scalar_text(value: Column) -> Column:
    """A number with six decimals at most, a flag as 1 or 0; a list of one gives its element."""
    return bound(single(value), _scalar_text)


def _scalar_text(one: Column) -> Column:
    k = kind(one)
    number = F.when(F.trim(one).rlike(r"^-?\d+$"), F.trim(one)).otherwise(text.fmt_scalar(one.try_cast("double")))
    return F.when(k == "none", "").when(k == "flag", F.when(F.trim(one) == "true", "1").otherwise("0")).when(k == "number", number).otherwise(bare(one))


def time_text(value: Column) -> Column:
    """A time to the second; text that isn't one stays as it is, nothing is empty."""
    return bound(bare(single(value)), lambda one: F.coalesce(text.fmt_timestamp(text.parse_timestamp(one)), one, F.lit("")))


def interval_text(value: Column) -> Column:
    """[start, end] of a list's first two times, or of an object's members under any of their names."""
    return bound(value, _interval_text)


def _interval_text(value: Column) -> Column:
    k = kind(value)
    pair = lambda a, b: F.concat(F.lit("["), time_text(a), F.lit(", "), time_text(b), F.lit("]"))
    a, b = first_of(value, STARTS), first_of(value, ENDS)
    listed = (k == "list") & (F.json_array_length(value) >= 2)
    named = (k == "object") & a.isNotNull() & b.isNotNull()
    return F.when(k == "none", "").when(listed, pair(part(value, "$[0]"), part(value, "$[1]"))).when(named, pair(a, b)).otherwise(bare(value))


def date_text(value: Column) -> Column:
    return bound(value, _date_text)


def _date_text(value: Column) -> Column:
    dated = value.rlike("^.{4}-.{2}-.{2}")
    return F.when(dated, F.left(value, F.lit(10))).otherwise(F.coalesce(F.date_format(text.parse_timestamp(value), "yyyy-MM-dd"), value, F.lit("")))


def date_set_text(value: Column) -> Column:
    """['d1', 'd2'] of a list, or of an object's list under any of its names; [] for nothing."""
    return bound(value, _date_set_text)


def _date_set_text(value: Column) -> Column:
    k = kind(value)
    inside = F.coalesce(*(F.when(kind(part(value, f"$.{n}")) == "list", part(value, f"$.{n}")) for n in DATE_LISTS))
    dates = F.from_json(F.when(k == "list", value).when(k == "object", inside), "array<string>")
    shown = text.fmt_date_set(F.transform(dates, date_text))
    return F.when(k == "none", "[]").when(dates.isNotNull(), shown).otherwise(bare(value))


def report_text(value: Column) -> Column:
    """The two-line text of an object with segments and outliers; incomplete ones are left out."""
    return bound(value, _report_text)


def _report_text(value: Column) -> Column:
    return bound(F.from_json(F.when(kind(value) == "object", value), REPORT), lambda r: _report(value, r))


def _report(value: Column, r: Column) -> Column:
    k = kind(value)
    full = lambda c: F.when(F.size(c) > 0, c)
    word = lambda *cs: F.lower(F.trim(F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))))
    segments = F.transform(F.coalesce(full(r["trend_segments"]), r["segments"]), lambda s: F.struct(text.parse_timestamp(s["start"]).alias("start"), text.parse_timestamp(s["end"]).alias("end"), word(s["adj"], s["adjective"]).alias("adj"), word(s["kind"], s["type"], s["trend"]).alias("kind")))
    whole = F.filter(segments, lambda s: s["start"].isNotNull() & s["end"].isNotNull() & (F.coalesce(s["adj"], F.lit("")) != "") & (F.coalesce(s["kind"], F.lit("")) != ""))
    outliers = F.transform(F.coalesce(full(r["outliers"]), r["anomalies"]), lambda o: F.struct(bound(F.coalesce(o["timestamp"], o["time"], o["at"]), text.parse_timestamp).alias("timestamp"), o["value"].try_cast("double").alias("value")))
    timed = F.filter(outliers, lambda o: o["timestamp"].isNotNull())
    return F.when(k == "none", "").when(k == "object", text.fmt_report(whole, timed)).otherwise(bare(value))


def answer_text(metric: Column, value: Column) -> Column:
    """An answer as text, in the form that its metric asks for; of an unknown metric, as it is."""
    out = F.when(metric == "rel_acc", scalar_text(value)).when(metric == "hit", time_text(value)).when(metric == "iou", interval_text(value))
    out = out.when(metric == "set_f1", date_set_text(value)).when(metric == "report", report_text(value))
    return F.coalesce(out.otherwise(bare(value)), F.lit(""))


def is_time(value: Column) -> Column:
    return bound(bare(value), lambda one: F.coalesce(text.parse_timestamp(one).isNotNull(), F.lit(False)))


def shape_of(metric: Column) -> Column:
    return F.coalesce(*(F.when(metric == m, F.lit(s)) for m, s in SHAPES.items()))


def shape_problem(shape: Column, value: Column, most: int = MOST_DATES) -> Column:
    """What is wrong with an answer of a shape (scalar, timestamp, interval, date_set, nonempty_string,
    report_dict), in words; null if nothing is, or if the shape is unknown."""
    return bound(F.struct(shape.alias("s"), value.alias("v"), kind(value).alias("k")), lambda x: _problem(x["s"], x["v"], x["k"], most))


def _problem(shape: Column, value: Column, k: Column, most: int) -> Column:
    shown = F.concat(F.lit(", not "), k, F.lit(": "), F.left(F.coalesce(value, F.lit("null")), F.lit(200)))
    n = F.json_array_length(value)
    items = F.from_json(F.when(k == "list", value), "array<string>")
    says = lambda good, words: F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit(words), shown))
    spoken = (k == "text") & (F.trim(bare(value)) != "")
    dated = F.forall(items, lambda x: F.coalesce(F.length(x) >= 10, F.lit(False)))
    dates = F.when(k != "list", F.concat(F.lit("a list of dates is needed"), shown)).when(n > most, F.concat(F.lit("more dates than "), F.lit(str(most)), F.lit(": "), n.cast("string"))).when(~dated, F.concat(F.lit("not all are dates: "), F.left(value, F.lit(200))))
    keyed = (k == "object") & (part(value, "$.trend_segments").isNotNull() | part(value, "$.segments").isNotNull())
    return (
        F.when(shape == "scalar", says(k == "number", "a number is needed"))
        .when(shape == "timestamp", says((k == "text") & is_time(value), "a time is needed"))
        .when(shape == "interval", says((k == "list") & (n == 2) & is_time(part(value, "$[0]")) & is_time(part(value, "$[1]")), "a list of two times is needed"))
        .when(shape == "date_set", dates)
        .when(shape == "nonempty_string", says(spoken, "a text is needed"))
        .when(shape == "report_dict", says(spoken | keyed, "a report with trend_segments, or a text, is needed"))
    )


def read_prediction(metric: Column, prediction: Column) -> Column:
    """A prediction's text as a struct of number, time, start, end, dates, segments, outliers and other, of
    which its metric fills some. The ends of an interval may be dates, and keep their order."""
    return bound(F.struct(metric.alias("m"), F.nullif(F.trim(prediction), F.lit("")).alias("t")), lambda x: _read(x["m"], x["t"]))


def _read(metric: Column, t: Column) -> Column:
    of = lambda m, c: F.when(metric == m, c)
    ends = text.all_matches(t, rf"{text.DATE}(?:[ T]\d{{2}}:\d{{2}}:\d{{2}})?")
    two = lambda i: of("iou", F.when(F.size(ends) >= 2, F.get(ends, F.lit(i))))
    segments, outliers = text.parse_report(F.replace(t, F.lit("\n"), F.lit(" ")))
    return F.struct(
        of("rel_acc", text.parse_float(t)).alias("number"),
        of("hit", F.get(text.all_matches(t, text.TIMESTAMP), F.lit(0))).alias("time"),
        two(0).alias("start"),
        two(1).alias("end"),
        of("set_f1", text.all_matches(t, text.DATE)).alias("dates"),
        of("report", segments).alias("segments"),
        of("report", outliers).alias("outliers"),
        F.when(~F.coalesce(metric.isin(list(SHAPES)), F.lit(False)), t).alias("other"),
    )


def read_report_truth(truth: Column) -> tuple[Column, Column]:
    """Trend segments and outlier times of a true report: its text, or an object with the sentences of
    ``trend_segments`` and the time of ``significant_anomaly``."""
    truth = F.coalesce(truth, F.lit(""))
    # a text that can't be an object isn't tried as JSON
    is_object = F.ltrim(truth).startswith("{") & (kind(truth) == "object")
    r = F.from_json(F.when(is_object, truth), "trend_segments array<string>, significant_anomaly struct<timestamp:string>")
    plain = F.replace(truth, F.lit("\n"), F.lit(" "))
    segments, outliers = text.parse_report(F.when(is_object, F.array_join(r["trend_segments"], " ")).otherwise(plain))
    at = text.parse_timestamp(r["significant_anomaly"]["timestamp"])
    none = F.array().cast("array<timestamp_ntz>")
    segments = F.coalesce(segments, text.parse_report(F.lit(""))[0])  # an object without segments
    return segments, F.when(is_object, F.when(at.isNotNull(), F.array(at)).otherwise(none)).otherwise(outliers)
