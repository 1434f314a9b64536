"""What a question asks for: intent, names, dates and their window, and what kind of answer it wants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import expr as X
from engram.operators.packing import NUMBERS

SIGNAL = "array<struct<kind:string,value:string,resolved:timestamp_ntz>>"
_FULL = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_MONTH = "|".join([*_FULL, "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug", "Sept", "Sep", "Oct", "Nov", "Dec"])
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
_DAY, _COUNT, _NTH = "|".join(_DAYS), rf"\d+|{'|'.join(NUMBERS)}", r"\d{1,2}(?:st|nd|rd|th)?"
_UNIT = "minute|hour|day|week|month|year"

#: The grammar: forms of dates, the longer ones first where one is a part of another.
FORMS = {
    "iso": r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
    "month day year": rf"(?:{_MONTH})\s+{_NTH},?\s+\d{{4}}",
    "day month year": rf"{_NTH}\s+(?:of\s+)?(?:{_MONTH}),?\s+\d{{4}}",
    "edge": rf"(?:beginning|start|end)\s+of\s+(?:the\s+)?(?:(?:last|this|next)\s+)?(?:week|month|year)",
    "month year": rf"(?:{_MONTH}),?\s+\d{{4}}",
    "month day": rf"(?:{_MONTH})\s+{_NTH}",
    "day month": rf"{_NTH}\s+(?:of\s+)?(?:{_MONTH})",
    "in month": rf"(?:in|since|during|until|last|next)\s+(?:{_MONTH})",
    "ago": rf"(?:{_COUNT})\s+(?:{_UNIT})s?\s+ago",
    "ahead": rf"in\s+(?:{_COUNT})\s+(?:{_UNIT})s?",
    "last": r"(?:last|next)\s+(?:week|month|year)",
    "weekday": rf"(?:(?:last|next|this|on)\s+)?(?:{_DAY})",
    "near": r"(?:the\s+)?day\s+before\s+yesterday|(?:the\s+)?day\s+after\s+tomorrow|yesterday|today|tomorrow",
}


def _month(name: Column) -> Column:
    return X.lookup({m[:3].lower(): i % 12 + 1 for i, m in enumerate(_FULL)}, F.lower(F.substring(name, 1, 3)), None)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date").cast("timestamp_ntz")


def _resolved(value: Column, now: Column) -> Column:
    """The time that a piece of text of one of the forms means. Without a year the last such day counts, a month without a day has
    today's (or its last), a day of the week is the last one, or the next if it is called so."""
    part = lambda pattern, i=1: F.regexp_extract(value, "(?i)" + pattern, i)
    low, today = F.lower(value), F.date_trunc("day", now.cast("timestamp")).cast("timestamp_ntz")
    year, name, digits = F.year(now), _month(part(rf"\b({_MONTH})\b")), part(r"\b(\d{1,2})(?:st|nd|rd|th)?\b")
    given = part(r"\b(\d{4})\b")
    nth = F.when(digits != "", digits)

    def within(y: Column, m: Column) -> Column:  # today's day of that month, or its last
        first = _date(y, m, F.lit(1))
        return _date(y, m, F.least(F.dayofmonth(now), F.dayofmonth(F.last_day(first.cast("date")))))

    past = lambda at: F.when(at(year) <= now, at(year)).otherwise(at(year - 1))
    coming = lambda at: F.when(at(year) > now, at(year)).otherwise(at(year + 1))
    word = F.lower(part(rf"\b({_COUNT})\s+(?:{_UNIT})s?\b"))
    n, unit = F.coalesce(X.lookup(NUMBERS, word, None), word.try_cast("int")), F.lower(part(rf"\b({_UNIT})s?\b"))
    sign = F.when(low.rlike("^(in|next) "), 1).otherwise(-1)
    n = sign * F.coalesce(n, F.lit(1))
    moved = F.when(unit.isin("month", "year"), now + F.make_ym_interval(F.when(unit == "year", n).otherwise(0), F.when(unit == "month", n).otherwise(0))).otherwise(
        now + F.make_dt_interval(F.when(unit == "week", 7 * n).when(unit == "day", n).otherwise(0), F.when(unit == "hour", n).otherwise(0), F.when(unit == "minute", n).otherwise(0))
    )
    turn = F.when(low.rlike(r"\blast\b"), -1).when(low.rlike(r"\bnext\b"), 1).otherwise(0)
    late = low.startswith("end").cast("int")  # the end of a span is the day before the next begins
    trunc = lambda u, steps: F.date_trunc(u, now.cast("timestamp")).cast("timestamp_ntz") + steps
    week = trunc("week", F.make_dt_interval(7 * (turn + late) - late))
    month = trunc("month", F.make_ym_interval(F.lit(0), turn + late)) - F.make_dt_interval(late)
    whole = trunc("year", F.make_ym_interval(turn + late, F.lit(0))) - F.make_dt_interval(late)
    edge = F.when(unit == "week", week).when(unit == "month", month).otherwise(whole)
    asked = X.lookup({d.lower(): i for i, d in enumerate(_DAYS)}, F.lower(part(rf"\b({_DAY})$")), None)
    back = F.pmod(F.weekday(now) - asked, F.lit(7))
    back = F.when(back == 0, 7).otherwise(back)  # not today
    weekday = F.when(low.rlike("^next "), today + F.make_dt_interval(7 - F.when(back == 7, 0).otherwise(back))).otherwise(today - F.make_dt_interval(back))
    near = F.when(low.contains("before"), -2).when(low == "yesterday", -1).when(low == "tomorrow", 1).when(low.contains("after"), 2).otherwise(0)
    meant = {
        "iso": _date(part(r"^(\d{4})"), part(r"^\d{4}[-/](\d{1,2})"), part(r"(\d{1,2})$")),
        "month day year": _date(given, name, nth),
        "day month year": _date(given, name, nth),
        "edge": edge,
        "month year": within(given, name),
        "month day": past(lambda y: _date(y, name, nth)),
        "day month": past(lambda y: _date(y, name, nth)),
        "in month": F.when(low.startswith("next"), coming(lambda y: within(y, name))).otherwise(past(lambda y: within(y, name))),
        "ago": moved,
        "ahead": moved,
        "last": moved,
        "weekday": weekday,
        "near": now + F.make_dt_interval(near),
    }
    out = F.lit(None).cast("timestamp_ntz")
    for form in reversed(FORMS):
        out = F.when(value.rlike(f"(?i)^(?:{FORMS[form]})$"), meant[form]).otherwise(out)
    return out


def signals(query: Column, now: Column) -> Column:
    """Dates in a text, in order: its words, ABSOLUTE where they hold a digit and RELATIVE otherwise, and the time meant. Of forms that
    overlap the first and longest counts."""
    found = F.regexp_extract_all(query, F.lit(rf"(?i)\b({'|'.join(FORMS.values())})\b"), F.lit(1))
    made = F.transform(found, lambda v: F.struct(F.when(v.rlike(r"\d"), "ABSOLUTE").otherwise("RELATIVE").alias("kind"), v.alias("value"), _resolved(v, now).alias("resolved")))
    return F.filter(made, lambda s: s["resolved"].isNotNull())


def resolve_date(text: Column, now) -> Column:
    """The first date that a text speaks of, as an ISO string; null without one."""
    return F.date_format(F.try_element_at(signals(text, X.at(now)), F.lit(1))["resolved"], "yyyy-MM-dd'T'HH:mm:ss")


def analyze(queries: DataFrame, now) -> DataFrame:
    """queries: (query_id, query, ...) and maybe time_from, time_to -> the same with intent, entities, signals, a window, and
    flags. A given bound rules out the window of the text; without any, the window spans the dates of the text."""
    q = F.col("query")
    given = [F.col(c).cast("timestamp_ntz") if c in queries.columns else F.lit(None).cast("timestamp_ntz") for c in ("time_from", "time_to")]
    out = queries.withColumns({"signals": signals(q, X.at(now)), "given_from": given[0], "given_to": given[1]})
    free = F.col("given_from").isNull() & F.col("given_to").isNull()
    times = F.transform("signals", lambda s: s["resolved"])
    kind = F.when((X.intent(q) != "entity_lookup") & (F.size("signals") > 0), "temporal").otherwise(X.intent(q))
    out = out.withColumns({"intent": kind, "entities": X.entities(q), "time_from": F.when(free, F.array_min(times)).otherwise(F.col("given_from")), "time_to": F.when(free, F.array_max(times)).otherwise(F.col("given_to"))})
    open_ended = (F.col("intent") == "temporal") & F.col("time_from").isNull() & F.col("time_to").isNull()
    flags = {"is_aggregation": q.rlike(X.AGGREGATION), "is_current_state": q.rlike(X.CURRENT_STATE) | open_ended, "is_episodic": q.rlike(X.EPISODIC)}
    return out.withColumns(flags).drop("given_from", "given_to")
