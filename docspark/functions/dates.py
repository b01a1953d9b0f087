"""Dates in many spellings to ``YYYY-MM-DD`` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions.text import strip

#: Format and the pattern that a text must match to be read with it (the parser alone is laxer).
FORMATS = [
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"), ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]+ \d{4}$"), ("MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"), ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"), ("MMMM yyyy", r"^[A-Za-z]+ \d{4}$"), ("yyyy", r"^\d{4}$"),
]


def parse_date(c: Column) -> Column:
    """The date in ISO form, or the text as it is where no format fits; null is empty."""
    text = strip(F.coalesce(c, F.lit("")))
    tries = [F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f)).cast("date")) for f, p in FORMATS]
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), text)


def _from_path(url: Column, pattern: str) -> Column:
    y, m, d = (F.regexp_extract(url, pattern, i) for i in (1, 2, 3))
    year, month, day = (F.try_to_number(x, F.lit("9999")).cast("int") for x in (y, m, d))
    ok = (y != "") & year.between(2000, 2035) & month.between(1, 12) & day.between(1, 31)
    return F.when(ok, F.concat_ws("-", y, m, d)).otherwise(F.lit(""))


def date_from_dashed_path(url: Column) -> Column:
    """``/2024-03-01-title`` to its date; empty if there is none."""
    return _from_path(url, r"/(\d{4})-(\d{2})-(\d{2})-")


def date_from_plain_path(url: Column) -> Column:
    """``/20240301-title`` to its date; empty if there is none."""
    return _from_path(url, r"/(\d{4})(\d{2})(\d{2})-")


_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_IN_TEXT = [rf"({_MONTH} \d{{1,2}}, \d{{4}})", rf"(\d{{1,2}} {_MONTH} \d{{4}})", r"(\d{4}-\d{2}-\d{2})", r"(\d{1,2}/\d{1,2}/\d{4})", rf"({_MONTH} \d{{4}})"]


def date_from_text(text: Column, most: int = 3000) -> Column:
    """The first date among the first characters of a text, in the order of the patterns."""
    head = F.substring(text, 1, most)
    found = [F.nullif(F.regexp_extract(head, p, 1), F.lit("")) for p in _IN_TEXT]
    dates = [F.when(parse_date(x).rlike(r"^\d{4}-"), parse_date(x)) for x in found]
    return F.coalesce(*dates, F.lit(""))


def year_of(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit(""))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def next_weekly(after: Column, weekday: str = "Mon", hour: int = 18) -> Column:
    """The next weekly run at ``hour`` o'clock after a time."""
    day = F.date_trunc("day", after)
    today = F.date_add(F.next_day(F.date_sub(day, 1), weekday), 0).cast("timestamp") + F.make_interval(hours=F.lit(hour))
    return F.when(today > after, today).otherwise(F.next_day(day, weekday).cast("timestamp") + F.make_interval(hours=F.lit(hour)))
