"""Posting dates and months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vakanta import settings as S
from vakanta.functions.text import strip

_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?"
YEAR_FIRST = rf"^\s*(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}\s*$"
YEAR_LAST = rf"^\s*(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}\s*$"
DAY_NAME = rf"(?i)^\s*(?:\p{{L}}+\.?,\s*)?(\d{{1,2}})(?:st|nd|rd|th|\.)?[\s-]*(?:of\s+)?(\p{{L}}{{3,}})\.?,?[\s-]*(\d{{4}}){_TIME}\s*$"
NAME_DAY = rf"(?i)^\s*(?:\p{{L}}+\.?,\s*)?(\p{{L}}{{3,}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th|\.)?,?\s+(\d{{4}}){_TIME}\s*$"
COMPACT = rf"^\s*(\d{{4}})(\d{{2}})(\d{{2}}){_TIME}\s*$"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named(raw: Column) -> Column:
    """Year-month-day where the month is written as an English or German name."""
    months = F.create_map(*[F.lit(x) for number, names in S.MONTHS.items() for name in names for x in (name, str(number))])
    plain = F.regexp_replace(F.regexp_replace(F.lower(raw), DAY_NAME, "$3-$2-$1"), NAME_DAY, "$3-$1-$2")

    def with_number(parts: Column) -> Column:
        return F.concat_ws("-", F.get(parts, F.lit(0)), F.try_element_at(months, F.get(parts, F.lit(1))), F.get(parts, F.lit(2)))

    return _bound(F.split(plain, "-"), with_number)


def is_unread(raw: Column) -> Column:
    """A date is written, but ``posting_date`` cannot read it."""
    return raw.isNotNull() & (strip(raw) != "") & posting_date(raw).isNull()


def posting_date(raw: Column) -> Column:
    """Calendar date as written, in numbers or with an English or German month name; anything else gives null.

    A time of day or an offset never moves it. In numbers the month comes before the day; a first number that cannot be
    a month is the day.
    """
    plain = F.regexp_replace(raw, YEAR_FIRST, "$1-$2-$3")
    plain = F.regexp_replace(plain, YEAR_LAST, "$3-$1-$2")
    plain = F.regexp_replace(plain, COMPACT, "$1-$2-$3")
    plain = F.when(raw.rlike(r"\p{L}{3}"), _named(raw)).otherwise(plain)
    return _bound(plain, lambda p: F.coalesce(F.try_to_date(p, "yyyy-M-d"), F.try_to_date(p, "yyyy-d-M")))


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c).cast("date")
