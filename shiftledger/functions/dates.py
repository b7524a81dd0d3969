"""Calendar expressions over DATE columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday names in calendar order.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Text date formats of the landing files.
PATTERNS = {
    "long": "MMMM d, yyyy",
    "short": "d-MMM-yy",
    "us": "M/d/yyyy",
    "day_first": "d/M/yy",
    "iso": "yyyy-MM-dd",
}

PERIODS = ("week", "month", "quarter", "year")

ColumnOrDate = Column | str | dt.date


def as_col(value: ColumnOrDate) -> Column:
    """A column name, a column or a Python date as a column."""
    if isinstance(value, Column):
        return value
    return F.lit(value) if isinstance(value, dt.date) else F.col(value)


def day_name(d: ColumnOrDate) -> Column:
    return F.date_format(as_col(d), "EEEE")


def padded_day_name(d: ColumnOrDate) -> Column:
    """Weekday name blank-padded to nine characters, the form of the date dimension."""
    return F.rpad(day_name(d), 9, " ")


def iso_week(d: ColumnOrDate) -> Column:
    return F.weekofyear(as_col(d))


def period_start(kind: str, d: ColumnOrDate) -> Column:
    """First day of the week (Monday), month, quarter or year of ``d``."""
    _check_period(kind)
    return F.trunc(as_col(d), kind)


def period_end(kind: str, d: ColumnOrDate) -> Column:
    """Last day of the period of ``d``."""
    start = period_start(kind, d)
    if kind == "week":
        return F.date_add(start, 6)
    return F.date_sub(F.add_months(start, {"month": 1, "quarter": 3, "year": 12}[kind]), 1)


def week_bounds(d: ColumnOrDate) -> tuple[Column, Column]:
    return period_start("week", d), period_end("week", d)


def previous_period(kind: str, as_of: ColumnOrDate) -> tuple[Column, Column]:
    """First and last day of the full period before the one that holds ``as_of``."""
    last = F.date_sub(period_start(kind, as_of), 1)
    return period_start(kind, last), last


def same_day_before(kind: str, d: ColumnOrDate) -> Column:
    """The same day one month or one year earlier, clamped to the end of a shorter month."""
    return F.add_months(as_col(d), {"month": -1, "year": -12}[kind])


def week_of_month(d: ColumnOrDate) -> Column:
    """Which occurrence of its weekday ``d`` is in its month, from 1."""
    return F.floor((F.dayofmonth(as_col(d)) - 1) / 7).cast("int") + 1


def weekday_index(d: ColumnOrDate) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(as_col(d))


def nth_weekday_in_month(d: ColumnOrDate, weekday: Column, nth: Column) -> Column:
    """The ``nth`` given weekday of the month of ``d``; null when the month has none."""
    first = F.trunc(as_col(d), "month")
    day = F.date_add(first, (F.pmod(weekday - F.weekday(first), F.lit(7)) + (nth - 1) * 7).cast("int"))
    return F.when(F.trunc(day, "month") == first, day)


def days_between(start: ColumnOrDate, end: ColumnOrDate) -> Column:
    """Every day from ``start`` to ``end`` as an array; null when the range is reversed."""
    first, last = as_col(start), as_col(end)
    return F.when(first <= last, F.sequence(first, last, F.expr("interval 1 day")))


def parse_date(text: Column | str, pattern: str) -> Column:
    """Text to date; malformed text raises. Two-digit years run from 1969 to 2068."""
    return _century(F.to_date(text, pattern), pattern)


def try_parse_date(text: Column | str, pattern: str) -> Column:
    """Text to date; malformed text gives null. Two-digit years run from 1969 to 2068.

    The shape of the text is checked first, so the parser, for which a failure is slow, sees few
    malformed values.
    """
    column = F.col(text) if isinstance(text, str) else text
    parsed = F.when(column.rlike(_shape(pattern)), F.try_to_date(column, pattern))
    return _century(parsed, pattern)


# What each part of a date pattern looks like in text.
_SHAPES = {
    "yyyy": r"\d{4}",
    "yy": r"\d{2}",
    "MMMM": "[A-Za-z]+",
    "MMM": "[A-Za-z]{3}",
    "MM": r"\d{2}",
    "M": r"\d{1,2}",
    "dd": r"\d{2}",
    "d": r"\d{1,2}",
}


def _shape(pattern: str) -> str:
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]+", pattern)
    return "^" + "".join(_SHAPES[part] if part.isalpha() else re.escape(part) for part in parts) + "$"


def _century(parsed: Column, pattern: str) -> Column:
    if "yyyy" in pattern or "yy" not in pattern:
        return parsed
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed)


def planned_hour(plan: dict[str, float], d: ColumnOrDate) -> Column:
    """Planned hour of the weekday of ``d``; null when the weekday is not planned."""
    unknown = set(plan) - set(WEEKDAYS)
    if unknown:
        raise ValueError(f"not weekdays: {sorted(unknown)}")
    hours = F.create_map(*[F.lit(part) for pair in plan.items() for part in pair])
    return F.try_element_at(hours, day_name(d)).cast("decimal(5,1)")


def _check_period(kind: str) -> None:
    if kind not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, not {kind!r}")
