"""Date and value expressions against the Python calendar."""

import calendar
import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shiftledger.functions import dates, values

D = dt.date


@pytest.fixture(scope="module")
def days(spark):
    span = F.sequence(F.lit(D(1996, 1, 1)), F.lit(D(2021, 12, 31)))
    return spark.range(1).select(F.explode(span).alias("d"))


def test_week_numbers_and_names(days):
    found = days.select(
        "d", dates.iso_week("d"), dates.day_name("d"), dates.padded_day_name("d"), dates.weekday_index("d")
    ).collect()
    for d, week, name, padded, index in found:
        assert (week, name, index) == (d.isocalendar()[1], calendar.day_name[d.weekday()], d.weekday())
        assert padded == name.ljust(9)
    assert len(found) == (D(2021, 12, 31) - D(1996, 1, 1)).days + 1


def test_periods(days):
    for kind in dates.PERIODS:
        start, end = dates.previous_period(kind, "d")
        found = days.select(
            "d", dates.period_start(kind, "d"), dates.period_end(kind, "d"), start, end
        ).collect()
        for d, first, last, before_first, before_last in found:
            assert first <= d <= last
            assert before_last == first - dt.timedelta(1)
            assert before_first <= before_last
            length = {"week": {7}, "month": {28, 29, 30, 31}, "quarter": {90, 91, 92}, "year": {365, 366}}[kind]
            assert (last - first).days + 1 in length
            assert (before_last - before_first).days + 1 in length


def test_unknown_period_is_refused():
    with pytest.raises(ValueError):
        dates.period_start("decade", "d")


def test_nth_weekday(days):
    found = days.select(
        "d",
        dates.week_of_month("d").alias("n"),
        dates.nth_weekday_in_month("d", dates.weekday_index("d"), dates.week_of_month("d")),
        dates.nth_weekday_in_month("d", F.lit(0), F.lit(5)),
    ).collect()
    for d, n, same, fifth_monday in found:
        assert n == (d.day - 1) // 7 + 1
        assert same == d
        mondays = [w[0] for w in calendar.monthcalendar(d.year, d.month) if w[0]]
        assert fifth_monday == (D(d.year, d.month, mondays[4]) if len(mondays) == 5 else None)


def test_same_day_before_is_clamped(spark):
    row = spark.range(1).select(
        dates.same_day_before("month", D(2024, 3, 31)), dates.same_day_before("year", D(2024, 2, 29))
    )
    assert tuple(row.first()) == (D(2024, 2, 29), D(2023, 2, 28))


def test_reversed_range_has_no_days(spark):
    one = spark.range(1)
    assert one.select(F.explode(dates.days_between(D(2024, 1, 3), D(2024, 1, 1)))).count() == 0
    assert one.select(F.explode(dates.days_between(D(2024, 1, 1), D(2024, 1, 1)))).count() == 1


@pytest.mark.parametrize(
    ("text", "pattern", "day"),
    [
        ("July 29, 2024", "long", D(2024, 7, 29)),
        ("29-Jul-24", "short", D(2024, 7, 29)),
        ("5-Mar-99", "short", D(1999, 3, 5)),
        ("8/1/2024", "us", D(2024, 8, 1)),
        ("01/08/24", "day_first", D(2024, 8, 1)),
        ("31/12/68", "day_first", D(2068, 12, 31)),
        ("01/01/69", "day_first", D(1969, 1, 1)),
        ("2024-08-01", "iso", D(2024, 8, 1)),
    ],
)
def test_parse_date(spark, text, pattern, day):
    found = spark.range(1).select(dates.parse_date(F.lit(text), dates.PATTERNS[pattern])).first()[0]
    assert found == day


def test_malformed_text(spark):
    frame = spark.createDataFrame([("soon",), ("12x",)], "s string")
    assert {r[0] for r in frame.select(dates.try_parse_date("s", "yyyy-MM-dd")).collect()} == {None}
    assert {r[0] for r in frame.select(values.try_to_id("s")).collect()} == {None}
    with pytest.raises(PySparkException):
        frame.select(values.to_id("s")).collect()
    with pytest.raises(PySparkException):
        frame.select(dates.parse_date("s", "yyyy-MM-dd")).collect()


def test_planned_hour(spark):
    plan = {"Monday": 6.0, "Friday": 4.5}
    week = spark.range(1).select(F.explode(dates.days_between(D(2024, 7, 29), D(2024, 8, 4))).alias("d"))
    found = [r[0] for r in week.orderBy("d").select(dates.planned_hour(plan, "d")).collect()]
    assert found == [Decimal("6.0"), None, None, None, Decimal("4.5"), None, None]
    with pytest.raises(ValueError):
        dates.planned_hour({"Someday": 1.0}, "d")


def test_ratio_and_email(spark):
    frame = spark.createDataFrame([(6.0, 4.0), (6.0, 0.0), (6.0, None)], "a double, b double")
    assert [r[0] for r in frame.select(values.ratio("a", "b")).collect()] == [1.5, None, None]
    name = spark.range(1).select(values.email(F.lit("Ann Mary Lee"), "clinic.example")).first()[0]
    assert name == "ann.mary.lee@clinic.example"


@given(st.text(alphabet="aB9 .#-_", min_size=1))
@settings(max_examples=200, deadline=None)
def test_clean_name_is_stable(name):
    clean = values.clean_name(name)
    assert values.clean_name(clean) == clean
    assert not set(clean) & set(" .#-B")


def test_clean_name_of_sheet_headers():
    assert values.clean_name(" Appt. Date") == "appt_date"
    assert values.clean_name("Invoice #") == "invoice_no"
    assert values.clean_name("Staff ID") == "staff_id"
