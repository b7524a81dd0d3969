"""Fact builds on a hand-made clinic."""

import datetime as dt
from decimal import Decimal

import pytest

from shiftledger import schemas
from shiftledger.operators.aggregates import max_loaded_date
from shiftledger.plans import dimensions, facts

D = dt.date
H = Decimal
LANDING = (
    "staff_id bigint, staff_name string, manager string, location string, item string, purchase_date date, "
    "total decimal(12,2), actual_hour decimal(5,1)"
)


@pytest.fixture(scope="module")
def landing(spark):
    rows = [
        (1, "Ann Lee", "Kim", "North", "massage", D(2024, 7, 29), H("100.25"), H("2.0")),
        (1, "Ann Lee", "Kim", "North", "massage", D(2024, 7, 29), H("50.00"), H("1.5")),
        (1, "Ann Lee", "Kim", "South", "yoga", D(2024, 7, 29), None, H("1.0")),
        (2, "Bo Day", "Lou", "South", None, D(2024, 7, 29), H("10.00"), H("4.0")),
        (2, "Bo Day", "Lou", "South", "yoga", D(2024, 7, 30), H("20.00"), None),
        (None, "Nobody", "Lou", "South", "yoga", D(2024, 7, 30), H("99.00"), H("9.0")),
    ]
    return spark.createDataFrame(rows, LANDING)


@pytest.fixture(scope="module")
def target(spark):
    rows = [
        (1, "Ann Lee", D(2024, 7, 29), H("6.0")),
        (2, "Bo Day", D(2024, 7, 30), H("5.0")),
        (2, "Bo Day", D(2024, 7, 30), H("2.0")),
    ]
    return spark.createDataFrame(rows, schemas.TARGET)


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(1, "North", None), (2, "South", None)], schemas.DIM_LOCATION)


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (10, 1, "Ann Lee", "a", None, "Kim", 1, "North", None, None, True),
        (11, 1, "Ann Lee", "a", None, "Old", 1, "North", None, None, False),
        (20, 2, "Bo Day", "b", None, "Lou", 2, "South", None, None, True),
    ]
    return spark.createDataFrame(rows, schemas.DIM_PRACTITIONER)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, "massage", None, None), (8, "yoga", None, None)], schemas.DIM_ITEM)


def test_fact_performance(landing, target, people, places, rows):
    fact = facts.fact_performance(landing, target, people, places)
    assert fact.schema.simpleString() == schemas.FACT_PERFORMANCE.simpleString()
    assert rows(fact) == [
        # The target of a day counts at each location of the day.
        (D(2024, 7, 29), 10, 1, H("6.0"), H("3.5"), H("150.3")),
        (D(2024, 7, 29), 10, 2, H("6.0"), H("1.0"), H("0.0")),
        (D(2024, 7, 29), 20, 2, H("0.0"), H("4.0"), H("10.0")),
        # Two target rows of a day add up and repeat the actuals.
        (D(2024, 7, 30), 20, 2, H("7.0"), H("0.0"), H("40.0")),
    ]


def test_fact_performance_dedup(landing, target, rows):
    fact = facts.fact_performance_dedup(landing.where("staff_id is not null"), target)
    assert rows(fact) == [
        (D(2024, 7, 29), 1, H("6.0"), H("4.5"), H("150.3")),
        (D(2024, 7, 29), 2, H("0.0"), H("4.0"), H("10.0")),
        (D(2024, 7, 30), 2, H("5.0"), H("0.0"), H("20.0")),
    ]


def test_several_current_versions_repeat_the_fact(spark, landing, target, people, places):
    second = people.where("practitioner_dim_id = 11").selectExpr(
        *[c if c != "is_current" else "true as is_current" for c in people.columns]
    )
    fact = facts.fact_performance(landing, target, people.where("is_current").union(second), places)
    assert fact.where("practitioner_dim_id in (10, 11)").count() == 4


def test_fact_appointments(landing, people, places, items, rows):
    fact = facts.fact_appointments(landing, people, places, items)
    assert fact.schema.simpleString() == schemas.FACT_APPOINTMENTS.simpleString()
    assert rows(fact) == [
        (D(2024, 7, 29), 10, 1, 7, 2, H("3.5"), H("150.3")),
        (D(2024, 7, 29), 10, 2, 8, 1, H("1.0"), H("0.0")),
        (D(2024, 7, 30), 20, 2, 8, 1, H("0.0"), H("20.0")),
    ]


def test_appointments_without_items_give_no_fact(landing, people, places, items):
    bare = landing.where("item is null")
    assert facts.fact_appointments(bare, people, places, items).count() == 0


def test_batches_by_date_add_up_to_the_full_load(landing, target, people, places, items, rows):
    old = landing.where("purchase_date <= date'2024-07-29'")
    loaded = facts.fact_performance(old, target, people, places)
    mark = max_loaded_date(loaded, D(2020, 1, 1))
    assert mark.first()[0] == D(2024, 7, 29)
    more = facts.new_fact_performance(landing, target, people, places, mark)
    assert rows(loaded.union(more)) == rows(facts.fact_performance(landing, target, people, places))
    appointments = facts.fact_appointments(old, people, places, items).union(
        facts.new_fact_appointments(landing, people, places, items, mark)
    )
    assert rows(appointments) == rows(facts.fact_appointments(landing, people, places, items))


def test_mark_is_exclusive_and_can_look_back(landing, target, people, places):
    mark = max_loaded_date(facts.fact_performance(landing, target, people, places), D(2020, 1, 1))
    assert facts.new_fact_performance(landing, target, people, places, mark).count() == 0
    assert facts.new_fact_performance(landing, target, people, places, mark, lookback_days=1).count() == 1


def test_empty_fact_gives_the_default_mark(spark):
    none = spark.createDataFrame([], schemas.FACT_PERFORMANCE)
    assert max_loaded_date(none, D(2020, 1, 1)).first()[0] == D(2020, 1, 1)


def test_hot_key_does_not_change_the_sum(spark, target, places, people):
    """One person holds nearly all rows; the totals stay exact beyond the width of the landing types."""
    many = spark.range(50_000).selectExpr(
        "1L as staff_id", "'Ann Lee' as staff_name", "'Kim' as manager", "'North' as location", "'yoga' as item",
        "date'2024-07-29' as purchase_date", "cast(9999.99 as decimal(12,2)) as total",
        "cast(9.5 as decimal(5,1)) as actual_hour",
    )
    fact = facts.fact_performance(many, target, people, places).first()
    assert (fact.actual_hour, fact.total_billing) == (H("475000.0"), H("499999500.0"))


def test_dimensions_feed_the_fact(landing, target, rows):
    seen = dimensions.members(landing)
    places = dimensions.first_locations(seen)
    people = dimensions.first_practitioners(seen, places, "x")
    fact = facts.fact_performance(landing, target, people, places)
    # Staff member 1 has one version per location, and each version meets both locations.
    assert fact.where("date = date'2024-07-29'").count() == 5
