"""Surrogate keys and the dimensions, with practitioner history."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shiftledger import schemas
from shiftledger.operators.joins import superseded
from shiftledger.operators.keys import surrogate_keys
from shiftledger.plans import dimensions

D = dt.date
LANDING = "staff_id bigint, staff_name string, manager string, location string, item string, purchase_date date"


@pytest.fixture(scope="module")
def landing(spark):
    def build(*people):
        return spark.createDataFrame(
            [(i, f"Staff {i}", manager, location, "visit", day) for i, manager, location, day in people], LANDING
        )

    return build


@pytest.fixture(scope="module")
def places(spark):
    return spark.createDataFrame([(1, "North", None), (2, "South", None)], schemas.DIM_LOCATION)


def empty(spark):
    return spark.createDataFrame([], schemas.DIM_PRACTITIONER)


def merge(dim, batch, places, day):
    merged = dimensions.merge_practitioners(dim, batch, places, "clinic.example", day)
    return merged.sparkSession.createDataFrame(merged.collect(), schemas.DIM_PRACTITIONER)


def test_keys_are_dense_and_independent_of_partitions(spark):
    names = spark.range(5000).select(F.concat(F.lit("name "), F.col("id")).alias("name"))
    first = surrogate_keys(names.repartition(7), ["name"], "key", after=10).collect()
    again = surrogate_keys(names.repartition(3, "name"), ["name"], "key", after=10).collect()
    assert sorted(r.key for r in first) == list(range(11, 5011))
    assert {(r.key, r.name) for r in first} == {(r.key, r.name) for r in again}


def test_keys_of_null_parts_differ(spark):
    pairs = spark.createDataFrame([("a", None), (None, "a"), ("a", "a")], "x string, y string")
    assert sorted(r.key for r in surrogate_keys(pairs, ["x", "y"], "key").collect()) == [1, 2, 3]


def test_first_load_keeps_every_manager_and_location(landing, places, rows):
    seen = landing((1, "Kim", "North", D(2024, 1, 1)), (1, "Lou", "South", D(2024, 1, 2)), (2, None, "North", D(2024, 1, 1)))
    dim = dimensions.first_practitioners(seen, places, "clinic.example")
    assert dim.schema.simpleString() == schemas.DIM_PRACTITIONER.simpleString()
    assert rows(dim, "practitioner_id", "manager_name", "location_id", "email", "is_current") == [
        (1, "Kim", 1, "staff.1@clinic.example", True),
        (1, "Lou", 2, "staff.1@clinic.example", True),
        (2, None, 1, "staff.2@clinic.example", True),
    ]


def test_rows_of_unknown_places_or_without_id_are_dropped(landing, places):
    seen = landing((1, "Kim", "West", D(2024, 1, 1)), (None, "Kim", "North", D(2024, 1, 1)))
    assert dimensions.first_practitioners(seen, places, "x").count() == 0


def test_members_serve_every_dimension(landing, rows):
    seen = landing(*[(1, "Kim", "North", D(2024, 1, d)) for d in range(1, 20)], (2, "Kim", "South", D(2024, 1, 1)))
    found = dimensions.members(seen)
    assert found.count() == 2
    for build in (dimensions.first_locations, dimensions.first_items):
        assert rows(build(found)) == rows(build(seen))
    assert rows(dimensions.latest_people(found)) == rows(dimensions.latest_people(seen))


def test_manager_change_closes_the_old_version(spark, landing, places, rows):
    dim = merge(empty(spark), landing((1, "Kim", "North", D(2024, 1, 1)), (2, "Kim", "North", D(2024, 1, 1))), places, D(2024, 1, 1))
    dim = merge(dim, landing((1, "Lou", "North", D(2024, 2, 5)), (3, "Kim", "South", D(2024, 2, 5))), places, D(2024, 2, 5))
    found = rows(dim, "practitioner_id", "manager_name", "effective_start_date", "effective_end_date", "is_current")
    assert found == [
        (1, "Kim", D(2024, 1, 1), D(2024, 2, 4), False),
        (1, "Lou", D(2024, 2, 5), None, True),
        (2, "Kim", D(2024, 1, 1), None, True),
        (3, "Kim", D(2024, 2, 5), None, True),
    ]
    assert sorted(r.practitioner_dim_id for r in dim.collect()) == [1, 2, 3, 4]
    assert superseded(dim).count() == 0


def test_merge_is_idempotent_with_old_rows_in_the_batch(spark, landing, places, rows):
    batch = landing((1, "Kim", "North", D(2024, 1, 1)), (1, "Lou", "North", D(2024, 2, 1)))
    once = merge(empty(spark), batch, places, D(2024, 2, 1))
    assert rows(once, "practitioner_id", "manager_name", "is_current") == [(1, "Lou", True)]
    assert rows(merge(once, batch, places, D(2024, 2, 2))) == rows(once)


def test_location_change_alone_makes_no_version(spark, landing, places):
    dim = merge(empty(spark), landing((1, "Kim", "North", D(2024, 1, 1))), places, D(2024, 1, 1))
    assert merge(dim, landing((1, "Kim", "South", D(2024, 2, 1))), places, D(2024, 2, 1)).count() == 1


def test_missing_manager_is_always_new(spark, landing, places, rows):
    batch = landing((1, None, "North", D(2024, 1, 1)))
    dim = merge(empty(spark), batch, places, D(2024, 1, 1))
    dim = merge(dim, batch, places, D(2024, 1, 2))
    assert rows(dim, "practitioner_id", "is_current") == [(1, False), (1, True)]


def test_merge_leaves_one_current_version_each(spark, landing, places):
    first = landing(*[(i, m, "North", D(2024, 1, 1)) for i in range(20) for m in ("Kim", "Lou")])
    dim = dimensions.first_practitioners(first, places, "x")
    dim = spark.createDataFrame(dim.collect(), schemas.DIM_PRACTITIONER)
    change = landing(*[(i, "New", "South", D(2024, 3, 1)) for i in range(0, 20, 3)])
    current = merge(dim, change, places, D(2024, 3, 1)).where("is_current")
    assert current.groupBy("practitioner_id").count().where("count <> 1").count() == 0
    assert current.count() == 20


def test_new_members_get_the_next_keys(spark, places, rows):
    seen = spark.createDataFrame([("North",), ("East",), (None,), ("East",)], "location string")
    assert rows(dimensions.add_locations(places, seen)) == [(3, "East", None)]


def test_calendar(spark):
    days = spark.createDataFrame([(D(2020, 5, 1),), (D(2021, 1, 3),)], "day date")
    found = {r.date: r for r in dimensions.dim_date(days, "day").collect()}
    assert len(found) == 366 + 365
    assert tuple(found[D(2021, 1, 3)]) == (D(2021, 1, 3), "Sunday   ", 53, 1, 1, 2021)
    ten_years = dimensions.dim_date_between(spark.range(1), D(2020, 1, 1), D(2030, 12, 31))
    assert ten_years.count() == 4018
