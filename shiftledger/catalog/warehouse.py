"""Dimensions, joins to them, facts and the incremental loads."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger import params as p
from shiftledger import schemas
from shiftledger.catalog.base import query
from shiftledger.catalog.filters import loaded_mark
from shiftledger.catalog.views import day, words
from shiftledger.operators import aggregates, joins, keys
from shiftledger.plans import dimensions, facts
from shiftledger.session import work_dir
from shiftledger.sources.mapping import Landing
from shiftledger.sources.writers import read_snapshot, write_snapshot

BATCH_DATE = p.SPLIT_DATE + dt.timedelta(days=1)


def stored(t: Landing, df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """A table as a later step of the load finds it: written to the shared folder and read back."""
    path = work_dir(t.spark, name)
    write_snapshot(df, path, 1)
    return read_snapshot(t.spark, path, schema)


@dataclass(frozen=True)
class Star:
    """The dimensions that a fact load joins."""

    places: DataFrame
    people: DataFrame
    items: DataFrame | None = None


def star(t: Landing, items: bool = False) -> Star:
    """Locations, practitioners and, if asked for, items of all rows. The members of the appointments are kept
    as a table from one pass, and all dimensions are built on that small table."""
    found = dimensions.members(t.input()) if items else t.members()
    members = stored(t, dimensions.fill(found, schemas.MEMBERS), schemas.MEMBERS, "members")
    places = dimensions.first_locations(members)
    people = dimensions.first_practitioners(members, places, p.EMAIL_DOMAIN)
    return Star(places, people, dimensions.first_items(members) if items else None)


def old_people(t: Landing, places: DataFrame) -> DataFrame:
    """The practitioner dimension after the first batch."""
    dim = dimensions.first_practitioners(t.members(until=p.SPLIT_DATE), places, p.EMAIL_DOMAIN)
    return stored(t, dim, schemas.DIM_PRACTITIONER, "dim_practitioner")


def stored_places(t: Landing) -> DataFrame:
    return stored(t, dimensions.first_locations(t.members()), schemas.DIM_LOCATION, "dim_location")


def new_members(t: Landing) -> DataFrame:
    """The members of the second batch, in which some staff report to another manager."""
    moved = F.col("account_balance") >= p.MIN_BALANCE_REASSIGNED
    manager = F.when(moved, p.REASSIGNED_MANAGER).otherwise(F.col("manager"))
    return t.members(since=p.SPLIT_DATE).withColumn("manager", manager)


def merged_people(t: Landing) -> DataFrame:
    places = stored_places(t)
    return dimensions.merge_practitioners(
        old_people(t, places), new_members(t), places, p.EMAIL_DOMAIN, BATCH_DATE
    )


def appended_people(t: Landing) -> DataFrame:
    """Old and new versions before the old ones are closed."""
    appended = stored(t, merged_people(t), schemas.DIM_PRACTITIONER, "dim_practitioner")
    return appended.withColumn("is_current", F.lit(True))


@query("dim_location", "SELECT * FROM dim_location", "dim_location")
def dim_location(t: Landing) -> DataFrame:
    return dimensions.first_locations(t.members())


@query("dim_item", "SELECT * FROM dim_item", "dim_item")
def dim_item(t: Landing) -> DataFrame:
    return dimensions.first_items(t.input(people=False))


@query("dim_practitioner", "SELECT * FROM dim_practitioner", "dim_practitioner")
def dim_practitioner(t: Landing) -> DataFrame:
    return dimensions.first_practitioners(t.members(), stored_places(t), p.EMAIL_DOMAIN)


def _incremental_member_sql(kind: str) -> str:
    name = f"{kind}_name"
    first = f"purchase_date <= {day(p.FIRST_LOAD_DATE)} AND location IN ({words(p.LOCATIONS)})"
    return f"""
    SELECT (SELECT count(DISTINCT {kind}) FROM landing WHERE {first})
               + row_number() OVER (ORDER BY md5({name}), {name}) AS {kind}_id, {name}
    FROM (SELECT DISTINCT {kind} AS {name} FROM landing
          WHERE {kind} IS NOT NULL
            AND {kind} NOT IN (SELECT {kind} FROM landing WHERE {first} AND {kind} IS NOT NULL))"""


def first_load(t: Landing, with_items: bool) -> DataFrame:
    """The very first load: one day of the locations that opened first."""
    rows = t.input(items=with_items, until=p.FIRST_LOAD_DATE)
    return rows.where(F.col("location").isin(list(p.LOCATIONS)))


@query("dim_location_incremental", _incremental_member_sql("location"), "landing")
def dim_location_incremental(t: Landing) -> DataFrame:
    """Locations unknown after the first load, with the next keys."""
    known = dimensions.first_locations(first_load(t, with_items=False))
    return dimensions.add_locations(known, t.members()).select("location_id", "location_name")


@query("dim_item_incremental", _incremental_member_sql("item"), "landing")
def dim_item_incremental(t: Landing) -> DataFrame:
    """Items unknown after the first load, with the next keys."""
    known = dimensions.first_items(first_load(t, with_items=True))
    return dimensions.add_items(known, t.input(people=False)).select("item_id", "item_name")


@query("distinct_members", """
    SELECT DISTINCT 'item' AS kind, item AS member FROM landing WHERE item IS NOT NULL
    UNION ALL SELECT DISTINCT 'location', location FROM landing WHERE location IS NOT NULL""", "landing")
def distinct_members(t: Landing) -> DataFrame:
    found = [
        aggregates.distinct_members(t.input(items=kind == "item", people=kind == "location"), kind).select(
            F.lit(kind).alias("kind"), F.col(kind).alias("member")
        )
        for kind in ("item", "location")
    ]
    return found[0].unionByName(found[1])


@query("distinct_practitioners", """
    SELECT practitioner_id, practitioner_name, email, contract_type, manager_name, location_id, location_name,
           is_current
    FROM dim_practitioner""", "dim_practitioner")
def distinct_practitioners(t: Landing) -> DataFrame:
    return dimensions.distinct_practitioners(t.members(), stored_places(t), p.EMAIL_DOMAIN)


@query("surrogate_keys", """
    SELECT 100 + row_number() OVER (ORDER BY md5(concat_ws('|', CAST(staff_id AS VARCHAR), item)), staff_id, item)
               AS pair_key, staff_id, item
    FROM (SELECT DISTINCT staff_id, item FROM landing)""", "landing")
def surrogate_keys(t: Landing) -> DataFrame:
    """Dense keys after 100 for each pair of staff member and item."""
    pairs = t.input(people=False).select("staff_id", "item").distinct()
    return keys.surrogate_keys(pairs, ["staff_id", "item"], "pair_key", after=100)


_ROW = "invoice_no, purchase_date, staff_id, total"


@query("join_dim_location", f"""
    SELECT {_ROW}, location_id FROM landing JOIN dim_location ON location = location_name""",
    "landing dim_location")
def join_dim_location(t: Landing) -> DataFrame:
    return joins.with_location(t.input(items=False), stored_places(t)).select(*_ROW.split(", "), "location_id")


@query("join_dim_practitioner_current", f"""
    SELECT {_ROW}, practitioner_dim_id
    FROM landing JOIN dim_practitioner_new ON staff_id = practitioner_id AND is_current""",
    "landing dim_practitioner_new")
def join_dim_practitioner_current(t: Landing) -> DataFrame:
    people = stored(t, merged_people(t), schemas.DIM_PRACTITIONER, "dim_practitioner")
    joined = joins.with_practitioner(t.input(items=False, people=False), people)
    return joined.select(*_ROW.split(", "), "practitioner_dim_id")


@query("join_dim_item", f"SELECT {_ROW}, item_id FROM landing JOIN dim_item ON item = item_name",
       "landing dim_item")
def join_dim_item(t: Landing) -> DataFrame:
    items = stored(t, dimensions.first_items(t.input(people=False)), schemas.DIM_ITEM, "dim_item")
    return joins.with_item(t.input(people=False), items).select(*_ROW.split(", "), "item_id")


@query("left_join_target_daily", """
    SELECT d.staff_id, d.purchase_date, location, total_actual_hour, total_billing, target_hour
    FROM daily d LEFT JOIN target t ON d.staff_id = t.staff_id AND d.purchase_date = t.appt_date""",
    "daily target")
def left_join_target_daily(t: Landing) -> DataFrame:
    return joins.with_daily_target(aggregates.daily_actuals(t.input(items=False)), t.target())


@query("anti_new_dim_member", f"""
    SELECT DISTINCT location FROM landing
    WHERE location NOT IN (SELECT location FROM landing
                           WHERE purchase_date <= {day(p.FIRST_LOAD_DATE)} AND location IN ({words(p.LOCATIONS)}))""",
    "landing")
def anti_new_dim_member(t: Landing) -> DataFrame:
    known = dimensions.first_locations(first_load(t, with_items=False))
    seen = aggregates.distinct_members(t.members(), "location")
    return joins.new_members(seen, known, "location", "location_name")


@query("anti_scd_unchanged", """
    SELECT practitioner_id, practitioner_name, manager_name, location_name FROM newcomers""", "newcomers")
def anti_scd_unchanged(t: Landing) -> DataFrame:
    changed = joins.changed_practitioners(dimensions.latest_people(new_members(t)), old_people(t, stored_places(t)))
    return changed.select("practitioner_id", "practitioner_name", "manager_name", "location_name")


_VERSION = "practitioner_dim_id, practitioner_id, manager_name"


@query("semi_newer_version", f"""
    SELECT {_VERSION} FROM dim_appended WHERE is_current
    QUALIFY rank() OVER (PARTITION BY practitioner_id ORDER BY practitioner_dim_id DESC) > 1""",
    "dim_appended")
def semi_newer_version(t: Landing) -> DataFrame:
    return joins.superseded(appended_people(t)).select(*_VERSION.split(", "))


@query("scd_latest_version", f"""
    SELECT {_VERSION} FROM dim_appended WHERE is_current
    QUALIFY row_number() OVER (PARTITION BY practitioner_id ORDER BY practitioner_dim_id DESC) = 1""",
    "dim_appended")
def scd_latest_version(t: Landing) -> DataFrame:
    return dimensions.latest_versions(appended_people(t)).select(*_VERSION.split(", "))


@query("scd2_merge_practitioner", "SELECT * FROM dim_practitioner_new", "dim_practitioner_new")
def scd2_merge_practitioner(t: Landing) -> DataFrame:
    return merged_people(t)


@query("agg_daily_actuals", "SELECT * FROM daily", "daily")
def agg_daily_actuals(t: Landing) -> DataFrame:
    return aggregates.daily_actuals(t.input(items=False))


@query("fact_performance", "SELECT * FROM fact_performance", "fact_performance")
def fact_performance(t: Landing) -> DataFrame:
    dims = star(t)
    return facts.fact_performance(t.per_day(), t.target(), dims.people, dims.places)


@query("fact_performance_dedup", """
    SELECT l.purchase_date AS date, l.staff_id AS practitioner_id,
           CAST(coalesce(max(target_hour), 0) AS DECIMAL(18,1)) AS target_hour,
           CAST(coalesce(sum(actual_hour), 0) AS DECIMAL(18,1)) AS actual_hour,
           CAST(coalesce(sum(total), 0) AS DECIMAL(22,1)) AS total_billing
    FROM landing l
    LEFT JOIN target t ON l.staff_id = t.staff_id AND l.purchase_date = t.appt_date
    GROUP BY l.purchase_date, l.staff_id""", "landing target")
def fact_performance_dedup(t: Landing) -> DataFrame:
    return facts.fact_performance_dedup(t.input(items=False, people=False), t.target())


@query("fact_appointments", "SELECT * FROM fact_appointments", "fact_appointments")
def fact_appointments(t: Landing) -> DataFrame:
    dims = star(t, items=True)
    return facts.fact_appointments(t.input(), dims.people, dims.places, dims.items)


@query("max_loaded_date", "SELECT mark FROM mark", "mark")
def max_loaded_date(t: Landing) -> DataFrame:
    """The newest date in the fact of the first batch."""
    dims = star(t)
    loaded = facts.fact_performance(t.per_day(until=p.SPLIT_DATE), t.target(), dims.people, dims.places)
    return aggregates.max_loaded_date(loaded, p.DEFAULT_MARK)


@query("incremental_fact_performance", "SELECT * FROM fact_performance_added", "fact_performance_added")
def incremental_fact_performance(t: Landing) -> DataFrame:
    dims = star(t)
    newer = t.per_day(since=loaded_mark(t))
    return facts.fact_performance(newer, t.target(since=loaded_mark(t)), dims.people, dims.places)


@query("incremental_fact_appointments", "SELECT * FROM fact_appointments_added", "fact_appointments_added")
def incremental_fact_appointments(t: Landing) -> DataFrame:
    dims = star(t, items=True)
    newer = t.input(since=loaded_mark(t))
    return facts.fact_appointments(newer, dims.people, dims.places, dims.items)
