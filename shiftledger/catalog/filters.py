"""Projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import params as p
from shiftledger.catalog.base import query
from shiftledger.catalog.views import day, words
from shiftledger.operators import filters
from shiftledger.operators.aggregates import max_loaded_date
from shiftledger.operators.joins import with_practitioner_details
from shiftledger.sources.mapping import Landing

_TARGET = "practitioner_id, practitioner_name, clinic_location, manager_name, target_date, target_hour"


def targets_with_people(t: Landing) -> DataFrame:
    rows = with_practitioner_details(t.target_update(), t.practitioner())
    return rows.select(*_TARGET.split(", "))


@query(
    "filter_not_null",
    """
    SELECT staff_id, purchase_date, nullif(item, 'PROMO') AS item FROM landing
    WHERE nullif(item, 'PROMO') IS NOT NULL AND staff_id IS NOT NULL""",
    "landing",
)
def filter_not_null(t: Landing) -> DataFrame:
    """Rows with an item, where one appointment type stands for a missing item."""
    rows = t.input(people=False).select("staff_id", "purchase_date", F.nullif("item", F.lit("PROMO")).alias("item"))
    return filters.not_null(rows, "item", "staff_id")


@query(
    "filter_date_between",
    f"SELECT * FROM target_update WHERE target_date BETWEEN {day(p.PLAN_START)} AND {day(p.PLAN_END)}",
    "target_update",
)
def filter_date_between(t: Landing) -> DataFrame:
    return filters.between_dates(t.target_update(), "target_date", p.PLAN_START, p.PLAN_END)


@query(
    "filter_equality",
    f"""
    SELECT {_TARGET} FROM target_update JOIN practitioner USING (practitioner_id, practitioner_name)
    WHERE manager_name = '{p.MANAGER}' AND target_date BETWEEN {day(p.PLAN_START)} AND {day(p.PLAN_END)}""",
    "target_update practitioner",
)
def filter_equality(t: Landing) -> DataFrame:
    """Targets of a manager in a range; the location filter is open."""
    rows = filters.between_dates(targets_with_people(t), "target_date", p.PLAN_START, p.PLAN_END)
    return filters.pick_group(rows, location=filters.ALL, manager=p.MANAGER)


@query(
    "filter_equality_location",
    f"""
    SELECT {_TARGET} FROM target_update JOIN practitioner USING (practitioner_id, practitioner_name)
    WHERE clinic_location = '{p.LOCATIONS[0]}'""",
    "target_update practitioner",
)
def filter_equality_location(t: Landing) -> DataFrame:
    """The location wins over the manager."""
    return filters.pick_group(targets_with_people(t), location=p.LOCATIONS[0], manager=p.MANAGER)


@query(
    "filter_cascading_isin",
    f"""
    SELECT * FROM practitioner
    WHERE clinic_location IN ({words(p.LOCATIONS)}) AND manager_name IN ({words(p.MANAGERS)})
      AND practitioner_id IN (SELECT staff_id FROM target)""",
    "practitioner target",
)
def filter_cascading_isin(t: Landing) -> DataFrame:
    """Short location and manager lists, and a long selection of practitioners as a table."""
    with_target = t.target().select("staff_id")
    return filters.cascade(t.practitioner(), p.LOCATIONS, p.MANAGERS, with_target)


@query(
    "filter_row_security",
    f"""
    SELECT appt_date, practitioner_id, practitioner_name, appt_type, total_hours, total_income FROM perf
    WHERE practitioner_id = {p.SECONDARY_USER}""",
    "perf",
)
def filter_row_security(t: Landing) -> DataFrame:
    return filters.row_security(t.performance(), "secondary", p.SECONDARY_USER)


@query(
    "filter_row_security_master",
    "SELECT appt_date, practitioner_id, practitioner_name, appt_type, total_hours, total_income FROM perf",
    "perf",
)
def filter_row_security_master(t: Landing) -> DataFrame:
    return filters.row_security(t.performance(), "master")


_USERS = """
    SELECT practitioner_id AS user_id, CASE practitioner_id % 7 WHEN 0 THEN 'guest' WHEN 1 THEN 'manager' ELSE 'secondary' END AS role,
           practitioner_id, manager_name FROM practitioner
    UNION ALL SELECT practitioner_id, 'manager', NULL, manager_name FROM practitioner WHERE practitioner_id % 50 = 0
    UNION ALL SELECT 0, 'master', NULL, NULL"""


def entitlements(t: Landing) -> DataFrame:
    """Who may see whose rows: practitioners their own, some of them their manager's, guests none, user 0 all."""
    people = t.practitioner().select("practitioner_id", "manager_name").withColumn("user_id", F.col("practitioner_id"))
    kind = F.col("user_id") % 7
    role = F.when(kind == 0, "guest").when(kind == 1, "manager").otherwise("secondary")
    more = people.where(F.col("user_id") % 50 == 0).withColumn("practitioner_id", F.lit(None).cast("bigint"))
    master = t.spark.range(1).select(F.col("id").alias("user_id"), F.lit("master").alias("role"))
    users = people.withColumn("role", role).unionByName(more.withColumn("role", F.lit("manager")))
    return users.unionByName(master, allowMissingColumns=True)


@query(
    "filter_entitlements",
    f"""
    SELECT user_id, count(*) AS visible_rows, CAST(sum(actual_hour) AS DECIMAL(15,1)) AS visible_hours
    FROM (SELECT DISTINCT user_id, rid, actual_hour
          FROM ({_USERS}) u JOIN (SELECT row_number() OVER () AS rid, staff_id, manager, actual_hour FROM landing) l
            ON role = 'master' OR role = 'manager' AND manager_name = manager OR role = 'secondary' AND practitioner_id = staff_id)
    GROUP BY user_id""",
    "landing practitioner",
)
def filter_entitlements(t: Landing) -> DataFrame:
    """What every user may see of the appointments, for all users in one pass."""
    rows = t.input(items=False).select(
        F.col("staff_id").alias("practitioner_id"), F.col("manager").alias("manager_name"), "actual_hour"
    )
    return filters.entitled_totals(rows, entitlements(t), "actual_hour").withColumnRenamed("actual_hour", "visible_hours")


@query(
    "normalise_columns",
    """
    SELECT purchase_date AS appt_date, staff_id AS practitioner_id, invoice_no, actual_hour AS total_hours
    FROM landing""",
    "landing",
)
def normalise_columns(t: Landing) -> DataFrame:
    """Sheet headers with blanks, dots and signs become plain names."""
    sheet = t.input(items=False, people=False).select(
        F.col("purchase_date").alias(" Appt. Date"),
        F.col("staff_id").alias("Practitioner ID "),
        F.col("invoice_no").alias("Invoice #"),
        F.col("actual_hour").alias("Total Hours"),
    )
    return filters.normalise_columns(sheet)


@query(
    "project_rename_alias",
    "SELECT practitioner_id AS staff, target_date AS period, target_hour AS total_target_hours FROM target_update",
    "target_update",
)
def project_rename_alias(t: Landing) -> DataFrame:
    rows = t.target_update().select("practitioner_id", "target_date", "target_hour")
    names = {"practitioner_id": "staff", "target_date": "period", "target_hour": "total_target_hours"}
    return filters.rename(rows, names)


@query(
    "project_constant_default",
    "SELECT practitioner_id, practitioner_name, CAST(NULL AS VARCHAR) AS contract_type, TRUE AS is_current FROM practitioner",
    "practitioner",
)
def project_constant_default(t: Landing) -> DataFrame:
    return filters.with_dimension_defaults(t.practitioner().select("practitioner_id", "practitioner_name"))


_PLAN_ROWS = ", ".join(f"('{name}', CAST({hour} AS DECIMAL(5,1)))" for name, hour in p.WEEKDAY_PLAN.items())


@query(
    "filter_weekday_in_plan",
    f"""
    SELECT staff_id, purchase_date, plan.hour AS target_hour
    FROM landing JOIN (VALUES {_PLAN_ROWS}) plan(weekday, hour) ON dayname(purchase_date) = plan.weekday""",
    "landing",
)
def filter_weekday_in_plan(t: Landing) -> DataFrame:
    rows = t.input(items=False, people=False).select("staff_id", "purchase_date")
    return filters.weekday_in_plan(rows, "purchase_date", p.WEEKDAY_PLAN)


@query(
    "filter_high_watermark",
    "SELECT staff_id, purchase_date, total, actual_hour FROM landing_after",
    "landing_after",
)
def filter_high_watermark(t: Landing) -> DataFrame:
    """Rows newer than the newest row of the first batch."""
    rows = t.input(items=False, people=False, since=loaded_mark(t))
    return rows.select("staff_id", "purchase_date", "total", "actual_hour")


def loaded_mark(t: Landing) -> DataFrame:
    """The mark after the first batch. Each landing row with a staff id gives a fact row on its date, so
    the newest date of the batch is the newest date of its facts. ``max_loaded_date`` takes it from the fact."""
    return max_loaded_date(t.input(items=False, people=False, until=p.SPLIT_DATE), p.DEFAULT_MARK, "purchase_date")


@query(
    "filter_exact_key",
    f"""
    SELECT w.* FROM weekly_target w
    WHERE EXISTS (SELECT 1 FROM perf x
                  WHERE x.practitioner_id = w.practitioner_id AND x.week = w.week AND x.appt_type = w.appt_type
                    AND x.appt_date BETWEEN {day(p.PLAN_START)} AND {day(p.PLAN_END)})""",
    "weekly_target perf",
)
def filter_exact_key(t: Landing) -> DataFrame:
    """Weekly targets whose key occurs among the appointments of the plan range."""
    seen = filters.between_dates(t.performance(names=False), "appt_date", p.PLAN_START, p.PLAN_END)
    keys = seen.select("practitioner_id", F.weekofyear("appt_date").alias("week"), "appt_type")
    return filters.exact_key(t.weekly_target(), keys, ["practitioner_id", "week", "appt_type"])
