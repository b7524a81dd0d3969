"""Scans, row sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import params as p
from shiftledger import schemas
from shiftledger.catalog.base import query
from shiftledger.catalog.warehouse import star, stored_places
from shiftledger.functions import dates
from shiftledger.plans import dimensions, facts
from shiftledger.session import work_dir
from shiftledger.sources import readers, writers
from shiftledger.sources.mapping import Landing

_INPUT = ("location", "purchase_date", "item", "staff_id", "staff_name", "manager", "invoice_no", "total", "actual_hour")


@query("scan_input", f"SELECT {', '.join(_INPUT)} FROM landing", "landing")
def scan_input(t: Landing) -> DataFrame:
    return t.input().select(*_INPUT)


@query("scan_target", "SELECT staff_id, staff_name, appt_date, target_hour FROM target", "target")
def scan_target(t: Landing) -> DataFrame:
    return t.target()


@query("scan_practitioner", "SELECT * FROM practitioner", "practitioner")
def scan_practitioner(t: Landing) -> DataFrame:
    return t.practitioner()


@query(
    "scan_performance",
    "SELECT appt_date, practitioner_id, practitioner_name, appt_type, total_hours, total_income FROM perf",
    "perf",
)
def scan_performance(t: Landing) -> DataFrame:
    return t.performance()


@query("scan_weekly_target", "SELECT * FROM weekly_target", "weekly_target")
def scan_weekly_target(t: Landing) -> DataFrame:
    return t.weekly_target()


@query(
    "scan_holidays",
    "SELECT holiday_date FROM holidays",
    "holidays",
)
def scan_holidays(t: Landing) -> DataFrame:
    return t.holidays()


@query(
    "range_source_dates",
    """
    SELECT practitioner_id, CAST(unnest(generate_series(first_date, last_date, INTERVAL 1 DAY)) AS DATE) AS date
    FROM (SELECT staff_id AS practitioner_id, min(appt_date) AS first_date, max(appt_date) AS last_date
          FROM target GROUP BY staff_id)""",
    "target",
)
def range_source_dates(t: Landing) -> DataFrame:
    """Every day between the first and the last target of each practitioner."""
    spans = (
        t.target()
        .groupBy(F.col("staff_id").alias("practitioner_id"))
        .agg(F.min("appt_date").alias("first_date"), F.max("appt_date").alias("last_date"))
    )
    return spans.select("practitioner_id", F.explode(dates.days_between("first_date", "last_date")).alias("date"))


@query("sink_full_refresh", "SELECT * FROM dim_practitioner", "dim_practitioner")
def sink_full_refresh(t: Landing) -> DataFrame:
    """The practitioner dimension written twice in full; the newest snapshot is read back."""
    path = work_dir(t.spark, "dim_practitioner")
    places = stored_places(t)
    for snapshot, seen in enumerate((t.members(until=p.SPLIT_DATE), t.members()), start=1):
        people = dimensions.first_practitioners(seen, places, p.EMAIL_DOMAIN)
        writers.write_snapshot(people, path, snapshot)
    return writers.read_snapshot(t.spark, path, schemas.DIM_PRACTITIONER)


@query("sink_append", "SELECT * FROM fact_performance", "fact_performance")
def sink_append(t: Landing) -> DataFrame:
    """The performance fact appended in two batches, the second one twice; read back once each."""
    path = work_dir(t.spark, "fact_performance")
    dims = star(t)
    old, new = t.input(items=False, until=p.SPLIT_DATE), t.input(items=False, since=p.SPLIT_DATE)
    for batch, source in ((1, old), (2, new), (2, new)):
        writers.append_facts(facts.fact_performance(source, t.target(), dims.people, dims.places), path, batch)
    return writers.read_facts(t.spark, path, schemas.FACT_PERFORMANCE).select(*schemas.FACT_PERFORMANCE.names)


@query("sink_target_export", "SELECT * FROM target_update", "target_update")
def sink_target_export(t: Landing) -> DataFrame:
    """The target table exported as CSV and read back under its schema."""
    path = work_dir(t.spark, "target_export")
    writers.export_targets(t.target_update(), path)
    return readers.read_target_updates(t.spark, path, format="csv")


@query(
    "dim_date_build",
    """
    SELECT CAST(d AS DATE) AS date, rpad(dayname(d), 9, ' ') AS day_of_week,
           CAST(weekofyear(d) AS INTEGER) AS week_of_year, CAST(month(d) AS INTEGER) AS month,
           CAST(quarter(d) AS INTEGER) AS quarter, CAST(year(d) AS INTEGER) AS year
    FROM (SELECT unnest(generate_series(
              CAST(date_trunc('year', min(purchase_date)) AS DATE),
              CAST(date_trunc('year', max(purchase_date)) AS DATE) + INTERVAL 1 YEAR - INTERVAL 1 DAY,
              INTERVAL 1 DAY)) AS d
          FROM landing)""",
    "landing",
)
def dim_date_build(t: Landing) -> DataFrame:
    """The calendar of all years in the data."""
    return dimensions.dim_date(t.input(items=False, people=False), "purchase_date")
