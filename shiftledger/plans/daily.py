"""The daily load of the star schema. After the first load it costs the increment.

Facts are kept by month and dimensions as parts that are only added to, all as versions of stored tables
(``sources/tables.py``). A load reads the landing rows dated after the mark, which is the newest day of the performance
fact, less a lookback, plus days that are named as changed. These days are computed whole and take the place of what the
fact holds of them, so a late row changes its day once and a load that runs again gives the same; months without such a
day keep their files. Members are looked for in the same rows only and compared with the dimensions. Day totals, from
which the figures of weeks, months, quarters and years are added up, follow the months of the fact that are new.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import params, schemas
from shiftledger.plans import dimensions, facts
from shiftledger.sources import tables

# The tables of the warehouse folder.
TABLES = {
    "members": schemas.MEMBERS,
    "dim_location": schemas.DIM_LOCATION,
    "dim_item": schemas.DIM_ITEM,
    "dim_practitioner": schemas.DIM_PRACTITIONER,
    "fact_performance": schemas.FACT_PERFORMANCE,
    "fact_appointments": schemas.FACT_APPOINTMENTS,
    "day_totals": schemas.DAY_TOTALS,
}
CURRENT = "current"


def read(spark: SparkSession, warehouse: str, name: str) -> DataFrame:
    """A table of the warehouse at its newest version."""
    return tables.read_table(spark, f"{warehouse}/{name}", TABLES[name])


def loaded_until(spark: SparkSession, warehouse: str, default_mark: dt.date = params.DEFAULT_MARK) -> dt.date:
    """The newest day of the performance fact; only its newest month is read."""
    path = f"{warehouse}/fact_performance"
    found = tables.manifest(spark, path)
    months = [k for k in found.parts if k != tables.UNDATED] if found else []
    if not months:
        return default_mark
    newest = tables.read_manifest(spark, path, schemas.FACT_PERFORMANCE, found, lambda part: part == max(months))
    return newest.agg(F.max("date")).first()[0]


def days_of(rows: DataFrame, col: str = "purchase_date") -> list[dt.date]:
    """The days of some rows, for instance of newly landed ones; the driver gets one value per day."""
    return sorted(r[0] for r in rows.select(col).where(F.col(col).isNotNull()).distinct().collect())


def increment(rows: DataFrame, col: str, since: dt.date, changed: Sequence[dt.date] = ()) -> DataFrame:
    """Rows dated after ``since`` or on one of the changed days, with literal bounds that reach the scan."""
    return rows.where(_in_increment(col, since, changed))


def _in_increment(col: str, since: dt.date, changed: Sequence[dt.date]) -> Column:
    newer = F.col(col) > F.lit(since)
    older = [d for d in changed if d <= since]
    return newer | F.col(col).isin(older) if older else newer


def run_daily(
    spark: SparkSession,
    warehouse: str,
    landing: DataFrame,
    target: DataFrame,
    batch_date: dt.date,
    email_domain: str = params.EMAIL_DOMAIN,
    default_mark: dt.date = params.DEFAULT_MARK,
    lookback_days: int = 0,
    changed_days: Sequence[dt.date] = (),
    pieces: int | None = None,
) -> None:
    """Bring the warehouse folder up to date with the landing rows.

    Locations and items come first, then practitioners, then both facts; the performance fact, which carries the
    mark, is committed last, after the day totals of its new months. A batch notes its lower bound with its members, so a run that was lost, or is repeated,
    takes the same rows again. Once a later batch has been loaded, running an older one changes nothing.

    The performance fact sums the rows in ``pieces`` partitions by person and day, the session's number if none is named,
    and joins targets from there. Nearly every row is a person-day of its own, so sums before the shuffle would fill a
    scan task's memory and save little.

    Late rows may bring unknown members, but only rows after the mark, and those of unknown people, make new versions of
    practitioners.
    """
    batch = batch_date.year * 10_000 + batch_date.month * 100 + batch_date.day
    path = {name: f"{warehouse}/{name}" for name in TABLES}
    if any(version > batch for version in tables.versions(spark, path["dim_practitioner"])):
        return
    own = tables.manifest(spark, path["members"], at=batch)
    if own:
        mark = dt.date.fromisoformat(own.notes["mark"])
        since = dt.date.fromisoformat(own.notes["since"])
        changed_days = sorted({*changed_days, *map(dt.date.fromisoformat, own.notes["changed"].split())})
    else:
        mark = loaded_until(spark, warehouse, default_mark)
        since = mark - dt.timedelta(days=lookback_days)
    notes = {"mark": str(mark), "since": str(since), "changed": " ".join(map(str, changed_days))}
    fresh = increment(landing, "purchase_date", since, changed_days)

    found = dimensions.fill(dimensions.members(fresh), schemas.MEMBERS)
    tables.write_table(found, path["members"], batch, notes=notes)
    seen = tables.read_table(spark, path["members"], schemas.MEMBERS, at=batch)

    def extended(name: str, add) -> DataFrame:
        """The dimension before the batch and, as one more part, the new members."""
        before = tables.manifest(spark, path[name], before=batch) or tables.Manifest(0)
        known = tables.read_manifest(spark, path[name], TABLES[name], before)
        new = tables.write_parts(add(known, seen), path[name])
        parts = {**before.parts, f"batch-{batch}": new[tables.WHOLE]}
        tables.commit(spark, path[name], tables.Manifest(batch, parts))
        return tables.read_table(spark, path[name], TABLES[name], at=batch)

    places = extended("dim_location", dimensions.add_locations)
    items = extended("dim_item", dimensions.add_items)
    people = merge_history(spark, path["dim_practitioner"], seen, mark, places, email_domain, batch_date, batch)

    planned = increment(target, "appt_date", since, changed_days)
    by_day = ("staff_id", "purchase_date")
    dealt = fresh.repartition(pieces, *by_day) if pieces else fresh.repartition(*by_day)
    appointments = facts.fact_appointments(fresh, people, places, items)
    performance = facts.fact_performance(dealt, planned, people, places)
    tables.commit(spark, path["fact_appointments"], restated(spark, path, "fact_appointments", appointments, since, changed_days))
    new = restated(spark, path, "fact_performance", performance, since, changed_days)
    update_totals(spark, path, new)
    tables.commit(spark, path["fact_performance"], new)


def update_totals(spark: SparkSession, path: dict[str, str], fact: tables.Manifest) -> None:
    """Bring the day totals to a version of the performance fact, reading its new months only.

    The totals note which folder of the fact each month was summed from. Months with another folder are summed again,
    so totals that a lost run left behind, or that an older warehouse lacks, are made good by the next load.
    """
    old = tables.manifest(spark, path["day_totals"]) or tables.Manifest(0)
    new = {part for part, folder in fact.parts.items() if old.notes.get(part) != folder}
    gone = {part for part in old.parts if part in new or part not in fact.parts}
    if not new and not gone:
        return
    rows = tables.read_manifest(spark, path["fact_performance"], schemas.FACT_PERFORMANCE, fact, new.__contains__)
    totals = tables.prepare_parts(facts.day_totals(rows), path["day_totals"], tables.month("date"), gone)
    tables.commit(spark, path["day_totals"], tables.Manifest(totals.version, totals.parts, dict(fact.parts)))


def restated(
    spark: SparkSession, path: dict[str, str], name: str, rows: DataFrame, since: dt.date, changed: Sequence[dt.date]
) -> tables.Manifest:
    """``rows``, all facts of the increment's days, in the place of what the fact table holds of these days.

    The version is written, and for the caller to commit.
    """
    months = {f"{d:%Y-%m}" for d in changed}
    first = f"{since + dt.timedelta(days=1):%Y-%m}"

    def touched(part: str) -> bool:
        return part != tables.UNDATED and (part >= first or part in months)

    found = tables.manifest(spark, path[name])
    kept = tables.read_manifest(spark, path[name], TABLES[name], found, touched)
    kept = kept.where(~_in_increment("date", since, changed))
    gone = [part for part in found.parts if touched(part)] if found else []
    return tables.prepare_parts(kept.unionByName(rows), path[name], tables.month("date"), gone)


def merge_history(
    spark: SparkSession,
    path: str,
    seen: DataFrame,
    mark: dt.date,
    places: DataFrame,
    email_domain: str,
    batch_date: dt.date,
    batch: int,
) -> DataFrame:
    """Merge the members into the stored practitioner dimension and give its current versions.

    Current and closed versions are parts of their own. A merge reads and rewrites the current part; versions that it
    closes become one more closed part, and the closed parts of earlier batches keep their files.
    """
    before = tables.manifest(spark, path, before=batch) or tables.Manifest(0)
    current = tables.read_manifest(spark, path, schemas.DIM_PRACTITIONER, before, lambda part: part == CURRENT)
    known = current.select(F.col("practitioner_id").alias("staff_id")).distinct().withColumn("_known", F.lit(True))
    rows = seen.join(known, "staff_id", "left").where((F.col("purchase_date") > F.lit(mark)) | F.col("_known").isNull())
    merged = dimensions.merge_practitioners(current, rows.drop("_known"), places, email_domain, batch_date)
    part = F.when(F.col("is_current"), CURRENT).otherwise(f"closed-{batch}")
    closed = {k: v for k, v in before.parts.items() if k != CURRENT}
    new = tables.write_parts(merged, path, part)
    tables.commit(spark, path, tables.Manifest(batch, {**closed, **new}))
    return tables.read_table(spark, path, schemas.DIM_PRACTITIONER, at=batch, wanted=lambda name: name == CURRENT)
