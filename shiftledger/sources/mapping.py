"""The driver's star-schema tables seen as the landing, planning and dashboard tables.

Line items play the appointments, suppliers the practitioners, nations the locations, regions the
managers and part types the appointment types. Only nation and region are broadcast by hint: their
sizes are fixed at 25 and 5 rows at any scale. Every other join is left to the planner, which
broadcasts a side only while its measured size is below the threshold.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import params
from shiftledger.functions import dates
from shiftledger.sources import buckets, tables


# The types of the driver's tables, so that no file is opened to infer them.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

# Fixed value: the bytes of line item files, about a third of a million rows, whose person-days one task holds.
PIECE_BYTES = 4 * 1024 * 1024
# Fixed value: the bytes of line item files, about a million rows, whose person-days lie in one bucket.
BUCKET_BYTES = 16 * 1024 * 1024


class Landing:
    """Views over the tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._held: int | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.schema(TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _line_bytes(self) -> int:
        if self._held is None:
            self._held = tables.size(self.spark, f"{self.sf_dir}/lineitem.parquet")
        return self._held

    def pieces(self) -> int:
        """The number of partitions for person-days: the session's, or more in proportion to the line items."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(least, math.ceil(self._line_bytes() / PIECE_BYTES))

    def buckets(self) -> int:
        """The number of buckets of stored tables: in proportion to the line items, and enough to keep all cores busy.

        What a task sorts to write or join a bucket is the same at any size of the table. A table by month has a file
        per month and bucket, so there are no more buckets than that takes.
        """
        least = min(buckets.default_buckets(self.spark), self.spark.sparkContext.defaultParallelism)
        return max(least, math.ceil(self._line_bytes() / BUCKET_BYTES))

    def _by_day(self, since: dt.date | DataFrame | None = None, until: dt.date | None = None) -> DataFrame:
        """Line items dealt to partitions by person and day.

        Nearly every line item is a person-day of its own, so sums before the shuffle would fill a task's memory and
        save little. Partitions of a size of their own, rather than those that adaptive execution merges, keep what a
        task groups, sorts and joins the same at any size of the table.
        """
        return self._lines(since, until).repartition(self.pieces(), "staff_id", "purchase_date")

    def _staff(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("staff_id"),
            F.col("s_name").alias("staff_name"),
            F.col("s_acctbal").alias("account_balance"),
            F.col("s_nationkey").alias("_nation"),
        )

    def _located(self, staff: DataFrame) -> DataFrame:
        """Location and manager by nation. This join comes last, so that the planner sees the staff
        table at its file size when it picks how to join it."""
        regions = F.broadcast(self.table("region"))
        places = (
            self.table("nation")
            .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("_nation"),
                F.col("n_name").alias("location"),
                F.col("r_name").alias("manager"),
            )
        )
        return staff.join(F.broadcast(places), "_nation").drop("_nation")

    def _lines(self, since: dt.date | DataFrame | None = None, until: dt.date | None = None) -> DataFrame:
        """Line items under landing names, optionally after ``since`` and up to ``until``.

        The bounds are set on the stored timestamp, so that they reach the Parquet scan. A ``since`` that is a
        one-row table of a mark becomes a scalar subquery with the arithmetic inside, compared with as it is.
        """
        lines = self.table("lineitem")
        shipped = F.col("l_shipdate")
        if isinstance(since, DataFrame):
            lines = lines.where(shipped >= since.select(F.date_add("mark", 1).cast("timestamp_ntz")).scalar())
        elif since is not None:
            lines = lines.where(shipped >= F.date_add(dates.as_col(since), 1).cast("timestamp_ntz"))
        if until is not None:
            lines = lines.where(shipped < F.date_add(dates.as_col(until), 1).cast("timestamp_ntz"))
        return lines.select(
            F.col("l_suppkey").alias("staff_id"),
            F.col("l_partkey").alias("_part"),
            shipped.cast("date").alias("purchase_date"),
            F.col("l_orderkey").alias("invoice_no"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("total"),
            F.col("l_quantity").cast("decimal(5,1)").alias("actual_hour"),
        )

    def input(
        self,
        items: bool = True,
        people: bool = True,
        since: dt.date | DataFrame | None = None,
        until: dt.date | None = None,
    ) -> DataFrame:
        """Appointment and billing rows.

        An inner join is carried out even when none of its columns are used. Each line item has one
        part and one supplier, so a caller that needs no ``items`` or no ``people`` leaves that join out.
        """
        rows = self._lines(since, until)
        if items:
            types = self.table("part").select(F.col("p_partkey").alias("_part"), F.col("p_type").alias("item"))
            rows = rows.join(types, "_part")
        rows = rows.drop("_part")
        return self._located(rows.join(self._staff(), "staff_id")) if people else rows

    def per_day(self, since: dt.date | DataFrame | None = None, until: dt.date | None = None) -> DataFrame:
        """Landing rows summed per staff member and day.

        The location of a row follows from its staff member, so the line items are summed before the
        staff table is joined. The sums stay partitioned by person and day, which is what the facts
        group and join them by.
        """
        days = (
            self._by_day(since, until)
            .groupBy("staff_id", "purchase_date")
            .agg(F.sum("actual_hour").alias("actual_hour"), F.sum("total").alias("total"))
        )
        return self._located(days.join(self._staff(), "staff_id"))

    def members(self, since: dt.date | DataFrame | None = None, until: dt.date | None = None) -> DataFrame:
        """The staff of the landing rows with name, manager, location and newest day.

        Only staff ids are grouped and shuffled; names are joined to the distinct ids.
        """
        seen = self._lines(since, until).groupBy("staff_id").agg(F.max("purchase_date").alias("purchase_date"))
        return self._located(seen.join(self._staff(), "staff_id"))

    def practitioner(self) -> DataFrame:
        return self._located(self._staff()).select(
            F.col("staff_id").alias("practitioner_id"),
            F.col("staff_name").alias("practitioner_name"),
            F.col("location").alias("clinic_location"),
            F.col("manager").alias("manager_name"),
        )

    def _with_target(self) -> DataFrame:
        return self._staff().where(F.col("account_balance") >= params.MIN_BALANCE_WITH_TARGET)

    def target(self, since: dt.date | DataFrame | None = None) -> DataFrame:
        """One row per staff member and worked day other than Sunday, for staff with targets.

        The days are made distinct before the names are joined, so only keys are shuffled.
        """
        days = (
            self._by_day(since)
            .where(dates.weekday_index("purchase_date") < 6)
            .select("staff_id", F.col("purchase_date").alias("appt_date"))
            .distinct()
        )
        hour = (4 + (F.col("staff_id") + F.dayofmonth("appt_date")) % 4).cast("decimal(5,1)")
        return days.join(self._with_target().select("staff_id", "staff_name"), "staff_id").select(
            "staff_id", "staff_name", "appt_date", hour.alias("target_hour")
        )

    def target_update(self) -> DataFrame:
        return self.target().select(
            F.col("staff_id").alias("practitioner_id"),
            F.col("staff_name").alias("practitioner_name"),
            F.col("appt_date").alias("target_date"),
            "target_hour",
            timestamp(params.UPDATED_AT).alias("updated_at"),
        )

    def holidays(self, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
        """The statutory holidays of the years of a range, or of every year in the data."""
        if start and end:
            year = self.spark.range(start.year, end.year + 1).select(F.col("id").cast("int").alias("year"))
        else:
            year = self._lines().select(F.year("purchase_date").alias("year")).distinct()
        days = [F.make_date("year", F.lit(m), F.lit(d)) for m, d in params.HOLIDAY_MONTH_DAYS]
        return year.select(F.explode(F.array(*days)).alias("holiday_date")).where(F.col("holiday_date").isNotNull())

    def performance(self, types: bool = True, names: bool = True) -> DataFrame:
        """Performance sheet rows, with the appointment type and the practitioner name where needed."""
        rows = self.input(items=types, people=names)
        return rows.select(
            F.col("purchase_date").alias("appt_date"),
            F.col("staff_id").alias("practitioner_id"),
            *([F.col("staff_name").alias("practitioner_name")] if names else []),
            *([F.col("item").alias("appt_type")] if types else []),
            F.col("actual_hour").alias("total_hours"),
            F.col("total").alias("total_income"),
        )

    def weekly_target(self) -> DataFrame:
        """Weekly targets per practitioner and appointment type, one row per key."""
        types = self.table("part").select(F.col("p_partkey").alias("_part"), F.col("p_type").alias("appt_type"))
        n = F.count("*")
        return (
            self._lines()
            .join(types, "_part")
            .groupBy(
                F.col("staff_id").alias("practitioner_id"),
                "appt_type",
                dates.iso_week("purchase_date").alias("week"),
            )
            .agg(
                (n * 1000).cast("decimal(12,2)").alias("target_income"),
                (n * 6).cast("decimal(12,1)").alias("target_hour"),
            )
            .join(self._with_target().select(F.col("staff_id").alias("practitioner_id")), "practitioner_id", "left_semi")
        )

    def activity(self) -> DataFrame:
        return activity_of(self.table("events"))

    def activity_stream(self) -> DataFrame:
        """The event table, a file or a folder of files, as a stream.

        All files that are there form one batch. Files are not in the order of time, so with several batches
        the watermark of one would make rows of the next late, and their number would decide the result. The
        source takes folders; a single file is given as a pattern that only it matches.
        """
        path = f"{self.sf_dir}/events.parquet"
        if not tables.is_folder(self.spark, path):
            path = f"{self.sf_dir}/events.parque[t]"
        return activity_of(self.spark.readStream.schema(TABLES["events"]).parquet(path))


def activity_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("practitioner_id"),
        F.col("value").cast("decimal(10,2)").alias("actual_hour"),
    )


def timestamp(value: dt.datetime) -> Column:
    """A zone-less timestamp literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
