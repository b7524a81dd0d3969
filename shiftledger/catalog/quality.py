"""Data-quality checks over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftledger import params as p
from shiftledger import schemas
from shiftledger.catalog.base import query
from shiftledger.catalog.views import day
from shiftledger.catalog.warehouse import appended_people
from shiftledger.functions import dates
from shiftledger.operators import quality
from shiftledger.sources.mapping import Landing

_HOUR = "CAST(4 + (staff_id + day(purchase_date)) % 4 AS DECIMAL(5,1))"

_COLLAPSED = f"""
    SELECT staff_id AS practitioner_id, purchase_date AS target_date,
           CAST(sum({_HOUR}) AS DECIMAL(15,1)) AS target_hour
    FROM landing GROUP BY ALL"""


def raw_targets(t: Landing) -> DataFrame:
    """A target line per appointment, so a person's day may have several."""
    hour = (4 + (F.col("staff_id") + F.dayofmonth("purchase_date")) % 4).cast("decimal(5,1)")
    return t.input(items=False, people=False).select(
        F.col("staff_id").alias("practitioner_id"),
        F.col("purchase_date").alias("target_date"),
        hour.alias("target_hour"),
    )


@query("dq_collapse_daily_targets", _COLLAPSED, "landing")
def dq_collapse_daily_targets(t: Landing) -> DataFrame:
    return quality.collapse_daily_targets(raw_targets(t))


@query(
    "dq_target_hour_range",
    f"SELECT * FROM ({_COLLAPSED}) WHERE target_hour NOT BETWEEN {p.HOUR_LOW} AND {p.HOUR_HIGH}",
    "landing",
)
def dq_target_hour_range(t: Landing) -> DataFrame:
    """Daily targets outside four to seven hours."""
    return quality.hour_out_of_range(quality.collapse_daily_targets(raw_targets(t)), p.HOUR_LOW, p.HOUR_HIGH)


@query(
    "dq_date_range",
    f"""
    SELECT *, CASE WHEN start_date > end_date THEN 'end_before_start' ELSE 'start_before_as_of' END AS reason
    FROM (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS start_date, end_date
          FROM orders JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS end_date
                            FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey)
    WHERE start_date > end_date OR start_date < {day(p.AS_OF)}""",
)
def dq_date_range(t: Landing) -> DataFrame:
    """Planning requests from the order date to the last ship date."""
    last = t.table("lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(
        F.max("l_shipdate").cast("date").alias("end_date")
    )
    requests = (
        t.table("orders")
        .select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").cast("date").alias("start_date"))
        .join(last, "request_id")
    )
    return quality.bad_date_ranges(requests, p.AS_OF)


def _repeated_versions(key: str) -> str:
    return f"SELECT {key}, count(*) AS row_count FROM dim_appended WHERE is_current GROUP BY {key} HAVING count(*) > 1"


@query("dq_unique_email", _repeated_versions("email"), "dim_appended")
def dq_unique_email(t: Landing) -> DataFrame:
    """E-mail addresses of several current practitioner rows, before superseded versions are closed."""
    return quality.duplicate_keys(appended_people(t).where("is_current"), ["email"])


@query("dq_unique_practitioner", _repeated_versions("practitioner_id"), "dim_appended")
def dq_unique_practitioner(t: Landing) -> DataFrame:
    """Practitioner ids of several current rows, before superseded versions are closed."""
    return quality.duplicate_keys(appended_people(t).where("is_current"), ["practitioner_id"])


@query(
    "dq_unique_key",
    """
    SELECT staff_id, purchase_date, count(*) AS row_count FROM landing
    GROUP BY staff_id, purchase_date HAVING count(*) > 1""",
    "landing",
)
def dq_unique_key(t: Landing) -> DataFrame:
    return quality.duplicate_keys(t.input(items=False, people=False), ["staff_id", "purchase_date"])


_RAW = """
    SELECT invoice_no, nullif(CASE WHEN item = 'PROMO' THEN 'S' ELSE '' END
               || CASE WHEN item = 'ECONOMY' THEN '' ELSE CAST(staff_id AS VARCHAR) END, '') AS staff_id,
           CASE WHEN item = 'SMALL' THEN strftime(purchase_date, '%d/%m/%Y')
                ELSE CAST(purchase_date AS VARCHAR) END AS appt_date,
           CASE WHEN item = 'MEDIUM' THEN staff_name || ' ' || location ELSE staff_name END AS staff_name,
           CASE WHEN item = 'STANDARD' THEN item || ' ' || manager ELSE item END AS item
    FROM landing"""


def raw_text(t: Landing) -> DataFrame:
    """Appointments as loose text: a sign before the id, an id left out, another date format, a name
    with the location, an item with the manager, each for one appointment type."""
    item = F.col("item")
    sign = F.when(item == "PROMO", "S").otherwise("")
    number = F.when(item == "ECONOMY", "").otherwise(F.col("staff_id").cast("string"))
    return t.input().select(
        "invoice_no",
        F.nullif(F.concat(sign, number), F.lit("")).alias("staff_id"),
        F.when(item == "SMALL", F.date_format("purchase_date", "dd/MM/yyyy"))
        .otherwise(F.col("purchase_date").cast("string"))
        .alias("appt_date"),
        F.when(item == "MEDIUM", F.concat_ws(" ", "staff_name", "location"))
        .otherwise(F.col("staff_name"))
        .alias("staff_name"),
        F.when(item == "STANDARD", F.concat_ws(" ", item, "manager")).otherwise(item).alias("item"),
    )


_NAME_LIMIT = 18


@query(
    "dq_cast_and_length",
    f"""
    SELECT * FROM (
        SELECT *, concat_ws(',',
            CASE WHEN staff_id IS NULL THEN 'missing:staff_id' END,
            CASE WHEN staff_id IS NOT NULL AND TRY_CAST(staff_id AS BIGINT) IS NULL THEN 'not_a_number:staff_id' END,
            CASE WHEN TRY_STRPTIME(appt_date, '%Y-%m-%d') IS NULL THEN 'not_a_date:appt_date' END,
            CASE WHEN length(staff_name) > {_NAME_LIMIT} THEN 'too_long:staff_name' END,
            CASE WHEN NOT regexp_matches(item, '^[A-Za-z]+$') THEN 'not_letters:item' END) AS reasons
        FROM ({_RAW}))
    WHERE reasons <> ''""",
    "landing",
)
def dq_cast_and_length(t: Landing) -> DataFrame:
    """Raw text rows that a strict load would refuse, with every reason."""
    return quality.bad_text(
        raw_text(t),
        T.StructType([f for f in schemas.TARGET if f.name != "target_hour"]),
        date_pattern=dates.PATTERNS["iso"],
        required=["staff_id"],
        max_length={"staff_name": _NAME_LIMIT},
        letters_only=["item"],
    )


@query(
    "dq_bad_ids",
    f"SELECT invoice_no, staff_id FROM ({_RAW}) WHERE coalesce(TRY_CAST(staff_id AS INTEGER), 0) <= 0",
    "landing",
)
def dq_bad_ids(t: Landing) -> DataFrame:
    """Ids that are no whole number above zero."""
    return quality.bad_ids(raw_text(t), "staff_id").select("invoice_no", "staff_id")
