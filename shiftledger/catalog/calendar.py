"""Text, number and date functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import params as p
from shiftledger.catalog.base import query
from shiftledger.functions import dates, values
from shiftledger.sources.mapping import Landing


def order_days(t: Landing) -> DataFrame:
    return t.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))


_ORDERS = "(SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"


@query(
    "fn_email",
    f"""
    SELECT c_custkey, lower(replace(replace(c_name, '#', ' '), ' ', '.')) || '@{p.EMAIL_DOMAIN}' AS email
    FROM customer""",
)
def fn_email(t: Landing) -> DataFrame:
    """Addresses of the customer names, with the sign in them as a blank."""
    people = t.table("customer").withColumn("name", F.replace("c_name", F.lit("#"), F.lit(" ")))
    return people.select("c_custkey", values.email("name", p.EMAIL_DOMAIN).alias("email"))


@query(
    "fn_cast_int",
    """
    SELECT o_orderkey, CAST(o_orderkey AS INTEGER) AS order_id, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER)
               AS priority, TRY_CAST(o_orderpriority AS INTEGER) AS malformed
    FROM orders""",
)
def fn_cast_int(t: Landing) -> DataFrame:
    """Text to whole number, strict and tolerant."""
    return t.table("orders").select(
        "o_orderkey",
        values.to_id(F.col("o_orderkey").cast("string")).alias("order_id"),
        values.try_to_id(F.substring("o_orderpriority", 1, 1)).alias("priority"),
        values.try_to_id("o_orderpriority").alias("malformed"),
    )


@query(
    "fn_coalesce_zero",
    """
    SELECT l_suppkey, l_returnflag,
           coalesce(sum(CASE WHEN l_discount > 0.09 THEN CAST(l_quantity AS DECIMAL(5,1)) END), 0)::DECIMAL(15,1)
               AS discounted_hours
    FROM lineitem GROUP BY l_suppkey, l_returnflag""",
)
def fn_coalesce_zero(t: Landing) -> DataFrame:
    """A sum over nothing is zero."""
    hours = F.when(F.col("l_discount") > 0.09, F.col("l_quantity").cast("decimal(5,1)"))
    total = values.zero_if_null(F.sum(hours)).cast("decimal(15,1)")
    return t.table("lineitem").groupBy("l_suppkey", "l_returnflag").agg(total.alias("discounted_hours"))


@query(
    "fn_day_name",
    f"SELECT o_orderkey, dayname(d) AS day_name, rpad(dayname(d), 9, ' ') AS padded FROM {_ORDERS}",
)
def fn_day_name(t: Landing) -> DataFrame:
    return order_days(t).select(
        "o_orderkey", dates.day_name("d").alias("day_name"), dates.padded_day_name("d").alias("padded")
    )


@query("fn_iso_week", f"SELECT o_orderkey, CAST(weekofyear(d) AS INTEGER) AS week FROM {_ORDERS}")
def fn_iso_week(t: Landing) -> DataFrame:
    return order_days(t).select("o_orderkey", dates.iso_week("d").alias("week"))


@query(
    "fn_month_quarter_year",
    f"""
    SELECT o_orderkey, CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter,
           CAST(year(d) AS INTEGER) AS year
    FROM {_ORDERS}""",
)
def fn_month_quarter_year(t: Landing) -> DataFrame:
    return order_days(t).select(
        "o_orderkey", F.month("d").alias("month"), F.quarter("d").alias("quarter"), F.year("d").alias("year")
    )


@query(
    "fn_period_start",
    f"""
    SELECT o_orderkey, CAST(date_trunc('week', d) AS DATE) AS week_start,
           CAST(date_trunc('month', d) AS DATE) AS month_start,
           CAST(date_trunc('quarter', d) AS DATE) AS quarter_start, CAST(date_trunc('year', d) AS DATE) AS year_start
    FROM {_ORDERS}""",
)
def fn_period_start(t: Landing) -> DataFrame:
    starts = [dates.period_start(kind, "d").alias(f"{kind}_start") for kind in dates.PERIODS]
    return order_days(t).select("o_orderkey", *starts)


@query(
    "fn_parse_date",
    f"""
    SELECT o_orderkey, d AS "long", d AS short, d AS us, d AS day_first, d AS iso, CAST(NULL AS DATE) AS malformed
    FROM {_ORDERS}""",
)
def fn_parse_date(t: Landing) -> DataFrame:
    """Each text format written and parsed back; tolerant parsing of the wrong format gives null."""
    written = order_days(t).select(
        "o_orderkey", *[F.date_format("d", pattern).alias(name) for name, pattern in dates.PATTERNS.items()]
    )
    return written.select(
        "o_orderkey",
        *[dates.parse_date(name, pattern).alias(name) for name, pattern in dates.PATTERNS.items()],
        dates.try_parse_date("iso", dates.PATTERNS["long"]).alias("malformed"),
    )


@query(
    "fn_date_arith",
    f"""
    SELECT o_orderkey, d + 10 AS later, d - 14 AS two_weeks_before,
           CAST(datediff('day', d, DATE '{p.AS_OF}') AS INTEGER) AS days_to_as_of
    FROM {_ORDERS}""",
)
def fn_date_arith(t: Landing) -> DataFrame:
    return order_days(t).select(
        "o_orderkey",
        F.date_add("d", 10).alias("later"),
        F.date_sub("d", 14).alias("two_weeks_before"),
        F.date_diff(F.lit(p.AS_OF), "d").alias("days_to_as_of"),
    )


@query(
    "fn_week_bounds",
    f"""
    SELECT o_orderkey, CAST(date_trunc('week', d) AS DATE) AS monday, CAST(date_trunc('week', d) AS DATE) + 6 AS sunday
    FROM {_ORDERS}""",
)
def fn_week_bounds(t: Landing) -> DataFrame:
    monday, sunday = dates.week_bounds("d")
    return order_days(t).select("o_orderkey", monday.alias("monday"), sunday.alias("sunday"))


@query(
    "fn_week_of_month",
    f"""
    SELECT o_orderkey, CAST((day(d) - 1) // 7 + 1 AS INTEGER) AS week_of_month,
           CAST(isodow(d) - 1 AS INTEGER) AS weekday
    FROM {_ORDERS}""",
)
def fn_week_of_month(t: Landing) -> DataFrame:
    return order_days(t).select(
        "o_orderkey", dates.week_of_month("d").alias("week_of_month"), dates.weekday_index("d").alias("weekday")
    )


@query(
    "fn_nth_weekday_in_month",
    f"""
    SELECT o_orderkey,
           (SELECT CAST(x AS DATE)
            FROM generate_series(date_trunc('month', d - INTERVAL 1 MONTH),
                                 date_trunc('month', d) - INTERVAL 1 DAY, INTERVAL 1 DAY) days(x)
            WHERE isodow(x) = isodow(d) AND (day(x) - 1) // 7 = (day(d) - 1) // 7) AS month_before
    FROM {_ORDERS}""",
)
def fn_nth_weekday_in_month(t: Landing) -> DataFrame:
    """The same occurrence of the weekday in the month before; null when there is none."""
    found = dates.nth_weekday_in_month(
        dates.same_day_before("month", "d"), dates.weekday_index("d"), dates.week_of_month("d")
    )
    return order_days(t).select("o_orderkey", found.alias("month_before"))


@query(
    "fn_ratio",
    """
    SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS quantity_ratio FROM lineitem""",
)
def fn_ratio(t: Landing) -> DataFrame:
    """Null where the divisor is zero."""
    return t.table("lineitem").select(
        "l_orderkey", "l_linenumber", values.ratio("l_quantity", "l_discount").alias("quantity_ratio")
    )


def _previous(kind: str, months: int) -> str:
    start = f"CAST(date_trunc('{kind}', d) AS DATE)"
    step = "INTERVAL 7 DAY" if kind == "week" else f"INTERVAL {months} MONTH"
    return f"CAST({start} - {step} AS DATE) AS {kind}_start, {start} - 1 AS {kind}_end"


@query(
    "fn_shift_period",
    f"""
    SELECT o_orderkey, {_previous('week', 0)}, {_previous('month', 1)}, {_previous('quarter', 3)},
           {_previous('year', 12)}
    FROM {_ORDERS}""",
)
def fn_shift_period(t: Landing) -> DataFrame:
    """Bounds of the full week, month, quarter and year before each order date."""
    bounds = []
    for kind in dates.PERIODS:
        start, end = dates.previous_period(kind, "d")
        bounds += [start.alias(f"{kind}_start"), end.alias(f"{kind}_end")]
    return order_days(t).select("o_orderkey", *bounds)


@query(
    "fn_shift_same_days",
    f"""
    SELECT o_orderkey, CAST(d - INTERVAL 1 MONTH AS DATE) AS month_before,
           CAST(d - INTERVAL 1 YEAR AS DATE) AS year_before
    FROM {_ORDERS}""",
)
def fn_shift_same_days(t: Landing) -> DataFrame:
    return order_days(t).select(
        "o_orderkey",
        dates.same_day_before("month", "d").alias("month_before"),
        dates.same_day_before("year", "d").alias("year_before"),
    )
