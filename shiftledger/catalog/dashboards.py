"""Weekly performance, ratios, totals, reshapes and KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shiftledger import params as p
from shiftledger.catalog.base import query
from shiftledger.catalog.warehouse import star
from shiftledger.functions import dates
from shiftledger.operators import aggregates, filters, joins, ordering, reshape
from shiftledger.plans import facts, kpi
from shiftledger.sources.mapping import Landing

_MINE = f"practitioner_id = {p.SECONDARY_USER}"


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


@query("weekly_performance", "SELECT * FROM weekly", "weekly")
def weekly_performance(t: Landing) -> DataFrame:
    return aggregates.weekly_performance(t.performance(types=False, names=False), "practitioner_id")


@query(
    "weekly_performance_by_name",
    """
    SELECT week, practitioner_name, CAST(sum(total_hours) AS DECIMAL(15,1)) AS total_hours,
           CAST(sum(total_income) AS DECIMAL(22,2)) AS total_income
    FROM perf GROUP BY week, practitioner_name""",
    "perf",
)
def weekly_performance_by_name(t: Landing) -> DataFrame:
    return aggregates.weekly_performance(t.performance(types=False), "practitioner_name")


@query("weekly_performance_by_type", "SELECT * FROM weekly_type", "weekly_type")
def weekly_performance_by_type(t: Landing) -> DataFrame:
    return kpi.weekly_by_type(t.performance(names=False))


@query("weekly_hours_one_user", f"SELECT week, total_hours FROM weekly WHERE {_MINE}", "weekly")
def weekly_hours_one_user(t: Landing) -> DataFrame:
    return aggregates.weekly_hours(filters.row_security(t.performance(types=False, names=False), "secondary", p.SECONDARY_USER))


@query(
    "left_merge_weekly",
    """
    SELECT w.week, w.practitioner_id, total_hours, total_income, target_income, target_hour
    FROM weekly w LEFT JOIN weekly_target g ON w.week = g.week AND w.practitioner_id = g.practitioner_id""",
    "weekly weekly_target",
)
def left_merge_weekly(t: Landing) -> DataFrame:
    weekly = aggregates.weekly_performance(t.performance(types=False, names=False), "practitioner_id")
    return joins.with_weekly_target(weekly, t.weekly_target(), "target_income", "target_hour")


@query(
    "left_merge_weekly_type",
    """
    SELECT w.*, target_income, target_hour
    FROM weekly_type w LEFT JOIN weekly_target g
      ON w.week = g.week AND w.practitioner_id = g.practitioner_id AND w.appt_type = g.appt_type""",
    "weekly_type weekly_target",
)
def left_merge_weekly_type(t: Landing) -> DataFrame:
    return joins.with_weekly_type_target(kpi.weekly_by_type(t.performance(names=False)), t.weekly_target())


_FANOUT = f"""
    SELECT w.week, w.practitioner_id, w.appt_type AS appt_type_actual, total_hours, total_income,
           g.appt_type AS appt_type_target, target_income, target_hour
    FROM weekly_type w LEFT JOIN weekly_target g ON w.week = g.week AND w.practitioner_id = g.practitioner_id"""


@query("left_merge_weekly_fanout", _FANOUT, "weekly_type weekly_target")
def left_merge_weekly_fanout(t: Landing) -> DataFrame:
    return joins.with_weekly_target_any_type(kpi.weekly_by_type(t.performance(names=False)), t.weekly_target())


@query(
    "weekly_ratio",
    f"""
    SELECT w.*, target_hour, {_ratio('total_hours', 'target_hour')} AS performance_ratio
    FROM weekly w LEFT JOIN weekly_target g ON w.week = g.week AND w.practitioner_id = g.practitioner_id""",
    "weekly weekly_target",
)
def weekly_ratio(t: Landing) -> DataFrame:
    return kpi.weekly_ratio(t.performance(types=False, names=False), t.weekly_target())


_PER_WEEK = """(SELECT week, practitioner_id, CAST(sum(target_income) AS DECIMAL(22,2)) AS target_income,
                       CAST(sum(target_hour) AS DECIMAL(22,1)) AS target_hour
                FROM weekly_target GROUP BY week, practitioner_id)"""


@query(
    "weekly_ratio_dedup",
    f"""
    SELECT w.*, target_hour, {_ratio('total_hours', 'target_hour')} AS performance_ratio
    FROM weekly w LEFT JOIN {_PER_WEEK} g ON w.week = g.week AND w.practitioner_id = g.practitioner_id""",
    "weekly weekly_target",
)
def weekly_ratio_dedup(t: Landing) -> DataFrame:
    return kpi.weekly_ratio(t.performance(types=False, names=False), kpi.targets_per_week(t.weekly_target()))


_MASTER = f"""
    SELECT w.*, appt_type, target_income, target_hour,
           {_ratio('total_hours', 'target_hour')} AS ratio_performance
    FROM weekly w LEFT JOIN weekly_target g ON w.week = g.week AND w.practitioner_id = g.practitioner_id"""


@query("master_dashboard_weekly", _MASTER, "weekly weekly_target")
def master_dashboard_weekly(t: Landing) -> DataFrame:
    return kpi.master_weekly(t.performance(types=False, names=False), t.weekly_target())


@query(
    "master_dashboard_weekly_dedup",
    f"""
    SELECT w.*, target_income, target_hour, {_ratio('total_hours', 'target_hour')} AS ratio_performance
    FROM weekly w LEFT JOIN {_PER_WEEK} g ON w.week = g.week AND w.practitioner_id = g.practitioner_id""",
    "weekly weekly_target",
)
def master_dashboard_weekly_dedup(t: Landing) -> DataFrame:
    return kpi.master_weekly(t.performance(types=False, names=False), kpi.targets_per_week(t.weekly_target()))


_SUMS = """CAST(sum(total_hours) AS DECIMAL(28,1)) AS total_hours,
           CAST(sum(total_income) AS DECIMAL(32,2)) AS total_income,
           CAST(sum(target_hour) AS DECIMAL(28,1)) AS target_hours,
           CAST(sum(target_income) AS DECIMAL(32,2)) AS target_income"""


def _totals(source: str, with_ratio: bool = True) -> str:
    ratio = f", {_ratio('total_hours', 'target_hours')} AS ratio_performance" if with_ratio else ""
    return f"""
    SELECT *{ratio} FROM (SELECT practitioner_id, {_SUMS} FROM ({source}) GROUP BY practitioner_id)"""


@query("master_dashboard_totals", _totals(_MASTER), "weekly weekly_target")
def master_dashboard_totals(t: Landing) -> DataFrame:
    return kpi.master_totals(t.performance(types=False, names=False), t.weekly_target())


@query(
    "master_dashboard_totals_dedup",
    _totals(f"""SELECT w.*, target_income, target_hour FROM weekly w
                LEFT JOIN {_PER_WEEK} g ON w.week = g.week AND w.practitioner_id = g.practitioner_id"""),
    "weekly weekly_target",
)
def master_dashboard_totals_dedup(t: Landing) -> DataFrame:
    return kpi.master_totals_dedup(t.performance(types=False, names=False), t.weekly_target())


@query("practitioner_totals", _totals(_MASTER, with_ratio=False), "weekly weekly_target")
def practitioner_totals(t: Landing) -> DataFrame:
    return kpi.practitioner_totals(t.performance(types=False, names=False), t.weekly_target())


@query(
    "practitioner_weekly_type",
    f"SELECT *, {_ratio('total_hours', 'target_hour')} AS performance_ratio FROM ({_FANOUT}) WHERE {_MINE}",
    "weekly_type weekly_target",
)
def practitioner_weekly_type(t: Landing) -> DataFrame:
    return kpi.practitioner_weekly_type(t.performance(names=False), t.weekly_target(), "secondary", p.SECONDARY_USER)


_PROFILED = (
    "week", "practitioner_id", "appt_type_actual", "total_hours", "total_income", "appt_type_target",
    "target_income", "target_hour", "performance_ratio",
)


@query(
    "null_profile",
    "SELECT " + ", ".join(f"count(*) - count({c}) AS {c}" for c in _PROFILED)
    + f" FROM (SELECT *, {_ratio('total_hours', 'target_hour')} AS performance_ratio FROM ({_FANOUT}))",
    "weekly_type weekly_target",
)
def null_profile(t: Landing) -> DataFrame:
    return kpi.practitioner_null_profile(t.performance(names=False), t.weekly_target(), "master")


_BY_TYPE = """
    SELECT w.*, target_income, target_hour FROM weekly_type w LEFT JOIN weekly_target g
      ON w.week = g.week AND w.practitioner_id = g.practitioner_id AND w.appt_type = g.appt_type"""


def _long(kind: str, unit: str, where: str = "") -> str:
    values = (f"total_{kind}", f"target_{unit}")
    parts = [
        f"SELECT week, appt_type, '{v}' AS {kind}_type, CAST({v} AS DECIMAL({size})) AS {kind} FROM b {where}"
        for v, size in zip(values, [("15,1" if kind == "hours" else "22,2")] * 2)
    ]
    return f"SELECT * FROM (WITH b AS ({_BY_TYPE}) {' UNION ALL '.join(parts)})"


@query("unpivot_hours", _long("hours", "hour"), "weekly_type weekly_target")
def unpivot_hours(t: Landing) -> DataFrame:
    return reshape.hours_long(kpi.practitioner_by_type(t.performance(names=False), t.weekly_target(), "master"))


@query("unpivot_income", _long("income", "income"), "weekly_type weekly_target")
def unpivot_income(t: Landing) -> DataFrame:
    return reshape.income_long(kpi.practitioner_by_type(t.performance(names=False), t.weekly_target(), "master"))


@query("practitioner_hours_long", _long("hours", "hour", f"WHERE {_MINE}"), "weekly_type weekly_target")
def practitioner_hours_long(t: Landing) -> DataFrame:
    mine = kpi.practitioner_by_type(t.performance(names=False), t.weekly_target(), "secondary", p.SECONDARY_USER)
    return reshape.hours_long(mine)


@query("practitioner_income_long", _long("income", "income", f"WHERE {_MINE}"), "weekly_type weekly_target")
def practitioner_income_long(t: Landing) -> DataFrame:
    mine = kpi.practitioner_by_type(t.performance(names=False), t.weekly_target(), "secondary", p.SECONDARY_USER)
    return reshape.income_long(mine)


@query(
    "practitioner_week_head",
    f"""
    SELECT w.week, w.practitioner_id, total_hours, appt_type, target_income, target_hour,
           {_ratio('total_hours', 'target_hour')} AS performance_ratio
    FROM (SELECT * FROM weekly WHERE {_MINE} ORDER BY week LIMIT 5) w
    LEFT JOIN (SELECT * FROM weekly_target WHERE {_MINE} ORDER BY week, appt_type LIMIT 5) g
      ON w.week = g.week AND w.practitioner_id = g.practitioner_id""",
    "weekly weekly_target",
)
def practitioner_week_head(t: Landing) -> DataFrame:
    return kpi.practitioner_week_head(t.performance(types=False, names=False), t.weekly_target(), p.SECONDARY_USER)


@query("head_n", "SELECT * FROM weekly ORDER BY week, practitioner_id LIMIT 5", "weekly")
def head_n(t: Landing) -> DataFrame:
    """The first five rows of the weekly frame."""
    weekly = aggregates.weekly_performance(t.performance(types=False, names=False), "practitioner_id")
    return ordering.head(weekly, 5, "week", "practitioner_id")


@query(
    "kpi_by_location_manager_staff",
    f"""
    SELECT *, {_ratio('actual_hour', 'target_hour')} AS performance_ratio
    FROM (SELECT l.location_name, p.manager_name, p.practitioner_name,
                 CAST(3 - bit_count(GROUPING(l.location_name, p.manager_name, p.practitioner_name)) AS INTEGER) AS level,
                 CAST(sum(actual_hour) AS DECIMAL(28,1)) AS actual_hour,
                 CAST(sum(target_hour) AS DECIMAL(28,1)) AS target_hour
          FROM fact_performance f JOIN dim_practitioner p ON f.practitioner_dim_id = p.practitioner_dim_id
          JOIN dim_location l ON f.location_id = l.location_id
          GROUP BY ROLLUP (l.location_name, p.manager_name, p.practitioner_name))""",
    "fact_performance",
)
def kpi_by_location_manager_staff(t: Landing) -> DataFrame:
    dims = star(t)
    fact = facts.fact_performance(t.per_day(), t.target(), dims.people, dims.places)
    return kpi.by_location_manager_staff(fact, dims.people, dims.places)


def _by_period(kind: str) -> str:
    return f"""
    SELECT '{kind}' AS period_type, CAST(date_trunc('{kind}', date) AS DATE) AS period_start,
           CAST(sum(actual_hour) AS DECIMAL(28,1)) AS actual_hour,
           CAST(sum(target_hour) AS DECIMAL(28,1)) AS target_hour
    FROM fact_performance GROUP BY ALL"""


@query(
    "kpi_by_period",
    f"""
    SELECT *, {_ratio('actual_hour', 'target_hour')} AS performance_ratio
    FROM ({' UNION ALL '.join(_by_period(kind) for kind in dates.PERIODS)})""",
    "fact_performance",
)
def kpi_by_period(t: Landing) -> DataFrame:
    """No attribute of a person or place is used, so neither members nor dimensions are built."""
    return kpi.by_period(facts.first_day_totals(t.per_day(), t.target()))


@query(
    "kpi_by_calendar",
    f"""
    SELECT *, {_ratio('actual_hour', 'target_hour')} AS performance_ratio
    FROM (SELECT CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter,
                 CAST(sum(actual_hour) AS DECIMAL(28,1)) AS actual_hour,
                 CAST(sum(target_hour) AS DECIMAL(28,1)) AS target_hour
          FROM fact_performance GROUP BY ALL)""",
    "fact_performance",
)
def kpi_by_calendar(t: Landing) -> DataFrame:
    """By year and quarter of the date dimension."""
    return kpi.by_calendar(facts.first_day_totals(t.per_day(), t.target()), "year", "quarter")
