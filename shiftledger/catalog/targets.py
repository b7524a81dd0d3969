"""Target planning: set, clone, edit, delete, view and summarise target hours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftledger import params as p
from shiftledger.catalog.base import query
from shiftledger.catalog.filters import targets_with_people
from shiftledger.catalog.views import day, stamp
from shiftledger.functions import dates
from shiftledger.operators import aggregates, changes, filters, joins, ordering, reshape
from shiftledger.plans import planning
from shiftledger.sources.mapping import Landing, timestamp

_KEY = "practitioner_id, target_date"
_PLANNED = "practitioner_id, practitioner_name, target_date, target_hour"
_IN_YEAR = f"target_date BETWEEN {day(p.YEAR_START)} AND {day(p.YEAR_END)}"
_IN_PLAN = f"target_date BETWEEN {day(p.PLAN_START)} AND {day(p.PLAN_END)}"


def changed_at():
    return timestamp(p.CHANGED_AT)


def chosen(t: Landing) -> DataFrame:
    """The practitioners that a planner picked by location and manager."""
    return filters.cascade(t.practitioner(), p.LOCATIONS, p.MANAGERS)


# Person-days and the anti joins of planning


@query("cross_practitioner_dates", "SELECT * FROM slots", "slots")
def cross_practitioner_dates(t: Landing) -> DataFrame:
    """Every practitioner on every day of a year."""
    people = t.practitioner().select("practitioner_id", "practitioner_name")
    return joins.person_days(people, p.YEAR_START, p.YEAR_END)


@query(
    "anti_existing_target",
    f"""
    SELECT * FROM slots s
    WHERE NOT EXISTS (SELECT 1 FROM target_update u
                      WHERE u.practitioner_id = s.practitioner_id AND u.target_date = s.target_date)""",
    "slots target_update",
)
def anti_existing_target(t: Landing) -> DataFrame:
    slots = joins.person_days(
        t.practitioner().select("practitioner_id", "practitioner_name"), p.YEAR_START, p.YEAR_END
    )
    known = filters.between_dates(t.target_update(), "target_date", p.YEAR_START, p.YEAR_END)
    return joins.without_target(slots, known)


@query(
    "anti_holiday",
    """
    SELECT staff_id, purchase_date, actual_hour FROM landing
    WHERE purchase_date NOT IN (SELECT holiday_date FROM holidays)""",
    "landing holidays",
)
def anti_holiday(t: Landing) -> DataFrame:
    rows = t.input(items=False, people=False).select("staff_id", "purchase_date", "actual_hour")
    return joins.without_holiday(rows, t.holidays(), "purchase_date").select(*rows.columns)


@query(
    "join_target_practitioner",
    """
    SELECT u.practitioner_id, p.practitioner_name, clinic_location, manager_name, target_date, target_hour
    FROM target_update u JOIN practitioner p ON u.practitioner_id = p.practitioner_id""",
    "target_update practitioner",
)
def join_target_practitioner(t: Landing) -> DataFrame:
    return targets_with_people(t)


@query(
    "union_practitioner_targets",
    f"""
    SELECT {_PLANNED} FROM target_update WHERE practitioner_id IN (SELECT practitioner_id FROM chosen)""",
    "target_update chosen",
)
def union_practitioner_targets(t: Landing) -> DataFrame:
    """The targets of all picked practitioners from one semi join instead of a query per person."""
    picked = chosen(t).select("practitioner_id")
    return t.target_update().join(picked, "practitioner_id", "left_semi").select(*_PLANNED.split(", "))


# Set


_PLAN_ROWS = ", ".join(f"('{name}', CAST({hour} AS DECIMAL(5,1)))" for name, hour in p.WEEKDAY_PLAN.items())

_STATUS = """CASE WHEN s.target_date IN (SELECT holiday_date FROM holidays) THEN 'holiday'
                  WHEN EXISTS (SELECT 1 FROM target_update u WHERE u.practitioner_id = s.practitioner_id
                               AND u.target_date = s.target_date) THEN 'conflict'
                  ELSE 'inserted' END"""

_SET = f"""
    SELECT s.practitioner_id, s.practitioner_name, s.target_date, plan.hour AS target_hour, {_STATUS} AS status
    FROM slots s JOIN (VALUES {_PLAN_ROWS}) plan(weekday, hour) ON dayname(s.target_date) = plan.weekday"""


def plan_holidays(t: Landing) -> DataFrame:
    return t.holidays(p.YEAR_START, p.YEAR_END)


def set_plan(t: Landing) -> DataFrame:
    return planning.set_weekday_plan(
        t.practitioner(), t.target_update(), plan_holidays(t), p.YEAR_START, p.YEAR_END, p.WEEKDAY_PLAN
    )


@query("targets_set_weekday_plan", _SET, "slots target_update holidays")
def targets_set_weekday_plan(t: Landing) -> DataFrame:
    """The weekday plan for every practitioner over a year."""
    return set_plan(t)


@query(
    "targets_set_rows",
    f"""
    SELECT practitioner_id, practitioner_name, target_date, target_hour, {stamp(p.CHANGED_AT)} AS updated_at
    FROM ({_SET}) WHERE status = 'inserted'""",
    "slots target_update holidays",
)
def targets_set_rows(t: Landing) -> DataFrame:
    """The rows that the plan adds to the target table."""
    return planning.inserted(set_plan(t), changed_at())


@query(
    "targets_set_counts",
    f"SELECT status, count(*) AS row_count FROM ({_SET}) GROUP BY status",
    "slots target_update holidays",
)
def targets_set_counts(t: Landing) -> DataFrame:
    return planning.status_counts(set_plan(t))


_UPSERT = f"""
    SELECT * FROM target_update u
    WHERE NOT EXISTS (SELECT 1 FROM change c WHERE c.practitioner_id = u.practitioner_id
                      AND c.target_date = u.target_date)
    UNION ALL SELECT {_PLANNED}, updated_at FROM change"""


def _days(start, end) -> str:
    return f"generate_series({day(start)}, {day(end)}, INTERVAL 1 DAY) days(d)"


@query(
    "targets_upsert_constant",
    f"""
    SELECT * FROM (WITH change AS (
        SELECT practitioner_id, practitioner_name, CAST(d AS DATE) AS target_date,
               CAST({p.CONSTANT_HOUR} AS DECIMAL(5,1)) AS target_hour, {stamp(p.CHANGED_AT)} AS updated_at
        FROM practitioner, {_days(p.PLAN_START, p.PLAN_END)}
        WHERE practitioner_id IN (SELECT practitioner_id FROM target_update WHERE {_IN_PLAN}))
    {_UPSERT})""",
    "practitioner target_update",
)
def targets_upsert_constant(t: Landing) -> DataFrame:
    return planning.set_constant(
        t.target_update(), t.practitioner(), p.PLAN_START, p.PLAN_END, p.CONSTANT_HOUR, changed_at()
    )


# Clone


_LATEST = """(SELECT * FROM target_update
              WHERE date_trunc('week', target_date) = (SELECT date_trunc('week', max(target_date)) FROM target_update))"""


@query(
    "targets_clone_latest_week",
    f"""
    SELECT s.practitioner_id, s.practitioner_name, s.target_date, w.target_hour, {_STATUS} AS status
    FROM slots s LEFT JOIN {_LATEST} w
      ON w.practitioner_id = s.practitioner_id AND isodow(w.target_date) = isodow(s.target_date)
    WHERE w.target_hour IS NOT NULL OR {_STATUS} <> 'inserted'""",
    "slots target_update holidays",
)
def targets_clone_latest_week(t: Landing) -> DataFrame:
    return planning.clone_latest_week(
        t.practitioner(), t.target_update(), plan_holidays(t), p.YEAR_START, p.YEAR_END
    )


@query(
    "latest_row",
    "SELECT target_date FROM target_update ORDER BY target_date DESC LIMIT 1",
    "target_update",
)
def latest_row(t: Landing) -> DataFrame:
    return aggregates.latest_date(t.target_update())


def _source_start(option: str) -> str:
    start = day(p.CLONE_START)
    if option == "last_week":
        return f"{start} - 7"
    first = f"CAST(date_trunc('month', {start}) - INTERVAL 1 {'MONTH' if option == 'last_month' else 'YEAR'} AS DATE)"
    return f"""(SELECT CAST(x AS DATE) FROM generate_series({first}, {first} + INTERVAL 1 MONTH - INTERVAL 1 DAY,
                                                            INTERVAL 1 DAY) days(x)
               WHERE isodow(x) = isodow({start}) AND (day(x) - 1) // 7 = (day({start}) - 1) // 7)"""


def _clone_aligned(option: str) -> str:
    return f"""
    SELECT p.practitioner_id, p.practitioner_name,
           CASE WHEN NOT busy THEN source_date + CAST(datediff('day', first, {day(p.CLONE_START)}) AS INTEGER) END
               AS target_date,
           CASE WHEN NOT busy THEN source_hour END AS target_hour,
           CASE WHEN busy THEN 'conflict' WHEN source_date IS NULL THEN 'no_source' ELSE 'cloned' END AS status
    FROM (SELECT *, EXISTS (SELECT 1 FROM target_update u WHERE u.practitioner_id = q.practitioner_id
                    AND target_date BETWEEN {day(p.CLONE_START)} AND {day(p.CLONE_END)}) AS busy,
                 {_source_start(option)} AS first
          FROM practitioner q) p
    LEFT JOIN (SELECT practitioner_id, target_date AS source_date, target_hour AS source_hour FROM target_update) s
      ON s.practitioner_id = p.practitioner_id AND NOT busy
     AND source_date BETWEEN first AND first + {(p.CLONE_END - p.CLONE_START).days}"""


def clone(t: Landing, option: str) -> DataFrame:
    return planning.clone_aligned(t.practitioner(), t.target_update(), p.CLONE_START, p.CLONE_END, option)


@query("targets_clone_aligned", _clone_aligned("last_month"), "practitioner target_update")
def targets_clone_aligned(t: Landing) -> DataFrame:
    return clone(t, "last_month")


@query("targets_clone_aligned_year", _clone_aligned("last_year"), "practitioner target_update")
def targets_clone_aligned_year(t: Landing) -> DataFrame:
    return clone(t, "last_year")


@query("targets_clone_aligned_week", _clone_aligned("last_week"), "practitioner target_update")
def targets_clone_aligned_week(t: Landing) -> DataFrame:
    return clone(t, "last_week")


@query(
    "targets_clone_aligned_apply",
    f"""
    SELECT * FROM target_update
    UNION ALL SELECT {_PLANNED}, {stamp(p.CHANGED_AT)} FROM ({_clone_aligned("last_month")})
    WHERE status = 'cloned'""",
    "practitioner target_update",
)
def targets_clone_aligned_apply(t: Landing) -> DataFrame:
    """The target table after the clones are written."""
    return planning.apply_clones(t.target_update(), clone(t, "last_month"), changed_at())


def _period(kind: str, manager: bool = False) -> str:
    start = f"CAST(date_trunc('{kind}', {day(p.AS_OF)}) AS DATE)"
    step = {"week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}[kind]
    only = f" AND manager_name = '{p.MANAGER}'" if manager else ""
    return f"""
    SELECT manager_name, u.practitioner_id, u.practitioner_name, target_date, target_hour
    FROM target_update u JOIN practitioner p ON u.practitioner_id = p.practitioner_id
    WHERE target_date >= {start} - INTERVAL {step} AND target_date < {start}{only}"""


def load_period(t: Landing, kind: str, manager: str | None = None) -> DataFrame:
    return planning.load_period(t.target_update(), t.practitioner(), kind, p.AS_OF, manager, max_date=p.AS_OF)


@query("targets_load_period", _period("quarter", manager=True), "target_update practitioner")
def targets_load_period(t: Landing) -> DataFrame:
    """The previous quarter of one manager."""
    return load_period(t, "quarter", p.MANAGER)


@query("targets_load_period_week", _period("week"), "target_update practitioner")
def targets_load_period_week(t: Landing) -> DataFrame:
    return load_period(t, "week")


@query("targets_load_period_month", _period("month"), "target_update practitioner")
def targets_load_period_month(t: Landing) -> DataFrame:
    return load_period(t, "month")


@query("targets_load_period_year", _period("year"), "target_update practitioner")
def targets_load_period_year(t: Landing) -> DataFrame:
    return load_period(t, "year")


@query(
    "targets_clone_broadcast",
    f"""
    SELECT * FROM (WITH change AS (
        SELECT practitioner_id, practitioner_name, CAST(d AS DATE) AS target_date, target_hour,
               {stamp(p.CHANGED_AT)} AS updated_at
        FROM (SELECT practitioner_id, max_by(practitioner_name, target_date) AS practitioner_name,
                     max_by(target_hour, target_date) AS target_hour
              FROM ({_period("month")}) GROUP BY practitioner_id), {_days(p.PLAN_START, p.PLAN_END)})
    {_UPSERT})""",
    "target_update practitioner",
)
def targets_clone_broadcast(t: Landing) -> DataFrame:
    return planning.clone_over_range(
        t.target_update(), load_period(t, "month"), p.PLAN_START, p.PLAN_END, changed_at()
    )


@query(
    "pivot_week_preview",
    "SELECT p.practitioner_id, p.practitioner_name, "
    + ", ".join(
        f"max(CASE WHEN dayname(target_date) = '{name}' THEN target_hour END) AS {name.lower()}"
        for name in dates.WEEKDAYS
    )
    + f" FROM practitioner p LEFT JOIN {_LATEST} w ON w.practitioner_id = p.practitioner_id GROUP BY ALL",
    "target_update practitioner",
)
def pivot_week_preview(t: Landing) -> DataFrame:
    return reshape.week_matrix(t.practitioner(), planning.latest_week(t.target_update()))


# View and summarise


@query(
    "targets_consolidated_view",
    f"""
    SELECT p.practitioner_id, p.practitioner_name, target_date, target_hour
    FROM target_update u JOIN practitioner p ON u.practitioner_id = p.practitioner_id WHERE {_IN_YEAR}
    ORDER BY practitioner_name, target_date""",
    "target_update practitioner",
)
def targets_consolidated_view(t: Landing) -> DataFrame:
    return planning.consolidated(t.target_update(), t.practitioner(), p.YEAR_START, p.YEAR_END)


@query(
    "targets_series",
    f"""
    SELECT p.practitioner_name, target_date, target_hour
    FROM target_update u JOIN chosen p ON u.practitioner_id = p.practitioner_id WHERE {_IN_YEAR}
    ORDER BY practitioner_name, target_date""",
    "target_update chosen",
)
def targets_series(t: Landing) -> DataFrame:
    return planning.series(t.target_update(), chosen(t), p.YEAR_START, p.YEAR_END)


@query(
    "sort_target_date",
    "SELECT * FROM target_update ORDER BY target_date, practitioner_id",
    "target_update",
)
def sort_target_date(t: Landing) -> DataFrame:
    return ordering.by_date(t.target_update())


@query(
    "sort_name_date",
    "SELECT * FROM target_update ORDER BY practitioner_name, target_date",
    "target_update",
)
def sort_name_date(t: Landing) -> DataFrame:
    return ordering.by_name_and_date(t.target_update())


def _summary(kind: str, where: str = "") -> str:
    return f"""
    SELECT CAST(date_trunc('{kind}', target_date) AS DATE) AS period,
           CAST(sum(target_hour) AS DECIMAL(15,1)) AS total_target_hours
    FROM target_update {where} GROUP BY ALL"""


@query("target_summary_weekly", _summary("week"), "target_update")
def target_summary_weekly(t: Landing) -> DataFrame:
    return aggregates.target_summary(t.target_update(), "week")


@query("target_summary_monthly", _summary("month"), "target_update")
def target_summary_monthly(t: Landing) -> DataFrame:
    return aggregates.target_summary(t.target_update(), "month")


@query("target_summary_quarterly", _summary("quarter"), "target_update")
def target_summary_quarterly(t: Landing) -> DataFrame:
    return aggregates.target_summary(t.target_update(), "quarter")


@query(
    "target_summary_by_manager",
    _summary("week", f"JOIN practitioner USING (practitioner_id) WHERE manager_name = '{p.MANAGER}'"),
    "target_update practitioner",
)
def target_summary_by_manager(t: Landing) -> DataFrame:
    rows = filters.pick_group(targets_with_people(t), manager=p.MANAGER)
    return aggregates.target_summary(rows, "week")


@query(
    "distinct_sorted_lists",
    """
    SELECT 'clinic_location' AS list, clinic_location AS value FROM practitioner GROUP BY ALL
    UNION ALL SELECT 'manager_name', manager_name FROM practitioner GROUP BY ALL
    ORDER BY list, value""",
    "practitioner",
)
def distinct_sorted_lists(t: Landing) -> DataFrame:
    """The choices of the location and manager menus."""
    lists = [
        aggregates.distinct_members(t.practitioner(), col).select(F.lit(col).alias("list"), F.col(col).alias("value"))
        for col in ("clinic_location", "manager_name")
    ]
    return lists[0].unionByName(lists[1]).orderBy("list", "value")


@query(
    "distinct_sorted_managers",
    "SELECT DISTINCT manager_name FROM practitioner WHERE manager_name IS NOT NULL ORDER BY manager_name",
    "practitioner",
)
def distinct_sorted_managers(t: Landing) -> DataFrame:
    return aggregates.sorted_values(t.practitioner(), "manager_name")


@query(
    "count_existing",
    f"""
    SELECT p.*, count(target_date) AS existing_count
    FROM practitioner p LEFT JOIN target_update u ON p.practitioner_id = u.practitioner_id AND {_IN_PLAN}
    GROUP BY ALL""",
    "practitioner target_update",
)
def count_existing(t: Landing) -> DataFrame:
    known = filters.between_dates(t.target_update(), "target_date", p.PLAN_START, p.PLAN_END)
    return aggregates.count_targets(t.practitioner(), known)


# Edit and delete


_EDITS = f"""
    SELECT practitioner_id, practitioner_name, target_date,
           CAST(target_hour + CASE WHEN target_hour < 5 THEN 1 ELSE 0 END AS DECIMAL(5,1)) AS target_hour,
           {stamp(p.CHANGED_AT)} AS updated_at
    FROM target_update WHERE {_IN_YEAR}"""

_SUNDAYS = f"""
    SELECT DISTINCT staff_id AS practitioner_id, staff_name AS practitioner_name, purchase_date AS target_date,
           CAST({p.CONSTANT_HOUR} AS DECIMAL(5,1)) AS target_hour, {stamp(p.CHANGED_AT)} AS updated_at
    FROM landing WHERE isodow(purchase_date) = 7"""


def edits(t: Landing) -> DataFrame:
    """A planner's edit of a year: short days get one hour more, the others stay."""
    more = F.when(F.col("target_hour") < 5, 1).otherwise(0)
    return filters.between_dates(t.target_update(), "target_date", p.YEAR_START, p.YEAR_END).withColumns(
        {"target_hour": (F.col("target_hour") + more).cast("decimal(5,1)"), "updated_at": changed_at()}
    )


def sundays(t: Landing) -> DataFrame:
    """Targets for the Sundays that staff worked; the target table has none."""
    worked = t.input(items=False, people=False).where(dates.weekday_index("purchase_date") == 6)
    days = worked.select(
        F.col("staff_id").alias("practitioner_id"), F.col("purchase_date").alias("target_date")
    ).distinct()
    names = t.practitioner().select("practitioner_id", "practitioner_name")
    return days.join(names, "practitioner_id").withColumns(
        {"target_hour": F.lit(p.CONSTANT_HOUR).cast("decimal(5,1)"), "updated_at": changed_at()}
    )


@query(
    "targets_edit_diff",
    f"""
    SELECT c.practitioner_id, c.target_date, u.target_hour AS old_hour, c.target_hour AS new_hour
    FROM ({_EDITS}) c JOIN target_update u ON c.practitioner_id = u.practitioner_id AND c.target_date = u.target_date
    WHERE c.target_hour <> u.target_hour""",
    "target_update",
)
def targets_edit_diff(t: Landing) -> DataFrame:
    return planning.edit_changes(t.target_update(), edits(t))


@query(
    "targets_edit_all",
    f"""
    SELECT practitioner_id, practitioner_name, target_date,
           CASE WHEN hit THEN CAST({p.CONSTANT_HOUR} AS DECIMAL(5,1)) ELSE target_hour END AS target_hour,
           CASE WHEN hit THEN {stamp(p.CHANGED_AT)} ELSE updated_at END AS updated_at
    FROM (SELECT *, {_IN_YEAR} AND practitioner_id IN (SELECT practitioner_id FROM chosen) AS hit FROM target_update)""",
    "target_update chosen",
)
def targets_edit_all(t: Landing) -> DataFrame:
    return planning.edit_all(t.target_update(), chosen(t), p.YEAR_START, p.YEAR_END, p.CONSTANT_HOUR, changed_at())


@query(
    "upsert_targets",
    f"SELECT * FROM (WITH change AS ({_EDITS} UNION ALL {_SUNDAYS}) {_UPSERT})",
    "target_update landing",
)
def upsert_targets(t: Landing) -> DataFrame:
    """Edits replace rows, Sundays are new."""
    return changes.upsert(t.target_update(), edits(t).unionByName(sundays(t)))


@query(
    "update_targets",
    f"""
    SELECT u.practitioner_id, u.practitioner_name, u.target_date,
           coalesce(c.target_hour, u.target_hour) AS target_hour, coalesce(c.updated_at, u.updated_at) AS updated_at
    FROM target_update u LEFT JOIN ({_EDITS} UNION ALL {_SUNDAYS}) c
      ON c.practitioner_id = u.practitioner_id AND c.target_date = u.target_date""",
    "target_update landing",
)
def update_targets(t: Landing) -> DataFrame:
    """Edits replace rows, Sundays match nothing and are ignored."""
    change = edits(t).unionByName(sundays(t))
    return changes.update(t.target_update(), change, ["target_hour", "updated_at"])


_LOG = f"""
    SELECT *, 0 AS source_rank FROM target_update UNION ALL SELECT *, 1 FROM ({_EDITS})
    UNION ALL SELECT practitioner_id, practitioner_name, target_date, CAST(3 AS DECIMAL(5,1)),
                     {stamp(p.CHANGED_AT)}, 2 FROM target_update WHERE {_IN_PLAN}"""


@query(
    "upsert_last_writer",
    f"""
    SELECT * FROM ({_LOG})
    QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY updated_at DESC, source_rank DESC) = 1""",
    "target_update",
)
def upsert_last_writer(t: Landing) -> DataFrame:
    """The last change of each key in a log of three sources; equal times go by the source."""
    half_days = filters.between_dates(t.target_update(), "target_date", p.PLAN_START, p.PLAN_END).withColumns(
        {"target_hour": F.lit(3).cast("decimal(5,1)"), "updated_at": changed_at()}
    )
    sources = [t.target_update(), edits(t), half_days]
    ranked = [rows.withColumn("source_rank", F.lit(rank)) for rank, rows in enumerate(sources)]
    log = ranked[0].unionByName(ranked[1]).unionByName(ranked[2])
    return aggregates.last_writer(log, ["practitioner_id", "target_date"], ["updated_at", "source_rank"])


def saturdays(t: Landing) -> DataFrame:
    return t.target_update().where(dates.weekday_index("target_date") == 5).select("practitioner_id", "target_date")


@query("semi_delete_keys", "SELECT * FROM target_update WHERE isodow(target_date) = 6", "target_update")
def semi_delete_keys(t: Landing) -> DataFrame:
    """Preview of deleting all Saturdays by their keys."""
    return joins.matching_keys(t.target_update(), saturdays(t)).select(*t.target_update().columns)


@query("delete_targets_keys", "SELECT * FROM target_update WHERE isodow(target_date) <> 6", "target_update")
def delete_targets_keys(t: Landing) -> DataFrame:
    """The target table without the listed keys, all Saturdays."""
    return changes.delete_keys(t.target_update(), saturdays(t))


@query(
    "delete_targets_range",
    f"""
    SELECT * FROM target_update
    WHERE NOT ({_IN_YEAR} AND practitioner_id IN (SELECT practitioner_id FROM chosen))""",
    "target_update chosen",
)
def delete_targets_range(t: Landing) -> DataFrame:
    return changes.delete_range(t.target_update(), chosen(t), p.YEAR_START, p.YEAR_END)


_CHANGE = """
    SELECT practitioner_id, CASE WHEN week <= 26 THEN week ELSE week + 100 END AS week, appt_type,
           target_income + 500 AS target_income, target_hour + 2 AS target_hour
    FROM weekly_target WHERE target_hour >= 18"""


@query(
    "target_weekly_update",
    f"""
    SELECT g.practitioner_id, g.week, g.appt_type,
           CAST(coalesce(c.target_income, g.target_income) AS DECIMAL(12,2)) AS target_income,
           CAST(coalesce(c.target_hour, g.target_hour) AS DECIMAL(12,1)) AS target_hour,
           CASE WHEN c.week IS NULL THEN 'kept' ELSE 'updated' END AS status
    FROM weekly_target g LEFT JOIN ({_CHANGE}) c
      ON g.practitioner_id = c.practitioner_id AND g.week = c.week AND g.appt_type = c.appt_type
    UNION ALL
    SELECT practitioner_id, week, appt_type, CAST(target_income AS DECIMAL(12,2)),
           CAST(target_hour AS DECIMAL(12,1)), 'rejected'
    FROM ({_CHANGE}) WHERE week > 100""",
    "weekly_target",
)
def target_weekly_update(t: Landing) -> DataFrame:
    """New income and hours for busy weeks; changes of the second half year name weeks that do not exist."""
    busy = t.weekly_target().where(F.col("target_hour") >= 18)
    change = busy.withColumns(
        {
            "week": F.when(F.col("week") <= 26, F.col("week")).otherwise(F.col("week") + 100),
            "target_income": (F.col("target_income") + 500).cast("decimal(12,2)"),
            "target_hour": (F.col("target_hour") + 2).cast("decimal(12,1)"),
        }
    )
    return planning.update_weekly_targets(t.weekly_target(), change)
