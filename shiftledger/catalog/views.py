"""SQL views that the oracle statements share.

They spell out each table by its rule, independent of how the Spark side computes it; keys are numbered by
one window over all members.
"""

from __future__ import annotations

import datetime as dt

from shiftledger import params as p


def day(value: dt.date) -> str:
    return f"DATE '{value.isoformat()}'"


def stamp(value: dt.datetime) -> str:
    return f"TIMESTAMP '{value.isoformat(sep=' ')}'"


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_MONTH_DAYS = ", ".join(f"({m}, {d})" for m, d in p.HOLIDAY_MONTH_DAYS)

_PERSON_DIGEST = (
    "md5(concat_ws('|', CAST(practitioner_id AS VARCHAR), practitioner_name, manager_name, location_name))"
)


def _numbered_people(source: str) -> str:
    """Rule: a member is a distinct (id, name, manager, place); keys count members in the order of their digest."""
    return f"""
        WITH members AS (
            SELECT location AS location_name, manager AS manager_name, staff_id AS practitioner_id,
                   staff_name AS practitioner_name
            FROM {source} GROUP BY ALL HAVING staff_id IS NOT NULL)
        SELECT row_number() OVER by_digest AS practitioner_dim_id, practitioner_id, practitioner_name,
               concat(lower(replace(practitioner_name, ' ', '.')), '@', '{p.EMAIL_DOMAIN}') AS email,
               NULL::VARCHAR AS contract_type, manager_name, location_id, location_name,
               NULL::DATE AS effective_start_date, NULL::DATE AS effective_end_date, true AS is_current
        FROM members NATURAL JOIN (SELECT location_id, location_name FROM dim_location)
        WINDOW by_digest AS (ORDER BY {_PERSON_DIGEST}, practitioner_id)"""


def _keyed(rows: str, people: str) -> str:
    """``rows`` with natural keys staff_id and place, given their surrogate keys; rows without a member are left out."""
    return f"""
        (SELECT * FROM {rows}
         NATURAL JOIN (SELECT practitioner_id AS staff_id, practitioner_dim_id FROM {people} WHERE is_current)
         NATURAL JOIN (SELECT location_name AS place, location_id FROM dim_location))"""


def _fact_performance(rows: str, people: str) -> str:
    """Rule: what a person worked at a place on a day counts once for each target row of that person and day,
    and once without any; the targets of the day are added up. Sums of nothing are 0."""
    worked = f"""
        (SELECT staff_id, location AS place, purchase_date AS date, sum(actual_hour) AS hours, sum(total) AS billed
         FROM {rows} GROUP BY ALL)"""
    return f"""
        WITH planned AS (SELECT staff_id, appt_date AS date, count(*) AS times, sum(target_hour) AS hours_planned
                         FROM target GROUP BY ALL)
        SELECT date, practitioner_dim_id, location_id,
               CAST(sum(coalesce(hours_planned, 0)) AS DECIMAL(18,1)) AS target_hour,
               CAST(sum(coalesce(hours * coalesce(times, 1), 0)) AS DECIMAL(18,1)) AS actual_hour,
               CAST(sum(coalesce(billed * coalesce(times, 1), 0)) AS DECIMAL(22,1)) AS total_billing
        FROM {_keyed(worked, people)} LEFT JOIN planned USING (staff_id, date)
        GROUP BY ALL"""


def _fact_appointments(rows: str, people: str) -> str:
    """Rule: rows with an item, counted and summed per day, person, place and item."""
    counted = f"""
        (SELECT staff_id, location AS place, purchase_date AS date, item AS item_name, count(*) AS n,
                sum(actual_hour) AS hours, sum(total) AS billed
         FROM {rows} WHERE item IS NOT NULL GROUP BY ALL)"""
    return f"""
        SELECT date, practitioner_dim_id, location_id, item_id, CAST(sum(n) AS BIGINT) AS number_appointments,
               CAST(sum(coalesce(hours, 0)) AS DECIMAL(18,1)) AS actual_hour,
               CAST(sum(coalesce(billed, 0)) AS DECIMAL(22,1)) AS total_billing
        FROM {_keyed(counted, people)} NATURAL JOIN (SELECT item_id, item_name FROM dim_item)
        GROUP BY ALL"""


# name -> (views it reads, statement), in order of dependence
VIEWS: dict[str, tuple[str, str]] = {
    "landing": (
        "",
        """
        SELECT n_name AS location, CAST(l_shipdate AS DATE) AS purchase_date, p_type AS item,
               l_suppkey AS staff_id, s_name AS staff_name, r_name AS manager,
               s_acctbal AS account_balance, l_orderkey AS invoice_no,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS total, CAST(l_quantity AS DECIMAL(5,1)) AS actual_hour
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "practitioner": (
        "",
        """
        SELECT s_suppkey AS practitioner_id, s_name AS practitioner_name, n_name AS clinic_location,
               r_name AS manager_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    ),
    "target": (
        "landing",
        f"""
        SELECT DISTINCT staff_id, staff_name, purchase_date AS appt_date,
               CAST(4 + (staff_id + day(purchase_date)) % 4 AS DECIMAL(5,1)) AS target_hour
        FROM landing WHERE isodow(purchase_date) <= 6 AND account_balance >= {p.MIN_BALANCE_WITH_TARGET}""",
    ),
    "target_update": (
        "target",
        f"""
        SELECT staff_id AS practitioner_id, staff_name AS practitioner_name, appt_date AS target_date,
               target_hour, {stamp(p.UPDATED_AT)} AS updated_at
        FROM target""",
    ),
    "holidays": (
        "",
        f"""
        SELECT make_date(y, m, d) AS holiday_date
        FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS y FROM lineitem WHERE l_shipdate IS NOT NULL)
        CROSS JOIN (VALUES {_MONTH_DAYS}) days(m, d)""",
    ),
    "perf": (
        "landing",
        """
        SELECT purchase_date AS appt_date, staff_id AS practitioner_id, staff_name AS practitioner_name,
               item AS appt_type, actual_hour AS total_hours, total AS total_income,
               CAST(weekofyear(purchase_date) AS INTEGER) AS week, account_balance
        FROM landing""",
    ),
    "weekly_target": (
        "perf",
        f"""
        SELECT practitioner_id, appt_type, week, CAST(1000 * count(*) AS DECIMAL(12,2)) AS target_income,
               CAST(6 * count(*) AS DECIMAL(12,1)) AS target_hour
        FROM perf WHERE account_balance >= {p.MIN_BALANCE_WITH_TARGET}
        GROUP BY practitioner_id, appt_type, week""",
    ),
    "weekly": (
        "perf",
        """
        SELECT week, practitioner_id, CAST(sum(total_hours) AS DECIMAL(15,1)) AS total_hours,
               CAST(sum(total_income) AS DECIMAL(22,2)) AS total_income
        FROM perf GROUP BY week, practitioner_id""",
    ),
    "weekly_type": (
        "perf",
        """
        SELECT week, practitioner_id, appt_type, CAST(sum(total_hours) AS DECIMAL(15,1)) AS total_hours,
               CAST(sum(total_income) AS DECIMAL(22,2)) AS total_income
        FROM perf GROUP BY week, practitioner_id, appt_type""",
    ),
    "daily": (
        "landing",
        """
        SELECT purchase_date, staff_id, location, CAST(sum(actual_hour) AS DECIMAL(15,1)) AS total_actual_hour,
               CAST(sum(total) AS DECIMAL(22,2)) AS total_billing
        FROM landing GROUP BY purchase_date, staff_id, location""",
    ),
    "dim_location": (
        "landing",
        """
        SELECT row_number() OVER (ORDER BY md5(location_name), location_name) AS location_id, location_name,
               CAST(NULL AS VARCHAR) AS address
        FROM (SELECT DISTINCT location AS location_name FROM landing WHERE location IS NOT NULL)""",
    ),
    "dim_item": (
        "landing",
        """
        SELECT row_number() OVER (ORDER BY md5(item_name), item_name) AS item_id, item_name,
               CAST(NULL AS VARCHAR) AS department, CAST(NULL AS VARCHAR) AS category
        FROM (SELECT DISTINCT item AS item_name FROM landing WHERE item IS NOT NULL)""",
    ),
    "landing_old": ("landing", f"SELECT * FROM landing WHERE purchase_date <= {day(p.SPLIT_DATE)}"),
    "landing_new": (
        "landing",
        f"""
        SELECT * REPLACE (CASE WHEN account_balance >= {p.MIN_BALANCE_REASSIGNED}
                               THEN '{p.REASSIGNED_MANAGER}' ELSE manager END AS manager)
        FROM landing WHERE purchase_date > {day(p.SPLIT_DATE)}""",
    ),
    "dim_practitioner": ("landing dim_location", _numbered_people("landing")),
    "dim_practitioner_old": ("landing_old dim_location", _numbered_people("landing_old")),
    "newcomers": (
        "landing_new dim_practitioner_old dim_location",
        f"""
        WITH seen AS (
            SELECT staff_id AS practitioner_id,
                   max({{'on': purchase_date, 'manager_name': manager, 'location_name': location, 'practitioner_name': staff_name}}) AS last
            FROM landing_new GROUP BY staff_id),
        led AS (SELECT practitioner_id, list(DISTINCT manager_name) AS managers
                FROM dim_practitioner_old WHERE is_current GROUP BY ALL),
        moved AS (
            SELECT practitioner_id, last.practitioner_name, last.manager_name, last.location_name
            FROM seen LEFT JOIN led USING (practitioner_id)
            WHERE managers IS NULL OR coalesce(list_position(managers, last.manager_name), 0) = 0)
        SELECT (SELECT count(*) FROM dim_practitioner_old) + row_number() OVER (ORDER BY {_PERSON_DIGEST}, practitioner_id)
                   AS practitioner_dim_id, practitioner_id, practitioner_name,
               concat(lower(replace(practitioner_name, ' ', '.')), '@', '{p.EMAIL_DOMAIN}') AS email,
               NULL::VARCHAR AS contract_type, manager_name, location_id, location_name,
               {day(p.SPLIT_DATE + dt.timedelta(days=1))} AS effective_start_date, NULL::DATE AS effective_end_date,
               true AS is_current
        FROM moved NATURAL JOIN (SELECT location_id, location_name FROM dim_location)""",
    ),
    "dim_appended": (
        "dim_practitioner_old newcomers",
        "SELECT * FROM dim_practitioner_old UNION ALL SELECT * FROM newcomers",
    ),
    "dim_practitioner_new": (
        "dim_appended",
        f"""
        WITH numbered AS (SELECT *, is_current AND practitioner_dim_id = max(practitioner_dim_id) OVER (
                              PARTITION BY practitioner_id, is_current) AS last FROM dim_appended)
        SELECT * EXCLUDE (last) REPLACE (
            if(last OR NOT is_current, effective_end_date, {day(p.SPLIT_DATE)}) AS effective_end_date, last AS is_current)
        FROM numbered""",
    ),
    "fact_performance": (
        "landing target dim_practitioner dim_location",
        _fact_performance("landing", "dim_practitioner"),
    ),
    "fact_appointments": (
        "landing dim_practitioner dim_location dim_item",
        _fact_appointments("landing", "dim_practitioner"),
    ),
    "fact_performance_old": (
        "landing_old target dim_practitioner_old dim_location",
        _fact_performance("landing_old", "dim_practitioner_old"),
    ),
    "mark": (
        "fact_performance_old",
        f"SELECT coalesce(max(date), {day(p.DEFAULT_MARK)}) AS mark FROM fact_performance_old",
    ),
    "landing_after": (
        "landing mark",
        "SELECT * FROM landing WHERE purchase_date > (SELECT mark FROM mark)",
    ),
    "fact_performance_added": (
        "landing_after target dim_practitioner dim_location",
        _fact_performance("landing_after", "dim_practitioner"),
    ),
    "fact_appointments_added": (
        "landing_after dim_practitioner dim_location dim_item",
        _fact_appointments("landing_after", "dim_practitioner"),
    ),
    "chosen": (
        "practitioner",
        f"""
        SELECT * FROM practitioner
        WHERE clinic_location IN ({words(p.LOCATIONS)}) AND manager_name IN ({words(p.MANAGERS)})""",
    ),
    "slots": (
        "practitioner",
        f"""
        SELECT practitioner_id, practitioner_name, CAST(d AS DATE) AS target_date
        FROM practitioner, generate_series({day(p.YEAR_START)}, {day(p.YEAR_END)}, INTERVAL 1 DAY) days(d)""",
    ),
}


def with_views(names: str, statement: str) -> str:
    """``statement`` after the views it reads, and those that they read, as common table expressions."""
    wanted: set[str] = set()

    def visit(name: str) -> None:
        if name not in wanted:
            wanted.add(name)
            for other in VIEWS[name][0].split():
                visit(other)

    for name in names.split():
        visit(name)
    if not wanted:
        return statement.strip()
    parts = [f"{name} AS ({VIEWS[name][1].strip()})" for name in VIEWS if name in wanted]
    return "WITH " + ",\n".join(parts) + "\n" + statement.strip()
