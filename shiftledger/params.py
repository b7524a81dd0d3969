"""Parameters shared by the registered queries, their oracle SQL, the benchmark and the tests."""

from __future__ import annotations

import datetime as dt

# The plan that the target-planning queries apply.
WEEKDAY_PLAN = {
    "Monday": 6.0,
    "Tuesday": 6.0,
    "Wednesday": 5.0,
    "Thursday": 5.0,
    "Friday": 4.0,
}

# Month and day of the statutory holidays of a year.
HOLIDAY_MONTH_DAYS = ((1, 1), (5, 18), (7, 1), (12, 25))

DEFAULT_MARK = dt.date(1994, 12, 31)
SPLIT_DATE = dt.date(2000, 12, 31)
LATE_START = dt.date(1997, 3, 1)
LATE_END = dt.date(1997, 3, 31)
FIRST_LOAD_DATE = dt.date(1995, 1, 2)
AS_OF = dt.date(1998, 4, 15)

PLAN_START = dt.date(1998, 5, 4)
PLAN_END = dt.date(1998, 5, 31)
YEAR_START = dt.date(1998, 1, 1)
YEAR_END = dt.date(1998, 12, 31)
CLONE_START = dt.date(1998, 5, 4)
CLONE_END = dt.date(1998, 5, 8)

UPDATED_AT = dt.datetime(1994, 12, 31)
CHANGED_AT = dt.datetime(2002, 1, 1, 9, 0)

LOCATIONS = ("NATION_1", "NATION_2", "NATION_3")
MANAGERS = ("AMERICA", "ASIA")
MANAGER = "AMERICA"
SECONDARY_USER = 5
EMAIL_DOMAIN = "clinic.example"

MIN_BALANCE_WITH_TARGET = 1000
MIN_BALANCE_REASSIGNED = 8000
REASSIGNED_MANAGER = "REASSIGNED"
CONSTANT_HOUR = 6.5
HOUR_LOW, HOUR_HIGH = 4, 7

STREAM_DELAY = "1 day"
SESSION_GAP = "15 minutes"
SESSION_DELAY = "1 hour"
