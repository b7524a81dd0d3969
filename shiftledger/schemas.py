"""Explicit schemas of every table. Nothing in the library infers a type.

Hours and money keep one decimal as in the warehouse model; the facts carry a wider precision,
so that a key holding a large share of the rows cannot overflow its sum.
"""

from __future__ import annotations

from pyspark.sql import types as T

HOUR = T.DecimalType(5, 1)
MONEY = T.DecimalType(12, 2)
FACT_HOUR = T.DecimalType(18, 1)
FACT_MONEY = T.DecimalType(22, 1)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


INPUT = _struct(
    ("location", T.StringType()),
    ("purchase_date", T.DateType()),
    ("client", T.StringType()),
    ("item", T.StringType()),
    ("staff_id", T.LongType()),
    ("staff_name", T.StringType()),
    ("manager", T.StringType()),
    ("payer", T.StringType()),
    ("invoice_date", T.DateType()),
    ("invoice_no", T.StringType()),
    ("status", T.StringType()),
    ("subtotal", MONEY),
    ("taxes", MONEY),
    ("total", MONEY),
    ("collected", MONEY),
    ("balance", MONEY),
    ("actual_hour", HOUR),
)

TARGET = _struct(
    ("staff_id", T.LongType()),
    ("staff_name", T.StringType()),
    ("appt_date", T.DateType()),
    ("target_hour", HOUR),
)

PRACTITIONER = _struct(
    ("practitioner_id", T.LongType()),
    ("practitioner_name", T.StringType()),
    ("clinic_location", T.StringType()),
    ("manager_name", T.StringType()),
)

TARGET_UPDATE = _struct(
    ("practitioner_id", T.LongType()),
    ("practitioner_name", T.StringType()),
    ("target_date", T.DateType()),
    ("target_hour", HOUR),
    ("updated_at", T.TimestampNTZType()),
)

HOLIDAYS = _struct(("holiday_date", T.DateType()))

PERFORMANCE = _struct(
    ("appt_date", T.DateType()),
    ("practitioner_id", T.LongType()),
    ("practitioner_name", T.StringType()),
    ("appt_type", T.StringType()),
    ("total_hours", HOUR),
    ("total_income", MONEY),
)

WEEKLY_TARGET = _struct(
    ("practitioner_id", T.LongType()),
    ("appt_type", T.StringType()),
    ("week", T.IntegerType()),
    ("target_income", MONEY),
    ("target_hour", T.DecimalType(12, 1)),
)

MEMBERS = _struct(
    ("staff_id", T.LongType()),
    ("staff_name", T.StringType()),
    ("manager", T.StringType()),
    ("location", T.StringType()),
    ("item", T.StringType()),
    ("purchase_date", T.DateType()),
)

PERSON_DAYS = _struct(
    ("staff_id", T.LongType()),
    ("purchase_date", T.DateType()),
    ("location", T.StringType()),
    ("actual_hour", T.DecimalType(15, 1)),
    ("total", T.DecimalType(22, 2)),
)

WEEKS = _struct(
    ("week", T.IntegerType()),
    ("practitioner_id", T.LongType()),
    ("total_hours", T.DecimalType(15, 1)),
    ("total_income", T.DecimalType(22, 2)),
)

DIM_DATE = _struct(
    ("date", T.DateType()),
    ("day_of_week", T.StringType()),
    ("week_of_year", T.IntegerType()),
    ("month", T.IntegerType()),
    ("quarter", T.IntegerType()),
    ("year", T.IntegerType()),
)

DIM_LOCATION = _struct(
    ("location_id", T.LongType()),
    ("location_name", T.StringType()),
    ("address", T.StringType()),
)

DIM_ITEM = _struct(
    ("item_id", T.LongType()),
    ("item_name", T.StringType()),
    ("department", T.StringType()),
    ("category", T.StringType()),
)

DIM_PRACTITIONER = _struct(
    ("practitioner_dim_id", T.LongType()),
    ("practitioner_id", T.LongType()),
    ("practitioner_name", T.StringType()),
    ("email", T.StringType()),
    ("contract_type", T.StringType()),
    ("manager_name", T.StringType()),
    ("location_id", T.LongType()),
    ("location_name", T.StringType()),
    ("effective_start_date", T.DateType()),
    ("effective_end_date", T.DateType()),
    ("is_current", T.BooleanType()),
)

FACT_PERFORMANCE = _struct(
    ("date", T.DateType()),
    ("practitioner_dim_id", T.LongType()),
    ("location_id", T.LongType()),
    ("target_hour", FACT_HOUR),
    ("actual_hour", FACT_HOUR),
    ("total_billing", FACT_MONEY),
)

FACT_MEASURES = _struct(
    ("date", T.DateType()),
    ("target_hour", FACT_HOUR),
    ("actual_hour", FACT_HOUR),
    ("total_billing", FACT_MONEY),
)

FACT_APPOINTMENTS = _struct(
    ("date", T.DateType()),
    ("practitioner_dim_id", T.LongType()),
    ("location_id", T.LongType()),
    ("item_id", T.LongType()),
    ("number_appointments", T.LongType()),
    ("actual_hour", FACT_HOUR),
    ("total_billing", FACT_MONEY),
)

DAY_TOTALS = _struct(
    ("date", T.DateType()),
    ("target_hour", T.DecimalType(28, 1)),
    ("actual_hour", T.DecimalType(28, 1)),
    ("total_billing", T.DecimalType(32, 1)),
)
