"""Text and number expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def email(name: Column | str, domain: str) -> Column:
    """Address made from a name: lower case, blanks as dots."""
    text = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lower(F.replace(text, F.lit(" "), F.lit("."))), F.lit("@" + domain))


def to_id(text: Column | str) -> Column:
    """Text to whole number; malformed text raises."""
    return (F.col(text) if isinstance(text, str) else text).cast("int")


def try_to_id(text: Column | str) -> Column:
    """Text to whole number; malformed text gives null."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("int")


def zero_if_null(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(actual: Column | str, target: Column | str) -> Column:
    """Actual over target as a double; null when the target is missing or zero."""
    a = F.col(actual) if isinstance(actual, str) else actual
    b = F.col(target) if isinstance(target, str) else target
    return F.try_divide(a.cast("double"), b.cast("double"))


def clean_name(name: str) -> str:
    """A header name as snake case: ``" Appt. Date "`` becomes ``appt_date``, ``"Invoice #"`` ``invoice_no``."""
    spelled = name.strip().lower().replace("#", "no")
    return re.sub(r"[^0-9a-z]+", "_", spelled).strip("_")
