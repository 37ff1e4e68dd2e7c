"""Month arithmetic (A7, D5) on the driver and as column expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_minus(d: dt.date, months: int) -> dt.date:
    """First of the month ``months`` before ``d`` (across years)."""
    years, month0 = divmod(d.month - 1 - months, 12)
    return d.replace(year=d.year + years, month=month0 + 1, day=1)


def month_index(c) -> Column:
    """Months since year 0: ``year*12 + month - 1`` as bigint (consecutive months differ by 1)."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.year(c).cast("bigint") * 12 + F.month(c) - 1).alias("month_index")


def is_first_of_month(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.dayofmonth(c) == 1
