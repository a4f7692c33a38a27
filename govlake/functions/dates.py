"""Cutoff months for retention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cutoff_period(today: Column, months: int) -> Column:
    """Month ``months`` before a date, day overflow carried into the next month.

    31 March minus one month is "31 February", that is early March.
    """
    first = F.add_months(F.trunc(today, "MM"), -months)
    return F.date_format(F.date_add(first, F.dayofmonth(today) - 1), "yyyy-MM")
