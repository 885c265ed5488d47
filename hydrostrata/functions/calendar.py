"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def water_year(date: Column) -> Column:
    """October to September, named by the year in which it ends."""
    return F.year(F.add_months(date, 3))


def month_start(date: Column) -> Column:
    return F.to_date(F.trunc(date, "month"))


def season(date: Column) -> Column:
    """wet (October to March) or dry."""
    return F.when(F.month(date).between(4, 9), "dry").otherwise("wet")
