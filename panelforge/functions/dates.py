"""Day arithmetic and date text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import as_col

# The fall semester that the growth summaries use, and the days from infection
# to death and from mobility to infection.
SEMESTER_START = date(2020, 8, 18)
SEMESTER_END = date(2020, 12, 15)
DEATH_LAG_DAYS = 24
MOBILITY_LAG_DAYS = 7


def parse_mdy(c: Column | str) -> Column:
    return F.try_to_date(as_col(c), "M/d/yyyy")


def parse_iso(c: Column | str) -> Column:
    return F.try_to_date(as_col(c), "yyyy-MM-dd")


def iso_text(c: Column | str) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd")


def shifted(c: Column | str, days: int) -> Column:
    return F.date_add(as_col(c), days)


def shift_days(df: DataFrame, column: str, days: int) -> DataFrame:
    """The frame with its date column moved; the input frame is left as it was."""
    return df.withColumn(column, shifted(column, days))


def day_number(c: Column | str) -> Column:
    return F.unix_date(as_col(c))


def between_days(c, lo, hi, lo_open: bool = False, hi_open: bool = False) -> Column:
    """Date-range predicate with each end open or closed."""
    c = as_col(c)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return ((c > lo) if lo_open else (c >= lo)) & ((c < hi) if hi_open else (c <= hi))
