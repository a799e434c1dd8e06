"""Null and arithmetic rules of the panel study, as column expressions.

Sums, means and maxima are *strict* (one null makes the result null) unless a caller asks for
the skipping form; conditions on null give null; logs and ratios give null outside their domain.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _strict(agg: Column, c: Column) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


def strict_sum(c: Column | str) -> Column:
    c = as_col(c)
    return _strict(F.sum(c), c)


def strict_avg(c: Column | str) -> Column:
    c = as_col(c)
    return _strict(F.avg(c), c)


def strict_max(c: Column | str) -> Column:
    c = as_col(c)
    return _strict(F.max(c), c)


def if_else(cond: Column, yes: Column, no: Column) -> Column:
    """Two-way choice that stays null where the condition is null."""
    return F.when(cond, yes).when(~cond, no)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, null for a zero divisor."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def safe_ln(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.ln(c))


def log1p_count(c: Column | str) -> Column:
    """ln(x + 1) for counts; null at or below -1."""
    c = as_col(c)
    return F.when(c > -1, F.log1p(c))


def to_number(c: Column | str) -> Column:
    return as_col(c).try_cast("double")


def not_in(c: Column | str, values: Iterable) -> Column:
    """Exclusion list that keeps nulls (a null is not a member of the list)."""
    return F.coalesce(~as_col(c).isin(list(values)), F.lit(True))


def null_of(c: Column | str, sentinels: Iterable) -> Column:
    """The column with every sentinel value turned to null."""
    c = as_col(c)
    return F.when(not_in(c, sentinels), c)
