"""Text, category and number helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.nulls import as_col

# Significance marks, and how dates look inside text columns.
SIGNIFICANCE = ((0.01, "**"), (0.05, "*"))
NOT_SIGNIFICANT = "NS"
DATE_LIKE = "20..-"


def county_code(uid: Column | str) -> Column:
    """Characters 4 to 8 of a location id."""
    return F.substring(as_col(uid), 4, 5)


def percent_label(c: Column | str) -> Column:
    return F.concat(as_col(c).cast("string"), F.lit("%"))


def level_rank(c: Column | str, levels: Sequence[str]) -> Column:
    """Position of a category in an explicit level order, null for other values."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c)), F.lit(0))


def significance(p: Column | str) -> Column:
    p = as_col(p)
    marks = F.when(p.isNull(), F.lit(NOT_SIGNIFICANT))
    for bound, mark in SIGNIFICANCE:
        marks = marks.when(p <= bound, mark)
    return marks.otherwise(NOT_SIGNIFICANT)


def per(c: Column | str, base: Column | str, unit: float) -> Column:
    """A count per `unit` of a base population."""
    return F.try_divide(as_col(c).cast("double") * F.lit(float(unit)), as_col(base).cast("double"))


def recode(c: Column | str, members: Sequence[str], to: str, other: str | None = None) -> Column:
    """Collapse listed categories into one; the rest keep their value or become `other`."""
    c = as_col(c)
    rest = c if other is None else F.lit(other)
    return F.when(c.isin(list(members)), F.lit(to)).when(c.isNotNull(), rest)


def size_tag(c: Column | str, at: float, large: str = "Large", small: str = "Small") -> Column:
    c = as_col(c)
    return F.when(c >= at, large).when(c < at, small)
