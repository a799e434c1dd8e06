"""Joins of panels with other tables. Lagged joins and grand totals are in `ordered` and
`aggregates`; none of them carries a broadcast hint."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ordered import attach


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all columns the two frames share; null keys match null keys."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the frames share no column")
    return attach(left, right, common)


def within_bounds(
    panel: DataFrame, bounds: DataFrame, entity: str, condition: Column
) -> DataFrame:
    """Rows of each entity that meet a condition on its own bounds.

    An equi-join on the entity with the range as a filter, so the range is never a join of
    everything with everything.
    """
    return panel.join(bounds, entity).filter(condition)


def values_at(
    panel: DataFrame, keys: Sequence[str], day: str, value: str, moments: Mapping[str, Column]
) -> DataFrame:
    """The value on several days side by side (each day a literal or a column of the key), from
    one aggregate instead of a join per day."""
    on = {name: F.col(day) == moment for name, moment in moments.items()}
    picks = [F.max(F.when(hit, F.col(value))).alias(name) for name, hit in on.items()]
    return panel.groupBy(*keys).agg(*picks)
