"""Shares, majorities, rates and totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import ratio, strict_sum

# Fixed value: the one-sided 95 % normal quantile used for the bands.
Z_BAND = 1.6448536269514722


def category_totals(
    df: DataFrame, by: Sequence[str], unit: str, size: str, name: str = "enroll"
) -> DataFrame:
    """Total size per group after reducing rows to distinct (group, unit, size).

    A unit of unknown size makes the total null.
    """
    units = df.select(*by, unit, size).distinct()
    return units.groupBy(*by).agg(strict_sum(size).alias(name))


def with_share(df: DataFrame, part: str, total: str, name: str, digits: int | None = 2) -> DataFrame:
    share = ratio(part, total)
    return df.withColumn(name, share if digits is None else F.round(share, digits))


def with_grand_total(df: DataFrame, totals: DataFrame, value: str, name: str) -> DataFrame:
    """The sum of a column over another frame next to each row, as a scalar (no join)."""
    return df.withColumn(name, totals.agg(F.sum(value).alias(name)).scalar())


def argmax_columns(columns: Mapping[str, Column | str]) -> Column:
    """Label of the largest of several columns, the first one among equals."""
    cols = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
    top = F.greatest(*cols.values())
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, c in cols.items():
        out = out.when(c == top, F.lit(label))
    return out


def value_of_label(label: Column | str, columns: Mapping[str, str]) -> Column:
    """The column that a label names, 0 for an unknown label."""
    label = F.col(label) if isinstance(label, str) else label
    out = F.when(F.lit(False), F.lit(0.0))
    for name, column in columns.items():
        out = out.when(label == name, F.col(column))
    return out.otherwise(F.lit(0.0))


def weighted_mean(value: str, weight: str) -> Column:
    """Null as soon as one product is unknown."""
    return ratio(strict_sum(F.col(value) * F.col(weight)), strict_sum(weight))


def ratio_of_sums(a: str, b: str) -> Column:
    return ratio(strict_sum(a), strict_sum(b))


def incidence_band(
    panel: DataFrame, day: str, category: str, events: str, population: str, z: float = Z_BAND
) -> DataFrame:
    """Events per head by day and category with a normal band around the rate."""
    totals = panel.groupBy(day, category).agg(
        strict_sum(events).alias("total_events"), strict_sum(population).alias("total_pop")
    )
    p = F.col("rate")
    spread = F.try_divide(p * (F.lit(1.0) - p), F.col("total_pop").cast("double"))
    half = F.lit(z) * F.when(spread >= 0, F.sqrt(spread))  # null outside [0, 1]
    return totals.withColumn("rate", ratio("total_events", "total_pop")).withColumns(
        {"rate_upper": p + half, "rate_lower": p - half}
    )


def soft_category_rates(
    panel: DataFrame, day: str, shares: Sequence[str], events: str, population: str
) -> DataFrame:
    """Rates per category when each entity counts towards every category by its share."""
    sums = [
        F.try_divide(
            F.sum(F.col(s) * F.col(events)), F.sum(F.col(s) * F.col(population))
        ).alias(f"rate_{s}")
        for s in shares
    ]
    return panel.groupBy(day).agg(*sums)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)
