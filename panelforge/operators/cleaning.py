"""Cleaning, imputation and data-quality operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.nulls import as_col, null_of
from panelforge.operators.ordered import attach

# Missing-value codes of the school survey, and the location labels that are not
# counties.
SCHOOL_SENTINELS = {"enrollment": [-999.0], "gslo": ["N"], "gshi": ["N"], "openenroll": [2], "level": ["N"]}
PSEUDO_COUNTIES = ["UNASSIGNED", "OUT OF OH"]


def sentinels_to_null(df: DataFrame, sentinels: Mapping[str, Sequence]) -> DataFrame:
    return df.withColumns({c: null_of(c, values) for c, values in sentinels.items()})


def complete_cases(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(columns) if columns else None)


def null_profile(df: DataFrame) -> DataFrame:
    """Null count of every column, from one aggregate."""
    cols = df.columns
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.unpivot([], cols, "column_name", "n_null")


def null_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of rows for each combination of missing columns (1 = missing)."""
    flags = [F.col(c).isNull().cast("int").alias(c) for c in columns]
    return df.select(*flags).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def learn_lookup(df: DataFrame, key: str, target: str) -> DataFrame:
    """key -> target for the keys that go with exactly one target in the complete rows.

    min = max replaces a distinct count, so map tasks send one row per key.
    """
    seen = df.filter(F.col(key).isNotNull() & F.col(target).isNotNull())
    ends = seen.groupBy(key).agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    return ends.filter(F.col("_lo") == F.col("_hi")).select(key, F.col("_lo").alias("_learnt"))


def impute_from_lookup(df: DataFrame, key: str, target: str) -> DataFrame:
    """Fill a missing target from the lookup learnt on the complete rows; ambiguous keys stay."""
    joined = attach(df, learn_lookup(df, key, target), [key])
    return joined.withColumn(target, F.coalesce(target, "_learnt")).select(*df.columns)


def impute_override(df: DataFrame, key: str, target: str, overrides: DataFrame) -> DataFrame:
    """Fill what is still missing from a keyed table (columns: key, target)."""
    joined = attach(df, overrides.select(key, F.col(target).alias("_fixed")), [key])
    return joined.withColumn(target, F.coalesce(target, "_fixed")).select(*df.columns)


def larger_of_summed_and_reported(summed: Column | str, reported: Column | str) -> Column:
    """The larger total, null while the reported one is missing."""
    a, b = as_col(summed), as_col(reported)
    return F.when(b.isNotNull() & a.isNotNull(), F.greatest(a, b))


def group_total_check(
    df: DataFrame, key: str, value: str, limits: DataFrame, limit: str
) -> DataFrame:
    """Rows whose group's total exceeds the reported total of the group.

    Totals meet the limits one row per key; only offending keys go back to the rows.
    """
    totals = df.groupBy(key).agg(F.sum(value).alias("total")).join(limits, key)
    offending = totals.filter(F.col("total") > F.col(limit))
    return attach(df, offending, [key]).filter(F.col("total").isNotNull())


def subtract_where(
    totals: DataFrame, key: str, category: str, value: str, where: str, other: DataFrame, amount: str
) -> DataFrame:
    """Subtract a second per-key aggregate from the rows of one category."""
    joined = attach(totals, other.select(key, F.col(amount).alias("_less")), [key])
    less = F.when(F.col(category) == where, F.coalesce("_less", F.lit(0))).otherwise(F.lit(0))
    return joined.withColumn(value, F.col(value) - less).drop("_less")


def reconcile(
    increments: DataFrame, levels: DataFrame, key: str, increment: str, level: str, day: str
) -> DataFrame:
    """Per key: sum of increments against the latest cumulative level, joined by key.

    When both live in one frame it is read once and nothing is joined.
    """
    if increments is levels:
        both = levels.groupBy(key).agg(
            F.sum(increment).alias("summed"), F.max_by(level, day).alias("latest")
        )
        return both.withColumn("mismatch", ~F.col("summed").eqNullSafe(F.col("latest")))
    summed = increments.groupBy(key).agg(F.sum(increment).alias("summed"))
    latest = levels.groupBy(key).agg(F.max_by(level, day).alias("latest"))
    both = summed.join(latest, key, "full")
    return both.withColumn("mismatch", ~F.col("summed").eqNullSafe(F.col("latest")))


def back_allocate(counts) -> np.ndarray:
    """Each negative entry in turn takes one unit from each of the nearest earlier positive entries.

    `open_` lists the earlier entries that still are positive, in order; a correction takes from its
    end, and only entries that it used up leave the list. So the work is one step per day and one
    array operation per correction, as long as what it moves.
    """
    v = np.array(counts, dtype="float64")
    open_, size = np.empty(len(v), dtype="int64"), 0
    for i, x in enumerate(v.tolist()):
        if x < 0:
            units = int(min(np.ceil(-x), size))
            if units:
                taken = open_[size - units : size]
                v[taken] -= 1
                v[i] += units
                left = taken[v[taken] > 0]
                size += len(left) - units
                open_[size - len(left) : size] = left
        if v[i] > 0:
            open_[size] = i
            size += 1
    return v


def _back_allocated():
    @F.pandas_udf("array<double>")
    def walk(series: pd.Series) -> pd.Series:
        rows = [None if v is None else back_allocate(v) for v in series]
        return pd.Series(rows, dtype="object")

    return walk


def redistribute_negatives(
    df: DataFrame, entity: str, day: str, value: str, name: str = "adjusted"
) -> DataFrame:
    """Move negative corrections back onto earlier positive days, one unit per day.

    Input: one row per (entity, day), so an entity's array is bounded by the calendar. Only
    series that hold a negative go to Python, as Arrow arrays. Each row also says whether it stayed negative
    (`residual`): the first day has nothing before it, and a correction may exceed the number of
    earlier positive days. A null count stays null and takes no part.
    """
    rest = [c for c in df.columns if c != entity]
    packed = df.withColumn("_x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    order = [day, "_x", *[c for c in rest if c != day]]
    arrays = packed.groupBy(entity).agg(
        F.array_sort(F.collect_list(F.struct(*order))).alias("_s")
    )
    arrays = arrays.withColumn("_v", F.transform("_s", lambda s: s["_x"]))
    arrays = arrays.withColumn(
        "_n", _back_allocated()(F.when(F.exists("_v", lambda v: v < 0), F.col("_v")))
    )
    out = arrays.withColumn("_f", F.coalesce("_n", "_v")).select(
        entity, F.explode(F.arrays_zip("_s", "_f")).alias("_r")
    )
    return out.select(
        entity,
        *[F.col(f"_r._s.`{c}`").alias(c) for c in rest],
        F.when(F.col(f"_r._s.`{value}`").isNotNull(), F.col("_r._f")).alias(name),
        F.coalesce(F.col("_r._f") < 0, F.lit(False)).alias("residual"),
    )
