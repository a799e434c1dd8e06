"""Growth coefficients: local change of log counts per entity, and their summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.dates import day_number
from panelforge.functions.nulls import log1p_count, strict_sum
from panelforge.functions.spline import STUDY_DF, fit_series


def _fit_udf(df: float):
    @F.pandas_udf("value array<double>, slope array<double>, curve array<double>")
    def fit(days: pd.Series, counts: pd.Series) -> pd.DataFrame:
        rows = fit_series(list(days), list(counts), df)
        empty = (None, None, None)
        return pd.DataFrame([r or empty for r in rows], columns=["value", "slope", "curve"])

    return fit


def spline_growth(
    df: DataFrame,
    entity: str | Sequence[str],
    day: str,
    values: Sequence[str],
    df_target: float = STUDY_DF,
) -> DataFrame:
    """Smoothed value, first (`_b`) and second (`_b2`) derivative of each value column.

    Input: one row per (entity, day); two rows on a day are an error. Each entity becomes one row of arrays bounded by the
    calendar; the fit runs once per series in Arrow batches and all derivatives come from it.
    Rows with a null value stay, with null results; the fit leaves them out.
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    arrays = df.groupBy(*keys).agg(
        F.when(
            F.count(F.lit(1)) == F.count_distinct(F.col(day)),
            F.array_sort(F.collect_list(F.struct(day, *values))),
        )
        .otherwise(F.raise_error(F.lit(f"more than one row, or none dated, on a {day}")))
        .alias("_s")
    )
    arrays = arrays.withColumn(
        "_d", F.transform("_s", lambda s: day_number(s[day]).cast("double"))
    )
    fit = _fit_udf(df_target)
    for i, v in enumerate(values):
        arrays = arrays.withColumn(f"_f{i}", fit("_d", F.col(f"_s.{v}")))
    fits = [f"_f{i}" for i in range(len(values))]
    flat = arrays.select(*keys, *fits, F.posexplode("_s").alias("_i", "_r"))
    # A series too short for the fit keeps its rows as well.
    out = [F.col(f"_r.{day}").alias(day)]
    for i, v in enumerate(values):
        out.append(F.col(f"_r.{v}").alias(v))
        for part, suffix in (("value", "fit"), ("slope", "b"), ("curve", "b2")):
            at = F.get(F.col(f"_f{i}.{part}"), F.col("_i"))
            out.append(F.when(~F.isnan(at), at).alias(f"{v}_{suffix}"))
    return flat.select(*keys, *out)


def derivative_errors(fit: DataFrame, entity: str, day: str, value: str) -> DataFrame:
    """Per entity: how far slopes and curvatures of a fit are from what its own values ask for.

    Input: output of `spline_growth`. Each step between two fitted days lies within one cubic, for
    which both rules are exact; the largest error of a step is returned. One window by entity, the
    placement that the fit's arrays already had.
    """
    fitted = fit.filter(F.col(f"{value}_fit").isNotNull())
    before = W.partitionBy(entity).orderBy(day)
    parts = {s: F.col(f"{value}_{s}") for s in ("fit", "b", "b2")}
    last = {s: F.lag(c).over(before) for s, c in parts.items()}
    steps = fitted.select(
        entity,
        F.datediff(day, F.lag(day).over(before)).alias("_h"),
        *[c.alias(s) for s, c in parts.items()],
        *[c.alias(f"_{s}") for s, c in last.items()],
    ).filter(F.col("_h").isNotNull())
    h = F.col("_h")
    rise = h / 2 * (F.col("b") + F.col("_b")) - h * h / 12 * (F.col("b2") - F.col("_b2"))
    turn = h / 2 * (F.col("b2") + F.col("_b2"))
    return steps.groupBy(entity).agg(
        F.count(F.lit(1)).alias("steps"),
        F.sum(h).alias("days"),
        F.max(F.abs(F.col("fit") - F.col("_fit") - rise)).alias("slope_error"),
        F.max(F.abs(F.col("b") - F.col("_b") - turn)).alias("curvature_error"),
    )


def with_log_counts(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """ln(x + 1) of count columns as ``{new: source}``."""
    return df.withColumns({new: log1p_count(src) for new, src in columns.items()})


def with_local_slope(
    df: DataFrame,
    value: str,
    day: str,
    entity: str | Sequence[str],
    name: str = "slope",
    before: int = 14,
    after: int = 13,
) -> DataFrame:
    """Least-squares slope per day over a sliding frame of days, in the JVM.

    A quick stand-in for the spline slope with the same reach. Null where the frame is not full of
    known values on consecutive days. On consecutive days the slope is a weighted sum of the
    values, so differences of two running sums replace the fit of every frame: the work per row
    does not grow with the frame. (The sums cost some digits: about 1e-12 after 2,400 days.)
    """
    keys = [entity] if isinstance(entity, str) else list(entity)
    m = before + after + 1
    row = W.partitionBy(*keys).orderBy(day)
    upto = row.rowsBetween(W.unboundedPreceding, 0)
    y = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    at = F.row_number().over(row).cast("double")
    summed = df.withColumn("_i", at).withColumns(
        {
            "_n": F.count(value).over(upto).cast("double"),
            "_s": F.sum(y).over(upto),
            "_t": F.sum(F.col("_i") * y).over(upto),
        }
    )

    def inside(column: str) -> Column:
        end = F.lead(column, after).over(row)
        return end - F.lag(column, before + 1, 0.0).over(row)

    whole = (inside("_n") == m) & (
        F.datediff(F.lead(day, after).over(row), F.lag(day, before).over(row)) == m - 1
    )
    middle = F.col("_i") + (after - before) / 2
    slope = (inside("_t") - middle * inside("_s")) / ((m**3 - m) / 12)
    return summed.withColumn(name, F.when(whole, slope)).drop("_i", "_n", "_s", "_t")


def category_series(
    panel: DataFrame, day: str, category: str, counts: str, name: str = "log_count"
) -> DataFrame:
    """Daily total per category and its log, the input of a fit per category."""
    totals = panel.filter(F.col(category).isNotNull()).groupBy(category, day)
    summed = totals.agg(strict_sum(counts).alias("total"))
    return summed.withColumn(name, log1p_count("total"))


def summaries(
    df: DataFrame, entity: str, measures: Mapping[str, tuple[Column, Column, str]]
) -> DataFrame:
    """Many windowed summaries in one aggregate: ``{name: (condition, value, "max" | "avg")}``.

    A null value inside a window makes its summary null.
    """
    fn = {"max": F.max, "avg": F.avg}
    aggs = []
    for name, (cond, value, how) in measures.items():
        known = F.count_if(cond & value.isNull()) == 0
        aggs.append(F.when(known, fn[how](F.when(cond, value))).alias(name))
    return df.groupBy(entity).agg(*aggs)


def at_offsets(
    df: DataFrame, entity: str, offset: Column, value: str, offsets: Mapping[str, int]
) -> DataFrame:
    """Value at several day offsets side by side, one aggregate instead of a chain of joins."""
    picks = df.withColumn("_o", offset).filter(F.col("_o").isin(list(offsets.values())))
    return picks.groupBy(entity).agg(
        *[F.max(F.when(F.col("_o") == k, F.col(value))).alias(n) for n, k in offsets.items()]
    )
