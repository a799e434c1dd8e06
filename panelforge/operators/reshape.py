"""Long to wide, wide to long, stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widen(
    df: DataFrame, keys: Sequence[str], category: str, value: str, categories: Sequence, fill=0
) -> DataFrame:
    """One column per listed category. The list is explicit, so no extra job finds it.

    A cell that holds more than one row is an error rather than a silent pick, and so is a row of
    a category that is not listed, null among them.
    """
    listed = F.col(category).isin(list(categories))
    name = F.coalesce(F.col(category).cast("string"), F.lit("null"))
    refused = F.raise_error(F.concat(F.lit(f"{category} not listed: "), name))
    known = F.when(listed, F.col(category)).otherwise(refused.cast(dict(df.dtypes)[category]))
    df = df.withColumn(category, known)
    one = F.when(F.count(value) <= 1, F.first(value, ignorenulls=True)).otherwise(
        F.raise_error(F.lit(f"more than one {value} in a cell"))
    )
    wide = df.groupBy(*keys).pivot(category, list(categories)).agg(one)
    return wide if fill is None else wide.fillna(fill, subset=[str(c) for c in categories])


def widen_dates(
    df: DataFrame, keys: Sequence[str], day: str, value: str, days: Sequence[date]
) -> DataFrame:
    """Entity by day matrix for a bounded list of days, columns named by ISO date."""
    picked = df.filter(F.col(day).isin(list(days)))
    text = picked.withColumn("_day", F.date_format(day, "yyyy-MM-dd"))
    return widen(text, keys, "_day", value, [d.isoformat() for d in days], fill=None)


def lengthen(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str, value: str
) -> DataFrame:
    return df.unpivot(list(keys), list(values), name, value)


def stack_labelled(frames: Mapping[str, DataFrame], label: str = "type") -> DataFrame:
    """Union of frames by column name with a label column."""
    out: DataFrame | None = None
    for name, frame in frames.items():
        tagged = frame.withColumn(label, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def multi_signal(
    signals: DataFrame,
    geo: str,
    day: str,
    signal: str,
    values: Mapping[str, Sequence[str]],
    base: str,
) -> DataFrame:
    """Signals of a long table side by side per (geo, day) that has the `base` signal.

    `values` maps a signal to the value columns wanted from it; the result column is
    ``<signal>_<column>``. One scan and one partially aggregated shuffle replace a chain of left
    joins that starts at `base`. Two values of a signal in a cell are an error.
    """
    wanted = []
    for name, columns in values.items():
        for c in columns:
            own = F.when(F.col(signal) == name, F.col(c))
            cell = F.when(F.count(own) <= 1, F.max(own)).otherwise(
                F.raise_error(F.lit(f"more than one {name} {c} in a cell"))
            )
            wanted.append(cell.alias(f"{name}_{c}"))
    rows = signals.filter(F.col(signal).isin(list(dict.fromkeys([*values, base]))))
    wide = rows.groupBy(geo, day).agg(*wanted, F.count_if(F.col(signal) == base).alias("_base"))
    return wide.filter(F.col("_base") > 0).drop("_base")
