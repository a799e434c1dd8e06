"""Choosing, naming and typing columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.text import DATE_LIKE
from panelforge.operators.ordered import attach, preceding_sums


def at_positions(df: DataFrame, positions: str) -> DataFrame:
    """Columns by 1-based positions and ranges, e.g. ``"1,14-20,38-50"``."""
    picked: list[str] = []
    for part in positions.split(","):
        lo, _, hi = part.strip().partition("-")
        if not 1 <= int(lo) <= int(hi or lo) <= len(df.columns):
            raise ValueError(f"positions {part} of {len(df.columns)} columns")
        picked += df.columns[int(lo) - 1 : int(hi or lo)]
    return df.select(*[F.col(f"`{c}`") for c in picked])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by ``{old: new}``; an unknown old name is an error, not a silent no-op."""
    unknown = set(names) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return df.withColumnsRenamed(dict(names))


def rename_positions(df: DataFrame, names: Mapping[int, str]) -> DataFrame:
    return rename(df, {df.columns[i - 1]: new for i, new in names.items()})


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case names with blanks, dots and slashes as underscores."""
    return df.toDF(*[re.sub(r"[\s./]+", "_", c.strip().lower()) for c in df.columns])


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def detect_date_columns(df: DataFrame, pattern: str = DATE_LIKE) -> DataFrame:
    """One row per text column: does any value look like a date? One pass over the table."""
    cols = text_columns(df)
    flags = df.agg(*[F.max(F.col(c).rlike(pattern)).alias(c) for c in cols])
    return flags.unpivot([], cols, "column_name", "is_date").withColumn(
        "is_date", F.coalesce("is_date", F.lit(False))
    )


def value_frequencies(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count of each value of each text column; nulls are not counted."""
    cols = list(columns or text_columns(df))
    long = df.select(*cols).unpivot([], cols, "column_name", "value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reorder_by_aggregate(
    df: DataFrame, category: str, value: str, fn=F.max, descending: bool = True
) -> DataFrame:
    """Categories with an aggregate of a column and their dense rank by it.

    Ranking goes over the distinct aggregate values, split in ranges, so the number of categories
    may be as large as the number of entities.
    """
    totals = df.groupBy(category).agg(fn(value).cast("double").alias("total"))
    key = -F.col("total") if descending else F.col("total")
    totals = totals.withColumn("_key", key)
    levels = preceding_sums(
        totals.select("_key").filter(F.col("_key").isNotNull()).distinct(),
        "_key",
        {"rank": F.lit(1).cast("bigint")},
    ).select("_key", (F.col("rank") + 1).alias("rank"))
    return attach(totals, levels, ["_key"]).drop("_key")
