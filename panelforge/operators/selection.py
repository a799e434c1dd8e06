"""Order statistics by repeated selection of value ranges.

A first pass counts the raw values of each group in ranges cut at quantiles of the whole column. The counts
tell which range holds a wanted rank. Ranges that are still large are cut again, at quantiles of their own
values, until they are small or hold one value; only then do values move, and only those of ranges that
hold a wanted rank. Every pass sends one row per (group, range) and task, so a group may be of any size.

The ranges found in a pass are a small table that is written once, because the next step depends on it.
A range always leaves its least and its largest value behind as ranges of their own when it is cut, so
ties of any number end the cutting.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.operators.ordered import range_block, sum_of_earlier_ranges
from panelforge.session import kept_table

SMALL = 1 << 20  # rows of a range whose values may be sorted in one task
CUTS = 256  # cut points of a range that is cut again


def _below(value: Column, cuts: Sequence) -> Column:
    """How many of the sorted cuts lie below the value, by two steps of compiled comparisons."""
    if not cuts:
        return F.lit(0)
    block = math.isqrt(len(cuts) - 1) + 1
    padded = [*cuts, *[cuts[-1]] * (block * block - len(cuts))]
    less = lambda c: (c < value).cast("int")
    coarse = reduce(add, [less(F.lit(c)) for c in padded[block - 1 :: block]])
    table, first = F.array(*[F.lit(c) for c in padded]), F.least(coarse, F.lit(block - 1)) * block
    return first + reduce(add, [less(F.get(table, first + i)) for i in range(block)])


def _same(by: Sequence[str]) -> Column:
    """The group of `_l` is that of `_r`; null groups are groups."""
    return reduce(lambda a, b: a & b, [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in by])


def _inside(rows: DataFrame, cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The rows whose value lies in a cell of their group, with the cell's columns."""
    v = F.col(f"_l.`{value}`")
    held = (v >= F.col("_r._lo")) & (v <= F.col("_r._hi"))
    extra = [F.col(f"_r.`{c}`").alias(c) for c in cells.columns if c not in by]
    joined = rows.alias("_l").join(cells.alias("_r"), _same(by) & held)
    return joined.select(*[F.col(f"_l.`{c}`").alias(c) for c in [*by, value]], *extra)


def _cell_counts(placed: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return placed.groupBy(*keys, "_range").agg(
        F.count(F.lit(1)).alias("_t"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )


def first_cells(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per (group, range of the whole column): least and largest value, rows, rows before it in the
    group (`_before`), and the group's size `n`."""
    ranges = range_block(rows) ** 2
    steps = [i / ranges for i in range(1, ranges)]
    # A sketch of fixed size; the cut points become constants of the passes that follow.
    cuts = rows.agg(F.percentile_approx(value, steps, 10 * ranges).alias("c")).first()["c"]
    counts = _cell_counts(rows.withColumn("_range", _below(F.col(value), sorted(set(cuts or [])))), by, value)
    return counts.withColumns(
        {"_before": sum_of_earlier_ranges("_t", by), "n": F.sum("_t").over(W.partitionBy(*by))}
    ).select(*by, "_lo", "_hi", "_t", "_before", "n")


def _cut_again(rows: DataFrame, cells: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The cells cut at quantiles of their own values."""
    steps = [i / CUTS for i in range(1, CUTS)]
    own = [*by, "_lo", "_hi"]
    sketch = _inside(rows, cells, by, value).groupBy(*own, "_before", "n").agg(
        F.percentile_approx(value, steps, 10 * CUTS).alias("_cuts")
    )
    held = _inside(rows, sketch, by, value)
    v = F.col(value)
    place = (
        F.when(v == F.col("_cell"), -1)
        .when(v == F.col("_end"), CUTS)
        .otherwise(F.size(F.filter("_cuts", lambda c: c < v)))
    )
    # The old bounds name the cell while its parts are counted.
    held = held.withColumnsRenamed({"_lo": "_cell", "_hi": "_end"}).withColumn("_range", place)
    parts = held.groupBy(*by, "_cell", "_before", "n", "_range").agg(
        F.count(F.lit(1)).alias("_t"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    earlier = sum_of_earlier_ranges("_t", [*by, "_cell"])
    return parts.withColumn("_before", F.col("_before") + earlier).select(
        *by, "_lo", "_hi", "_t", "_before", "n"
    )


def select_ranks(
    df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column], small: int = SMALL
) -> DataFrame:
    """The values at the given 0-based ranks of each group, with the group's size `n`.

    A rank is an expression of `n`; one outside the group gives null. Null values do not count.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, value)
    through = F.col("_before") + F.col("_t")
    holds = {name: (F.col("_before") <= r) & (r < through) for name, r in ranks.items()}
    wanted = reduce(lambda a, b: a | b, holds.values())
    large = (F.col("_t") > small) & (F.col("_lo") < F.col("_hi"))
    cells = kept_table(first_cells(rows, by, value), "ranges")
    sizes = cells.select(*by, "n").distinct()
    cells = cells.filter(wanted)
    while not (again := cells.filter(large)).isEmpty():
        parts = _cut_again(rows, again, by, value).filter(wanted)
        cells = kept_table(cells.filter(~large).unionByName(parts), "ranges")
    several = cells.filter(F.col("_lo") < F.col("_hi"))
    single = cells.filter(F.col("_lo") == F.col("_hi")).select(
        *by, "n", F.col("_lo").alias(value), "_before", "_t"
    )
    found = _inside(rows, several, by, value)
    counts = found.groupBy(*by, "n", "_lo", "_before", value).agg(F.count(F.lit(1)).alias("_t"))
    inside = W.partitionBy(*by, "_lo").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_t").over(inside), F.lit(0)))
    both = placed.select(*by, "n", value, "_before", "_t").unionByName(single)
    picks = [F.max(F.when(h, F.col(value))).alias(name) for name, h in holds.items()]
    chosen = both.groupBy(*by).agg(*picks)
    out = sizes.alias("_l").join(chosen.alias("_r"), _same(by), "left")
    return out.select(
        *[F.col(f"_l.`{c}`").alias(c) for c in [*by, "n"]], *[F.col(f"_r.`{c}`").alias(c) for c in ranks]
    )
