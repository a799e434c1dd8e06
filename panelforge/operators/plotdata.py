"""Data behind box plots, histograms and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators.ordered import attach, next_in_order
from panelforge.operators.selection import SMALL, select_ranks
from panelforge.session import kept_table


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[tuple[str, float]],
    small: int = SMALL,
) -> DataFrame:
    """Interpolated quantiles per group, by repeated selection of ranges.

    Values move only inside the ranges that hold a wanted rank. No task gathers a group.
    """
    if not by:
        all_rows = df.withColumn("_all", F.lit(True))
        return exact_quantiles(all_rows, ["_all"], value, probs, small).drop("_all")
    at = {name: F.lit(p) * (F.col("n") - 1) for name, p in probs}
    ranks = {}
    for name, r in at.items():
        ranks |= {f"_lo_{name}": F.floor(r), f"_hi_{name}": F.ceil(r)}
    out = select_ranks(df, by, value, ranks, small)
    for name, r in at.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out = out.withColumn(name, lo + (hi - lo) * (r - F.floor(r)))
    return out.select(*by, "n", *at)


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str, small: int = SMALL) -> DataFrame:
    """Quartiles, whiskers (extremes within 1.5 box heights) and the number of outliers.

    The quartiles are a small table; one more pass over the raw column counts what lies between the
    fences of each group. No value moves for it.
    """
    if not by:
        all_rows = df.withColumn("_all", F.lit(True))
        return boxplot_stats(all_rows, ["_all"], value, small).drop("_all")
    by = list(by)
    probs = [("q1", 0.25), ("median", 0.5), ("q3", 0.75)]
    boxes = kept_table(exact_quantiles(df, by, value, probs, small), "boxes")
    height = F.col("q3") - F.col("q1")
    fences = boxes.select(
        *by, (F.col("q1") - 1.5 * height).alias("_lo"), (F.col("q3") + 1.5 * height).alias("_hi")
    )
    v = F.col(value)
    rows = attach(df.filter(v.isNotNull()).select(*by, value), fences, by)
    ends = rows.filter(v.between(F.col("_lo"), F.col("_hi"))).groupBy(*by).agg(
        F.min(v).alias("whisker_low"), F.max(v).alias("whisker_high"), F.count(F.lit(1)).alias("_inside")
    )
    out = attach(boxes, ends, by)
    return out.withColumn("outliers", F.col("n") - F.col("_inside")).drop("_inside")


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal-width bins over the whole range; the top edge belongs to the last bin."""
    rows = df.filter(F.col(value).isNotNull())
    span = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s"))
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / bins
    place = F.when(width > 0, F.floor((F.col(value) - lo) / width)).otherwise(0)
    framed = rows.withColumn("_s", span.scalar()).withColumn(
        "bin", F.least(place, F.lit(bins - 1)).cast("int")
    )
    return framed.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.max(lo + F.col("bin") * width).alias("lower")
    )


def polygon_centroids(
    vertices: DataFrame, by: Sequence[str], vertex: str, x: str, y: str
) -> DataFrame:
    """Area centroid of each closed ring by the shoelace sums.

    Coordinates are taken relative to the ring's first vertex, which keeps small rings far from
    the origin accurate.
    """
    edges = next_in_order(vertices.select(*by, vertex, x, y), by, vertex, [x, y], closed=True)
    ox, oy = F.col(f"first_{x}"), F.col(f"first_{y}")
    x0, y0 = F.col(x) - ox, F.col(y) - oy
    x1, y1 = F.col(f"next_{x}") - ox, F.col(f"next_{y}") - oy
    cross = x0 * y1 - x1 * y0
    sums = edges.groupBy(*by).agg(
        F.count(F.lit(1)).alias("vertices"),
        F.sum(cross).alias("_a"),
        F.sum((x0 + x1) * cross).alias("_cx"),
        F.sum((y0 + y1) * cross).alias("_cy"),
        F.max(ox).alias("_ox"),
        F.max(oy).alias("_oy"),
    )
    three = 3 * F.col("_a")
    return sums.select(
        *by,
        "vertices",
        (F.abs("_a") / 2).alias("area"),
        (F.col("_ox") + F.try_divide(F.col("_cx"), three)).alias("center_x"),
        (F.col("_oy") + F.try_divide(F.col("_cy"), three)).alias("center_y"),
    )
