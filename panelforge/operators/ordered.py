"""Order-dependent operators.

Two families, chosen by how many rows one group may hold:

* *Series* operators work on frames already reduced to one row per (entity, day). A group is
  bounded by the length of the calendar, so a window partitioned by entity is safe.
* *Detail* operators (`*_detail`, `with_row_id`, `preceding_sums`, `next_in_order`) accept groups
  of any size. They split the order into ranges by approximate quantiles, work inside
  (group, range), and carry totals across the few ranges, so no task ever holds a whole group.

Their order is one number or date column without nulls, or any key: a text column, or a list of columns
of any types that Spark can sort, nulls first in each. Ranges of a key are cut at sampled keys.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order is cut into block * block ranges, found in two steps of `block` comparisons each. This is
# the least block; it grows with the shuffle partitions, and results do not depend on it.
BLOCK = 16


def range_block(df: DataFrame) -> int:
    """A block that gives at least four ranges per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(BLOCK, math.ceil(math.sqrt(4 * parts)))


def attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left-join columns of a one-row-per-key frame to every row; null keys match null keys.

    No hint: the planner broadcasts when the measured size allows and otherwise sorts and merges.
    The null-safe condition places both sides anew, which lets adaptive execution split a hot key
    of the detail side; a side already placed by its aggregate could not be split.
    """
    l, r = df.alias("_l"), small.alias("_r")
    cond = reduce(
        lambda a, b: a & b, [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys]
    )
    extra = [F.col(f"_r.`{c}`").alias(c) for c in small.columns if c not in keys]
    return l.join(r, cond, "left").select(*[F.col(f"_l.`{c}`") for c in df.columns], *extra)


# --- any group size ---------------------------------------------------------------------------

Order = str | Sequence[str]
_SAMPLED = 8  # sampled keys for each range
_PREFIX = 64  # characters of a text that a cut point keeps
_MEASURED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _with_key(df: DataFrame, order: Order) -> tuple[DataFrame, str]:
    """The frame and the column to sort by: the order itself, or `_key` for texts and lists."""
    if isinstance(order, str):
        if isinstance(df.schema[order].dataType, _MEASURED):
            return df, order
        order = [order]
    return df.withColumn("_key", F.struct(*[F.col(c) for c in order])), "_key"


def _sampled_cuts(df: DataFrame, key: str, ranges: int) -> DataFrame:
    """`c`: cut points of a struct key, taken from the keys with the smallest hashes.

    The sample is a function of the data, of a fixed size and uniform over distinct keys. Long texts
    are cut to a prefix, which bounds its bytes and is a cut point like any other.
    """
    short = lambda f: (
        F.substring(F.col(key)[f.name], 1, _PREFIX) if isinstance(f.dataType, T.StringType) else F.col(key)[f.name]
    )
    fields = df.schema[key].dataType.fields
    sample = (
        df.select(F.struct(*[short(f).alias(f.name) for f in fields]).alias("k"), F.xxhash64(key).alias("h"))
        .orderBy("h")
        .limit(_SAMPLED * ranges)
    )
    found = sample.agg(F.sort_array(F.collect_set("k")).alias("k"))
    at = lambda i: F.get("k", F.floor(i * F.size("k") / F.lit(ranges)).cast("int"))
    return found.select(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), at).alias("c"))


def with_range(
    df: DataFrame, order: str, touch: Sequence[str] = (), block: int | None = None
) -> DataFrame:
    """`_range`: number of quantile cut points below the order column, a deterministic range id.

    The cut points are one mergeable sketch over the column, or a sample if it is a struct, sent out as
    a scalar of fixed size.
    When `df` is itself an aggregate, `touch` names its aggregated columns: the sketch then needs
    the same shuffle as the main plan and reuses it instead of reading the source again.
    """
    size = block or range_block(df)
    ranges = size * size
    steps = [i / ranges for i in range(1, ranges)]
    if isinstance(df.schema[order].dataType, T.StructType):
        cuts, touch = _sampled_cuts(df, order, ranges), ()
    else:
        cuts = df.agg(
            F.percentile_approx(order, steps, 10 * ranges).alias("c"),
            *[F.max(t).alias(f"_touch_{t}") for t in touch],
        )
    coarse = F.array(*[F.element_at("c", i) for i in range(size, ranges, size)])
    touched = [F.col(f"_touch_{t}") for t in touch]
    both = cuts.select(
        F.struct(F.col("c").alias("fine"), coarse.alias("coarse"), *touched).alias("s")
    )
    # Comparisons are added up instead of searched by a lambda, which keeps them in compiled code.
    below = lambda cut: (cut < F.col(order)).cast("int")
    coarse_block = reduce(add, [below(F.get("_cuts.coarse", F.lit(i))) for i in range(size - 1)])
    fine = reduce(
        add, [below(F.get("_cuts.fine", F.col("_block") * size + i)) for i in range(size - 1)]
    )
    return (
        df.withColumn("_cuts", both.scalar())
        .withColumn("_block", coarse_block)
        .withColumn("_range", F.col("_block") * size + fine)
        .drop("_cuts", "_block")
    )


def sum_of_earlier_ranges(value: str, by: Sequence[str]) -> Column:
    """Over a frame with one row per (group, range): total of the group's earlier ranges."""
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(earlier), F.lit(0))


def preceding_sums(
    df: DataFrame,
    order: Order,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    peers: bool = False,
    touch: Sequence[str] = (),
) -> DataFrame:
    """For each row, the sum of each weight over the rows that come before it in its group.

    The order must be unique in its group unless `peers=True`: then rows with equal order are not
    before each other, and their own total is added as ``<name>_peers``.
    The result keeps the range id as `_range`.

    The totals of all earlier ranges arrive as one marker row per (group, range) that sorts first,
    so a single window over (group, range) yields the answer: one shuffle, no join.
    """
    by = list(by)
    keyed, order = _with_key(df, order)
    split = with_range(keyed, order, touch)
    split = split.withColumns({f"_w_{n}": w for n, w in sums.items()})
    weights = [f"_w_{n}" for n in sums]
    totals = split.groupBy(*by, "_range").agg(*[F.sum(w).alias(w) for w in weights])
    markers = totals.select(
        *by,
        "_range",
        *[sum_of_earlier_ranges(w, by).alias(w) for w in weights],
        F.lit(True).alias("_marker"),
    )
    rows = split.withColumn("_marker", F.lit(False)).unionByName(markers, allowMissingColumns=True)
    inside = W.partitionBy(*by, "_range").orderBy(F.asc_nulls_first(order))
    out = {}
    for n, w in zip(sums, weights):
        if peers:
            same = F.sum(w).over(W.partitionBy(*by, "_range", order))
            upto = F.sum(w).over(inside.rangeBetween(W.unboundedPreceding, 0))
            out[n], out[f"{n}_peers"] = upto - same, same
        else:
            out[n] = F.sum(w).over(inside.rowsBetween(W.unboundedPreceding, -1))
    found = rows.select(*df.columns, "_range", "_marker", *[c.alias(n) for n, c in out.items()])
    return found.filter(~F.col("_marker")).drop("_marker")


def with_row_id(df: DataFrame, order: Order, name: str = "id") -> DataFrame:
    """Consecutive 1-based row number in the order of a unique key."""
    numbered = preceding_sums(df, order, {name: F.lit(1).cast("bigint")}).drop("_range")
    return numbered.withColumn(name, F.col(name) + 1)


def next_in_order(
    df: DataFrame, by: Sequence[str], order: Order, columns: Sequence[str], closed: bool = False
) -> DataFrame:
    """Columns of the following row of the group as `next_<column>` and of the group's first row
    as `first_<column>`; `closed` wraps the last row to the first one.

    The first row of the next range arrives as a marker row that sorts last in its range.
    """
    by = list(by)
    keyed, order = _with_key(df, order)
    split = with_range(keyed, order)
    packed = F.struct(*columns)
    along = W.partitionBy(*by).orderBy("_range")
    heads = split.groupBy(*by, "_range").agg(F.min_by(packed, F.col(order)).alias("_head"))
    first = F.first("_head").over(along.rowsBetween(W.unboundedPreceding, 0))
    follow = F.lead("_head").over(along)
    markers = heads.select(
        *by,
        "_range",
        (F.coalesce(follow, first) if closed else follow).alias("_row"),
        first.alias("_first"),
        F.lit(True).alias("_marker"),
    )
    rows = split.withColumns({"_row": packed, "_marker": F.lit(False)}).unionByName(
        markers, allowMissingColumns=True
    )
    group = W.partitionBy(*by, "_range")
    onward = group.orderBy(F.asc_nulls_last(order))
    out = rows.select(
        *df.columns,
        "_marker",
        F.lead("_row").over(onward).alias("_next"),
        F.max("_first").over(group).alias("_start"),
    ).filter(~F.col("_marker"))
    return out.select(
        *df.columns,
        *[F.col(f"_next.`{c}`").alias(f"next_{c}") for c in columns],
        *[F.col(f"_start.`{c}`").alias(f"first_{c}") for c in columns],
    )


def duplicates_detail(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every row of a key but the first one in order."""
    firsts = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return attach(df, firsts, keys).filter(F.col(order) > F.col("_first")).drop("_first")


def rows_at_max_detail(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Rows that hold their group's maximum; all ties stay."""
    tops = df.groupBy(*by).agg(F.max(value).alias("_top"))
    return attach(df, tops, by).filter(F.col(value) == F.col("_top")).drop("_top")


def first_last_rows_detail(df: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """First and last row of each group with its position and the group size.

    Each map task sends two rows per group; `order` must be unique in its group.
    """
    row = F.struct(*[c for c in df.columns if c not in by])
    ends = df.groupBy(*by).agg(
        F.min_by(row, order).alias("_first"),
        F.max_by(row, order).alias("_last"),
        F.count(F.lit(1)).alias("group_size"),
    )
    at = lambda end, position: F.struct(
        F.col(end).alias("row"), position.cast("bigint").alias("position")
    )
    first, last = at("_first", F.lit(1)), at("_last", F.col("group_size"))
    both = F.when(F.col("group_size") > 1, F.array(first, last)).otherwise(F.array(first))
    rows = ends.select(*by, "group_size", F.explode(both).alias("_e"))
    return rows.select(
        *[F.col(c) if c in by else F.col(f"_e.row.`{c}`").alias(c) for c in df.columns],
        F.col("_e.position").alias("position"),
        "group_size",
    )


def group_total_detail(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """A group's total next to each of its rows."""
    return attach(df, df.groupBy(*by).agg(F.sum(value).alias(name)), by)


def pick_largest(
    df: DataFrame, by: Sequence[str], score: str, tie: str, keep: Sequence[str]
) -> DataFrame:
    """The row with the largest score per group, the smallest `tie` among equals.

    An aggregate, not a window: each map task sends one candidate per group. Groups whose scores
    are all null give no row.
    """
    kept = [c for c in dict.fromkeys([*keep, score]) if c not in by]
    best = df.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.min_by(F.struct(*kept), F.struct((-F.col(score)).alias("s"), F.col(tie).alias("t"))).alias(
            "_best"
        )
    )
    return best.select(*by, *[F.col(f"_best.`{c}`").alias(c) for c in kept])


# --- one row per (entity, day) ----------------------------------------------------------------


def densify(
    counts: DataFrame,
    entities: DataFrame,
    entity: str,
    day: str,
    values: Sequence[str],
    seen: DataFrame | None = None,
) -> DataFrame:
    """One row per entity and calendar day between the first and last day seen; gaps hold 0.

    `seen` may name a cheaper frame to take the first and last day from than `counts` itself.

    Counts of an entity that is not listed are an error.

    The calendar comes as a scalar, so there is no cross join. One marker row per entity travels
    with the counts and turns into zero rows only after both are placed by entity: the shuffle
    holds the days that were seen, not the grid. That one placement serves the sum and every
    window or fold by entity that follows. The number of partitions is given, because the panel
    is small in bytes but long in work: left alone, adaptive execution would merge it into a few
    tasks.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = list(values)
    attributes = [c for c in entities.columns if c != entity]
    days = (counts if seen is None else seen).agg(F.sequence(F.min(day), F.max(day)).alias("days"))
    marked = entities.withColumn("_known", F.lit(True))
    rows = counts.select(entity, day, *values).unionByName(marked, allowMissingColumns=True)
    placed = rows.repartition(parts, entity)
    own = F.when(F.col("_known"), days.scalar()).otherwise(F.array(day))
    return (
        placed.withColumn("_days", own)
        .select(
            entity,
            F.explode("_days").alias(day),
            *attributes,
            *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values],
            "_known",
        )
        .groupBy(entity, day)
        .agg(
            *[F.max(a).alias(a) for a in attributes],
            *[F.sum(v).alias(v) for v in values],
            F.count_if("_known").alias("_n"),
        )
        .filter(
            F.when(F.col("_n") > 0, F.lit(True)).otherwise(
                F.raise_error(F.lit(f"counts of a {entity} that is not among the entities")).cast("boolean")
            )
        )
        .drop("_n")
    )


def series(entity: str | Sequence[str], order: str) -> "W":
    keys = [entity] if isinstance(entity, str) else list(entity)
    return W.partitionBy(*keys).orderBy(order)


def running_total(value: str | Column, entity, order: str) -> Column:
    return F.sum(value).over(series(entity, order).rowsBetween(W.unboundedPreceding, 0))


def lag_rows(value: str | Column, k: int, entity, order: str) -> Column:
    return F.lag(value, k).over(series(entity, order))


def centered_mean(value: str | Column, k: int, entity, order: str) -> Column:
    """Mean of the k rows centred on each row, null where the frame is not full."""
    half = k // 2
    frame = series(entity, order).rowsBetween(-half, k - 1 - half)
    return F.when(F.count(value).over(frame) == k, F.avg(value).over(frame))


def first_last_change(
    df: DataFrame, by: Sequence[str], order: str, value: str, name: str = "change"
) -> DataFrame:
    """Last value minus first value per group in one aggregate; one-row groups give null."""
    ends = df.groupBy(*by).agg(
        F.min_by(value, order).alias("y0"),
        F.max_by(value, order).alias("y1"),
        F.count(F.lit(1)).alias("_n"),
    )
    return ends.withColumn(name, F.when(F.col("_n") > 1, F.col("y1") - F.col("y0"))).drop("_n")


def interval_endpoints(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """First (y0) and last (y1) value per group; a one-row group has only y0."""
    return first_last_change(df, by, order, value, "_d").select(
        *by, "y0", F.when(F.col("_d").isNotNull(), F.col("y1")).alias("y1")
    )


def label_windows(windows: Sequence[tuple[Column, str]]) -> Column:
    """First matching window label, null outside all windows."""
    (first, name), *rest = windows
    out = F.when(first, name)
    for cond, label in rest:
        out = out.when(cond, label)
    return out


def window_profile(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    level: str,
    means: Sequence[str],
) -> DataFrame:
    """Per (entity, window): mean of each signal and the increment of a cumulative column."""
    out = df.groupBy(*by).agg(
        *[F.avg(m).alias(f"avg_{m}") for m in means],
        F.count(F.lit(1)).alias("_n"),
        F.max_by(level, order).alias("_y1"),
        F.min_by(level, order).alias("_y0"),
    )
    rise = F.when(F.col("_n") > 1, F.col("_y1") - F.col("_y0"))
    return out.withColumn("increment", rise).drop("_n", "_y1", "_y0")


def previous_period(
    df: DataFrame, entity: str, period_rank: str, value: str, name: str = "y0"
) -> DataFrame:
    """The value of the entity's preceding period; rows without one are dropped."""
    return df.withColumn(name, lag_rows(value, 1, entity, period_rank)).filter(
        F.col(name).isNotNull()
    )


def lag_shift_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    day: str,
    days: int,
    how: str = "inner",
) -> DataFrame:
    """Equi-join with the right side's dates moved by `days` (negative = earlier)."""
    moved = right.withColumn(day, F.date_add(day, days))
    return left.join(moved, [*keys, day], how)
