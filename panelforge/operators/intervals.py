"""Windows of days that come as a table: any number per entity, overlapping as they like.

Days are cut into blocks. Rows and windows meet by (entity, block), never by entity alone, so neither a
long series nor an entity with very many windows is one group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.dates import day_number

BLOCK_DAYS = 64


def _block(day: Column, days: int) -> Column:
    return F.floor(day / days)


def _own(df: DataFrame, made: Sequence[str]) -> None:
    """Refuse columns that would hide what is made here."""
    clash = {c for c in df.columns if c in made or c.startswith("_w_")}
    if clash:
        raise ValueError(f"columns of this name are made here: {sorted(clash)}")


def rows_in_windows(
    df: DataFrame,
    windows: DataFrame,
    entity: str,
    day: str,
    start: str,
    end: str,
    block_days: int = BLOCK_DAYS,
) -> DataFrame:
    """Every row of `df` once per window of its entity that holds its day (closed ends), with the
    window's columns.

    A window is sent once per block that it touches and each row to its own block, where the days are
    compared: a pair meets exactly once. Rows without entity or day are in no window; windows without
    entity or an end, or that end before they start, hold no rows. Repeated rows and windows each count.
    The result is as large as the windows overlap; use `window_totals` where sums are enough.
    """
    _own(df, [c for c in windows.columns if c != entity])
    _own(windows, [])
    low, high = day_number(F.col(start)), day_number(F.col(end))
    sent = windows.filter(F.col(entity).isNotNull() & (low <= high)).withColumns(
        {
            "_w_low": low,
            "_w_high": high,
            "_w_block": F.explode(F.sequence(_block(low, block_days), _block(high, block_days))),
        }
    )
    placed = df.withColumn("_w_day", day_number(F.col(day)))
    placed = placed.withColumn("_w_block", _block(F.col("_w_day"), block_days))
    met = placed.join(sent, [entity, "_w_block"])
    met = met.filter(F.col("_w_day").between(F.col("_w_low"), F.col("_w_high")))
    return met.drop("_w_block", "_w_day", "_w_low", "_w_high")


def _measures(floating: Mapping[str, bool]) -> dict[str, Column]:
    """What is added up per value: known cells, their sum and, for doubles, cells that are not finite.

    A NaN or an infinity would stay in every later running sum; such cells are counted instead, NaN in
    both directions.
    """
    out = {"_w_rows": F.count(F.lit(1))}
    for name, is_floating in floating.items():
        v, odd = F.col(f"_w_{name}"), F.lit(float("inf"))
        out[f"_w_{name}_n"] = F.count(v)
        out[f"_w_{name}_s"] = F.sum(F.when(~F.isnan(v) & (F.abs(v) != odd), v) if is_floating else v)
        if is_floating:
            out[f"_w_{name}_up"] = F.count_if(F.isnan(v) | (v == odd))
            out[f"_w_{name}_down"] = F.count_if(F.isnan(v) | (v == -odd))
    return out


def window_totals(
    df: DataFrame,
    windows: DataFrame,
    entity: str,
    day: str,
    start: str,
    end: str,
    values: Mapping[str, Column],
    block_days: int = BLOCK_DAYS,
    skip_nulls: bool = False,
) -> DataFrame:
    """Each row of `windows` with the number of rows in it (`rows`) and `{name}_sum`, `{name}_mean`.

    A window's total is the running total at its end less the one before its start, so the work does not
    grow with the length or the overlap of windows. Rows shrink to one cell per (entity, day) before they
    move. The days at which a total is asked for join these cells as empty ones, each once however many
    windows begin or end there. Running totals are taken within (entity, block) and over the few blocks
    of an entity, and windows fetch two of them by (entity, day).

    Windows keep all their rows, repeated ones too. Rows without entity or day are in no window. A window
    without entity or an end, or that ends before it starts, has 0 rows and null totals, as has an empty
    one. A null in a window makes its sum and mean null unless `skip_nulls`. NaN and infinities count in
    the windows that hold them only. Sums of whole numbers and decimals are exact; of doubles, a total
    loses the digits that the running total of its entity takes.
    """
    made = [f"{n}_{part}" for n in values for part in ("sum", "mean")]
    _own(windows, ["rows", *made])
    low, high = day_number(F.col(start)), day_number(F.col(end))
    holds = F.col(entity).isNotNull() & (low <= high)
    asked = windows.withColumns({"_w_before": F.when(holds, low - 1), "_w_last": F.when(holds, high)})
    rows = df.select(
        F.col(entity).alias("_w_entity"),
        day_number(F.col(day)).alias("_w_day"),
        *[v.alias(f"_w_{n}") for n, v in values.items()],
    ).dropna("any", subset=["_w_entity", "_w_day"])
    types = {n: rows.schema[f"_w_{n}"].dataType.typeName() for n in values}
    floating = {n: t in ("double", "float") for n, t in types.items()}
    measures = _measures(floating)
    cells = rows.groupBy("_w_entity", "_w_day").agg(*[c.alias(n) for n, c in measures.items()])
    edges = asked.select(
        F.col(entity).alias("_w_entity"), F.explode(F.array("_w_before", "_w_last")).alias("_w_day")
    )
    edges = edges.dropna("any").distinct().withColumn("_w_edge", F.lit(True))
    points = cells.join(edges, ["_w_entity", "_w_day"], "full").withColumn(
        "_w_block", _block(F.col("_w_day"), block_days)
    )
    block = ["_w_entity", "_w_block"]
    sums = {n: F.sum(n).alias(n) for n in measures}
    before = W.partitionBy("_w_entity").orderBy("_w_block").rowsBetween(W.unboundedPreceding, -1)
    carried = points.groupBy(*block).agg(*sums.values())
    carried = carried.select(*block, *[F.sum(n).over(before).alias(f"{n}_c") for n in measures])
    upto = W.partitionBy(*block).orderBy("_w_day").rowsBetween(W.unboundedPreceding, 0)
    inside = points.select(
        "_w_entity", "_w_block", "_w_day", "_w_edge", *[F.sum(n).over(upto).alias(n) for n in measures]
    )
    zero = F.lit(0)
    totals = (
        inside.filter("_w_edge")
        .join(carried, block)
        .select(
            "_w_entity",
            "_w_day",
            F.struct(
                *[(F.coalesce(n, zero) + F.coalesce(f"{n}_c", zero)).alias(n) for n in measures]
            ).alias("_w_total"),
        )
    )

    def at(edge: str, name: str) -> DataFrame:
        return totals.withColumnsRenamed(
            {"_w_entity": f"{edge}_entity", "_w_day": f"{edge}_day", "_w_total": name}
        )

    for edge, name in (("_w_before", "_w_lower"), ("_w_last", "_w_upper")):
        here = (F.col(entity) == F.col(f"{edge}_entity")) & (F.col(edge) == F.col(f"{edge}_day"))
        asked = asked.join(at(edge, name), here, "left")
    part = lambda n: F.col(f"_w_upper.{n}") - F.col(f"_w_lower.{n}")
    held = F.coalesce(part("_w_rows"), zero).cast("bigint")
    out = {"rows": held}
    for name in values:
        known, total = part(f"_w_{name}_n"), part(f"_w_{name}_s")
        if floating[name]:
            up, down = part(f"_w_{name}_up") > 0, part(f"_w_{name}_down") > 0
            total = (
                F.when(up & down, float("nan"))
                .when(up, float("inf"))
                .when(down, float("-inf"))
                .otherwise(total)
            )
        whole = known > 0 if skip_nulls else (known > 0) & (known == held)
        out[f"{name}_sum"] = F.when(whole, total)
        out[f"{name}_mean"] = F.when(whole, total.cast("double") / known)
    return asked.select(*windows.columns, *[c.alias(n) for n, c in out.items()])
