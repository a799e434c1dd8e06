"""Tabular sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from panelforge.operators.ordered import Order, with_row_id
from panelforge.sources.readers import CSV_TEXT


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    index: tuple[str, Order] | None = None,
) -> StructType:
    """Write a folder of files and return the schema to read it with, partition columns last; `index=(name, order)` adds a 1-based row index first; the order is
    any unique key."""
    if index is not None:
        name, order = index
        df = with_row_id(df, order, name)
        df = df.select(name, *[c for c in df.columns if c != name])
    writer = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, **CSV_TEXT)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    inside = [f for f in df.schema if f.name not in partition_by]
    return StructType([*inside, *[df.schema[c] for c in partition_by]])
