"""Typed scans of files and of long signal tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.sources.schemas import STUDY, TESTDATA

# Quotes inside quoted fields are doubled, as spreadsheets and statistics packages write them.
CSV_TEXT = {"quote": '"', "escape": '"'}


def scan(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """Read a table under an explicit schema; CSV files carry a header line."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # Columns are matched by position: published headers carry spaces and trailing blanks.
        reader = reader.option("header", True).option("enforceSchema", True)
    return reader.format(fmt).load(path)


def study_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    return scan(spark, path, STUDY[name], fmt)


def test_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan(spark, f"{folder}/{name}.parquet", TESTDATA[name])


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV read as text only, for sources with sentinels or positional column picks."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def signal_scan(
    signals: DataFrame,
    names: list[str],
    start: date,
    end: date,
    signal: str = "signal",
    time: str = "time_value",
    geo: str = "geo_value",
    geos: DataFrame | None = None,
) -> DataFrame:
    """Rows of some signals in a closed day range, for the places listed in `geos`.

    Signal and time predicates are plain comparisons on stored columns so they reach the file
    scan (the day range is half-open, which also serves timestamps); places are a semi join whose
    physical form follows the measured size of the list.
    """
    rows = signals.filter(
        F.col(signal).isin(names)
        & (F.col(time) >= F.lit(start))
        & (F.col(time) < F.lit(end + timedelta(days=1)))
    )
    if geos is not None:
        rows = rows.join(geos.select(geo), geo, "left_semi")
    return rows
