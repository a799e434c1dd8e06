"""Signal archives laid out so that a request reads its own folders only.

An archive is partitioned by signal, month and area. An area is one of a fixed number of groups of places,
so the number of folders does not grow with the places. A request is a table too: its months and areas
are joined to the partition columns, and Spark leaves out the folders of others when the query runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

AREAS = 16


def area_of(place: Column, areas: int = AREAS) -> Column:
    """The group of a place; the same for equal values of any integer or text type."""
    return F.pmod(F.xxhash64(place.cast("string")), F.lit(areas)).cast("int")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def write_signals(
    df: DataFrame, path: str, signal: str, time: str, geo: str, areas: int = AREAS
) -> StructType:
    """Write the archive and return its schema: the columns of `df`, then `month` and `area`.

    Rows of a folder are brought together by a rebalance, which splits the folders that are large and
    joins small ones, so a hot signal or place is written by many tasks and none gets a file per task.
    Rows without signal, day or place are kept, in folders of their own.
    """
    clash = {"month", "area"} & set(df.columns)
    if clash:
        raise ValueError(f"columns of this name are made here: {sorted(clash)}")
    parts = [signal, "month", "area"]
    rows = df.withColumns({"month": month_of(F.col(time)), "area": area_of(F.col(geo), areas)})
    rows.hint("rebalance", *parts).sortWithinPartitions(*parts, geo, time).write.partitionBy(
        *parts
    ).parquet(path)
    return rows.schema


def request_signals(
    spark: SparkSession,
    path: str,
    schema: StructType,
    requests: DataFrame,
    places: DataFrame,
    signal: str,
    time: str,
    geo: str,
    areas: int = AREAS,
) -> DataFrame:
    """Rows of an archive for the listed places and for any of the requests (`signal`, `start`, `end`).

    `requests` holds closed day ranges, which may overlap: a row is returned once. A request opens the months
    that it touches. Both lists are joined on partition columns first, so wherever Spark takes them as
    small enough to broadcast, they prune folders before any file is opened; otherwise the result is
    the same by sorted merges. Requests and places with nulls find nothing.
    """
    first, last = F.trunc("start", "month"), F.trunc("end", "month")
    months = (
        requests.filter(F.col("start") <= F.col("end"))
        .select(
            F.col("signal").alias("_signal"),
            F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("_first"),
            F.struct("start", "end").alias("_range"),
        )
        .groupBy("_signal", month_of(F.col("_first")).alias("_month"))
        .agg(F.collect_set("_range").alias("_ranges"))
    )
    wanted = places.select(F.col(geo).alias("_geo")).dropna().distinct()
    areas_of = wanted.withColumn("_area", area_of(F.col("_geo"), areas))
    rows = spark.read.schema(schema).parquet(path)
    rows = rows.join(months, (F.col(signal) == F.col("_signal")) & (F.col("month") == F.col("_month")))
    day = F.to_date(F.col(time))
    rows = rows.filter(F.exists("_ranges", lambda r: day.between(r["start"], r["end"])))
    rows = rows.join(
        areas_of, (F.col("area") == F.col("_area")) & (F.col(geo) == F.col("_geo")), "left_semi"
    )
    return rows.select(*[c for c in schema.names if c not in ("month", "area")])
