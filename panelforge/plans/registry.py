"""Query registry: a Spark build function, an output contract, and an optional SQL oracle.

The output contract fixes names, types and rounding once for both engines, so a query and its
oracle differ only in how they compute. It is a space-separated list of ``name:kind``:
``i`` int, ``l`` bigint, ``s`` text, ``b`` boolean, ``d`` date as ISO text, ``fN`` double
rounded to N digits (sums of doubles depend on the order of addition in their last bits).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.plans.standins import Data, with_views

_SPARK = {"i": "int", "l": "bigint", "s": "string", "b": "boolean"}
_SQL = {"i": "INTEGER", "l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _fields(out: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in out.split()]


def emit(df: DataFrame, out: str) -> DataFrame:
    cols = []
    for name, kind in _fields(out):
        c = F.col(name)
        if kind == "d":
            c = c.cast("date").cast("string")
        elif kind[0] == "f":
            c = F.round(c.cast("double"), int(kind[1:])) + F.lit(0.0)
        else:
            c = c.cast(_SPARK[kind])
        cols.append(c.alias(name))
    return df.select(*cols)


def emit_sql(sql: str, out: str) -> str:
    cols = []
    for name, kind in _fields(out):
        if kind == "d":
            c = f"CAST(CAST({name} AS DATE) AS VARCHAR)"
        elif kind[0] == "f":
            c = f"round(CAST({name} AS DOUBLE), {kind[1:]}) + CAST(0.0 AS DOUBLE)"
        else:
            c = f"CAST({name} AS {_SQL[kind]})"
        cols.append(f"{c} AS {name}")
    return with_views(f"SELECT {', '.join(cols)} FROM ({sql}) AS answer")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Data], DataFrame]
    out: str
    oracle: str | None = None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return emit(self.build(Data(spark, folder)), self.out)

    def sql(self) -> str | None:
        return None if self.oracle is None else emit_sql(self.oracle, self.out)


QUERIES: dict[str, Query] = {}


def query(out: str, oracle: str | None = None, name: str | None = None):
    def register(build: Callable[[Data], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = Query(key, build, out, oracle)
        return build

    return register
