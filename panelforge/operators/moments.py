"""Weighted centred moments of two columns per test, in one pass.

Every task reduces its rows to one part per test, batch by batch: the number of rows, the weight, the
weighted means and the centred products. Only parts move; parts of one test are added around their common
mean, so no row meets its test's mean by a join and no task holds the rows of a test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HELD = 1024  # tests whose parts a task keeps at once
_SUMS = ["w", "x", "y", "sxx", "sxy", "syy"]


def _codes(tests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number per test in order of appearance, and the place of the first row of each."""
    if pa.types.is_nested(tests.type):  # has no dictionary; equal values have equal texts
        tests = pa.array([repr(v) for v in tests.to_pylist()])
    code = tests.dictionary_encode(null_encoding="encode").indices.to_numpy()
    first = np.empty(code.max() + 1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return code, first


def _added(part: pa.RecordBatch) -> pa.RecordBatch:
    """Parts of the same test as one; distances are from a part of the test itself, so equal values
    have squares of exactly zero."""
    code, first = _codes(part.column(0))
    n, w, x, y, sxx, sxy, syy = [c.to_numpy() for c in part.columns[1:]]
    total = lambda v: np.bincount(code, v, len(first))
    with np.errstate(all="ignore"):
        weight = total(w)
        dx, dy = x - x[first][code], y - y[first][code]
        mx, my = total(w * dx) / weight, total(w * dy) / weight
        dx, dy = dx - mx[code], dy - my[code]
        sums = [
            weight,
            x[first] + mx,
            y[first] + my,
            total(sxx + w * dx * dx),
            total(sxy + w * dx * dy),
            total(syy + w * dy * dy),
        ]
    leads = np.zeros(len(code), dtype=bool)
    leads[first] = True
    tests = part.column(0).filter(pa.array(leads))
    cells = [pa.array(c) for c in (total(n).astype(np.int64), *sums)]
    return pa.RecordBatch.from_arrays([tests, *cells], part.schema.names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        none = pa.array(np.zeros(batch.num_rows))
        n = pa.array(np.ones(batch.num_rows, dtype=np.int64))
        tests, *cells = batch.columns
        rows = pa.RecordBatch.from_arrays([tests, n, *cells, none, none, none], ["test", "n", *_SUMS])
        part = _added(rows)
        if held is not None:
            both = [pa.concat_arrays(pair) for pair in zip(held.columns, part.columns)]
            part = _added(pa.RecordBatch.from_arrays(both, part.schema.names))
        held = part
        if held.num_rows > _HELD:
            yield held
            held = None
    if held is not None:
        yield held


def weighted_moments(df: DataFrame, x: str, y: str, weight: str, test: str) -> DataFrame:
    """One row per `test`: `n`, `w` (the sum of the weights), the weighted means `x` and `y` and the
    weighted centred products `sxx`, `sxy`, `syy`.

    Rows with a null in x or y, and those without a weight above zero, do not count. Null tests are a
    test. The test is named `test` in the result.
    """
    double = lambda c: F.col(c).cast("double")
    rows = df.filter(F.col(y).isNotNull() & F.col(x).isNotNull() & (F.col(weight) > 0)).select(
        F.col(test).alias("test"), double(weight).alias("w"), double(x).alias("x"), double(y).alias("y")
    )
    kind = T.StructType([rows.schema["test"], T.StructField("n", T.LongType())])
    for name in _SUMS:
        kind = kind.add(name, T.DoubleType())
    whole = W.partitionBy("test")
    parts = rows.mapInArrow(_parts, kind).withColumns(
        {"_x": F.min("x").over(whole), "_y": F.min("y").over(whole)}
    )
    w, dx, dy = F.col("w"), F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    mean = lambda d: F.sum(w * d).over(whole) / F.sum(w).over(whole)
    parts = parts.withColumns({"_dx": mean(dx), "_dy": mean(dy)})
    dx, dy = dx - F.col("_dx"), dy - F.col("_dy")
    return parts.groupBy("test").agg(
        F.sum("n").alias("n"),
        F.sum("w").alias("w"),
        F.max(F.col("_x") + F.col("_dx")).alias("x"),
        F.max(F.col("_y") + F.col("_dy")).alias("y"),
        F.sum(F.col("sxx") + w * dx * dx).alias("sxx"),
        F.sum(F.col("sxy") + w * dx * dy).alias("sxy"),
        F.sum(F.col("syy") + w * dy * dy).alias("syy"),
    )
