"""Least squares by merged triangular factors.

A regression is fitted from the triangular factor of its rows (intercept, terms, outcome). Every task
reduces its rows to one factor per test, batch by batch; factors of tasks are stacked and factored again
in two steps, and the last one, of a few numbers, is solved. Moments are never squared, so columns that
are nearly parallel keep their digits, which cross moments lose.

Terms are taken in their order. One that the earlier terms explain up to `TOLERANCE` of its length is
dependent: it gets null estimates, and the fit is that of the other terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelforge.functions.tails import f_pvalue, t_pvalue

TOLERANCE = 1e-7
_HELD = 1024  # tests whose factors a task keeps at once
_SALTS = 64
_RESULT = {"term", "n", "df1", "df2", "r2", "adj_r2", "f", "est", "se", "t", "p", "f_p"}


def _factor(rows: np.ndarray) -> np.ndarray:
    """The square triangular factor of the rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def _columns(test, factors: list[tuple[int, np.ndarray]], kind: pa.DataType) -> list[pa.Array]:
    flat = [f.ravel().tolist() for _, f in factors]
    return [
        pa.array(test, kind),
        pa.array([n for n, _ in factors], pa.int64()),
        pa.array(flat, pa.list_(pa.float64())),
    ]


def _factors(width: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out():
            batch = pa.RecordBatch.from_arrays(_columns(list(held), list(held.values()), kind), ["test", "n", "r"])
            held.clear()
            return batch

        for batch in batches:
            if not batch.num_rows:
                continue
            encoded = batch.column(0).dictionary_encode(null_encoding="encode")
            code = encoded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            cells = [np.ones(batch.num_rows), *[batch.column(i).to_numpy() for i in range(1, width)]]
            rows = np.column_stack(cells)[order]
            ends = np.cumsum(np.bincount(code, minlength=len(encoded.dictionary)))
            for test, low, high in zip(encoded.dictionary.to_pylist(), np.append(0, ends[:-1]), ends):
                n, part = high - low, rows[low:high]
                if test in held:
                    n, part = n + held[test][0], np.vstack([held[test][1], part])
                held[test] = (int(n), _factor(part))
            if len(held) > _HELD:
                yield out()
        if held:
            yield out()

    return run


def _merged(table: pa.Table, width: int) -> tuple[int, np.ndarray]:
    flat = table.column("r").combine_chunks().flatten().to_numpy()
    return int(np.sum(table.column("n").to_numpy())), _factor(flat.reshape(-1, width))


def _merge(width: int, kind: pa.DataType):
    def run(table: pa.Table) -> pa.Table:
        test = [table.column("test")[0].as_py()]
        return pa.table(dict(zip(["test", "n", "r"], _columns(test, [_merged(table, width)], kind))))

    return run


def solve(n: int, factor: np.ndarray) -> dict:
    """Estimates and errors (None for dependent terms), and the whole fit, from the factor of
    (intercept, terms, outcome)."""
    x, y = factor[:, :-1], factor[:, -1]
    kept, q, r = [], np.zeros((len(x), 0)), np.zeros((0, 0))
    for j in range(x.shape[1]):
        v, c = x[:, j].copy(), np.zeros(q.shape[1])
        for _ in range(2):  # the second projection takes out what rounding left
            part = q.T @ v
            v, c = v - q @ part, c + part
        size = float(np.linalg.norm(v))
        if size > TOLERANCE * float(np.linalg.norm(x[:, j])):
            kept.append(j)
            k = len(kept)
            r = np.block([[r, c[:, None]], [np.zeros((1, k - 1)), np.array([[size]])]])
            q = np.column_stack([q, v / size])
    inverse = np.linalg.inv(r)
    beta = inverse @ (q.T @ y)
    rest = y - q @ (q.T @ y)
    around = y - q[:, :1] @ (q[:, :1].T @ y)
    rss, tss = float(rest @ rest), float(around @ around)
    df1, df2 = len(kept) - 1, n - len(kept)
    sigma2 = rss / df2 if df2 > 0 else None
    r2 = 1 - rss / tss if tss > 0 else None
    usable = df2 > 0 and df1 > 0 and r2 is not None
    se = np.sqrt(sigma2 * (inverse**2).sum(axis=1)) if sigma2 is not None else [None] * len(kept)
    est_of, se_of = dict(zip(kept, beta)), dict(zip(kept, se))
    return {
        "est": [float(est_of[j]) if j in est_of else None for j in range(x.shape[1])],
        "se": [None if se_of.get(j) is None else float(se_of[j]) for j in range(x.shape[1])],
        "df1": df1,
        "df2": df2,
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / df2 if usable else None,
        "f": ((tss - rss) / df1) / sigma2 if usable and sigma2 > 0 else None,
    }


def _fit(names: list[str], kind: pa.DataType):
    fields = {"n": pa.int64(), "df1": pa.int64(), "df2": pa.int64(), "r2": pa.float64(), "adj_r2": pa.float64()}
    fields["f"] = pa.float64()

    def run(table: pa.Table) -> pa.Table:
        n, factor = _merged(table, len(names) + 1)
        fit = {"n": n, **solve(n, factor)}
        k = len(names)
        out = {"test": pa.array([table.column("test")[0].as_py()] * k, kind), "term": pa.array(names)}
        out |= {c: pa.array([fit[c]] * k, t) for c, t in fields.items()}
        out |= {c: pa.array(fit[c], pa.float64()) for c in ("est", "se")}
        return pa.table(out)

    return run


def fit_terms(df: DataFrame, y: str, terms: Mapping[str, Column], test: str) -> DataFrame:
    """One row per (test, term), the intercept first: estimate, error, t and p, beside the fit's n,
    df1, df2, r2, adjusted r2, f and its p (`f_p`).

    Rows with a null in the outcome or a term do not count. A test of any size is one factor per task;
    null tests are a test. Without degrees of freedom left, estimates stand and errors are null.
    The test column must not have the name of a result column.
    """
    if test in _RESULT:
        raise ValueError(f"a test column named {test} would hide a result")
    names = ["(intercept)", *terms]
    cells = [c.cast("double").alias(f"_x{i}") for i, c in enumerate(terms.values())]
    rows = df.select(F.col(test).alias("test"), *cells, F.col(y).cast("double").alias("_y"))
    rows = rows.dropna("any", subset=rows.columns[1:])
    field = rows.schema["test"].dataType
    kind, width = to_arrow_type(field), len(names) + 1
    each = f"test {field.simpleString()}, n bigint, r array<double>"
    parts = rows.mapInArrow(_factors(width, kind), each)
    parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    merged = parts.groupBy("test", "salt").applyInArrow(_merge(width, kind), each)
    fitted = merged.groupBy("test").applyInArrow(
        _fit(names, kind),
        f"test {field.simpleString()}, term string, n bigint, df1 bigint, df2 bigint, r2 double, "
        "adj_r2 double, f double, est double, se double",
    )
    double = lambda c: F.col(c).cast("double")
    return fitted.withColumn("t", F.try_divide("est", "se")).withColumns(
        {"p": t_pvalue("t", double("df2")), "f_p": f_pvalue("f", double("df1"), double("df2"))}
    ).withColumnRenamed("test", test)
