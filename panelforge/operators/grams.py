"""Centred cross products of many columns in one pass, and the correlations that follow.

A task reduces its rows to one matrix, batch by batch; matrices of tasks are added in two steps, one after
the other, so no task holds more than two of them whatever the number of rows. The plan has one expression
per column, where aggregates would need one per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = 64
_PARTS = "salt int, n bigint, mean array<double>, gram array<double>"
State = tuple[int, np.ndarray, np.ndarray]


def _together(a: State | None, b: State) -> State:
    """Counts, means and centred products of two parts as those of the whole."""
    if a is None:
        return b
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _part(salt: int, state: State) -> pa.RecordBatch:
    n, mean, gram = state
    lists = [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (mean, gram)]
    return pa.RecordBatch.from_arrays(
        [pa.array([salt], pa.int32()), pa.array([n], pa.int64()), *lists], ["salt", "n", "mean", "gram"]
    )


def _reduce_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.column_stack([batch.column(i).to_numpy() for i in range(width)])
            mean = cells.mean(axis=0)
            away = cells - mean
            state = _together(state, (len(cells), mean, away.T @ away))
        if state is not None:
            yield _part(TaskContext.get().partitionId() % _SALTS, state)

    return run


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> State | None:
    state = None
    for batch in batches:
        for i in range(batch.num_rows):
            mean = batch.column("mean")[i].values.to_numpy()
            gram = batch.column("gram")[i].values.to_numpy().reshape(width, width)
            state = _together(state, (batch.column("n")[i].as_py(), mean, gram))
    return state


def _merge(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _merged(batches, width)
        if state is not None:
            yield _part(0, state)

    return run


def _rows(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _merged(batches, len(names))
        if state is None:
            return
        n, mean, gram = state
        size = np.sqrt(np.diag(gram))
        for i, name in enumerate(names):
            bounds = size[i] * size
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where(bounds > 0, np.clip(gram[i] / bounds, -1.0, 1.0), np.nan)
            k = len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * k),
                    pa.array(names),
                    pa.array([n] * k, pa.int64()),
                    pa.array(np.full(k, mean[i])),
                    pa.array(mean),
                    pa.array(gram[i]),
                    pa.array(r, from_pandas=True),
                ],
                ["x", "y", "n", "mean_x", "mean_y", "cross", "r"],
            )

    return run


def gram_table(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row per ordered pair of columns over the complete rows: `x`, `y`, `n`, both means, the centred
    cross product `cross` and the correlation `r`.

    Rows with a null in any column do not count; without complete rows the result is empty. `r` is null where
    a column is constant; NaN and infinities give null too. Work per row is the square of the
    columns; 500 of them are 2 MB per task in the shuffle. Sums of doubles depend on the order of the
    parts in their last digits.
    """
    names = list(columns)
    if not names:
        raise ValueError("no columns")
    width = len(names)
    cells = df.select(*[c.cast("double").alias(f"_g{i}") for i, c in enumerate(columns.values())])
    parts = cells.dropna("any").mapInArrow(_reduce_rows(width), _PARTS)
    merged = parts.repartition(_SALTS, "salt").mapInArrow(_merge(width), _PARTS)
    whole = merged.repartition(1).mapInArrow(
        _rows(names),
        "x string, y string, n bigint, mean_x double, mean_y double, cross double, r double",
    )
    return whole


def vector_columns(vector: str, positions: Sequence[int]) -> dict[str, Column]:
    """Components of an array column as columns, by position from 0; shorter arrays give null."""
    return {f"{vector}{i}": F.get(F.col(vector), F.lit(i)) for i in positions}
