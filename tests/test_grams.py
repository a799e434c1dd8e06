"""Cross products of many columns against numpy, and how they are put together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import grams as M


def table(spark, cells, parts=7):
    rows = [([None if v != v else float(v) for v in row],) for row in cells]
    return spark.createDataFrame(rows, "v array<double>").repartition(parts)


def matrix(df, width, field):
    out = np.full((width, width), np.nan)
    for r in df.collect():
        if r[field] is not None:
            out[int(r["x"][1:]), int(r["y"][1:])] = r[field]
    return out


def test_five_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(1)
    cells = rng.normal(size=(900, 500)) + 1e6 * rng.normal(size=500)
    cells[:, 1] = 3 * cells[:, 0] - 5
    df = table(spark, cells)
    found = M.gram_table(df, M.vector_columns("v", range(500)))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan") == 1 and "Join" not in text
    r = matrix(found, 500, "r")
    assert np.allclose(r, np.corrcoef(cells.T), atol=1e-8)
    few = df.select(F.corr(F.get("v", F.lit(0)), F.get("v", F.lit(1))), F.corr(F.get("v", F.lit(2)), F.get("v", F.lit(3))))
    assert tuple(few.first()) == pytest.approx((r[0, 1], r[2, 3]), abs=1e-8)


def test_complete_rows_only(spark):
    rng = np.random.default_rng(2)
    cells = rng.normal(size=(200, 4))
    cells[rng.random(cells.shape) < 0.1] = np.nan
    whole = cells[~np.isnan(cells).any(axis=1)]
    found = M.gram_table(table(spark, cells), M.vector_columns("v", range(4)))
    assert {r["n"] for r in found.collect()} == {len(whole)}
    assert np.allclose(matrix(found, 4, "cross"), np.cov(whole.T) * (len(whole) - 1), atol=1e-9)
    assert np.allclose(matrix(found, 4, "mean_y")[0], whole.mean(axis=0), atol=1e-12)


def test_constant_odd_and_missing(spark):
    cells = [[1.0, i, float("inf") if i == 2 else i] for i in range(5)]
    found = M.gram_table(table(spark, cells), M.vector_columns("v", range(3)))
    r = matrix(found, 3, "r")
    assert r[1, 1] == pytest.approx(1.0)
    assert np.isnan(np.delete(r.ravel(), 4)).all()
    # A shorter array has no value in the last column, so no row is complete.
    assert M.gram_table(table(spark, cells), M.vector_columns("v", range(4))).count() == 0
    assert M.gram_table(table(spark, cells).limit(0), M.vector_columns("v", range(3))).count() == 0
    one = M.gram_table(table(spark, cells[:1]), M.vector_columns("v", range(2))).collect()
    assert [(x["n"], x["r"]) for x in one] == [(1, None)] * 4
    with pytest.raises(ValueError, match="no columns"):
        M.gram_table(table(spark, cells), {})
