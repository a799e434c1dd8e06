from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import dense_spline
from panelforge.functions import spline as S
from panelforge.operators import growth as G

N = 398


def days(n=N):
    return np.arange(18283.0, 18283.0 + n)


def test_effective_parameters_hit_the_target():
    for n in (20, 49, 60, 200, N, 900):
        df = min(S.STUDY_DF, n / 2)
        calendar = S.Calendar(days(n))
        factors, trace = S.penalised([calendar], df)
        assert trace[0] == pytest.approx(df, abs=1e-8)
        # The smoother's matrix is its answer to unit series.
        fitted = calendar.curves_of(S._solve(factors[0], calendar.right_side(np.eye(n))))[0]
        assert np.trace(fitted) == pytest.approx(df, abs=1e-7)


def test_knot_counts():
    assert [S.knot_count(n) for n in (30, 49, 50, 200, 800, 3200)] == [30, 49, 50, 100, 140, 200]
    assert S.knot_count(5000) > 200


def test_line_is_reproduced():
    x = days()
    value, slope, curve = S.fit_series([x], [3.0 + 0.25 * (x - x[0])], S.STUDY_DF)[0]
    assert np.allclose(value, 3.0 + 0.25 * (x - x[0]), atol=1e-8)
    assert np.allclose(slope, 0.25, atol=1e-9)
    assert np.allclose(curve, 0.0, atol=1e-9)


def test_derivatives_match_differences():
    x = days()
    y = np.log1p(20 * np.exp(-(((x - x.mean()) / 70) ** 2)))
    value, slope, curve = S.fit_series([x], [y], S.STUDY_DF)[0]
    assert np.allclose(np.gradient(value)[3:-3], slope[3:-3], atol=2e-5)
    assert np.allclose(np.gradient(slope)[3:-3], curve[3:-3], atol=2e-5)
    assert np.abs(value - y).max() < 0.05


def test_fit_minimises_the_penalised_error():
    """With all days as knots the fit must beat any perturbed curve at the same penalty."""
    rng = np.random.default_rng(0)
    x = days(40)
    y = rng.normal(size=40)
    coef, value, _, curve, _ = dense_spline.smoother(x.tobytes(), 10.0)
    c = coef @ y
    u = np.linspace(x[0], x[-1], 4001)
    inner = (x - x[0]) / (x[-1] - x[0])
    t = np.concatenate([[0.0] * 3, inner, [1.0] * 3])
    dense = dense_spline._design(t, (u - u[0]) / (u[-1] - u[0]), 2, len(c))
    gram = np.trapezoid(dense[:, :, None] * dense[:, None, :], u, axis=0)
    left = value.T @ (y - value @ c)
    penalty = np.linalg.lstsq((gram @ c)[:, None], left, rcond=None)[0][0]
    assert penalty > 0
    assert np.allclose(left, penalty * (gram @ c), atol=1e-3 * np.abs(left).max())


def test_equals_the_natural_spline_smoother():
    """With all days as knots the fit is (I + a Q R^-1 Q')^-1 y; a is found from the trace."""
    rng = np.random.default_rng(8)
    n, df = 45, 9.5
    x = np.cumsum(rng.integers(1, 4, n)).astype(float)
    y = rng.normal(size=n)
    h = np.diff(x)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j < n - 3:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    k = q @ np.linalg.solve(r, q.T)
    lo, hi = -30.0, 30.0
    for _ in range(200):
        mid = (lo + hi) / 2
        s = np.linalg.inv(np.eye(n) + np.exp(mid) * k)
        lo, hi = (mid, hi) if np.trace(s) > df else (lo, mid)
    value, _, curve = S.fit_series([x], [y], df)[0]
    assert np.allclose(value, s @ y, atol=1e-7)
    assert np.allclose(curve[[0, -1]], 0.0, atol=1e-6)


@pytest.mark.parametrize("n, df", [(20, 8.0), (49, 14.2), (60, 14.2), (398, S.STUDY_DF), (2405, 60.0), (15, 14.5), (398, 3.0)])
def test_banded_equals_dense_on_curved_series(n, df):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.integers(1, 4, n)).astype(float)
    y = np.sin(x / 9) + rng.normal(size=n)
    coef, *designs, _ = dense_spline.smoother(x.tobytes(), df)
    for got, design in zip(S.fit_series([x], [y], df)[0], designs):
        assert np.abs(got - design @ (coef @ y)).max() < 1e-8


def test_as_many_parameters_as_days_interpolate():
    rng = np.random.default_rng(5)
    x, y = np.arange(15.0), rng.normal(size=15)
    assert np.allclose(S.fit_series([x], [y], 15.0)[0][0], y, atol=1e-6)
    with pytest.raises(ValueError, match="two parameters"):
        S.fit_series([x], [y], 2.0)


def test_batches_of_calendars_equal_single_series():
    rng = np.random.default_rng(9)
    x = [np.sort(rng.choice(500, n, replace=False)).astype(float) for n in (398, 30, 49, 50, 220, 15)]
    y = [rng.normal(size=len(d)) for d in x]
    for d, v, got in zip(x, y, S.fit_series(x, y, 14.0)):
        assert np.allclose(got, S.fit_series([d], [v], 14.0)[0], atol=1e-11)


def test_long_series_need_linear_memory():
    """Full matrices would hold 20,000 days by 207 coefficients several times."""
    import tracemalloc

    x = np.arange(20000.0)
    y = np.sin(x / 900) + 0.1 * np.random.default_rng(2).normal(size=len(x))
    tracemalloc.start()
    value, slope, curve = S.fit_series([x], [y], 60.0)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6
    inside = slice(200, -200)
    assert np.abs(slope - np.cos(x / 900) / 900)[inside].max() < 2e-4
    assert np.abs(curve + np.sin(x / 900) / 900**2)[inside].max() < 5e-6
    assert np.abs(value - np.sin(x / 900))[inside].max() < 0.03


def test_fit_keeps_level_and_trend_of_the_test_panel(spark):
    """The residuals of a smoothing spline are orthogonal to straight lines."""
    from panelforge.plans.catalog import QUERIES

    fit = QUERIES["spline_fit"].run(spark, "/root/testdata/sf0.001")
    day, r = F.datediff("date", F.lit("1995-01-01")), F.col("log_new") - F.col("log_new_fit")
    sums = fit.groupBy("county").agg(
        F.count("log_new_fit").alias("n"), F.sum(r).alias("a"), F.sum(r * day / 2405).alias("b")
    )
    rows = sums.collect()
    assert len(rows) == 25 and all(x.n == 2405 for x in rows)
    assert all(abs(x.a) < 1e-4 and abs(x.b) < 1e-4 for x in rows)


def test_short_series_give_nulls():
    assert S.fit_series([[1.0, 2.0, 3.0]], [[1.0, 2.0, 3.0]], 2.0) == [None]
    assert S.fit_series([days(10)], [np.ones(10)], 14.0) == [None]


def test_spline_over_groups_of_different_calendars(spark):
    rows = []
    for k, n, b in (("a", 60, 0.1), ("b", 60, -0.2), ("c", 45, 0.3), ("short", 3, 1.0)):
        rows += [(k, date(2020, 3, 1) + timedelta(days=i), 1.0 + b * i, 2.0) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, d date, x double, z double").repartition(5)
    got = G.spline_growth(df, "k", "d", ["x", "z"], df_target=8.0).toPandas()
    assert len(got) == 60 + 60 + 45 + 3
    for k, b in (("a", 0.1), ("b", -0.2), ("c", 0.3)):
        part = got[got.k == k]
        assert np.allclose(part.x_b, b, atol=1e-8) and np.allclose(part.x_fit, part.x, atol=1e-7)
        assert np.allclose(part.z_b, 0.0, atol=1e-8)
    assert got[got.k == "short"].x_fit.isna().all()


def test_missing_values_keep_their_rows(spark):
    start = date(2020, 3, 1)
    rows = [("a", start + timedelta(days=i), None if i in (0, 20) else 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    got = G.spline_growth(df, "k", "d", ["x"], df_target=8.0).orderBy("d").collect()
    assert len(got) == 60
    assert [i for i, r in enumerate(got) if r.x_b is None] == [0, 20]
    assert all(abs(r.x_b - 2.0) < 1e-8 for r in got if r.x_b is not None)


def test_local_slope_equals_the_fit_of_each_frame(spark):
    rng = np.random.default_rng(6)
    start, y = date(2020, 3, 1), rng.normal(size=120)
    rows = [("a", start + timedelta(days=i), float(v)) for i, v in enumerate(y)]
    # A missing value and a missing day empty every frame they fall into.
    rows += [("hole", d, None if i == 50 else v) for i, (_, d, v) in enumerate(rows)]
    rows += [("gap", d, v) for i, (_, d, v) in enumerate(rows[:120]) if i != 70]
    df = spark.createDataFrame(rows, "k string, d date, y double")
    got = G.with_local_slope(df, "y", "d", "k").toPandas().sort_values(["k", "d"])
    mine = got[got.k == "a"].slope.to_numpy()
    assert np.isnan(mine[:14]).all() and np.isnan(mine[-13:]).all()
    for i in range(14, 107):
        assert mine[i] == pytest.approx(np.polyfit(np.arange(28), y[i - 14 : i + 14], 1)[0], abs=1e-10)
    hole = got[got.k == "hole"].slope.isna().to_numpy()
    assert hole[14:107].sum() == 28 and hole[37:65].all()
    gap = got[got.k == "gap"]
    full = gap[~gap.slope.isna()].d
    assert all(not (d - timedelta(days=14) <= start + timedelta(days=70) <= d + timedelta(days=13)) for d in full)
    assert len(full) == 93 - 28


def test_summaries_are_null_when_a_value_in_the_window_is(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 9, 5.0)], "k string, t int, v double")
    got = G.summaries(
        df,
        "k",
        {
            "whole": (F.col("t") < 5, F.col("v"), "max"),
            "late": (F.col("t") > 5, F.col("v"), "avg"),
            "none": (F.col("t") > 50, F.col("v"), "avg"),
        },
    ).first()
    assert (got.whole, got.late, got.none) == (None, 5.0, None)
