import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.functions import tails as T
from panelforge.operators import inference as I
from panelforge.operators import moments as M


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(11)
    n = 600
    g = rng.choice(["Hybrid", "On Premises", "Online Only"], n, p=[0.7, 0.2, 0.1])
    x = np.round(rng.random(n), 2)
    y = 2 * x + (g == "Hybrid") * 0.3 + rng.normal(size=n)
    return pd.DataFrame({"test": rng.choice(["p", "q"], n), "g": g, "x": x, "y": y, "w": rng.random(n)})


def anova(y, g):
    groups = [y[g == v] for v in np.unique(g)]
    ssb = sum(len(a) * (a.mean() - y.mean()) ** 2 for a in groups)
    ssw = sum(((a - a.mean()) ** 2).sum() for a in groups)
    return (ssb / (len(groups) - 1)) / (ssw / (len(y) - len(groups)))


def test_anova_and_cutoff_sweep(spark, sample):
    df = spark.createDataFrame(sample)
    got = {r.test: r.f for r in I.anova_oneway(df, "y", "g", "test").collect()}
    cuts = [0.4 + 0.01 * i for i in range(60)] + [2.0]
    sweep = I.anova_cutoff_sweep(df, "y", "x", cuts, "test").toPandas()
    assert len(sweep) == 2 * len(cuts)
    for t, rows in sample.groupby("test"):
        y = rows.y.to_numpy()
        assert got[t] == pytest.approx(anova(y, rows.g.to_numpy()), rel=1e-9)
        mine = sweep[sweep.test == t].set_index("cutoff_id")
        for i, c in enumerate(cuts[:-1]):
            assert mine.f[i] == pytest.approx(anova(y, rows.x.to_numpy() > c), rel=1e-7, nan_ok=True)
        assert np.isnan(mine.f[len(cuts) - 1])


def test_degenerate_tests_are_null(spark):
    df = spark.createDataFrame(
        [("one", "a", 1.0), ("one", "a", 2.0), ("flat", "a", 1.0), ("flat", "b", 1.0)],
        "test string, g string, y double",
    )
    out = I.with_f_pvalue(I.anova_oneway(df, "y", "g", "test")).collect()
    assert len(out) == 2 and all(r.f is None and r.p is None for r in out)
    assert all(r.t is None for r in I.posthoc_pairs(df, "y", "g", "test").collect())
    fit = I.ols_multi(df, "y", {"c": F.lit(1.0)}, "test").collect()
    assert all(r.est is None for r in fit)


def test_kruskal_with_ties_and_skew(spark):
    rng = np.random.default_rng(5)
    n = 4000
    g = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    y = np.where(rng.random(n) < 0.5, 3, rng.integers(0, 400, n)).astype(float)
    ranks = pd.Series(y).rank().to_numpy()
    _, counts = np.unique(y, return_counts=True)
    between = sum(ranks[g == k].sum() ** 2 / (g == k).sum() for k in np.unique(g))
    h = 12 / (n * (n + 1)) * between - 3 * (n + 1)
    h /= 1 - (counts.astype(float) ** 3 - counts).sum() / (float(n) ** 3 - n)
    df = spark.createDataFrame(pd.DataFrame({"t": "x", "g": g, "y": y}))
    row = I.kruskal_wallis(df, "y", "g", "t").first()
    assert row.h == pytest.approx(h, rel=1e-9) and row.n == n and row.df1 == 2


def lstsq(x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    a = x * np.sqrt(w)[:, None]
    beta = np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0]
    s2 = (w * (y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    return beta, np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))


def test_regressions_equal_numpy(spark, sample):
    df = spark.createDataFrame(sample)
    terms = {
        "x": F.col("x"),
        **I.category_terms("g", ["Hybrid", "On Premises", "Online Only"]),
        "x:online": F.col("x") * (F.col("g") == "Online Only").cast("double"),
    }
    multi = I.ols_multi(df, "y", terms, "test").toPandas()
    line = I.ols_simple(df, "y", "x", "test").toPandas().set_index("test")
    weighted = I.wls_simple(df, "y", "x", "w", "test").toPandas().set_index("test")
    for t, r in sample.groupby("test"):
        x, y, one = r.x.to_numpy(), r.y.to_numpy(), np.ones(len(r))
        online = (r.g == "Online Only").to_numpy(float)
        design = np.column_stack([one, x, (r.g == "On Premises").to_numpy(float), online, x * online])
        beta, se = lstsq(design, y)
        mine = multi[multi.test == t].set_index("term").loc[["(intercept)", *terms]]
        assert np.allclose(mine.est, beta, atol=1e-9) and np.allclose(mine.se, se, atol=1e-9)
        rss, tss, k = ((y - design @ beta) ** 2).sum(), ((y - y.mean()) ** 2).sum(), len(terms)
        assert np.allclose(mine.f, ((tss - rss) / k) / (rss / (len(y) - k - 1)))
        assert np.allclose(mine.adj_r2, 1 - (rss / (len(y) - k - 1)) / (tss / (len(y) - 1)))
        beta, se = lstsq(np.column_stack([one, x]), y)
        assert line.slope[t] == pytest.approx(beta[1]) and line.se[t] == pytest.approx(se[1])
        beta, se = lstsq(np.column_stack([one, x]), y, r.w.to_numpy())
        assert weighted.intercept[t] == pytest.approx(beta[0])
        assert weighted.slope[t] == pytest.approx(beta[1]) and weighted.se[t] == pytest.approx(se[1])


def test_posthoc_orders(spark, sample):
    df = spark.createDataFrame(sample[sample.test == "p"])
    pairs = I.posthoc_pairs(df, "y", "g", "test")
    tukey, duncan, scheffe, bonf = (
        {(r.group1, r.group2): r for r in f(pairs).collect()}
        for f in (I.tukey_hsd, I.duncan, I.scheffe, I.bonferroni)
    )
    assert len(tukey) == 3
    for k, r in tukey.items():
        single = T.t_two_sided(r.t, r.df2)
        assert single <= r.p + 1e-9 <= scheffe[k].p + 1e-6
        assert duncan[k].p <= r.p + 1e-9
        assert bonf[k].p == pytest.approx(min(1.0, 3 * single), abs=1e-12)
    against = I.dunnett(pairs, "On Premises", "test").collect()
    for r in [*tukey.values(), *duncan.values(), *scheffe.values(), *against]:
        assert r.lower < r["diff"] < r.upper
        assert (r.lower > 0 or r.upper < 0) == (r.p < 0.05)
    assert {r.grp for r in against} == {"Hybrid", "Online Only"}
    means = sample[sample.test == "p"].groupby("g").y.mean()
    for r in against:
        assert r["diff"] == pytest.approx(means[r.grp] - means["On Premises"])


def test_correlation_is_symmetric_over_complete_cases(spark, sample):
    holes = sample.copy()
    holes.loc[::7, "x"] = None
    got = I.correlation_matrix(spark.createDataFrame(holes), ["x", "y", "w"], "test").toPandas()
    assert len(got) == 18
    for t, r in holes.dropna().groupby("test"):
        want = r[["x", "y", "w"]].corr()
        for row in got[got.test == t].itertuples():
            assert row.r == pytest.approx(want.loc[row.x, row.y], abs=1e-9)


def test_least_squares_with_dependent_terms(spark):
    """Null tests, tests over many tasks, constant and dependent columns, no degrees of freedom, nulls."""
    from panelforge.operators import leastsquares as L

    rng = np.random.default_rng(9)
    rows = []
    for test, n in ((None, 300), ("a", 5000), ("small", 4), ("two", 2)):
        x = rng.normal(5, 2, n)
        z = rng.normal(0, 1, n)
        y = 2 + 3 * x - z + rng.normal(0, 1, n)
        rows += [(test, float(a), float(b), float(c)) for a, b, c in zip(x, z, y)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0, 1.0), ("a", 1.0, 1.0, None)], "g string, x double, z double, y double")
    terms = {"x": F.col("x"), "one": F.lit(4.0), "z": F.col("z"), "sum": F.col("x") - 2 * F.col("z")}
    got = {(r.g, r.term): r for r in L.fit_terms(df.repartition(7), "y", terms, "g").collect()}
    assert len(got) == 20
    for test in (None, "a"):
        own = np.array([r[1:] for r in rows if r[0] == test])
        x = np.column_stack([np.ones(len(own)), own[:, :2]])
        beta, rss, *_ = np.linalg.lstsq(x, own[:, 2], rcond=None)
        se = np.sqrt(rss[0] / (len(own) - 3) * np.diag(np.linalg.inv(x.T @ x)))
        for k, term in enumerate(["(intercept)", "x", "z"]):
            r = got[test, term]
            assert (r.est, r.se, r.t) == pytest.approx((beta[k], se[k], beta[k] / se[k]), rel=1e-9)
            assert (r.n, r.df1, r.df2) == (len(own), 2, len(own) - 3) and 0 <= r.p <= 1 and r.f_p < 1e-6
        assert [got[test, c].est for c in ("one", "sum")] == [None, None]
        assert [got[test, c].p for c in ("one", "sum")] == [None, None]
    assert got["two", "x"].est is not None and got["two", "x"].se is None and got["two", "x"].f is None
    assert L.fit_terms(df.limit(0), "y", terms, "g").isEmpty()


def test_least_squares_keeps_the_digits_of_nearly_parallel_columns(spark):
    from panelforge.operators import leastsquares as L

    x = np.arange(1, 2001) / 7.0
    rows = [(1, float(v), float(v + 1e-4 * np.sin(i)), float(1 + 2 * v + 1e4 * (1e-4 * np.sin(i)))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    got = {r.term: r.est for r in L.fit_terms(df, "y", {"a": F.col("a"), "b": F.col("b")}, "g").collect()}
    assert got["a"] + got["b"] == pytest.approx(2, abs=1e-7) and got["b"] == pytest.approx(1e4, rel=1e-6)


def test_weighted_lines_move_parts_only(spark):
    """Rows stay where they are read: only parts, of one row per test and task, are exchanged."""
    rows = spark.range(0, 60_000, 1, 6).select(
        (F.col("id") % 3).alias("test"),
        (F.xxhash64("id") % 1000).cast("double").alias("x"),
        (F.xxhash64("id", F.lit(1)) % 1000).cast("double").alias("y"),
        F.lit(0.5).alias("w"),
    )
    plan = I.wls_simple(rows, "y", "x", "w", "test")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")
    batches = rows.select("test", "w", "x", "y").toArrow().to_batches(max_chunksize=500)
    assert sum(p.num_rows for p in M._parts(iter(batches))) == 3


KEYS = {
    "long": "cast(k as bigint)",
    "text": "'k' || cast(k as int)",
    "flag": "k > 1000",
    "double": "k",
    "struct": "if(k is null, null, struct(k as a, array(cast(k as string)) as b))",
}


@pytest.mark.parametrize("kind", KEYS)
def test_weighted_lines_of_any_key(spark, kind):
    """More tests than a task holds, hot and small ones, a null test, rows that do not count."""
    rng = np.random.default_rng(3)
    n = 9000
    k = np.where(rng.random(n) < 0.4, -1, rng.integers(0, 3000, n)).astype(float)
    frame = pd.DataFrame({"id": range(n), "k": k, "y": rng.normal(-3, 2, n), "w": rng.random(n)})
    frame["x"] = rng.normal(1e6, 1, n)
    frame.loc[rng.random(n) < 0.05, "w"] = 0
    cells = spark.createDataFrame(frame).repartition(4, "id").withColumns(
        {"k": F.expr("if(id % 10 = 3, null, k)"), "x": F.expr("if(id % 50 = 0, null, x)")}
    )
    cells = cells.withColumn("test", F.expr(KEYS[kind]))
    got = {str(r.test): r for r in I.wls_simple(cells, "y", "x", "w", "test").collect()}
    rows = pd.DataFrame([(str(r.test), r.x, r.y, r.w) for r in cells.dropna("any", subset=["x"]).collect()])
    rows.columns = ["test", "x", "y", "w"]
    groups = dict(list(rows[rows.w > 0].groupby("test")))
    assert got.keys() == groups.keys() and "None" in got
    for name, g in groups.items():
        x, y, w = g.x.to_numpy(), g.y.to_numpy(), g.w.to_numpy()
        mine = got[name]
        assert mine.n == len(g)
        if len(g) == 1:
            assert mine.slope is None and mine.intercept is None and mine.se is None
            continue
        dx, dy = x - np.average(x, weights=w), y - np.average(y, weights=w)
        slope = (w * dx * dy).sum() / (w * dx * dx).sum()
        assert mine.slope == pytest.approx(slope, rel=1e-5)
        if len(g) > 5:
            rest = (w * (dy - slope * dx) ** 2).sum()
            assert mine.se == pytest.approx(np.sqrt(rest / (len(g) - 2) / (w * dx * dx).sum()), rel=1e-5)


def test_weighted_lines_without_spread_are_null(spark):
    """Equal x in several parts have no slope, whatever their weights."""
    rows = [("flat", 0.1, float(i), 0.3 + i) for i in range(50)] + [("nan", float(i), float("nan"), 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "test string, x double, y double, w double").repartition(7)
    got = {r.test: r for r in I.wls_simple(df, "y", "x", "w", "test").collect()}
    assert got["flat"].n == 50 and got["flat"].slope is None and got["flat"].t is None
    assert got["nan"].n == 3 and np.isnan(got["nan"].slope)
