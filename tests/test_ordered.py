"""Ordered operators against pandas / numpy on skewed data: one group holds most rows."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import columns as K
from panelforge.operators import ordered as O
from panelforge.operators import plotdata as P


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    group = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.4, 5.0, np.round(rng.normal(0, 50, n), 1))
    return pd.DataFrame({"id": np.arange(n), "g": group, "v": value})


def test_row_id_is_consecutive_in_order(spark, skewed):
    df = spark.createDataFrame(skewed.sample(frac=1, random_state=1)).withColumn("id", F.col("id") * 7)
    got = O.with_row_id(df, "id", "row").orderBy("id").toPandas()
    assert list(got.row) == list(range(1, len(skewed) + 1))


def test_preceding_sums_with_peers(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = O.preceding_sums(df, "v", {"s": F.lit(1)}, by=["g"], peers=True).toPandas()
    for _, rows in got.groupby("g"):
        for r in rows.sample(40, random_state=2, replace=True).itertuples():
            assert r.s == (rows.v < r.v).sum()
            assert r.s_peers == (rows.v == r.v).sum()


def test_next_in_order_closes_rings(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = O.next_in_order(df, ["g"], "id", ["v"], closed=True).toPandas().sort_values("id")
    for _, rows in got.groupby("g"):
        assert list(rows.next_v) == list(np.roll(rows.v, -1))
        assert set(rows.first_v) == {rows.v.iloc[0]}
    opened = O.next_in_order(df, ["g"], "id", ["v"]).toPandas()
    assert opened.next_v.isna().sum() == skewed.g.nunique()


def test_quantiles_equal_numpy(spark, skewed):
    df = spark.createDataFrame(skewed)
    probs = [("lo", 0.1), ("mid", 0.5), ("hi", 0.99)]
    got = P.exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for g, rows in skewed.groupby("g"):
        for name, p in probs:
            assert got.loc[g, name] == pytest.approx(np.quantile(rows.v, p), abs=1e-9)


@pytest.mark.parametrize("small", [1, 7, 400])
def test_quantiles_by_ranges_cut_again(spark, skewed, small):
    """Ranges of a few rows, heavy ties, groups far apart and one value: as many passes as it takes."""
    rows = pd.concat(
        [
            skewed[["g", "v"]],
            pd.DataFrame({"g": "far", "v": 10.0 ** np.arange(-150, 150)}),
            pd.DataFrame({"g": "one", "v": [3.5] * 500}),
            pd.DataFrame({"g": "two", "v": [1.0] + [2.0] * 499 + [9.0]}),
            pd.DataFrame({"g": [None] * 30, "v": np.arange(30.0)}),
        ]
    )
    df = spark.createDataFrame([(g, float(v)) for g, v in zip(rows.g, rows.v)], "g string, v double")
    df = df.union(spark.createDataFrame([("hot", None), ("none", None)], "g string, v double"))
    probs = [("lo", 0.0), ("a", 0.1), ("mid", 0.5), ("hi", 1.0)]
    got = {r.g: r for r in P.exact_quantiles(df, ["g"], "v", probs, small=small).collect()}
    groups = {g: x.v for g, x in rows.groupby("g", dropna=False)}
    assert len(got) == len(groups)
    for g, v in groups.items():
        r = got[None if pd.isna(g) else g]
        assert r.n == len(v)
        for name, p in probs:
            assert r[name] == pytest.approx(np.quantile(v, p), rel=1e-12)


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert P.exact_quantiles(none, ["g"], "v", [("mid", 0.5)]).isEmpty()
    assert P.boxplot_stats(none, ["g"], "v").isEmpty()


def test_order_by_any_key(spark):
    rng = np.random.default_rng(5)
    words = ["é" * 70 + str(i) for i in range(40)] + [f"k{i}" for i in range(300)] + ["", "A", "a", "z" * 200]
    rows = [(w if rng.random() < 0.8 else None, None if i % 9 == 0 else days(400)[i], i) for i, w in enumerate(words)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "s string, d date, i int")
    low = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or date.min)
    for key in (["s", "i"], ["d", "i"], ["s", "d", "i"]):
        at = [("s", "d", "i").index(k) for k in key]
        want = sorted(rows, key=lambda r: tuple(r[k] if k == 2 else low(r[k]) for k in at))
        got = {r.i: r.id for r in O.with_row_id(df, key).collect()}
        assert got == {r[2]: n + 1 for n, r in enumerate(want)}
    after = {r.i: (r.next_i, r.first_i) for r in O.next_in_order(df, [], ["s", "i"], ["i"]).collect()}
    order = [r[2] for r in sorted(rows, key=lambda r: (low(r[0]), r[2]))]
    assert after == {i: (j, order[0]) for i, j in zip(order, [*order[1:], None])}
    texts = spark.createDataFrame([(w,) for w in set(words)], "s string")
    got = [r.s for r in O.with_row_id(texts, "s").orderBy("id").collect()]
    assert got == sorted(set(words), key=str.encode)
    assert O.with_row_id(texts.limit(0), "s").isEmpty()


def test_quantiles_of_the_whole_table(spark, skewed):
    row = P.boxplot_stats(spark.createDataFrame(skewed), [], "v").first()
    assert (row.n, row["median"]) == (len(skewed), np.median(skewed.v))
    assert "_all" not in row.asDict()


def test_boxplot_equals_numpy(spark, skewed):
    got = P.boxplot_stats(spark.createDataFrame(skewed), ["g"], "v").toPandas().set_index("g")
    for g, rows in skewed.groupby("g"):
        q1, q3 = np.quantile(rows.v, [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = rows.v[(rows.v >= lo) & (rows.v <= hi)]
        assert got.loc[g, "whisker_low"] == inside.min()
        assert got.loc[g, "whisker_high"] == inside.max()
        assert got.loc[g, "outliers"] == len(rows) - len(inside)


def test_centroid_of_known_shapes(spark):
    square = [("s", i, float(x), float(y)) for i, (x, y) in enumerate([(9, 9), (11, 9), (11, 13), (9, 13)])]
    triangle = [("t", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (3, 0), (0, 3)])]
    df = spark.createDataFrame(square + triangle, "p string, i int, x double, y double")
    got = {r.p: r for r in P.polygon_centroids(df, ["p"], "i", "x", "y").collect()}
    assert (got["s"].area, got["s"].center_x, got["s"].center_y) == (8.0, 10.0, 11.0)
    assert (got["t"].area, got["t"].center_x, got["t"].center_y) == (4.5, 1.0, 1.0)


def test_histogram_top_edge(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4]], "v double")
    got = {r.bin: r.n for r in P.histogram(df, "v", 4).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}


def test_detail_operators_equal_pandas(spark, skewed):
    df = spark.createDataFrame(skewed)
    dup = O.duplicates_detail(df, ["g"], "id").toPandas()
    assert sorted(dup.id) == sorted(skewed.id[skewed.duplicated("g")])
    top = O.rows_at_max_detail(df, ["g"], "v").toPandas()
    best = skewed.groupby("g").v.transform("max")
    assert sorted(top.id) == sorted(skewed.id[skewed.v == best])
    ends = O.first_last_rows_detail(df, ["g"], "id").toPandas()
    firsts = skewed.groupby("g").id.agg(["min", "max"])
    assert sorted(ends.id) == sorted(set(firsts["min"]) | set(firsts["max"]))


def test_null_keys_match_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 4.0)], "g string, v double")
    got = O.group_total_detail(df, ["g"], "v", "t").collect()
    assert sorted(r.t for r in got) == [3.0, 3.0, 4.0]


def test_pick_largest_ties_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", "x", 0.4), ("a", "b", 0.4), ("a", "c", 0.1), ("n", "x", None)],
        "g string, c string, s double",
    )
    got = O.pick_largest(df, ["g"], "s", "c", ["c"]).collect()
    assert [(r.g, r.c, r.s) for r in got] == [("a", "b", 0.4)]


def days(n):
    return [date(2020, 8, 1) + timedelta(days=i) for i in range(n)]


def test_series_windows(spark):
    rows = [("a", d, float(i)) for i, d in enumerate(days(25))]
    df = spark.createDataFrame(rows, "k string, d date, v double")
    out = (
        df.withColumns(
            {
                "m": O.centered_mean("v", 7, "k", "d"),
                "l": O.lag_rows("v", 21, "k", "d"),
                "t": O.running_total("v", "k", "d"),
            }
        )
        .orderBy("d")
        .collect()
    )
    assert [r.m for r in out[:4]] == [None, None, None, 3.0]
    assert [r.m for r in out[-3:]] == [None] * 3
    assert sum(r.l is None for r in out) == 21
    assert out[-1].t == sum(range(25))


def test_first_last_of_one_row_is_null(spark):
    df = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("b", 2, 9)], "k string, d int, v int")
    got = {r.k: (r.y0, r.y1, r.change) for r in O.first_last_change(df, ["k"], "d", "v").collect()}
    assert got == {"a": (5, 5, None), "b": (5, 9, 4)}
    got = {r.k: (r.y0, r.y1) for r in O.interval_endpoints(df, ["k"], "d", "v").collect()}
    assert got == {"a": (5, None), "b": (5, 9)}


def test_densify_fills_gaps_and_refuses_unknown_entities(spark):
    d = days(4)
    counts = spark.createDataFrame(
        [("a", d[0], 2), ("a", d[3], 1), ("ghost", d[1], 9)], "k string, d date, n bigint"
    )
    known = counts.filter("k <> 'ghost'")
    entities = spark.createDataFrame([("a", 10), ("b", 20)], "k string, pop int")
    got = O.densify(known, entities, "k", "d", ["n"]).orderBy("k", "d").collect()
    assert [(r.k, r.n, r["pop"]) for r in got] == [("a", n, 10) for n in (2, 0, 0, 1)] + [("b", 0, 20)] * 4
    with pytest.raises(Exception, match="not among the entities"):
        O.densify(counts, entities, "k", "d", ["n"]).collect()


def test_shift_join_moves_the_right_side(spark):
    d = days(10)
    left = spark.createDataFrame([("a", d[0], 1)], "k string, d date, x int")
    right = spark.createDataFrame([("a", d[7], 5), ("a", d[0], 6)], "k string, d date, y int")
    got = O.lag_shift_join(left, right, ["k"], "d", -7).collect()
    assert [(r.d, r.y) for r in got] == [(d[0], 5)]
    assert right.orderBy("d").first().d == d[0]


def test_reorder_is_a_dense_rank(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 9.0), ("c", 5.0), ("d", 1.0)], "c string, v double")
    got = {r.c: r["rank"] for r in K.reorder_by_aggregate(df, "c", "v").collect()}
    assert got == {"b": 1, "a": 2, "c": 2, "d": 3}


def test_positions_and_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], ["County", "b b", "NCHS Urban/Rural Status", "d", "e "])
    picked = K.at_positions(df, "1,3-5")
    assert K.normalise_names(picked).columns == ["county", "nchs_urban_rural_status", "d", "e"]
    with pytest.raises(ValueError):
        K.at_positions(df, "4-6")
    with pytest.raises(ValueError):
        K.rename(df, {"missing": "x"})
