import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.operators import cleaning as C


def back_allocate(x):
    """Plain reading of the rule: each negative takes one unit from each earlier positive day,
    nearest first."""
    x = list(x)
    for i, v in enumerate(x):
        for j in reversed(range(i)):
            if x[i] >= 0:
                break
            if x[j] > 0:
                x[j] -= 1
                x[i] += 1
    return x


def run(spark, series):
    rows = [(k, d, float(v)) for k, s in series.items() for d, v in enumerate(s)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "county string, day int, new double")
    out = C.redistribute_negatives(df, "county", "day", "new").orderBy("county", "day").collect()
    return {
        k: ([r.adjusted for r in out if r.county == k], [r.residual for r in out if r.county == k])
        for k in series
    }


def test_negatives_fixtures(spark):
    got = run(
        spark,
        {"basic": [2, 0, 3, -2], "partial": [5, -3], "first": [-1, 2], "none": [1, 0, 4]},
    )
    assert got["basic"] == ([1, 0, 2, 0], [False] * 4)
    assert got["partial"] == ([4, -2], [False, True])
    assert got["first"] == ([-1, 2], [True, False])
    assert got["none"][0] == [1, 0, 4]


def test_negatives_against_brute_force(spark):
    rng = random.Random(7)
    series = {
        f"c{i}": [rng.choice([0, 0, 1, 2, 3, 5, -1, -2, -4]) for _ in range(rng.randint(1, 60))]
        for i in range(40)
    }
    got = run(spark, series)
    for k, s in series.items():
        assert got[k][0] == back_allocate(s)
        assert sum(got[k][0]) == sum(s)
        assert got[k][1] == [v < 0 for v in got[k][0]]


def test_negatives_keep_other_columns_and_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1, None, "x"), ("a", 2, 2.0, "y")], "county string, day int, new double, tag string"
    )
    out = C.redistribute_negatives(df, "county", "day", "new").orderBy("day").collect()
    assert [(r.new, r.adjusted, r.tag) for r in out] == [(None, None, "x"), (2.0, 2.0, "y")]


def test_ambiguous_city_is_left_alone_then_overridden(spark):
    df = spark.createDataFrame(
        [
            (1, "Dublin", "FRANKLIN"),
            (2, "Dublin", "UNION"),
            (3, "Dublin", None),
            (4, "Athens", "ATHENS"),
            (5, "Athens", None),
            (6, "Nowhere", None),
        ],
        "id int, city string, county string",
    )
    learnt = C.impute_from_lookup(df, "city", "county")
    got = {r.id: r.county for r in learnt.collect()}
    assert got[3] is None and got[5] == "ATHENS" and got[6] is None and len(got) == 6
    fixed = spark.createDataFrame([("Dublin", "FRANKLIN")], "city string, county string")
    got = {r.id: r.county for r in C.impute_override(learnt, "city", "county", fixed).collect()}
    assert got[3] == "FRANKLIN" and got[2] == "UNION" and got[6] is None


def test_sentinels_and_null_profile(spark):
    df = spark.createDataFrame([(-999.0, "N"), (3.0, "K"), (None, "N")], "enrollment double, gslo string")
    clean = C.sentinels_to_null(df, {"enrollment": [-999.0], "gslo": ["N"]})
    profile = {r.column_name: r.n_null for r in C.null_profile(clean).collect()}
    assert profile == {"enrollment": 2, "gslo": 2}
    patterns = {(r.enrollment, r.gslo): r.n for r in C.null_patterns(clean, ["enrollment", "gslo"]).collect()}
    assert patterns == {(1, 1): 2, (0, 0): 1}


def test_larger_total_is_null_without_report(spark):
    df = spark.createDataFrame([(5.0, 3.0), (2.0, 3.0), (4.0, None)], "s double, r double")
    got = [r[0] for r in df.select(C.larger_of_summed_and_reported("s", "r")).collect()]
    assert got == [5.0, 3.0, None]


def test_reconcile_one_frame_equals_two(spark):
    df = spark.createDataFrame(
        [("a", 1, 2, 2), ("a", 2, 1, 3), ("b", 1, 1, 5)], "k string, day int, new int, cum int"
    )
    one = C.reconcile(df, df, "k", "new", "cum", "day").orderBy("k").collect()
    two = C.reconcile(df, df.select("*"), "k", "new", "cum", "day").orderBy("k").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in two] == [("a", 3, 3, False), ("b", 1, 5, True)]


def test_duplicate_cell_is_an_error(spark):
    from panelforge.operators.reshape import widen

    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "k string, c string, v int")
    with pytest.raises(Exception, match="more than one v"):
        widen(df, ["k"], "c", "v", ["x"]).collect()


def test_total_check_returns_all_rows_of_offending_keys(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 3.0), ("b", 1.0)], "k string, v double")
    limits = spark.createDataFrame([("a", 4.0), ("b", 9.0)], "k string, top double")
    out = C.group_total_check(df, "k", "v", limits, "top")
    assert sorted((r.k, r.v, r.total) for r in out.collect()) == [("a", 2.0, 5.0), ("a", 3.0, 5.0)]
    assert out.filter(F.col("top") < 0).count() == 0


def test_a_residual_negative_is_kept(spark):
    df = spark.createDataFrame([("a", 1, -1.0), ("a", 2, 2.0)], "county string, day int, new double")
    out = C.redistribute_negatives(df, "county", "day", "new").orderBy("day").collect()
    assert [(r.adjusted, r.residual) for r in out] == [(-1.0, True), (2.0, False)]


@given(st.lists(st.integers(-6, 5) | st.sampled_from([0.5, -0.5, 2.25, -3.75]), max_size=60))
@settings(max_examples=400, deadline=None)
def test_back_allocation_equals_the_stated_walk(counts):
    assert list(C.back_allocate(counts)) == back_allocate(counts)


def test_back_allocation_is_one_walk_over_long_series():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, 10_000).astype(float)
    v[rng.random(10_000) < 0.3] = -2.0
    start = time.perf_counter()
    got = C.back_allocate(v)
    assert time.perf_counter() - start < 2
    assert got.sum() == v.sum() and (got[v >= 0] >= 0).all()
    assert list(C.back_allocate(v[:1500])) == back_allocate(v[:1500])


def test_empty_and_null_counts(spark):
    df = spark.createDataFrame([], "county string, day int, new double")
    assert C.redistribute_negatives(df, "county", "day", "new").count() == 0
    df = spark.createDataFrame(
        [("a", 1, 3.0), ("a", 2, None), ("a", 3, -2.0), ("b", 1, 0.0)], "county string, day int, new double"
    )
    out = C.redistribute_negatives(df, "county", "day", "new").orderBy("county", "day").collect()
    assert [(r.adjusted, r.residual) for r in out] == [(2.0, False), (None, False), (-1.0, True), (0.0, False)]
