"""What earlier versions lost without a word: it is now kept, null or an error."""

import math

import pytest
from pyspark.sql import functions as F

from panelforge.functions import tails as T
from panelforge.operators import aggregates as A
from panelforge.operators import growth as G
from panelforge.operators import inference as I
from panelforge.operators import ordered as O
from panelforge.operators import reshape as R


@pytest.mark.parametrize("kind", ["New kind", None])
def test_widen_refuses_an_unlisted_category(spark, kind):
    rows = [(1, "Hybrid", 0.4), (1, kind, 0.6)]
    df = spark.createDataFrame(rows, "k int, kind string, share double")
    with pytest.raises(Exception, match="kind"):
        R.widen(df, ["k"], "kind", "share", ["Hybrid"]).collect()


def test_densify_refuses_counts_of_an_unknown_entity(spark):
    counts = spark.sql("select * from values (1, date'2020-01-01', 5), (2, date'2020-01-02', 7) as t(c, d, n)")
    known = spark.createDataFrame([(1,)], "c int")
    with pytest.raises(Exception, match="not among the entities"):
        O.densify(counts, known, "c", "d", ["n"]).collect()


def test_two_rows_on_a_day_are_an_error(spark):
    rows = spark.range(40).select(F.lit(1).alias("c"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 2).cast("int")).alias("d"), F.rand(1).alias("y"))
    with pytest.raises(Exception, match="more than one row"):
        G.spline_growth(rows, "c", "d", ["y"]).collect()


def test_two_values_of_a_signal_in_a_cell_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, "a", 1.0), (1, 1, "a", 2.0)], "g int, d int, s string, v double")
    with pytest.raises(Exception, match="more than one a"):
        R.multi_signal(df, "g", "d", "s", {"a": ["v"]}, "a").collect()


def test_a_band_outside_the_domain_is_null(spark):
    df = spark.createDataFrame([(1, "x", 5, 2)], "d int, c string, e int, p int")
    row = A.incidence_band(df, "d", "c", "e", "p").first()
    assert row.rate == 2.5 and row.rate_upper is None and row.rate_lower is None


def test_far_points_and_many_degrees_of_freedom():
    assert T.upper_point(lambda f: T.f_sf(f, 1, 1), 1e-5) == pytest.approx(4.0528e9, rel=1e-3)
    assert T.f_sf(1, 1e9, 1e9) == pytest.approx(0.5, abs=1e-9)
    assert T.f_sf(3, 2, 1e12) == pytest.approx(math.exp(-3), rel=1e-9)
    assert T.t_two_sided(2.0, 1e12) == pytest.approx(0.0455002639, rel=1e-8)


def test_weighted_lines_of_tests_far_apart(spark):
    rows = [("a", 1e8 + i, 2.0 * i + (i % 3)) for i in range(10)]
    rows += [("b", float(i), 2.0 * i + (i % 3)) for i in range(10)]
    df = spark.createDataFrame(rows, "name string, x double, y double").withColumn("w", F.lit(1.0))
    far = {r.name: r for r in I.wls_simple(df, "y", "x", "w", "name").collect()}
    own = {r.name: r for r in I.ols_simple(df, "y", "x", "name").collect()}
    for t in "ab":
        for name in ("slope", "se", "r2"):
            assert far[t][name] == pytest.approx(own[t][name], rel=1e-6)


def test_ranges_do_not_change_row_ids(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("k"))
    few = O.with_range(df, "k", block=4)
    many = O.with_range(df, "k", block=40)
    assert few.select("_range").distinct().count() < 17 < many.select("_range").distinct().count()
    assert O.range_block(df) >= O.BLOCK
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = sorted(map(tuple, O.with_row_id(df, "k").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert sorted(map(tuple, O.with_row_id(df, "k").collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
