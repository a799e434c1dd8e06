import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import nulls as N
from panelforge.functions import tails as T
from panelforge.functions import text as X
from panelforge.operators import aggregates as A


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "g string, x double")
    got = {
        r.g: (r.s, r.m, r.skip)
        for r in df.groupBy("g")
        .agg(N.strict_sum("x").alias("s"), N.strict_max("x").alias("m"), F.sum("x").alias("skip"))
        .collect()
    }
    assert got == {"a": (None, None, 1.0), "b": (2.0, 2.0, 2.0)}
    choice = N.if_else(F.col("x") > 1, F.lit("hi"), F.lit("lo")).alias("c")
    assert [r.c for r in df.select(choice).collect()] == ["lo", None, "hi"]


def test_logs_ratios_and_casts(spark):
    df = spark.createDataFrame([(0.0, "x1"), (math.e, "2.5")], "x double, t string")
    rows = df.select(
        N.safe_ln("x").alias("ln"),
        N.ratio("x", F.lit(0)).alias("r"),
        N.to_number("t").alias("n"),
        N.log1p_count(F.lit(-1.0)).alias("l"),
    ).collect()
    assert rows[0].ln is None and rows[1].ln == pytest.approx(1.0)
    assert [r.r for r in rows] == [None, None]
    assert [r.n for r in rows] == [None, 2.5]
    assert rows[0].l is None


def test_exclusion_list_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert [r.x for r in df.filter(N.not_in("x", ["a"])).collect()] == ["b", None]


def test_argmax_ties_take_the_first_column(spark):
    df = spark.createDataFrame(
        [(0.19, 0.41, 0.41), (0.0, 0.0, 0.0), (0.1, 0.2, 0.7)], "h double, p double, o double"
    )
    label = A.argmax_columns({"Hybrid": "h", "On Premises": "p", "Online Only": "o"})
    got = [r[0] for r in df.select(label).collect()]
    assert got == ["On Premises", "Hybrid", "Online Only"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("84039001", 0.004, 50)], "uid string, p double, d int")
    row = df.select(
        X.county_code("uid"), X.significance("p"), X.size_tag("d", 50), X.percent_label("d"),
        X.level_rank(F.lit("Hybrid"), ["On Premises", "Hybrid"]),
    ).first()
    assert list(row) == ["39001", "**", "Large", "50%", 2]


# Published critical values: the tail at the value equals the level of the table.
@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: T.f_sf(3.7083, 3, 10), 0.05),
        (lambda: T.f_sf(4.9646, 1, 10), 0.05),
        (lambda: T.t_two_sided(2.2281, 10), 0.05),
        (lambda: T.t_two_sided(63.657, 1), 0.01),
        (lambda: T.chi2_sf(5.9915, 2), 0.05),
        (lambda: T.chi2_sf(18.307, 10), 0.05),
        (lambda: T.tukey_sf(3.877, 3, 10), 0.05),
        (lambda: T.tukey_sf(5.673, 5, 5), 0.05),
        (lambda: T.tukey_sf(3.356, 3, 120), 0.05),
        (lambda: T.dunnett_two_sided(2.54, 20, np.full(3, math.sqrt(0.5))), 0.05),
    ],
)
def test_published_tails(got, want):
    assert got() == pytest.approx(want, rel=0.02)


def test_tail_identities():
    for t, df in ((0.3, 4), (2.0, 17), (5.0, 300)):
        assert T.f_sf(t * t, 1, df) == pytest.approx(T.t_two_sided(t, df), abs=1e-12)
        # Two means: the studentized range is sqrt(2) |t|; one comparison with a control is t.
        assert T.tukey_sf(math.sqrt(2) * t, 2, df) == pytest.approx(T.t_two_sided(t, df), abs=1e-9)
        assert T.dunnett_two_sided(t, df, np.array([0.6])) == pytest.approx(
            T.t_two_sided(t, df), abs=1e-9
        )
    assert T.chi2_sf(3.0, 2) == pytest.approx(math.exp(-1.5), abs=1e-14)
    assert T.tukey_quantile(0.95, 4, 20) == pytest.approx(3.958, abs=1e-3)


def test_fall_semester_anova_of_the_study():
    # Sums of squares of the largest growth per county by posture, 86 counties.
    f = (6.895057e-4 / 2) / (8.925370e-3 / 83)
    assert f == pytest.approx(3.205972, rel=1e-6)
    assert 0.04 < T.f_sf(f, 2, 83) < 0.05
