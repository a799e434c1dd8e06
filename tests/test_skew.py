"""A third of the rows on one key: adaptive execution must be able to split it in every operator
that joins detail rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from panelforge.operators import cleaning as C
from panelforge.operators import joins as J
from panelforge.operators import ordered as O
from panelforge.sources.readers import signal_scan

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    before = {k: spark.conf.get(k) for k in SETTINGS if spark.conf.get(k, None) is not None}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    path = str(tmp_path_factory.mktemp("hot") / "rows")
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.xxhash64("id") % 500).cast("bigint")
    value = (F.xxhash64("id", F.lit(1)) % 1000).cast("double")
    rows = spark.range(0, 200_000, 1, 16).select("id", key.alias("k"), value.alias("v"))
    rows.write.parquet(path)
    yield spark.read.parquet(path)
    for k in SETTINGS:
        spark.conf.set(k, before[k]) if k in before else spark.conf.unset(k)


CASES = {
    "duplicates": lambda d: O.duplicates_detail(d, ["k"], "id"),
    "rows_at_max": lambda d: O.rows_at_max_detail(d, ["k"], "v"),
    "group_total": lambda d: O.group_total_detail(d, ["k"], "v", "t"),
    "total_check": lambda d: C.group_total_check(
        d, "k", "v", d.groupBy("k").agg((F.sum("v") - 1).alias("top")), "top"
    ),
    "impute": lambda d: C.impute_from_lookup(
        d.withColumn("c", F.when(F.col("id") % 2 == 0, F.col("k"))), "k", "c"
    ),
    "natural": lambda d: J.natural_join(d, d.groupBy("k").agg(F.count("v").alias("n"))),
    "signal_scan": lambda d: signal_scan(
        d.select(
            F.lit("s").alias("signal"),
            F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("day"),
            "k",
            "v",
        ),
        ["s"],
        date(2020, 1, 1),
        date(2020, 2, 1),
        time="day",
        geo="k",
        geos=d.select("k").distinct(),
    ),
}


# `rows_at_max` joins on the key and the value together, so its hot key is spread already.
@pytest.mark.parametrize("name", ["duplicates", "group_total", "total_check", "impute", "natural"])
def test_hot_key_is_split(hot, name):
    out = CASES[name](hot)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(CASES))
def test_rows_stay_whole(hot, name):
    n, keys = hot.count(), hot.select("k").distinct().count()
    want = {"duplicates": n - keys, "total_check": n}
    got = CASES[name](hot)
    if name == "rows_at_max":
        tops = hot.groupBy("k").agg(F.max("v").alias("v"))
        assert got.count() == hot.join(tops, ["k", "v"]).count()
    else:
        assert got.count() == want.get(name, n)
