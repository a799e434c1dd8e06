"""Requests to a signal archive: rows, pruned folders, hot places, odd input."""

import glob
import random
import re
import tempfile
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.sources.signals import area_of, request_signals, write_signals

ROWS = "id bigint, name string, day date, place string"
REQUESTS = "signal string, start date, end date"
DAY0 = date(2020, 1, 1)


def rows(n=3000, seed=5):
    rng = random.Random(seed)
    return [
        (
            i,
            rng.choice(["deaths"] * 3 + ["cases", "tests", None]),
            rng.choice([None, *[DAY0 + timedelta(rng.randrange(400)) for _ in range(20)]]),
            rng.choice(["hot"] * 10 + [None] + [f"p{k}" for k in range(40)]),
        )
        for i in range(n)
    ]


ASKED = [
    ("deaths", date(2020, 1, 20), date(2020, 3, 3)),
    ("deaths", date(2020, 2, 1), date(2020, 2, 10)),
    ("cases", date(2020, 12, 31), date(2021, 1, 1)),
    ("tests", date(2020, 5, 2), date(2020, 5, 1)),
    (None, date(2020, 1, 1), date(2021, 1, 1)),
    ("tests", None, date(2021, 1, 1)),
]


def ask(spark, path, schema, requests, places):
    """Lists are read from files, whose size Spark knows."""
    lists = tempfile.mkdtemp(prefix="lists-")
    spark.createDataFrame(requests, REQUESTS).write.parquet(f"{lists}/requests")
    spark.createDataFrame([(p,) for p in places], "place string").write.parquet(f"{lists}/places")
    return request_signals(
        spark,
        path,
        schema,
        spark.read.schema(REQUESTS).parquet(f"{lists}/requests"),
        spark.read.schema("place string").parquet(f"{lists}/places").filter("place > ''"),
        "name",
        "day",
        "place",
    )


def partition_filters(df):
    """Partition filters of the archive's scan, unabridged."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return next(x for x in text.splitlines() if x.startswith("PartitionFilters") and "area" in x)


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_a_request_finds_its_rows_once(spark, tmp_path, threshold):
    data, path = rows(), str(tmp_path / "archive")
    schema = write_signals(spark.createDataFrame(data, ROWS), path, "name", "day", "place")
    assert spark.read.schema(schema).parquet(path).count() == len(data)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, threshold)
    try:
        got = ask(spark, path, schema, ASKED, ["hot", "p1", "p1", None, "p7"])
        found = sorted(r["id"] for r in got.collect())
        filters = partition_filters(got)
    finally:
        spark.conf.set(key, before)
    want = [
        i
        for i, name, day, place in data
        if place in ("hot", "p1", "p7")
        and day
        and any(name == s and a and a <= day <= b for s, a, b in ASKED if s)
    ]
    assert found == want and got.columns == ["id", "name", "day", "place"]
    assert ("dynamicpruning#" in filters) == (threshold != "-1")


def test_folders_of_others_are_not_opened(spark, tmp_path):
    """Both lists prune: the months and signals of the requests, and the areas of the places."""
    path = str(tmp_path / "archive")
    schema = write_signals(spark.createDataFrame(rows(), ROWS), path, "name", "day", "place")
    got = ask(spark, path, schema, ASKED[:2], ["p1"])
    before = got.collect()
    filters = partition_filters(got)
    for column in ("name", "month", "area"):
        assert re.search(rf"{column}#\d+ IN dynamicpruning#", filters), column
    # Files of other signals, months and areas are spoilt now; the request must not see it.
    area = spark.range(1).select(area_of(F.lit("p1")).alias("a")).first()["a"]
    spoilt = 0
    for name in glob.glob(f"{path}/*/*/*/*.parquet"):
        if "name=deaths" in name and f"area={area}/" in name and re.search("month=2020-0[123]", name):
            continue
        Path(name).write_bytes(b"spoilt")
        crc = Path(name).with_name(f".{Path(name).name}.crc")
        crc.write_bytes(b"") if crc.exists() else None
        spoilt += 1
    again = ask(spark, path, schema, ASKED[:2], ["p1"])
    assert spoilt > 100 and sorted(map(tuple, again.collect())) == sorted(map(tuple, before))


def test_empty_tables_and_clashing_names(spark, tmp_path):
    data = spark.createDataFrame(rows(50), ROWS)
    path = str(tmp_path / "archive")
    schema = write_signals(data, path, "name", "day", "place")
    assert ask(spark, path, schema, [], ["hot"]).count() == 0
    assert ask(spark, path, schema, ASKED, []).count() == 0
    empty = str(tmp_path / "empty")
    schema = write_signals(data.limit(0), empty, "name", "day", "place")
    assert ask(spark, empty, schema, ASKED, ["hot"]).count() == 0
    with pytest.raises(ValueError, match="made here"):
        write_signals(data.withColumn("area", F.lit(1)), path, "name", "day", "place")
