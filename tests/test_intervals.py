"""Windows from a table against plain loops, hot entities, odd input and the plan."""

import math
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from panelforge.operators import intervals as V

DAY0 = date(2020, 1, 1)
ROWS = "place string, day date, x bigint, y double"
WINDOWS = "id bigint, place string, lo date, hi date"


def totals(spark, rows, windows, **options):
    return V.window_totals(
        spark.createDataFrame(rows, ROWS),
        spark.createDataFrame(windows, WINDOWS),
        "place",
        "day",
        "lo",
        "hi",
        {"x": F.col("x"), "y": F.col("y")},
        **options,
    )


def inside(rows, window):
    _, place, lo, hi = window
    if None in (place, lo, hi):
        return []
    return [r for r in rows if r[0] == place and r[1] is not None and lo <= r[1] <= hi]


def made(seed, rows=1500, windows=400):
    """Half of all rows and windows belong to one place; days repeat and lie on both sides of 1970."""
    rng = random.Random(seed)
    place = lambda: rng.choice(["a"] * 4 + ["b", "c", None, ""])
    day = lambda: rng.choice([None] + [DAY0 + timedelta(rng.randrange(-300, 300)) for _ in range(30)])
    data = [
        (place(), day(), rng.choice([None, *range(-5, 30)]), rng.choice([None, *[rng.random()] * 20]))
        for _ in range(rows)
    ]
    asked = []
    for i in range(windows):
        lo = day()
        hi = lo and lo + timedelta(rng.choice([-3, 0, 1, 7, 63, 64, 65, 200]))
        asked.append((i % (windows - 20), place(), lo, rng.choice([hi] * 20 + [None])))
    return data, asked


@pytest.mark.parametrize("skip_nulls", [False, True])
@pytest.mark.parametrize("block_days", [1, 7, 64, 100_000])
def test_totals_equal_plain_sums(spark, skip_nulls, block_days):
    rows, windows = made(block_days)
    got = totals(spark, rows, windows, skip_nulls=skip_nulls, block_days=block_days)
    got = sorted(map(tuple, got.collect()), key=repr)
    want = []
    for w in windows:
        held = inside(rows, w)
        line = [*w, len(held)]
        for i in (2, 3):
            known = [r[i] for r in held if r[i] is not None]
            whole = known and (skip_nulls or len(known) == len(held))
            line += [sum(known), sum(known) / len(known)] if whole else [None, None]
        want.append(tuple(line))
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=repr)):
        assert a[:7] == b[:7]
        assert a[7:] == pytest.approx(b[7:], abs=1e-9)


def test_a_thousand_windows_for_each_place(spark):
    days = [DAY0 + timedelta(i) for i in range(730)]
    rows = [(p, d, i % 11, None) for p in "ab" for i, d in enumerate(days)]
    windows = [(i, p, days[i % 700], days[i % 700] + timedelta(i % 97)) for p in "ab" for i in range(1000)]
    got = {(r["id"], r["place"]): r for r in totals(spark, rows, windows).collect()}
    assert len(got) == 2000
    for w in windows:
        held = inside(rows, w)
        assert (got[w[:2]]["rows"], got[w[:2]]["x_sum"]) == (len(held), sum(r[2] for r in held))


def test_values_that_are_not_finite_stay_in_their_windows(spark):
    day = lambda i: DAY0 + timedelta(i)
    odd = [1.0, math.nan, 2.0, math.inf, 4.0, -math.inf, 8.0]
    rows = [("a", day(i), 0, v) for i, v in enumerate(odd)]
    windows = [(10 * i + j, "a", day(i), day(j)) for i in range(7) for j in range(i, 7)]
    for r in totals(spark, rows, windows, block_days=2).collect():
        want = sum(odd[r["id"] // 10 : r["id"] % 10 + 1])
        assert r["y_sum"] == want or (math.isnan(want) and math.isnan(r["y_sum"]))


def test_empty_tables_and_clashing_names(spark):
    rows, windows = made(1, 20, 30)
    assert totals(spark, rows, []).count() == 0
    got = totals(spark, [], windows).collect()
    assert len(got) == 30 and {(r["rows"], r["x_sum"], r["y_mean"]) for r in got} == {(0, None, None)}
    table = spark.createDataFrame(rows, ROWS)
    asked = spark.createDataFrame(windows, WINDOWS)
    with pytest.raises(ValueError, match="made here"):
        V.window_totals(table, asked.withColumn("x_sum", F.lit(1)), "place", "day", "lo", "hi", {"x": F.col("x")})
    with pytest.raises(ValueError, match="made here"):
        V.rows_in_windows(table.withColumn("id", F.lit(1)), asked, "place", "day", "lo", "hi")
    # Columns of the rows that windows have too do no harm to totals.
    wide = table.withColumns({"id": F.lit(1), "lo": F.lit("x"), "rows": F.lit(2)})
    found = V.window_totals(wide, asked, "place", "day", "lo", "hi", {"x": F.col("x")})
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        map(tuple, totals(spark, rows, windows).select(*found.columns).collect()), key=repr
    )


@pytest.mark.parametrize("block_days", [1, 30, 64])
def test_rows_meet_each_window_once(spark, block_days):
    rows, windows = made(7, 300, 120)
    got = V.rows_in_windows(
        spark.createDataFrame(rows, ROWS),
        spark.createDataFrame(windows, WINDOWS),
        "place",
        "day",
        "lo",
        "hi",
        block_days,
    ).select("place", "day", "x", "y", "id", "lo", "hi")
    want = [(*r, w[0], w[2], w[3]) for w in windows for r in inside(rows, w)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_windows_by_entity_see_block_totals_only(spark):
    """No cross join, and the one window by entity stands on an aggregate by (entity, block)."""
    rows, windows = made(3, 50, 30)
    text = totals(spark, rows, windows)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text
    specs = re.findall(r"windowspecdefinition\(([^)]*?) ASC", text)
    assert {re.sub(r"#\d+L?", "", x) for x in specs} == {
        "_w_entity, _w_block, _w_day",  # running totals within a block
        "_w_entity, _w_block",  # over the blocks of an entity
    }
    by_entity = [i for i, x in enumerate(text.splitlines()) if re.search(r"Window .*_w_block#\d+L? ASC", x)]
    for i in by_entity:
        below = text.splitlines()[i + 1 : i + 6]
        assert any("HashAggregate(keys=[_w_entity" in x and "_w_block" in x for x in below)
    assert by_entity
