"""Physical plans: nothing that would break on large or skewed tables."""

import ast
import re
from pathlib import Path

import pytest

from panelforge.operators import plotdata as P
from panelforge.plans.catalog import QUERIES
from panelforge.plans.standins import Data

FOLDER = "/root/testdata/sf0.001"
PACKAGE = Path(__file__).resolve().parent.parent / "panelforge"


def plan(query, spark):
    return query.run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_forced_broadcast_or_row_udf(spark, no_broadcast, name):
    """With size-based broadcasts off, none may remain: no query forces one."""
    text = plan(QUERIES[name], spark)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin", "BatchEvalPython"):
        assert bad not in text


# Windows without a group: only over the table of value ranges, which has a fixed size.
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_ungrouped_windows_only_over_ranges(spark, name):
    for spec in re.findall(r"windowspecdefinition\(([^)]*)", plan(QUERIES[name], spark)):
        first = spec.split(",")[0]
        if " ASC" in first or " DESC" in first:
            assert first.startswith("_range"), spec


def test_predicates_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["signal_scan"], spark)
    line = next(x for x in text.splitlines() if "FileScan" in x and "event_type" in x)
    pushed, schema = line.split("PushedFilters: ")[1].split("ReadSchema: ")
    assert "In(event_type" in pushed and "GreaterThanOrEqual(ts" in pushed
    assert "props" not in schema
    text = plan(QUERIES["date_window_filter"], spark)
    assert "GreaterThanOrEqual(l_shipdate" in text and "l_extendedprice" not in text
    text = plan(QUERIES["ols_multi"], spark)
    schema = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
    }


def test_panel_windows_share_one_placement(spark, no_broadcast):
    """Densify places the panel by county once; running totals and slopes add no shuffle."""
    text = plan(QUERIES["local_slope"], spark)
    assert len(re.findall(r"Exchange hashpartitioning\(county#\d+, \d+\)", text)) == 1


def test_library_never_collects():
    banned = {
        "collect", "toPandas", "toLocalIterator", "take", "head",
        "localCheckpoint", "crossJoin", "broadcast",
    }
    for path in PACKAGE.rglob("*.py"):
        if path.parent.name == "llm":  # has its own bounds and tests
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                assert node.func.attr not in banned, f"{path.name}:{node.lineno}"


@pytest.mark.parametrize(
    "name", ["row_id", "row_id_text", "kruskal_wallis", "polygon_centroid", "reorder_by_agg"]
)
def test_range_bounds_are_computed_once(spark, name):
    """All branches of a plan must see the same cut points: one sketch, reused elsewhere."""
    df = QUERIES[name].run(spark, FOLDER)
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.replace("ReusedSubquery Subquery", "Reused")
    ids = set(re.findall(r"(?<!Reused)Subquery subquery#(\d+)", final))
    assert len(ids) == 1


def _subtree(text, at):
    """The lines of a plan below the node in line `at`."""
    lines = text.splitlines()
    depth = lambda x: len(re.match(r"[\s:+\-*()0-9]*", x)[0])
    out = []
    for x in lines[at + 1 :]:
        if depth(x) <= depth(lines[at]):
            break
        out.append(x)
    return out


def test_values_move_only_for_ranges_that_hold_a_rank(spark):
    """No exchange of raw values by (group, value): below each one stands the join with the ranges."""
    rows = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderpriority", "o_totalprice")
    found = P.exact_quantiles(rows, ["o_orderpriority"], "o_totalprice", [("mid", 0.5)], small=100)
    text = found._jdf.queryExecution().sparkPlan().toString()
    prepared = found._jdf.queryExecution().executedPlan().toString()
    moved = [i for i, x in enumerate(prepared.splitlines()) if re.search(r"Exchange hashpartitioning\(.*o_totalprice", x)]
    assert moved and "orders.parquet" in text
    for i in moved:
        below = _subtree(prepared, i)
        assert any("Join" in x for x in below) and any("ranges-" in x for x in below)
    box = plan(QUERIES["boxplot_stats"], spark)
    assert not re.search(r"Exchange hashpartitioning\([^)]*o_totalprice", box)


@pytest.mark.parametrize("name", ["incidence_band", "lag_increment", "feature_table", "snapshot_rate"])
def test_orders_are_read_once(spark, no_broadcast, name):
    """All grains come from one pass; the query itself reads what that pass kept."""
    scans = lambda text: len(re.findall(r"FileScan.*?orders\.parquet", text))
    assert scans(plan(QUERIES[name], spark)) == 0
    grains = Data(spark, FOLDER).grains()._jdf.queryExecution().executedPlan().toString()
    assert scans(grains) == 1 and "Expand" in grains
