"""Every registered query against its SQL oracle on the smallest test folder."""

import os

import pytest

import oracle
from panelforge.plans.catalog import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

# The smoothing spline's values have no SQL form; `spline_moments`, `category_spline_moments`,
# `spline_lines` and `spline_derivatives` check what it must keep, test_growth.py its other properties.
WITHOUT_ORACLE = {"spline_fit", "growth_coefficient", "category_growth"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    rows, difference = oracle.compare(QUERIES[name], spark, con, FOLDER)
    assert rows > 0
    assert not difference


def test_only_the_spline_queries_lack_an_oracle():
    assert {n for n, q in QUERIES.items() if q.oracle is None} == WITHOUT_ORACLE


def test_entry_module(spark):
    import __spark_entry__ as entry

    own = {name for name in entry.queries() if name in QUERIES}
    assert {n for n in entry.oracle_sql() if n in QUERIES} == own - WITHOUT_ORACLE == set(QUERIES) - WITHOUT_ORACLE
    assert entry.entry(spark).limit(1).count() == 1
