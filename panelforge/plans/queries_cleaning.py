"""Cleaning, imputation and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.text import recode
from panelforge.operators import cleaning as C
from panelforge.operators.aggregates import category_totals
from panelforge.plans.queries_columns import _PLANTED, planted
from panelforge.plans.registry import query
from panelforge.plans.standins import Data


@query(
    "p_partkey:l p_size:i p_type:s p_retailprice:f2",
    """SELECT p_partkey, nullif(p_size, 2) AS p_size, nullif(p_type, 'SMALL') AS p_type,
              CASE WHEN p_retailprice NOT IN (900.0, 901.0) THEN p_retailprice END AS p_retailprice
       FROM part""",
)
def sentinel_to_null(d: Data):
    codes = {"p_size": [2], "p_type": ["SMALL"], "p_retailprice": [900.0, 901.0]}
    return C.sentinels_to_null(d.table("part"), codes)


@query(
    "c_custkey:l segment:s balance:f2 county:i",
    f"""SELECT c_custkey, coalesce(segment, 'none') AS segment, coalesce(balance, 0) AS balance,
               coalesce(county, 0) AS county FROM {_PLANTED} AS p""",
)
def fill_null(d: Data):
    rows = planted(d).withColumn("segment", F.coalesce("segment", F.lit("none")))
    return rows.fillna(0)


@query(
    "column_name:s n_null:l",
    f"""SELECT 'c_custkey' AS column_name, count(*) - count(c_custkey) AS n_null FROM {_PLANTED} AS p
        UNION ALL SELECT 'segment', count(*) - count(segment) FROM {_PLANTED} AS p
        UNION ALL SELECT 'balance', count(*) - count(balance) FROM {_PLANTED} AS p
        UNION ALL SELECT 'county', count(*) - count(county) FROM {_PLANTED} AS p""",
)
def null_profile(d: Data):
    return C.null_profile(planted(d))


@query(
    "segment:i balance:i county:i n:l",
    f"""SELECT CAST(segment IS NULL AS INTEGER) AS segment, CAST(balance IS NULL AS INTEGER) AS balance,
               CAST(county IS NULL AS INTEGER) AS county, count(*) AS n
        FROM {_PLANTED} AS p GROUP BY 1, 2, 3""",
)
def null_patterns(d: Data):
    return C.null_patterns(planted(d), ["segment", "balance", "county"])


# Neighbouring counties share one city name in four, so some cities are ambiguous.
_CITIES = """(SELECT c_custkey, 'City' || CAST(c_nationkey * 3 + c_custkey % 4 AS VARCHAR) AS city,
                     CASE WHEN c_custkey % 17 <> 0 THEN c_nationkey END AS county FROM customer)"""
_IMPUTED = f"""(SELECT c.c_custkey, c.city, coalesce(c.county, l.learnt) AS county
               FROM {_CITIES} AS c
               LEFT JOIN (SELECT city, min(county) AS learnt FROM {_CITIES} AS k
                          WHERE county IS NOT NULL GROUP BY city
                          HAVING count(DISTINCT county) = 1) AS l ON l.city = c.city)"""


def cities(d: Data):
    key = F.col("c_custkey")
    return d.table("customer").select(
        "c_custkey",
        F.concat(F.lit("City"), (F.col("c_nationkey") * 3 + key % 4).cast("string")).alias("city"),
        F.when(key % 17 != 0, F.col("c_nationkey")).alias("county"),
    )


@query("c_custkey:l city:s county:i", f"SELECT * FROM {_IMPUTED} AS i")
def impute_from_lookup(d: Data):
    return C.impute_from_lookup(cities(d), "city", "county")


@query(
    "c_custkey:l city:s county:i",
    f"""SELECT i.c_custkey, i.city, coalesce(i.county, o.county) AS county FROM {_IMPUTED} AS i
        LEFT JOIN (SELECT city, max(county) AS county FROM {_CITIES} AS k
                   WHERE county IS NOT NULL GROUP BY city) AS o ON o.city = i.city""",
)
def impute_override(d: Data):
    rows = cities(d)
    overrides = rows.filter(F.col("county").isNotNull()).groupBy("city").agg(
        F.max("county").alias("county")
    )
    learnt = C.impute_from_lookup(rows, "city", "county")
    return C.impute_override(learnt, "city", "county", overrides)


@query(
    "county:i date:d delta:l adjusted:l residual:b",
    """SELECT county, unnest(dates) AS date, unnest(before) AS delta, unnest(after) AS adjusted,
              unnest(after) < 0 AS residual
       FROM (SELECT county, dates, before, list_reduce(negatives, lambda acc, i:
               list_transform(acc, lambda x, j:
                 CASE WHEN j = i
                      THEN x + least(-acc[i], len(list_filter(acc[1:i - 1], lambda y: y > 0)))
                      WHEN j < i AND x > 0
                           AND len(list_filter(acc[j + 1:i - 1], lambda y: y > 0)) < -acc[i]
                      THEN x - 1 ELSE x END), before) AS after
             FROM (SELECT county, list(date ORDER BY date) AS dates,
                          list(CAST(delta AS BIGINT) ORDER BY date) AS before,
                          coalesce(list(CAST(place AS BIGINT) ORDER BY date)
                                     FILTER (delta < 0), []) AS negatives
                   FROM (SELECT county, date, delta, row_number() OVER (
                           PARTITION BY county ORDER BY date) AS place FROM v_daily) AS p
                   GROUP BY county) AS s) AS f""",
)
def redistribute_negatives(d: Data):
    panel = d.daily().select("county", "date", "delta")
    return C.redistribute_negatives(panel, "county", "date", "delta")


@query(
    "county:i summed:l latest:l mismatch:b",
    """SELECT county, sum(delta) AS summed, max(cum_deaths) AS latest,
              sum(delta) <> max(cum_deaths) AS mismatch FROM v_daily GROUP BY county""",
)
def reconcile_totals(d: Data):
    panel = d.daily()
    return C.reconcile(panel, panel, "county", "delta", "cum_deaths", "date")


@query(
    "o_orderkey:l mask:s is_low:s",
    """SELECT o_orderkey, CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN '1-URGENT'
                               ELSE o_orderpriority END AS mask,
              CASE WHEN o_orderpriority = '5-LOW' THEN 'Low' ELSE 'Not Low' END AS is_low
       FROM orders""",
)
def recode_category(d: Data):
    return d.table("orders").withColumns(
        {
            "mask": recode("o_orderpriority", ["2-HIGH", "3-MEDIUM"], "1-URGENT"),
            "is_low": recode("o_orderpriority", ["5-LOW"], "Low", "Not Low"),
        }
    )


@query(
    "county:i mask:s students:f2",
    """SELECT t.county, t.mask, t.students - CASE WHEN t.mask = '1-URGENT'
                THEN coalesce(e.less, 0) ELSE 0 END AS students
       FROM (SELECT county, mask, sum(enroll) AS students FROM (
               SELECT DISTINCT s.county, CASE WHEN s.mask IN ('2-HIGH', '3-MEDIUM') THEN '1-URGENT'
                                              ELSE s.mask END AS mask, s.district, d.enroll
               FROM v_school AS s JOIN v_district AS d ON d.district = s.district) AS u
             GROUP BY county, mask) AS t
       LEFT JOIN (SELECT county, sum(enrollment) AS less FROM v_school
                  WHERE mask IN ('2-HIGH', '3-MEDIUM') AND level = 'F' GROUP BY county) AS e
       ON e.county = t.county""",
)
def adjusted_group_total(d: Data):
    partial = ["2-HIGH", "3-MEDIUM"]
    sized = d.district_masks().withColumn("mask", recode("mask", partial, "1-URGENT"))
    totals = category_totals(sized, ["county", "mask"], "district", "enroll", "students")
    elementary = d.by_district(
        d.table("orders").filter(
            F.col("o_orderpriority").isin(partial) & (F.col("o_orderstatus") == "F")
        ),
        F.sum("o_totalprice").alias("amount"),
    )
    elementary = elementary.groupBy("county").agg(F.sum("amount").alias("less"))
    return C.subtract_where(totals, "county", "mask", "students", "1-URGENT", elementary, "less")


@query(
    "county:i district:l summed:f2 reported:f2 enroll:f2",
    "SELECT county, district, summed, reported, enroll FROM v_district",
)
def reported_vs_summed(d: Data):
    return d.district()
