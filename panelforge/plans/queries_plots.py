"""Queries for the data behind plots and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.nulls import ratio
from panelforge.operators import aggregates as A
from panelforge.operators import plotdata as P
from panelforge.plans.registry import query
from panelforge.plans.standins import Data


@query(
    "o_orderpriority:s n:l q1:f4 median:f4 q3:f4 whisker_low:f2 whisker_high:f2 outliers:l",
    """SELECT b.*, w.whisker_low, w.whisker_high, w.outliers
       FROM (SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q1,
                    quantile_cont(o_totalprice, 0.5) AS median,
                    quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) AS b
       JOIN (SELECT o.o_orderpriority,
                    min(CASE WHEN o_totalprice BETWEEN lo AND hi THEN o_totalprice END)
                      AS whisker_low,
                    max(CASE WHEN o_totalprice BETWEEN lo AND hi THEN o_totalprice END)
                      AS whisker_high,
                    count(*) FILTER (o_totalprice NOT BETWEEN lo AND hi) AS outliers
             FROM orders AS o JOIN (
               SELECT o_orderpriority, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
               FROM (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
                            quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1) AS q
             ) AS f ON f.o_orderpriority = o.o_orderpriority GROUP BY 1) AS w
       ON w.o_orderpriority = b.o_orderpriority""",
)
def boxplot_stats(d: Data):
    return P.boxplot_stats(d.table("orders"), ["o_orderpriority"], "o_totalprice")


@query(
    "l_returnflag:s bin:i n:l lower:f4",
    """SELECT l_returnflag, bin, count(*) AS n, max(lo + bin * width) AS lower
       FROM (SELECT l_returnflag, lo, width,
                    least(CAST(floor((l_extendedprice - lo) / width) AS INTEGER), 24) AS bin
             FROM lineitem CROSS JOIN (
               SELECT min(l_extendedprice) AS lo,
                      (max(l_extendedprice) - min(l_extendedprice)) / 25 AS width
               FROM lineitem) AS s) AS b
       GROUP BY 1, 2""",
)
def histogram_bins(d: Data):
    return P.histogram(d.table("lineitem"), "l_extendedprice", 25, ["l_returnflag"])


@query(
    "open_week:d method:s total:f2 state_share:f8",
    """SELECT open_week, method, sum(enroll) AS total,
              sum(enroll) / (SELECT sum(county_enroll) FROM v_county_totals) AS state_share
       FROM v_district WHERE open_week IS NOT NULL GROUP BY 1, 2""",
)
def share_by_date(d: Data):
    dated = d.district().filter(F.col("open_week").isNotNull())
    totals = dated.groupBy("open_week", "method").agg(F.sum("enroll").alias("total"))
    totals = A.with_grand_total(totals, d.county_totals(), "county_enroll", "state")
    return totals.withColumn("state_share", ratio("total", "state"))


@query(
    "county:i vertices:l area:f2 center_x:f4 center_y:f4",
    """SELECT county, count(*) AS vertices, abs(sum(k)) / 2 AS area,
              max(mx) + sum((x0 + x1) * k) / nullif(3 * sum(k), 0) AS center_x,
              max(my) + sum((y0 + y1) * k) / nullif(3 * sum(k), 0) AS center_y
       FROM (SELECT *, x0 * y1 - x1 * y0 AS k FROM (
               SELECT county, mx, my, x - mx AS x0, y - my AS y0,
                      coalesce(lead(x) OVER w, first_value(x) OVER w) - mx AS x1,
                      coalesce(lead(y) OVER w, first_value(y) OVER w) - my AS y1
               FROM (SELECT c_nationkey AS county, c_custkey AS vertex, c_acctbal AS x,
                            sqrt(c_custkey) * 100 AS y,
                            avg(c_acctbal) OVER (PARTITION BY c_nationkey) AS mx,
                            avg(sqrt(c_custkey) * 100) OVER (PARTITION BY c_nationkey) AS my
                     FROM customer) AS v
               WINDOW w AS (PARTITION BY county ORDER BY vertex)) AS e) AS s
       GROUP BY county""",
)
def polygon_centroid(d: Data):
    vertices = d.table("customer").select(
        F.col("c_nationkey").alias("county"),
        F.col("c_custkey").alias("vertex"),
        F.col("c_acctbal").alias("x"),
        (F.sqrt("c_custkey") * 100).alias("y"),
    )
    return P.polygon_centroids(vertices, ["county"], "vertex", "x", "y")
