"""Join queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.nulls import ratio
from panelforge.operators import aggregates as A
from panelforge.operators import growth as G
from panelforge.operators import joins as J
from panelforge.operators import ordered as O
from panelforge.operators import reshape as R
from panelforge.plans.registry import query
from panelforge.plans.standins import END, START, Data


@query(
    "c_custkey:l c_nationkey:i n_name:s",
    """SELECT c_custkey, c_nationkey, n_name FROM customer
       LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) AS n ON n_nationkey = c_nationkey""",
)
def left_join_dim(d: Data):
    places = d.table("nation").filter(F.col("n_regionkey") != 2)
    return d.table("customer").join(
        places, F.col("c_nationkey") == F.col("n_nationkey"), "left"
    )


@query(
    "o_orderkey:l c_custkey:l c_mktsegment:s o_totalprice:f2",
    """SELECT o_orderkey, c_custkey, c_mktsegment, o_totalprice
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def inner_join(d: Data):
    return d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(
    "p_partkey:l l_orderkey:l l_linenumber:i l_quantity:f2",
    """SELECT p_partkey, l_orderkey, l_linenumber, l_quantity
       FROM (SELECT * FROM lineitem WHERE l_quantity > 45) AS l
       RIGHT JOIN part ON l_partkey = p_partkey""",
)
def right_join(d: Data):
    big = d.table("lineitem").filter(F.col("l_quantity") > 45)
    return big.join(d.table("part"), F.col("l_partkey") == F.col("p_partkey"), "right")


@query(
    "o_custkey:l finished:l opened:l",
    """SELECT coalesce(f.o_custkey, o.o_custkey) AS o_custkey, finished, opened
       FROM (SELECT o_custkey, count(*) AS finished FROM orders
             WHERE o_orderstatus = 'F' GROUP BY 1) AS f
       FULL JOIN (SELECT o_custkey, count(*) AS opened FROM orders
                  WHERE o_orderstatus = 'O' GROUP BY 1) AS o ON f.o_custkey = o.o_custkey""",
)
def full_outer_join(d: Data):
    def per_customer(status: str, name: str):
        rows = d.table("orders").filter(F.col("o_orderstatus") == status)
        return rows.groupBy("o_custkey").agg(F.count(F.lit(1)).alias(name))

    return per_customer("F", "finished").join(per_customer("O", "opened"), "o_custkey", "full")


@query(
    "county:i district:l enroll:f2 county_enroll:f2 methods:l",
    """SELECT d.county, d.district, d.enroll, t.county_enroll, t.methods
       FROM (SELECT county, method, district, enroll FROM v_district) AS d
       LEFT JOIN (SELECT county, method, county_enroll, count(*) OVER (PARTITION BY county) AS methods
                  FROM v_shares) AS t ON t.county = d.county AND t.method = d.method""",
)
def natural_join(d: Data):
    left = d.district().select("county", "method", "district", "enroll")
    methods = F.count(F.lit(1)).over(W.partitionBy("county"))
    right = d.shares().select("county", "method", "county_enroll", methods.alias("methods"))
    return J.natural_join(left, right)


@query(
    "county:i date:d click_value:f6 click_sample_size:l error_value:f6 error_stderr:f8 "
    "purchase_value:f6 view_value:f6",
    """SELECT county, date,
              max(CASE WHEN signal = 'click' THEN value END) AS click_value,
              max(CASE WHEN signal = 'click' THEN sample_size END) AS click_sample_size,
              max(CASE WHEN signal = 'error' THEN value END) AS error_value,
              max(CASE WHEN signal = 'error' THEN stderr END) AS error_stderr,
              max(CASE WHEN signal = 'purchase' THEN value END) AS purchase_value,
              max(CASE WHEN signal = 'view' THEN value END) AS view_value
       FROM v_signals WHERE signal IN ('click', 'error', 'purchase', 'view')
       GROUP BY county, date HAVING count(*) FILTER (signal = 'click') > 0""",
)
def multi_signal_join(d: Data):
    wanted = {
        "click": ["value", "sample_size"],
        "error": ["value", "stderr"],
        "purchase": ["value"],
        "view": ["value"],
    }
    return R.multi_signal(d.signals(), "county", "date", "signal", wanted, base="click")


_WEEKS = {**{f"b_m{w}w": -7 * w for w in (3, 2, 1)}, **{f"b_{w}w": 7 * w for w in range(8)}}
_WEEK_SQL = ", ".join(
    f"max(CASE WHEN date - DATE '1998-08-18' = {k} THEN slope END) AS {n}" for n, k in _WEEKS.items()
)


def weekly_slopes(d: Data):
    """Slope at weekly offsets from the semester start, one aggregate over the panel."""
    return G.at_offsets(
        d.slopes(), "county", F.datediff("date", F.lit(START)), "slope", _WEEKS
    )


@query(
    "county:i " + " ".join(f"{n}:f6" for n in _WEEKS),
    f"SELECT county, {_WEEK_SQL} FROM v_slopes GROUP BY county",
)
def offset_feature_table(d: Data):
    return weekly_slopes(d)


@query(
    "county:i date:d deaths:l cum_deaths:l signal:s value:f6",
    """SELECT o.county, o.date, o.deaths, o.cum_deaths, s.signal, s.value
       FROM v_outbreak AS o JOIN v_signals AS s ON s.county = o.county AND s.date - 7 = o.date""",
)
def lag_shift_join(d: Data):
    return O.lag_shift_join(d.outbreak(), d.signals(), ["county"], "date", -7)


@query(
    "county:i open_week:d at_open:l at_end:l",
    """SELECT o.county, o.open_week,
              max(CASE WHEN d.date = o.open_week THEN d.cum_deaths END) AS at_open,
              max(CASE WHEN d.date = DATE '1998-12-15' THEN d.cum_deaths END) AS at_end
       FROM v_opening AS o LEFT JOIN v_daily AS d ON d.county = o.county GROUP BY 1, 2""",
)
def value_at_event(d: Data):
    rows = O.attach(
        d.daily().select("county", "date", "cum_deaths"),
        d.opening().select("county", "open_week"),
        ["county"],
    )
    moments = {"at_open": F.col("open_week"), "at_end": F.lit(END)}
    dated = rows.filter(F.col("open_week").isNotNull())
    return J.values_at(dated, ["county", "open_week"], "date", "cum_deaths", moments)


@query(
    "county:i method:s total:f2 share:f2 sum_of_ratios:f2 state_enroll:f2 state_share:f6",
    """SELECT s.county, s.method, s.total, s.share, r.sum_of_ratios, g.state_enroll,
              s.total / g.state_enroll AS state_share
       FROM v_shares AS s
       JOIN (SELECT d.county, d.method, round(sum(d.enroll / c.county_enroll), 2) AS sum_of_ratios
             FROM v_district AS d JOIN v_county_totals AS c ON c.county = d.county
             GROUP BY 1, 2) AS r ON r.county = s.county AND r.method = s.method
       CROSS JOIN (SELECT sum(county_enroll) AS state_enroll FROM v_county_totals) AS g""",
)
def share_of_total(d: Data):
    totals = d.county_totals()
    rows = (
        O.attach(d.district(), totals, ["county"])
        .groupBy("county", "method", "county_enroll")
        .agg(
            F.sum("enroll").alias("total"),
            F.round(F.sum(ratio("enroll", "county_enroll")), 2).alias("sum_of_ratios"),
        )
    )
    rows = A.with_share(rows, "total", "county_enroll", "share")
    rows = A.with_grand_total(rows, totals, "county_enroll", "state_enroll")
    return A.with_share(rows, "total", "state_enroll", "state_share", None)


@query(
    "county:i district:l enroll:f2 county_enroll:f2",
    """SELECT county, district, enroll, sum(enroll) OVER (PARTITION BY county) AS county_enroll
       FROM v_district""",
)
def group_total_attach(d: Data):
    rows = d.district().select("county", "district", "enroll")
    return O.group_total_detail(rows, ["county"], "enroll", "county_enroll")


@query(
    "county:i open_week:d week_total:f2 method:s method_total:f2",
    """SELECT w.county, w.open_week, w.total AS week_total, m.method, m.total AS method_total
       FROM v_open_shares AS w LEFT JOIN v_shares AS m ON m.county = w.county
       WHERE w.open_week IS NOT NULL""",
)
def two_agg_join(d: Data):
    dated = d.district().filter(F.col("open_week").isNotNull())
    weeks = A.category_totals(dated, ["county", "open_week"], "district", "enroll", "week_total")
    methods = A.category_totals(
        d.district(), ["county", "method"], "district", "enroll", "method_total"
    )
    return weeks.join(methods, "county", "left")


@query(
    "county:i method:s method_share:f2 open_week:d week_share:f2",
    """SELECT m.county, m.method, m.share AS method_share, o.open_week, o.share AS week_share
       FROM (SELECT * FROM (SELECT *, row_number() OVER (
               PARTITION BY county ORDER BY share DESC, method) AS rn FROM v_shares) AS r
             WHERE rn = 1) AS m
       LEFT JOIN v_opening AS o ON o.county = m.county""",
)
def majority_pair(d: Data):
    methods = O.pick_largest(d.shares(), ["county"], "share", "method", ["method", "share"])
    weeks = d.opening()
    return methods.withColumnRenamed("share", "method_share").join(
        weeks.withColumnRenamed("share", "week_share"), "county", "left"
    )


@query(
    "county:i vertex:l x:f2 name:s major:s automobile:f2",
    """SELECT c.c_nationkey AS county, c.c_custkey AS vertex, c.c_acctbal AS x,
              upper(n.n_name) AS name, w.major, w.automobile
       FROM customer AS c JOIN nation AS n ON n.n_nationkey = c.c_nationkey
       LEFT JOIN v_wide AS w ON w.county = c.c_nationkey""",
)
def polygon_join(d: Data):
    names = d.table("nation").select(
        F.col("n_nationkey").alias("county"), F.upper("n_name").alias("name")
    )
    attributes = names.join(d.wide().select("county", "major", "automobile"), "county", "left")
    vertices = d.table("customer").select(
        F.col("c_nationkey").alias("county"),
        F.col("c_custkey").alias("vertex"),
        F.col("c_acctbal").alias("x"),
    )
    return O.attach(vertices, attributes, ["county"])
