"""Aggregation, reshape, sort and set queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from panelforge.functions.nulls import ratio, safe_ln, strict_avg
from panelforge.operators import aggregates as A
from panelforge.operators import reshape as R
from panelforge.plans.registry import query
from panelforge.plans.standins import END, METHODS, SHARES, START, Data

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


@query(
    "county:i mask:s total:f2 share:f2",
    """SELECT t.county, t.mask, t.total, round(t.total / nullif(c.county_enroll, 0), 2) AS share
       FROM (SELECT county, mask, sum(enroll) AS total FROM (
               SELECT DISTINCT s.county, s.mask, s.district, d.enroll FROM v_school AS s
               JOIN v_district AS d ON d.district = s.district) AS u
             WHERE mask NOT IN ('4-NOT SPECIFIED', '5-LOW') GROUP BY county, mask) AS t
       JOIN v_county_totals AS c ON c.county = t.county""",
)
def enroll_by_category(d: Data):
    known = d.district_masks().filter(~F.col("mask").isin("4-NOT SPECIFIED", "5-LOW"))
    totals = A.category_totals(known, ["county", "mask"], "district", "enroll", "total")
    return A.with_share(totals.join(d.county_totals(), "county"), "total", "county_enroll", "share")


@query(
    "o_custkey:l mean_price:f7 strict_mean:f7",
    """SELECT o_custkey, avg(price) AS mean_price,
              CASE WHEN count(price) = count(*) THEN avg(price) END AS strict_mean
       FROM (SELECT o_custkey, CASE WHEN o_totalprice > 20000 THEN o_totalprice END AS price
             FROM orders) AS o GROUP BY o_custkey""",
)
def window_mean(d: Data):
    price = F.when(F.col("o_totalprice") > 20000, F.col("o_totalprice"))
    rows = d.table("orders").select("o_custkey", price.alias("price"))
    return rows.groupBy("o_custkey").agg(
        F.avg("price").alias("mean_price"), strict_avg("price").alias("strict_mean")
    )


@query(
    "county:i max_new:l max_cum:l",
    """SELECT county, max(confirmed) AS max_new, max(cum_confirmed) AS max_cum FROM v_daily
       WHERE date >= DATE '1998-08-18' AND date <= DATE '1998-12-15' GROUP BY county""",
)
def window_max(d: Data):
    semester = d.daily().filter(F.col("date").between(START, END))
    return semester.groupBy("county").agg(
        F.max("confirmed").alias("max_new"), F.max("cum_confirmed").alias("max_cum")
    )


@query(
    "l_returnflag:s l_linestatus:s n:l",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
)
def group_count(d: Data):
    return d.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "o_orderpriority:s F:l O:l P:l",
    """SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F,
              count(*) FILTER (o_orderstatus = 'O') AS O,
              count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def crosstab(d: Data):
    return A.crosstab(d.table("orders"), "o_orderpriority", "o_orderstatus", STATUSES)


@query(
    "l_suppkey:l mean_discount:f8",
    """SELECT l_suppkey, sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0) AS mean_discount
       FROM lineitem GROUP BY 1""",
)
def weighted_mean(d: Data):
    return d.table("lineitem").groupBy("l_suppkey").agg(
        A.weighted_mean("l_discount", "l_quantity").alias("mean_discount")
    )


@query(
    "date:d major:s fatality:f8",
    """SELECT date, major, sum(cum_deaths) / nullif(CAST(sum(cum_confirmed) AS DOUBLE), 0)
              AS fatality FROM v_panel GROUP BY 1, 2""",
)
def ratio_of_sums(d: Data):
    return d.panel().groupBy("date", "major").agg(
        A.ratio_of_sums("cum_deaths", "cum_confirmed").alias("fatality")
    )


@query(
    "n:l revenue:f2 quantity:f2",
    """SELECT count(*) AS n, sum(l_extendedprice) AS revenue, sum(l_quantity) AS quantity
       FROM lineitem""",
)
def grand_total(d: Data):
    return d.table("lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("l_extendedprice").alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
    )


@query(
    "date:d quantity:f2 revenue:f2 lines:l",
    """SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS quantity,
              sum(l_extendedprice) AS revenue, count(*) AS lines FROM lineitem GROUP BY 1""",
)
def daily_totals(d: Data):
    day = F.col("l_shipdate").cast("date").alias("date")
    return d.table("lineitem").groupBy(day).agg(
        F.sum("l_quantity").alias("quantity"),
        F.sum("l_extendedprice").alias("revenue"),
        F.count(F.lit(1)).alias("lines"),
    )


_BAND = """SELECT date, major, total_events, total_pop, rate,
       rate + 1.6448536269514722 * sqrt(rate * (1 - rate) / total_pop) AS rate_upper,
       rate - 1.6448536269514722 * sqrt(rate * (1 - rate) / total_pop) AS rate_lower
  FROM (SELECT date, major, sum(cum_deaths) AS total_events, sum(population) AS total_pop,
               CAST(sum(cum_deaths) AS DOUBLE) / nullif(sum(population), 0) AS rate
        FROM {source} GROUP BY date, major) AS t"""


@query(
    "date:d major:s total_events:l total_pop:l rate:f9 rate_upper:f9 rate_lower:f9",
    _BAND.format(source="v_panel"),
)
def incidence_band(d: Data):
    return A.incidence_band(d.panel(), "date", "major", "cum_deaths", "population")


@query(
    "date:d major:s total_events:l total_pop:l rate:f9",
    _BAND.format(source="v_panel WHERE county IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)"),
)
def stratum_rates(d: Data):
    stratum = d.table("nation").filter(F.col("n_regionkey") == 3)
    rows = d.panel().join(
        stratum.select(F.col("n_nationkey").alias("county")), "county", "left_semi"
    )
    return A.incidence_band(rows, "date", "major", "cum_deaths", "population")


@query(
    "date:d rate_automobile:f9 rate_building:f9 rate_furniture:f9",
    """SELECT d.date,
              sum(w.automobile * d.cum_deaths) / nullif(sum(w.automobile * d.population), 0)
                AS rate_automobile,
              sum(w.building * d.cum_deaths) / nullif(sum(w.building * d.population), 0)
                AS rate_building,
              sum(w.furniture * d.cum_deaths) / nullif(sum(w.furniture * d.population), 0)
                AS rate_furniture
       FROM v_daily AS d JOIN v_wide AS w ON w.county = d.county GROUP BY d.date""",
)
def soft_category_rates(d: Data):
    rows = d.once().daily().join(d.wide().select("county", *SHARES), "county")
    return A.soft_category_rates(rows, "date", SHARES, "cum_deaths", "population")


@query(
    "major:s date:d weighted:f4 log_weighted:f8",
    """SELECT major, date, weighted, CASE WHEN weighted > 0 THEN ln(weighted) END AS log_weighted
       FROM (SELECT w.major, d.date, sum(d.cum_confirmed * CASE w.major
                      WHEN 'AUTOMOBILE' THEN w.automobile WHEN 'BUILDING' THEN w.building
                      ELSE w.furniture END) AS weighted
             FROM v_daily AS d JOIN v_wide AS w ON w.county = d.county GROUP BY 1, 2) AS t""",
)
def weighted_total(d: Data):
    strength = A.value_of_label("major", dict(zip(METHODS, SHARES)))
    rows = d.daily().join(d.wide().withColumn("strength", strength), "county")
    totals = rows.groupBy("major", "date").agg(
        F.sum(F.col("cum_confirmed") * F.col("strength")).alias("weighted")
    )
    return totals.withColumn("log_weighted", safe_ln(F.round("weighted", 6)))


@query(
    "deaths:l people:l saved:f4 saved_share:f8",
    """SELECT deaths, people, 0.0003152 * people AS saved,
              0.0003152 * people / nullif(CAST(deaths AS DOUBLE), 0) AS saved_share
       FROM (SELECT sum(cum_deaths) AS deaths, sum(population) AS people FROM v_daily
             WHERE date = DATE '1998-12-15') AS t""",
)
def effect_on_total(d: Data):
    state = d.daily().filter(F.col("date") == F.lit(END)).agg(
        F.sum("cum_deaths").alias("deaths"), F.sum("population").alias("people")
    )
    state = state.withColumn("saved", F.lit(0.0003152) * F.col("people"))
    return state.withColumn("saved_share", ratio("saved", "deaths"))


@query(
    "l_suppkey:l l_partkey:l l_returnflag:s",
    "SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem",
)
def distinct_rows(d: Data):
    return d.table("lineitem").select("l_suppkey", "l_partkey", "l_returnflag").distinct()


# --- reshape, stack, sort ---------------------------------------------------------------------


@query(
    "county:i county_enroll:f2 automobile:f2 building:f2 furniture:f2 household:f2 machinery:f2",
    "SELECT * FROM v_wide",
)
def pivot_category(d: Data):
    return d.wide()


_DAYS = [date(1998, 8, 18) + timedelta(days=7 * i) for i in range(6)]
_DAY_COLS = [f"cases_{x:%Y%m%d}" for x in _DAYS]


@query(
    "county:i " + " ".join(f"{c}:l" for c in _DAY_COLS),
    "SELECT county, "
    + ", ".join(
        f"max(CASE WHEN date = DATE '{x}' THEN cum_confirmed END) AS {c}"
        for x, c in zip(_DAYS, _DAY_COLS)
    )
    + " FROM v_daily GROUP BY county",
)
def pivot_dates(d: Data):
    wide = R.widen_dates(d.daily(), ["county"], "date", "cum_confirmed", _DAYS)
    return wide.toDF("county", *_DAY_COLS)


@query(
    "date:d priority:s n:l",
    """SELECT d.date, p.priority, count(o_orderkey) AS n
       FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) AS d
       CROSS JOIN (SELECT DISTINCT o_orderpriority AS priority FROM orders) AS p
       LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d.date AND o_orderpriority = p.priority
       GROUP BY 1, 2""",
)
def unpivot(d: Data):
    rows = d.table("orders").withColumn("date", F.col("o_orderdate").cast("date"))
    wide = A.crosstab(rows, "date", "o_orderpriority", PRIORITIES)
    return R.lengthen(wide, ["date"], PRIORITIES, "priority", "n")


@query(
    "type:s key:l balance:f2",
    """SELECT 'customer' AS type, c_custkey AS key, c_acctbal AS balance FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def union_labelled(d: Data):
    return R.stack_labelled(
        {
            "customer": d.table("customer").selectExpr("c_custkey AS key", "c_acctbal AS balance"),
            "supplier": d.table("supplier").selectExpr("s_acctbal AS balance", "s_suppkey AS key"),
        }
    )


@query(
    "o_orderkey:l level:s label:s",
    """SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS level,
              split_part(o_orderpriority, '-', 2) AS label FROM orders""",
)
def split_pair(d: Data):
    parts = lambda i: F.split_part("o_orderpriority", F.lit("-"), F.lit(i))
    return d.table("orders").select(
        "o_orderkey", parts(1).alias("level"), parts(2).alias("label")
    )


@query(
    "l_suppkey:l l_shipdate:d l_orderkey:l l_linenumber:i",
    """SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem
       ORDER BY l_suppkey, l_shipdate DESC, l_orderkey, l_linenumber""",
)
def sort_rows(d: Data):
    return d.table("lineitem").orderBy(
        "l_suppkey", F.desc("l_shipdate"), "l_orderkey", "l_linenumber"
    )
