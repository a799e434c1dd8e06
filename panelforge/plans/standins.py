"""The study's concepts expressed on the test tables, once in Spark and once as SQL views.

county = nation, district = customer, school = order, teaching method = market segment,
mask policy = order priority, deaths = finished orders per day, signals = events by type.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.functions.nulls import log1p_count
from panelforge.operators import aggregates as A
from panelforge.operators import cleaning as C
from panelforge.operators import growth as G
from panelforge.operators import ordered as O
from panelforge.operators import reshape as R
from panelforge.session import kept_table
from panelforge.sources.readers import test_table

# Fixed values of the stand-in study.
START, END = date(1998, 8, 18), date(1998, 12, 15)
OPENING_FROM = date(1998, 8, 1)
METHODS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
MAIN_METHODS = METHODS[:3]
SHARES = [m.lower() for m in MAIN_METHODS]
SIGNALS = ["click", "error", "purchase", "signup", "view"]
PLACES = 25


class Data:
    """Stand-in tables of one test folder; every method is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._grains: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return test_table(self.spark, self.folder, name)

    def grains(self) -> DataFrame:
        """Orders by county and day (`is_panel`) and by district, from one pass over the fact table.

        The grains are grouping sets, so a task sends one row per cell of each. The join of orders and
        customers comes first, since a county is needed; adaptive execution may split a hot customer.
        """
        day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
        undo = (status == "P") & (F.col("o_orderpriority") == "5-LOW")
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.select(
            F.col("c_nationkey").alias("county"),
            day.alias("date"),
            F.col("c_custkey").alias("district"),
            F.col("c_mktsegment").alias("method"),
            "c_acctbal",
            "o_totalprice",
            F.when(day >= F.lit(OPENING_FROM), day).alias("opened"),
            (status == "F").alias("finished"),
            F.when(status == "F", 1).when(undo, -1).otherwise(0).alias("change"),
        )
        panel, district = ["county", "date"], ["county", "district", "method", "c_acctbal"]
        return rows.groupingSets([panel, district], *panel, *district[1:]).agg(
            (F.grouping("date") == 0).alias("is_panel"),
            F.count(F.lit(1)).alias("confirmed"),
            F.count_if("finished").alias("deaths"),
            F.sum("change").alias("delta"),
            F.round(F.sum("o_totalprice"), 2).alias("summed"),
            F.min("opened").alias("opened"),
        )

    def once(self) -> Data:
        """These tables with `grains` computed now and kept, for queries that need several of them:
        what follows reads a table of cells and districts, not the orders."""
        if self._grains is None:
            self._grains = kept_table(self.grains(), "grains")
        return self

    def by_district(self, orders: DataFrame, *aggs) -> DataFrame:
        """Orders reduced to one row per customer before the join, so a customer with very many
        orders reaches the join as one row; both steps share the placement by customer."""
        return (
            orders.groupBy("o_custkey")
            .agg(*aggs)
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .withColumnsRenamed(
                {"c_nationkey": "county", "c_custkey": "district", "c_mktsegment": "method"}
            )
        )

    def district(self) -> DataFrame:
        """One row per district with the larger of summed and reported enrollment."""
        day = F.col("o_orderdate").cast("date")
        if self._grains is not None:
            sums = self._grains.filter("not is_panel")
        else:
            sums = self.by_district(
                self.table("orders"),
                F.round(F.sum("o_totalprice"), 2).alias("summed"),
                F.min(F.when(day >= F.lit(OPENING_FROM), day)).alias("opened"),
            )
        return sums.select(
            "county",
            "district",
            "method",
            (F.col("c_acctbal") * 300.0).alias("reported"),
            "summed",
            C.larger_of_summed_and_reported("summed", F.col("c_acctbal") * 300.0).alias("enroll"),
            F.trunc("opened", "week").alias("open_week"),
        )

    def district_masks(self) -> DataFrame:
        """Districts with each mask policy of their schools."""
        masks = self.table("orders").select(
            F.col("o_custkey").alias("district"), F.col("o_orderpriority").alias("mask")
        )
        return masks.distinct().join(
            self.district().select("county", "district", "enroll"), "district"
        )

    def county_totals(self) -> DataFrame:
        return self.district().groupBy("county").agg(
            F.round(F.sum("enroll"), 2).alias("county_enroll")
        )

    def shares(self, category: str = "method") -> DataFrame:
        """Share of the county per category. Every district has one value of the category, so the
        county total is the sum over the few category rows and the districts are read once."""
        totals = A.category_totals(self.district(), ["county", category], "district", "enroll", "total")
        county = F.round(F.sum("total").over(W.partitionBy("county")), 2)
        return A.with_share(
            totals.withColumn("county_enroll", county), "total", "county_enroll", "share"
        )

    def wide(self) -> DataFrame:
        wide = R.widen(self.shares(), ["county", "county_enroll"], "method", "share", METHODS, 0.0)
        wide = wide.toDF(*[c.lower() for c in wide.columns])
        return wide.withColumn("major", A.argmax_columns(dict(zip(MAIN_METHODS, SHARES))))

    def opening(self) -> DataFrame:
        dated = self.shares("open_week").filter(F.col("open_week").isNotNull())
        return O.pick_largest(dated, ["county"], "share", "open_week", ["open_week", "share"])

    def counts(self) -> DataFrame:
        if self._grains is not None:
            return self._grains.filter("is_panel").select("county", "date", "confirmed", "deaths", "delta")
        status = F.col("o_orderstatus")
        undo = (status == "P") & (F.col("o_orderpriority") == "5-LOW")
        rows = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey")
        )
        return rows.groupBy(
            F.col("c_nationkey").alias("county"), F.col("o_orderdate").cast("date").alias("date")
        ).agg(
            F.count(F.lit(1)).alias("confirmed"),
            F.count_if(status == "F").alias("deaths"),
            F.sum(F.when(status == "F", 1).when(undo, -1).otherwise(0)).alias("delta"),
        )

    def population(self) -> DataFrame:
        return (
            self.table("customer")
            .groupBy(F.col("c_nationkey").alias("county"))
            .agg((F.count(F.lit(1)) * 1000).alias("population"))
        )

    def daily(self) -> DataFrame:
        """Dense county-by-day panel with running totals."""
        dense = O.densify(
            self.counts(),
            self.population(),
            "county",
            "date",
            ["confirmed", "deaths", "delta"],
            seen=None
            if self._grains is not None
            else self.table("orders").select(F.col("o_orderdate").cast("date").alias("date")),
        )
        return dense.withColumns(
            {
                "cum_confirmed": O.running_total("confirmed", "county", "date"),
                "cum_deaths": O.running_total("deaths", "county", "date"),
            }
        )

    def signals(self) -> DataFrame:
        value = F.col("value")
        return (
            self.table("events")
            .groupBy(
                F.col("event_type").alias("signal"),
                (F.col("user_id") % PLACES).cast("int").alias("county"),
                F.col("ts").cast("date").alias("date"),
            )
            .agg(
                F.round(F.avg(value), 6).alias("value"),
                F.count(value).alias("sample_size"),
                (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("stderr"),
            )
        )

    def outbreak(self) -> DataFrame:
        """Short county-by-day panel on the same days as the signals."""
        kind = F.col("event_type")
        rows = (
            self.table("events")
            .groupBy(
                (F.col("user_id") % PLACES).cast("int").alias("county"),
                F.col("ts").cast("date").alias("date"),
            )
            .agg(
                F.count_if(kind == "error").alias("deaths"),
                F.count_if(kind == "click").alias("confirmed"),
            )
        )
        return rows.withColumn("cum_deaths", O.running_total("deaths", "county", "date"))

    def slopes(self) -> DataFrame:
        panel = self.daily().withColumn("log_count", log1p_count("deaths"))
        return G.with_local_slope(panel, "log_count", "date", "county")

    def majors(self) -> DataFrame:
        return self.wide().select("county", "major")

    def panel(self) -> DataFrame:
        """Daily panel with the majority method of each county."""
        self.once()
        return self.daily().join(self.majors(), "county")


VIEWS = {
    "v_school": """
        SELECT o_orderkey AS school_id, c_nationkey AS county, c_custkey AS district,
               o_totalprice AS enrollment, c_acctbal * CAST(300 AS DOUBLE) AS reported,
               c_mktsegment AS method, o_orderpriority AS mask, o_orderstatus AS level,
               CAST(o_orderdate AS DATE) AS open_date
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "v_district": """
        SELECT county, district, method, reported, summed,
               CASE WHEN summed > reported THEN summed ELSE reported END AS enroll,
               CAST(date_trunc('week', opened) AS DATE) AS open_week
        FROM (SELECT county, district, method, reported, round(sum(enrollment), 2) AS summed,
                     min(open_date) FILTER (open_date >= DATE '1998-08-01') AS opened
              FROM v_school GROUP BY county, district, method, reported) AS s""",
    "v_county_totals": """
        SELECT county, round(sum(enroll), 2) AS county_enroll FROM v_district GROUP BY county""",
    "v_shares": """
        SELECT t.county, t.method, t.total, c.county_enroll,
               round(t.total / nullif(c.county_enroll, 0), 2) AS share
        FROM (SELECT county, method, sum(enroll) AS total
              FROM (SELECT DISTINCT county, method, district, enroll FROM v_district) AS u
              GROUP BY county, method) AS t
        JOIN v_county_totals AS c ON c.county = t.county""",
    "v_open_shares": """
        SELECT t.county, t.open_week, t.total, c.county_enroll,
               round(t.total / nullif(c.county_enroll, 0), 2) AS share
        FROM (SELECT county, open_week, sum(enroll) AS total FROM v_district
              GROUP BY county, open_week) AS t
        JOIN v_county_totals AS c ON c.county = t.county""",
    "v_wide0": """
        SELECT county, county_enroll,
               coalesce(max(CASE WHEN method = 'AUTOMOBILE' THEN share END), 0) AS automobile,
               coalesce(max(CASE WHEN method = 'BUILDING' THEN share END), 0) AS building,
               coalesce(max(CASE WHEN method = 'FURNITURE' THEN share END), 0) AS furniture,
               coalesce(max(CASE WHEN method = 'HOUSEHOLD' THEN share END), 0) AS household,
               coalesce(max(CASE WHEN method = 'MACHINERY' THEN share END), 0) AS machinery
        FROM v_shares GROUP BY county, county_enroll""",
    "v_wide": """
        SELECT *, CASE WHEN automobile >= building AND automobile >= furniture THEN 'AUTOMOBILE'
                       WHEN building >= furniture THEN 'BUILDING' ELSE 'FURNITURE' END AS major
        FROM v_wide0""",
    "v_opening": """
        SELECT county, open_week, share
        FROM (SELECT *, row_number() OVER (PARTITION BY county ORDER BY share DESC, open_week) AS rn
              FROM v_open_shares WHERE open_week IS NOT NULL AND share IS NOT NULL) AS r
        WHERE rn = 1""",
    "v_counts": """
        SELECT c_nationkey AS county, CAST(o_orderdate AS DATE) AS date, count(*) AS confirmed,
               count(*) FILTER (o_orderstatus = 'F') AS deaths,
               sum(CASE WHEN o_orderstatus = 'F' THEN 1
                        WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN -1
                        ELSE 0 END) AS delta
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY 1, 2""",
    "v_population": """
        SELECT c_nationkey AS county, count(*) * 1000 AS population FROM customer GROUP BY 1""",
    "v_days": """
        SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
        FROM v_counts""",
    "v_daily": """
        SELECT p.county, d.date, p.population, coalesce(c.confirmed, 0) AS confirmed,
               coalesce(c.deaths, 0) AS deaths, coalesce(c.delta, 0) AS delta,
               sum(coalesce(c.confirmed, 0)) OVER w AS cum_confirmed,
               sum(coalesce(c.deaths, 0)) OVER w AS cum_deaths
        FROM v_population AS p CROSS JOIN v_days AS d
        LEFT JOIN v_counts AS c ON c.county = p.county AND c.date = d.date
        WINDOW w AS (PARTITION BY p.county ORDER BY d.date
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "v_signals": """
        SELECT event_type AS signal, CAST(user_id % 25 AS INTEGER) AS county,
               CAST(ts AS DATE) AS date, round(avg(value), 6) AS value,
               count(value) AS sample_size, stddev_samp(value) / sqrt(count(value)) AS stderr
        FROM events GROUP BY 1, 2, 3""",
    "v_outbreak": """
        SELECT county, date, deaths, confirmed,
               sum(deaths) OVER (PARTITION BY county ORDER BY date
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_deaths
        FROM (SELECT CAST(user_id % 25 AS INTEGER) AS county, CAST(ts AS DATE) AS date,
                     count(*) FILTER (event_type = 'error') AS deaths,
                     count(*) FILTER (event_type = 'click') AS confirmed
              FROM events GROUP BY 1, 2) AS e""",
    "v_slopes": """
        SELECT *, ln(deaths + 1) AS log_count,
               CASE WHEN count(*) OVER w = 28
                    THEN regr_slope(ln(deaths + 1), date - DATE '1970-01-01') OVER w END AS slope
        FROM v_daily
        WINDOW w AS (PARTITION BY county ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)""",
    "v_panel": """
        SELECT d.*, w.major FROM v_daily AS d JOIN v_wide AS w ON w.county = d.county""",
}


def with_views(sql: str) -> str:
    """Prefix a statement with the views it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    return f"WITH {views} {sql}"
