"""Window and ordered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.dates import shift_days as move_days
from panelforge.functions.nulls import ratio, strict_sum
from panelforge.operators import aggregates as A
from panelforge.operators import intervals as V
from panelforge.operators import ordered as O
from panelforge.plans.registry import query
from panelforge.plans.standins import END, MAIN_METHODS, SHARES, START, Data


@query(
    "county:i method:s share:f2",
    """SELECT county, method, share FROM (SELECT *, row_number() OVER (
         PARTITION BY county ORDER BY share DESC, method) AS rn FROM v_shares
         WHERE share IS NOT NULL) AS t WHERE rn = 1""",
)
def majority_pick(d: Data):
    return O.pick_largest(d.shares(), ["county"], "share", "method", ["method", "share"])


@query(
    "county:i major:s major_share:f2",
    """SELECT county, major, CASE major WHEN 'AUTOMOBILE' THEN automobile
              WHEN 'BUILDING' THEN building WHEN 'FURNITURE' THEN furniture ELSE 0 END
              AS major_share FROM v_wide""",
)
def argmax_columns(d: Data):
    strength = A.value_of_label("major", dict(zip(MAIN_METHODS, SHARES)))
    return d.wide().withColumn("major_share", strength)


@query(
    "date:d major:s total:l total_lag:l pop:l increment:f9",
    """SELECT date, major, total, total_lag, pop,
              (total - total_lag) / CAST(pop AS DOUBLE) AS increment
       FROM (SELECT date, major, sum(cum_deaths) AS total,
                    CASE WHEN count(before) = count(*) THEN sum(before) END AS total_lag,
                    sum(population) AS pop
             FROM (SELECT *, lag(cum_deaths, 21) OVER (PARTITION BY county ORDER BY date) AS before
                   FROM v_panel) AS p GROUP BY 1, 2) AS t""",
)
def lag_increment(d: Data):
    rows = d.once().daily().withColumn("before", O.lag_rows("cum_deaths", 21, "county", "date"))
    totals = rows.join(d.majors(), "county").groupBy("date", "major").agg(
        strict_sum("cum_deaths").alias("total"),
        strict_sum("before").alias("total_lag"),
        strict_sum("population").alias("pop"),
    )
    return totals.withColumn("increment", ratio(F.col("total") - F.col("total_lag"), "pop"))


_LABELS = """CASE WHEN date >= DATE '1998-07-28' AND date < DATE '1998-08-18' THEN '1 before'
                  WHEN date >= DATE '1998-08-18' AND date <= DATE '1998-12-15' THEN '2 semester'
                  WHEN date > DATE '1998-12-15' AND date <= DATE '1999-01-05' THEN '3 after'
                  WHEN date > DATE '1999-01-05' AND date <= DATE '1999-01-26' THEN '4 later' END"""


def labelled(d: Data):
    """Daily panel with fixed event windows; days outside have a null label."""
    day = F.col("date")
    windows = [
        ((day >= F.date_sub(F.lit(START), 21)) & (day < F.lit(START)), "1 before"),
        (day.between(START, END), "2 semester"),
        ((day > F.lit(END)) & (day <= F.date_add(F.lit(END), 21)), "3 after"),
        (
            (day > F.date_add(F.lit(END), 21)) & (day <= F.date_add(F.lit(END), 42)),
            "4 later",
        ),
    ]
    return d.daily().withColumn("win", O.label_windows(windows))


@query(
    "county:i date:d win:s",
    """SELECT d.county, d.date,
              CASE WHEN d.date >= o.open_week AND d.date <= o.open_week + 21 THEN 'start'
                   WHEN d.date >= DATE '1998-11-14' AND d.date <= DATE '1998-12-05' THEN 'crossing'
                   WHEN d.date >= DATE '1999-01-05' AND d.date <= DATE '1999-01-26' THEN 'after'
              END AS win
       FROM v_daily AS d JOIN v_opening AS o ON o.county = d.county""",
)
def event_windows(d: Data):
    rows = d.daily().select("county", "date").join(
        d.opening().select("county", "open_week"), "county"
    )
    day, opened = F.col("date"), F.col("open_week")
    return rows.withColumn(
        "win",
        O.label_windows(
            [
                ((day >= opened) & (day <= F.date_add(opened, 21)), "start"),
                (day.between("1998-11-14", "1998-12-05"), "crossing"),
                (day.between("1999-01-05", "1999-01-26"), "after"),
            ]
        ),
    )


@query(
    "county:i win:s y1:l y0:l",
    f"""SELECT county, win, y1, y0 FROM (
          SELECT county, win, y1, lag(y1) OVER (PARTITION BY county ORDER BY win) AS y0
          FROM (SELECT county, win, max(cum_confirmed) - min(cum_confirmed) AS y1
                FROM (SELECT *, {_LABELS} AS win FROM v_daily) AS l
                WHERE win IS NOT NULL GROUP BY 1, 2) AS t) AS p
        WHERE y0 IS NOT NULL""",
)
def prev_period(d: Data):
    rows = labelled(d).filter(F.col("win").isNotNull())
    steps = O.first_last_change(rows, ["county", "win"], "date", "cum_confirmed", "rise")
    steps = steps.select("county", "win", F.col("rise").alias("y1"))
    return O.previous_period(steps, "county", "win", "y1")


@query(
    "o_custkey:l change:f2",
    """SELECT o_custkey, CASE WHEN count(*) > 1
              THEN arg_max(o_totalprice, o_orderkey) - arg_min(o_totalprice, o_orderkey) END AS change
       FROM orders GROUP BY 1""",
)
def first_last_diff(d: Data):
    return O.first_last_change(d.table("orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query(
    "major:s date:d new:l running:l running_rate:f9",
    """SELECT major, date, new, sum(new) OVER w AS running,
              sum(new) OVER w / CAST(pop AS DOUBLE) AS running_rate
       FROM (SELECT major, date, sum(confirmed) AS new, sum(population) AS pop FROM v_panel
             GROUP BY 1, 2) AS t
       WINDOW w AS (PARTITION BY major ORDER BY date ROWS UNBOUNDED PRECEDING)""",
)
def running_total(d: Data):
    daily = d.panel().groupBy("major", "date").agg(
        F.sum("confirmed").alias("new"), F.sum("population").alias("pop")
    )
    out = daily.withColumn("running", O.running_total("new", "major", "date"))
    return out.withColumn("running_rate", ratio("running", "pop"))


@query(
    "county:i date:d deaths:l mean7:f8",
    """SELECT county, date, deaths, CASE WHEN count(*) OVER w = 7 THEN avg(deaths) OVER w END AS mean7
       FROM v_daily
       WINDOW w AS (PARTITION BY county ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""",
)
def centered_rollmean(d: Data):
    return d.daily().withColumn("mean7", O.centered_mean("deaths", 7, "county", "date"))


@query(
    "county:i win:s y0:l y1:l",
    f"""SELECT county, win, min(cum_deaths) AS y0,
               CASE WHEN count(*) > 1 THEN max(cum_deaths) END AS y1
        FROM (SELECT *, {_LABELS} AS win FROM v_daily) AS l WHERE win IS NOT NULL GROUP BY 1, 2""",
)
def interval_endpoints(d: Data):
    rows = labelled(d).filter(F.col("win").isNotNull())
    return O.interval_endpoints(rows, ["county", "win"], "date", "cum_deaths")


@query(
    "county:i win:s avg_confirmed:f8 avg_deaths:f8 increment:l",
    f"""SELECT county, win, avg(confirmed) AS avg_confirmed, avg(deaths) AS avg_deaths,
               max(cum_deaths) - min(cum_deaths) AS increment
        FROM (SELECT *, {_LABELS} AS win FROM v_daily) AS l WHERE win IS NOT NULL GROUP BY 1, 2""",
)
def window_profile(d: Data):
    rows = labelled(d).filter(F.col("win").isNotNull())
    return O.window_profile(
        rows, ["county", "win"], "date", "cum_deaths", ["confirmed", "deaths"]
    )


@query(
    "signal:s county:i date:d value:f6",
    "SELECT signal, county, date - 24 AS date, value FROM v_signals",
)
def shift_days(d: Data):
    return move_days(d.signals(), "date", -24)


# Days around a district's first order, as (label, first offset, last offset).
BRACKETS = [("1 before", -21, 0), ("2 around", -7, 14), ("3 after", 0, 21), ("4 later", 15, 42)]


@query(
    "district:l bracket:s days:l deaths:l deaths_mean:f8 orders_mean:f8",
    f"""SELECT w.district, w.bracket, count(p.date) AS days, sum(p.deaths) AS deaths,
               avg(p.deaths) AS deaths_mean, avg(p.confirmed) AS orders_mean
        FROM (SELECT county, district, bracket, opened + lo AS first_day, opened + hi AS last_day
              FROM (SELECT county, district, min(open_date) AS opened FROM v_school GROUP BY 1, 2) AS o
              CROSS JOIN (VALUES {", ".join(map(str, BRACKETS))}) AS b(bracket, lo, hi)) AS w
        LEFT JOIN v_daily AS p
          ON p.county = w.county AND p.date BETWEEN w.first_day AND w.last_day
        GROUP BY w.district, w.bracket""",
)
def bracket_table(d: Data):
    """Four overlapping windows per district over the panel of its county, from one table of windows."""
    day = F.col("o_orderdate").cast("date")
    opened = d.by_district(d.table("orders"), F.min(day).alias("opened"))
    cells = [
        F.struct(
            F.lit(label).alias("bracket"),
            F.date_add("opened", low).alias("first_day"),
            F.date_add("opened", high).alias("last_day"),
        )
        for label, low, high in BRACKETS
    ]
    windows = opened.select("county", "district", F.inline(F.array(*cells)))
    found = V.window_totals(
        d.daily(),
        windows,
        "county",
        "date",
        "first_day",
        "last_day",
        {"deaths": F.col("deaths"), "orders": F.col("confirmed")},
    )
    return found.withColumnsRenamed({"rows": "days", "deaths_sum": "deaths"})


@query(
    "o_orderkey:l urgent:l days:i",
    """SELECT o.o_orderkey, u.o_orderkey AS urgent,
              CAST(o.o_orderdate AS DATE) - CAST(u.o_orderdate AS DATE) AS days
       FROM orders AS o JOIN orders AS u ON u.o_custkey = o.o_custkey
         AND u.o_orderpriority = '1-URGENT'
         AND CAST(o.o_orderdate AS DATE) - CAST(u.o_orderdate AS DATE) BETWEEN -14 AND 28""",
)
def orders_near_urgent(d: Data):
    """Orders from 14 days before to 28 days after each urgent order of their customer."""
    rows = d.table("orders").withColumn("day", F.col("o_orderdate").cast("date"))
    windows = rows.filter(F.col("o_orderpriority") == "1-URGENT").select(
        "o_custkey",
        F.col("o_orderkey").alias("urgent"),
        F.col("day").alias("urgent_day"),
        F.date_sub("day", 14).alias("first_day"),
        F.date_add("day", 28).alias("last_day"),
    )
    met = V.rows_in_windows(
        rows.select("o_custkey", "o_orderkey", "day"), windows, "o_custkey", "day", "first_day", "last_day"
    )
    return met.withColumn("days", F.datediff("day", "urgent_day"))
