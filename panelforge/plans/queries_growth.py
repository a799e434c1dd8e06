"""Growth-coefficient queries.

The queries with an oracle run on the sliding least-squares slope; the spline runs have none.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.dates import DEATH_LAG_DAYS, shift_days
from panelforge.functions.nulls import ratio, safe_ln
from panelforge.functions.text import per
from panelforge.operators import growth as G
from panelforge.operators import joins as J
from panelforge.operators import ordered as O
from panelforge.operators import reshape as R
from panelforge.operators.cleaning import redistribute_negatives
from panelforge.plans.queries_joins import weekly_slopes
from panelforge.plans.registry import query
from panelforge.plans.standins import END, START, Data


@query(
    "county:i date:d log_new:f9 log_total:f9",
    """SELECT county, date, ln(deaths + 1) AS log_new, ln(cum_deaths + 1) AS log_total
       FROM v_daily""",
)
def log_counts(d: Data):
    return G.with_log_counts(d.daily(), {"log_new": "deaths", "log_total": "cum_deaths"})


@query("county:i date:d log_new:f8 log_new_fit:f8")
def spline_fit(d: Data):
    panel = G.with_log_counts(d.daily(), {"log_new": "deaths"})
    return G.spline_growth(panel, "county", "date", ["log_new"])


@query("county:i date:d log_new_b:f8 log_new_b2:f8 log_total_b:f8 log_total_b2:f8")
def growth_coefficient(d: Data):
    """Both series, first on the counts after negative corrections were moved back."""
    fixed = redistribute_negatives(
        d.daily().select("county", "date", "delta", "cum_deaths"), "county", "date", "delta"
    )
    panel = G.with_log_counts(fixed, {"log_new": "adjusted", "log_total": "cum_deaths"})
    return G.spline_growth(panel, "county", "date", ["log_new", "log_total"])


# The smoother's residuals are orthogonal to straight lines: fit and data have equal sums and equal
# sums against the day. That needs no spline on the other side.
@query(
    "county:i n:l total:f6 moment:f4",
    """SELECT county, count(*) AS n, sum(y) AS total, sum(y * (date - DATE '1998-01-01')) AS moment
       FROM (SELECT county, date, ln(deaths + 1) AS y FROM v_daily) AS t GROUP BY county""",
)
def spline_moments(d: Data):
    panel = G.with_log_counts(d.daily(), {"log_new": "deaths"})
    fit = G.spline_growth(panel, "county", "date", ["log_new"])
    return _moments(fit, "county", "log_new_fit")


@query(
    "major:s n:l total:f6 moment:f4",
    """SELECT major, count(*) AS n, sum(y) AS total, sum(y * (date - DATE '1998-01-01')) AS moment
       FROM (SELECT major, date, ln(sum(deaths) + 1) AS y FROM v_panel GROUP BY 1, 2) AS t
       GROUP BY major""",
)
def category_spline_moments(d: Data):
    daily = G.category_series(d.panel(), "date", "major", "deaths")
    return _moments(G.spline_growth(daily, "major", "date", ["log_count"]), "major", "log_count_fit")


def _moments(fit, key: str, value: str):
    day = F.datediff("date", F.lit("1998-01-01").cast("date"))
    return fit.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(value).alias("total"),
        F.sum(F.col(value) * day).alias("moment"),
    )


# Straight lines, one per county, pass through the smoother unchanged.
@query(
    "county:i date:d y:f6 y_fit:f6 y_b:f6 y_b2:f6",
    """SELECT county, date, y, y AS y_fit, county / 16 AS y_b, 0 AS y_b2
       FROM (SELECT county, date, county + county / 16 * (date - DATE '1998-01-01') AS y
             FROM v_daily) AS t""",
)
def spline_lines(d: Data):
    day = F.datediff("date", F.lit("1998-01-01").cast("date"))
    line = F.col("county") + F.col("county") / 16 * day
    return G.spline_growth(d.daily().withColumn("y", line), "county", "date", ["y"])


# Between two days the fit is one cubic. So over each step the fit grows by the mean of both slopes
# less a twelfth of the change of curvature, and the slope by the mean of both curvatures: summed
# over a series, slopes and curvatures of real (curved) data must meet the fit's own values. The
# other side states the steps, the days between them and errors of zero.
@query(
    "county:i steps:l days:l slope_error:f7 curvature_error:f8",
    """SELECT county, count(*) - 1 AS steps, max(date) - min(date) AS days,
              0 AS slope_error, 0 AS curvature_error FROM v_daily GROUP BY county""",
)
def spline_derivatives(d: Data):
    panel = G.with_log_counts(d.daily(), {"log_new": "deaths"})
    fit = G.spline_growth(panel, "county", "date", ["log_new"])
    return G.derivative_errors(fit, "county", "date", "log_new")


@query("major:s date:d log_count:f8 log_count_fit:f8 log_count_b:f8")
def category_growth(d: Data):
    daily = G.category_series(d.panel(), "date", "major", "deaths")
    return G.spline_growth(daily, "major", "date", ["log_count"])


@query(
    "major:s date:d total:l slope:f6",
    """SELECT major, date, total, CASE WHEN count(*) OVER w = 28
              THEN regr_slope(ln(total + 1), date - DATE '1970-01-01') OVER w END AS slope
       FROM (SELECT major, date, sum(deaths) AS total FROM v_panel GROUP BY 1, 2) AS t
       WINDOW w AS (PARTITION BY major ORDER BY date ROWS BETWEEN 14 PRECEDING AND 13 FOLLOWING)""",
)
def category_local_slope(d: Data):
    daily = G.category_series(d.panel(), "date", "major", "deaths")
    return G.with_local_slope(daily, "log_count", "date", "major")


@query(
    "county:i date:d log_count:f9 slope:f6",
    "SELECT county, date, log_count, slope FROM v_slopes",
)
def local_slope(d: Data):
    return d.slopes()


@query(
    "county:i date:d slope:f6 major:s",
    """SELECT s.county, s.date - 24 AS date, s.slope, w.major
       FROM (SELECT county, major FROM v_wide) AS w
       RIGHT JOIN v_slopes AS s ON s.county = w.county
       WHERE s.date - 24 > DATE '1995-01-23'""",
)
def shifted_growth_panel(d: Data):
    moved = shift_days(d.slopes().select("county", "date", "slope"), "date", -DEATH_LAG_DAYS)
    return d.majors().join(moved, "county", "right").filter(F.col("date") > "1995-01-23")


_BRACKETS = {"avg_m3w": (-21, 0), "avg_m1w_p2w": (-7, 14), "avg_p3w": (0, 21)}
_BRACKET_SQL = ", ".join(
    f"avg(CASE WHEN date >= DATE '1998-08-18' + ({a}) AND date < DATE '1998-08-18' + ({b}) "
    f"THEN slope END) AS {n}"
    for n, (a, b) in _BRACKETS.items()
)
_SEMESTER_SQL = """max(CASE WHEN date BETWEEN DATE '1998-08-18' AND DATE '1998-12-15'
                            THEN slope END) AS max_fall,
                   avg(CASE WHEN date BETWEEN DATE '1998-08-18' AND DATE '1998-12-15'
                            THEN slope END) AS avg_fall"""


def bracket_measures() -> dict:
    offset, slope = F.datediff("date", F.lit(START)), F.col("slope")
    return {n: ((offset >= a) & (offset < b), slope, "avg") for n, (a, b) in _BRACKETS.items()}


def semester_measures() -> dict:
    inside = F.col("date").between(START, END)
    return {
        "max_fall": (inside, F.col("slope"), "max"),
        "avg_fall": (inside, F.col("slope"), "avg"),
    }


@query(
    "county:i max_fall:f6 avg_fall:f6 avg_m3w:f6 avg_m1w_p2w:f6 avg_p3w:f6",
    f"SELECT county, {_SEMESTER_SQL}, {_BRACKET_SQL} FROM v_slopes GROUP BY county",
)
def bracket_means(d: Data):
    return G.summaries(d.slopes(), "county", {**semester_measures(), **bracket_measures()})


@query(
    "county:i population:l major:s automobile:f2 building:f2 furniture:f2 max_fall:f6 avg_fall:f6 "
    "avg_m3w:f6 avg_m1w_p2w:f6 avg_p3w:f6 mobility:f8",
    f"""SELECT p.county, p.population, w.major, w.automobile, w.building, w.furniture,
               b.max_fall, b.avg_fall, b.avg_m3w, b.avg_m1w_p2w, b.avg_p3w, m.mobility
        FROM v_population AS p
        LEFT JOIN v_wide AS w ON w.county = p.county
        LEFT JOIN (SELECT county, {_SEMESTER_SQL}, {_BRACKET_SQL} FROM v_slopes
                   GROUP BY county) AS b ON b.county = p.county
        LEFT JOIN (SELECT county, avg(value) AS mobility FROM v_signals WHERE signal = 'view'
                   GROUP BY county) AS m ON m.county = p.county""",
)
def feature_table(d: Data):
    d.once()
    slopes = G.summaries(d.slopes(), "county", {**semester_measures(), **bracket_measures()})
    mobility = d.signals().filter(F.col("signal") == "view").groupBy("county").agg(
        F.avg("value").alias("mobility")
    )
    return (
        d.population()
        .join(d.wide(), "county", "left")
        .join(slopes, "county", "left")
        .join(mobility, "county", "left")
    )


_WEEK_COLS = """max(CASE WHEN date - DATE '1998-08-18' = 0 THEN slope END) AS b0,
                max(CASE WHEN date - DATE '1998-08-18' = 21 THEN slope END) AS b3,
                max(CASE WHEN date - DATE '1998-08-18' = 28 THEN slope END) AS b4,
                max(CASE WHEN date - DATE '1998-08-18' = 42 THEN slope END) AS b6"""


@query(
    "county:i diff:f6 diff2:f6 acceleration:f6",
    f"""SELECT county, b3 - b0 AS diff, b6 - b3 AS diff2, (b6 - b3) - (b3 - b0) AS acceleration
        FROM (SELECT county, {_WEEK_COLS} FROM v_slopes GROUP BY county) AS t""",
)
def offset_changes(d: Data):
    weeks = weekly_slopes(d)
    return weeks.select(
        "county",
        (F.col("b_3w") - F.col("b_0w")).alias("diff"),
        (F.col("b_6w") - F.col("b_3w")).alias("diff2"),
    ).withColumn("acceleration", F.col("diff2") - F.col("diff"))


@query(
    "type:s county:i change:f6",
    f"""SELECT '6w - 3w' AS type, county, (b6 - b3) / 3 AS change
        FROM (SELECT county, {_WEEK_COLS} FROM v_slopes GROUP BY county) AS t
        UNION ALL SELECT '6w - 4w', county, (b6 - b4) / 2
        FROM (SELECT county, {_WEEK_COLS} FROM v_slopes GROUP BY county) AS t""",
)
def normalised_change(d: Data):
    weeks = weekly_slopes(d)
    change = lambda a, n: weeks.select(
        "county", ((F.col("b_6w") - F.col(a)) / n).alias("change")
    )
    return R.stack_labelled({"6w - 3w": change("b_3w", 3), "6w - 4w": change("b_4w", 2)})


# Offset windows in days: three before the event, the rest after it, overlapping.
OFFSET_WINDOWS = {
    "m3w_0w": (-21, 0),
    "0w_3w": (0, 21),
    "1w_4w": (7, 28),
    "2w_5w": (14, 35),
    "3w_6w": (21, 42),
    "4w_7w": (28, 49),
    "5w_8w": (35, 56),
    "6w_9w": (42, 63),
}
_OFFSET_SQL = ", ".join(
    f"avg(CASE WHEN d.date >= o.open_week + ({a}) AND d.date <= o.open_week + ({b}) "
    f"THEN d.confirmed END) AS mean_{n}"
    for n, (a, b) in OFFSET_WINDOWS.items()
)


@query(
    "county:i " + " ".join(f"mean_{n}:f8" for n in OFFSET_WINDOWS),
    f"""SELECT d.county, {_OFFSET_SQL} FROM v_daily AS d
        JOIN v_opening AS o ON o.county = d.county GROUP BY d.county""",
)
def offset_signal_means(d: Data):
    rows = d.daily().join(d.opening().select("county", "open_week"), "county")
    offset = F.datediff("date", "open_week")
    windows = {
        f"mean_{n}": (offset.between(a, b), F.col("confirmed"), "avg")
        for n, (a, b) in OFFSET_WINDOWS.items()
    }
    return G.summaries(rows, "county", windows)


@query(
    "county:i population:l y0:l y1:l rise:l log_rise:f8 log_rate:f8 rate:f8",
    """SELECT county, population, y0, y1, y1 - y0 AS rise,
              CASE WHEN y1 > y0 THEN ln(y1 - y0) END AS log_rise,
              CASE WHEN y1 > y0 THEN ln((y1 - y0) / CAST(population AS DOUBLE)) END AS log_rate,
              (y1 - y0) / CAST(population AS DOUBLE) * 1000 AS rate
       FROM (SELECT county, population,
                    max(CASE WHEN date = DATE '1998-08-18' THEN cum_deaths END) AS y0,
                    max(CASE WHEN date = DATE '1998-12-15' THEN cum_deaths END) AS y1
             FROM v_daily GROUP BY 1, 2) AS t""",
)
def semester_outcome(d: Data):
    moments = {"y0": F.lit(START), "y1": F.lit(END)}
    ends = J.values_at(d.daily(), ["county", "population"], "date", "cum_deaths", moments)
    ends = ends.withColumn("rise", F.col("y1") - F.col("y0"))
    return ends.withColumns(
        {
            "log_rise": safe_ln("rise"),
            "log_rate": safe_ln(ratio("rise", "population")),
            "rate": per("rise", "population", 1000),
        }
    )


@query(
    "county:i cum_deaths:l per_1000:f3",
    """SELECT county, cum_deaths, round(cum_deaths / CAST(population AS DOUBLE), 5) * 1000 AS per_1000
       FROM v_daily WHERE date = (SELECT max(date) FROM v_daily)""",
)
def snapshot_rate(d: Data):
    panel = d.once().daily()
    last = d.counts().agg(F.max("date").alias("last")).scalar()
    snap = panel.filter(F.col("date") == last)
    return snap.withColumn("per_1000", F.round(ratio("cum_deaths", "population"), 5) * 1000)


@query(
    "county:i date:d slope:f7",
    """SELECT county, date, slope FROM (SELECT *, max(round(slope, 7)) OVER (PARTITION BY county) AS top
         FROM v_slopes) AS t WHERE round(slope, 7) = top""",
)
def peak_growth_dates(d: Data):
    rows = d.slopes().select("county", "date", F.round("slope", 7).alias("slope"))
    return O.rows_at_max_detail(rows, ["county"], "slope")
