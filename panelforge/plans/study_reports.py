"""Tables, tests and plot data of the county study, on the outputs of `study`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import dates as D
from panelforge.functions import text as X
from panelforge.functions.nulls import not_in, ratio, safe_ln, strict_sum
from panelforge.operators import aggregates as A
from panelforge.operators import growth as G
from panelforge.operators import inference as I
from panelforge.operators import joins as J
from panelforge.operators import ordered as O
from panelforge.operators import plotdata as P
from panelforge.operators import reshape as R
from panelforge.plans.study import POSTURES

# The day the incidence curves cross, the last day with data, the limits of the
# two-month windows, the mask cutoffs, and the rate differences in the effect on the state.
CROSSING = date(2020, 11, 24)
LAST_DAY = date(2021, 2, 22)
LATEST_OPENING = date(2020, 10, 15)
LAST_WINDOW_DAY = date(2020, 12, 25)
MASK_CUTOFFS = [0.4 + 0.01 * i for i in range(60)]
RATE_DIFFERENCES = {"hybrid": 0.0003152, "online": 0.0004732}
NO_POLICY = ["Pending", "Unknown"]
SHARE_COLUMNS = ["Online_Only", "On_Premises", "Hybrid"]
MOBILITY = ["full_work_prop_7d", "part_work_prop_7d", "res_visit_by_pop", "bar_visit_by_pop"]
WEEKS = {**{f"Bm{w}w": -7 * w for w in (3, 2, 1)}, **{f"B{w}w": 7 * w for w in range(8)}}


# --- policy tables ----------------------------------------------------------------------------


def majority(shares: DataFrame, category: str, share: str) -> DataFrame:
    """The policy of the largest share per county; undecided policies do not count."""
    known = shares.filter(not_in(category, NO_POLICY))
    return O.pick_largest(known, ["county"], share, category, [category, share])


def online_majority(shares: DataFrame, share: str = "share") -> DataFrame:
    """Online only against every other posture."""
    known = shares.filter(F.col("teachingmethod").isin(POSTURES))
    two = known.withColumn(
        "is_online", X.recode("teachingmethod", ["Online Only"], "Online Only", "Not Online Only")
    )
    sums = two.groupBy("county", "is_online").agg(strict_sum(share).alias("prop_online_only"))
    return O.pick_largest(
        sums, ["county"], "prop_online_only", "is_online", ["is_online", "prop_online_only"]
    )


def mask_wide(shares: DataFrame, category: str, share: str, policies: Sequence[str]) -> DataFrame:
    """Share per mask policy side by side and the largest one, in the given order."""
    wide = R.widen(shares, ["county"], category, share, policies, 0.0)
    columns = {p: F.col(f"`{p}`") for p in policies}
    return wide.withColumn(f"{category}_majority", A.argmax_columns(columns))


def snapshot(panel: DataFrame, day: date = LAST_DAY) -> DataFrame:
    """Cumulative deaths per person and per 1,000 people on one day."""
    rows = panel.filter(F.col("DATE") == F.lit(day))
    rate = F.round(ratio("CUMDEATHS", "POPULATION"), 5)
    return rows.select(
        F.upper("COUNTY").alias("county"),
        "POPULATION",
        "CUMDEATHS",
        rate.alias("death_prop"),
        (rate * 1000).alias("death_per_1000"),
    )


def policy_wide(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables keyed by county side by side; a county in any of them stays."""
    out = tables[0]
    for table in tables[1:]:
        out = out.join(table, "county", "full")
    return out


def opening_totals(schools: DataFrame) -> DataFrame:
    """Students per opening date and teaching method with their share of the state."""
    keys = ["date", "teachingmethod"]
    totals = A.category_totals(schools, keys, "leaid", "district_enroll", "students")
    counties = schools.select("county", "county_enroll").distinct()
    totals = A.with_grand_total(totals, counties, "county_enroll", "state_enroll")
    return A.with_share(totals, "students", "state_enroll", "state_share", None)


def method_totals(schools: DataFrame) -> DataFrame:
    """Students per teaching method, ranked by their number."""
    units = schools.select("teachingmethod", "leaid", "district_enroll").distinct()
    return units.groupBy("teachingmethod").agg(strict_sum("district_enroll").alias("students"))


# --- outcomes around events -------------------------------------------------------------------


def bracket(panel: DataFrame, openings: DataFrame, end: date = D.SEMESTER_END) -> DataFrame:
    """Rise of deaths and cases from each county's reopening to a common end day."""
    opened = openings.select(F.col("county").alias("_c"), "major_opendate")
    rows = panel.join(opened, F.upper("COUNTY") == F.col("_c"))
    at_open, at_end = F.col("DATE") == F.col("major_opendate"), F.col("DATE") == F.lit(end)
    keys = ["COUNTY", "POPULATION", "major_teaching", "major_opendate"]

    def rise(column: str) -> Column:
        return F.max(F.when(at_end, F.col(column))) - F.max(F.when(at_open, F.col(column)))

    out = rows.groupBy(*keys).agg(
        rise("CUMDEATHS").alias("deaths_rise"), rise("CUMCONFIRMED").alias("cases_rise")
    )
    return out.withColumns(
        {
            "deaths_per_100k": X.per("deaths_rise", "POPULATION", 100_000),
            "cases_per_1000": X.per("cases_rise", "POPULATION", 1_000),
        }
    )


def key_windows(panel: DataFrame, openings: DataFrame) -> DataFrame:
    """Deaths per 1,000 people in three weeks after reopening, around the crossing of the curves,
    and after the semester."""
    opened = openings.select(F.col("county").alias("_c"), "major_opendate")
    rows = panel.join(opened, F.upper("COUNTY") == F.col("_c"))
    day, start = F.col("DATE"), F.col("major_opendate")
    label = O.label_windows(
        [
            ((day >= start) & (day <= F.date_add(start, 21)), "after reopening"),
            (day.between(CROSSING - timedelta(days=10), CROSSING + timedelta(days=11)), "crossing"),
            (
                day.between(
                    D.SEMESTER_END + timedelta(days=21), D.SEMESTER_END + timedelta(days=42)
                ),
                "after the semester",
            ),
        ]
    )
    rows = rows.withColumn("win", label).filter(F.col("win").isNotNull())
    rise = O.first_last_change(
        rows, ["COUNTY", "POPULATION", "major_teaching", "win"], "DATE", "CUMDEATHS", "deaths"
    )
    return rise.withColumn("deaths_per_1000", X.per("deaths", "POPULATION", 1000))


def two_month_windows(panel_mobility: DataFrame, openings: DataFrame) -> DataFrame:
    """Two months before and after the third week of school: mean mobility and deaths, with the
    deaths of the earlier window beside those of the later one (y0, y1)."""
    opened = openings.select(F.col("county").alias("_c"), "major_opendate")
    rows = panel_mobility.join(opened, F.upper("COUNTY") == F.col("_c"))
    day, middle = F.col("DATE"), F.date_add("major_opendate", 21)
    rows = rows.filter(
        (F.col("major_opendate") < F.lit(LATEST_OPENING))
        & (day >= F.date_sub(middle, 56))
        & (day <= F.lit(LAST_WINDOW_DAY))
    )
    rows = rows.withColumn("win", F.when(day <= middle, 1).otherwise(2))
    keys = ["COUNTY", "POPULATION", "major_teaching", "win"]
    out = O.window_profile(rows, keys, "DATE", "CUMDEATHS", MOBILITY)
    out = out.withColumn("y1", X.per("increment", "POPULATION", 1000))
    return O.previous_period(out, "COUNTY", "win", "y1", "y0")


def deaths_at_offsets(panel: DataFrame, openings: DataFrame) -> DataFrame:
    """Cumulative deaths every three weeks from three before the reopening to fifteen after."""
    opened = openings.select(F.col("county").alias("_c"), "opendategrouped")
    rows = panel.join(opened, F.upper("COUNTY") == F.col("_c"))
    offsets = {f"day_{'m' if k < 0 else ''}{abs(k)}": k for k in range(-21, 106, 21)}
    return G.at_offsets(
        rows, "COUNTY", F.datediff("DATE", "opendategrouped"), "CUMDEATHS", offsets
    )


# --- series -----------------------------------------------------------------------------------


def lagged_increments(panel: DataFrame, days: int = 21) -> DataFrame:
    """New deaths per head of each posture over the days before, per day."""
    rows = panel.withColumn("_before", O.lag_rows("CUMDEATHS", days, "COUNTY", "DATE"))
    totals = rows.groupBy("DATE", "major_teaching").agg(
        strict_sum("CUMDEATHS").alias("deaths"),
        strict_sum("_before").alias("deaths_before"),
        strict_sum("POPULATION").alias("people"),
    )
    rise = F.col("deaths") - F.col("deaths_before")
    return totals.withColumn("increment", ratio(rise, "people"))


def soft_rates(panel: DataFrame) -> DataFrame:
    return A.soft_category_rates(panel, "DATE", SHARE_COLUMNS, "CUMDEATHS", "POPULATION")


def mobility_by_posture(panel_mobility: DataFrame) -> DataFrame:
    """Population-weighted work mobility and summed visits per day and posture, with the running
    total of full-time mobility and its date four weeks on."""
    full = F.col("full_work_prop_7d") * F.col("POPULATION")
    daily = panel_mobility.groupBy("DATE", "major_teaching").agg(
        A.weighted_mean("full_work_prop_7d", "POPULATION").alias("full_work_prop"),
        A.weighted_mean("part_work_prop_7d", "POPULATION").alias("part_work_prop"),
        strict_sum("res_visit_by_pop").alias("res_visit_prop"),
        strict_sum("bar_visit_by_pop").alias("bar_visit_prop"),
        strict_sum(full).alias("full_work"),
        strict_sum("POPULATION").alias("people"),
    )
    running = O.running_total("full_work", "major_teaching", "DATE")
    return daily.withColumns(
        {
            "cum_full_work": running,
            "cum_full_work_prop": ratio(running, "people"),
            "shifted_date": D.shifted("DATE", 28),
        }
    )


def age_shares(ages: DataFrame, groups: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of cases per age group in long form with its centred seven-day mean."""
    long = R.lengthen(ages.select("Date", *by, *groups), ["Date", *by], groups, "age_group", "share")
    mean = O.centered_mean("share", 7, [*by, "age_group"], "Date")
    return long.withColumn("share_mean7", mean)


# --- growth around the semester start ---------------------------------------------------------


def weekly_growth(shifted: DataFrame, slope: str = "new_slope") -> DataFrame:
    """Growth at weekly offsets from the semester start, its three-week changes and their change."""
    offset = F.datediff("DATE", F.lit(D.SEMESTER_START))
    weeks = G.at_offsets(shifted, "COUNTY", offset, slope, WEEKS)
    return weeks.withColumns(
        {"diff": F.col("B3w") - F.col("B0w"), "diff2": F.col("B6w") - F.col("B3w")}
    ).withColumn("acceleration", F.col("diff2") - F.col("diff"))


def weekly_change(weeks: DataFrame) -> DataFrame:
    """Change per week up to the sixth week, over three and over two weeks, stacked."""
    later = F.col("B6w")
    return R.stack_labelled(
        {
            "6w - 3w": weeks.select("COUNTY", ((later - F.col("B3w")) / 3).alias("change")),
            "6w - 4w": weeks.select("COUNTY", ((later - F.col("B4w")) / 2).alias("change")),
        }
    )


def mobility_at_offsets(
    panel_mobility: DataFrame, openings: DataFrame, windows: Mapping[str, tuple[int, int]]
) -> DataFrame:
    """Mean full-time mobility in closed windows of days around each county's reopening."""
    opened = openings.select(F.col("county").alias("_c"), "major_opendate")
    rows = panel_mobility.join(opened, F.upper("COUNTY") == F.col("_c"))
    offset, value = F.datediff("DATE", "major_opendate"), F.col("full_work_prop_7d")
    return G.summaries(
        rows, "COUNTY", {n: (offset.between(a, b), value, "avg") for n, (a, b) in windows.items()}
    )


def semester_rates(panel: DataFrame) -> DataFrame:
    """Deaths at the start and end of the semester with the logs of the rise and of its rate."""
    keys = ["COUNTY", "POPULATION", "major_teaching"]
    moments = {"start": F.lit(D.SEMESTER_START), "end": F.lit(D.SEMESTER_END)}
    ends = J.values_at(panel, keys, "DATE", "CUMDEATHS", moments)
    rise = F.col("end") - F.col("start")
    return ends.withColumns(
        {
            "deaths": rise,
            "log_deaths": safe_ln(rise),
            "log_rate": safe_ln(ratio(rise, "POPULATION")),
            "per_1000": X.per(rise, "POPULATION", 1000),
        }
    )


# --- tests ------------------------------------------------------------------------------------


def posthoc_tests(outcomes: DataFrame, y: str, control: str = "On Premises") -> dict[str, DataFrame]:
    """All pairwise comparisons of an outcome by posture and the rank test."""
    keyed = outcomes.withColumn("test", F.lit(y))
    pairs = I.posthoc_pairs(keyed, y, "major_teaching", "test")
    return {
        "tukey": I.tukey_hsd(pairs),
        "duncan": I.duncan(pairs),
        "scheffe": I.scheffe(pairs),
        "bonferroni": I.bonferroni(pairs),
        "dunnett": I.dunnett(pairs, control, "test"),
        "kruskal": I.with_chi2_pvalue(I.kruskal_wallis(keyed, y, "major_teaching", "test")),
    }


def mask_cutoffs(counties: DataFrame, y: str, share: str = "prop_student_mask") -> DataFrame:
    """p value of the outcome against (mask share > cutoff) for each cutoff and teaching method."""
    sweep = I.anova_cutoff_sweep(counties, y, share, MASK_CUTOFFS, "teachingmethod")
    return I.with_f_pvalue(sweep)


def growth_lines(features: DataFrame, x: Column, y: str = "maxB_fall") -> DataFrame:
    """Line of the growth on a county attribute per posture."""
    rows = features.withColumn("_x", x)
    return I.with_t_pvalue(I.ols_simple(rows, y, "_x", "major_teaching"))


def weighted_growth_lines(features: DataFrame, y: str = "maxB_fall") -> DataFrame:
    """Line of the growth on log population, weighted by the share of each posture in turn."""
    rows = features.withColumn("_x", safe_ln("POPULATION"))
    long = R.lengthen(
        rows.select("COUNTY", "_x", y, *SHARE_COLUMNS), ["COUNTY", "_x", y], SHARE_COLUMNS, "posture", "w"
    )
    return I.with_t_pvalue(I.wls_simple(long, y, "_x", "w", "posture"))


def effect_on_state(outcomes: DataFrame, deaths: str = "deaths_rise") -> DataFrame:
    """Lives that each rate difference would mean for the state, and their share of the deaths."""
    out = outcomes.agg(F.sum("POPULATION").alias("people"), F.sum(deaths).alias("deaths"))
    for name, difference in RATE_DIFFERENCES.items():
        out = out.withColumn(f"saved_{name}", F.lit(difference) * F.col("people"))
        out = out.withColumn(f"share_{name}", ratio(f"saved_{name}", "deaths"))
    return out


def county_map(polygons: DataFrame, attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributes on every boundary vertex, in drawing order, and a label point per county."""
    upper = polygons.withColumn("county", F.upper("county"))
    drawn = O.attach(upper, attributes, ["county"]).orderBy("county", "grp", "vertex")
    return drawn, P.polygon_centroids(upper, ["county", "grp"], "vertex", "long", "lat")

