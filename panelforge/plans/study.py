"""The county study end to end on its own tables (schemas in `sources.schemas.STUDY`).

Every step is a function of DataFrames, so steps can be used alone or chained; nothing is cached
or collected on the way. All dates are moved by pure functions, never in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import dates as D
from panelforge.functions import text as X
from panelforge.functions.nulls import log1p_count, not_in, ratio, strict_sum, to_number
from panelforge.operators import aggregates as A
from panelforge.operators import cleaning as C
from panelforge.operators import columns as K
from panelforge.operators import growth as G
from panelforge.operators import inference as I
from panelforge.operators import ordered as O
from panelforge.operators import reshape as R

# Categories of the survey in the order that breaks ties, the factor order of the
# postures, the partial mask policies, and the signal names with the columns made from them.
METHODS = ["Hybrid", "On Premises", "Online Only", "Other", "Pending", "Unknown"]
POSTURES = METHODS[:3]
POSTURE_ORDER = ["On Premises", "Hybrid", "Online Only"]
MASK_ALL = "Required for all students"
MASK_PARTIAL = [
    "Required for high school students only",
    "Required for middle/high school students only",
]
CLOSED = ["Closed indefinitely", "Pending", "Unknown"]
SIGNALS = {
    "part_time_work_prop_7dav": ["value", "sample_size"],
    "full_time_work_prop_7dav": ["value", "sample_size", "stderr"],
    "restaurants_visit_prop": ["value"],
    "bars_visit_prop": ["value"],
}
SIGNAL_NAMES = {
    "part_time_work_prop_7dav_value": "part_work_prop_7d",
    "part_time_work_prop_7dav_sample_size": "part_work_sample_size",
    "full_time_work_prop_7dav_value": "full_work_prop_7d",
    "full_time_work_prop_7dav_sample_size": "full_work_sample_size",
    "full_time_work_prop_7dav_stderr": "full_work_std",
    "restaurants_visit_prop_value": "res_visit_by_pop",
    "bars_visit_prop_value": "bar_visit_by_pop",
}
DAY_AFTER_START = date(2020, 1, 23)


# --- schools ----------------------------------------------------------------------------------


def clean_schools(raw: DataFrame, overrides: DataFrame) -> DataFrame:
    """Typed school rows with a county for each and the district and county enrollment.

    `overrides` (physicalcity, county) decides the cities that lie in more than one county.
    """
    rows = K.normalise_names(raw)
    rows = rows.withColumns(
        {
            "enrollment": to_number("enrollment"),
            "enrollment_1": to_number("enrollment_1"),
            **{c: D.parse_iso(c) for c in ("date", "lastverifieddate", "opendategrouped")},
        }
    )
    rows = C.sentinels_to_null(rows, C.SCHOOL_SENTINELS)
    rows = C.impute_from_lookup(rows, "physicalcity", "county")
    rows = C.impute_override(rows, "physicalcity", "county", overrides)
    return with_enrollment(rows.filter(F.col("teachingmethod").isNotNull()))


def with_enrollment(rows: DataFrame) -> DataFrame:
    districts = rows.groupBy("county", "leaid", "enrollment_1").agg(
        F.coalesce(F.sum("enrollment"), F.lit(0.0)).alias("_summed")
    )
    districts = districts.select(
        "county",
        "leaid",
        C.larger_of_summed_and_reported("_summed", "enrollment_1").alias("district_enroll"),
    )
    counties = districts.groupBy("county").agg(
        strict_sum("district_enroll").alias("county_enroll")
    )
    districts = O.attach(districts, counties, ["county"])
    return O.attach(rows, districts, ["county", "leaid"])


def enrollment_shares(
    schools: DataFrame, category: str, name: str = "share", digits: int = 2
) -> DataFrame:
    """Students and share of the county per category value."""
    totals = A.category_totals(
        schools, ["county", category, "county_enroll"], "leaid", "district_enroll", "students"
    )
    return A.with_share(totals, "students", "county_enroll", name, digits)


def teaching_wide(schools: DataFrame) -> DataFrame:
    """One row per county: share of each teaching method, the largest posture and its share."""
    shares = enrollment_shares(schools, "teachingmethod")
    wide = R.widen(shares, ["county", "county_enroll"], "teachingmethod", "share", METHODS, 0.0)
    wide = wide.toDF(*[c.replace(" ", "_") for c in wide.columns])
    columns = {p: p.replace(" ", "_") for p in POSTURES}
    wide = wide.withColumn("major_teaching", A.argmax_columns(columns))
    return wide.withColumn("major_teaching_prop", A.value_of_label("major_teaching", columns))


def major_opening(schools: DataFrame) -> DataFrame:
    """Reopening date of the largest share of a county's students, the earliest among equals."""
    shares = enrollment_shares(schools, "opendategrouped", "prop_by_opendate")
    dated = shares.filter(F.col("opendategrouped").isNotNull())
    best = O.pick_largest(
        dated, ["county"], "prop_by_opendate", "opendategrouped", ["opendategrouped"]
    )
    return best.withColumnRenamed("opendategrouped", "major_opendate")


def dominant_openings(schools: DataFrame, at_least: float = 0.6) -> DataFrame:
    """Reopening dates shared by more than a part of the county, schools closed for good aside,
    with the bounds of the study window around the semester."""
    open_ = schools.filter(not_in("schooltemporaryshutdown", CLOSED))
    shares = enrollment_shares(open_, "opendategrouped", "prop_opendate")
    return shares.filter(F.col("prop_opendate") > at_least).select(
        "county",
        "county_enroll",
        "opendategrouped",
        "prop_opendate",
        D.shifted("opendategrouped", -21).alias("threeweeks_before"),
        F.date_add(F.lit(D.SEMESTER_END), 42).alias("sixweeks_later"),
    )


def student_mask_shares(schools: DataFrame) -> DataFrame:
    """Shares by student mask policy: partial rules count as required for all, less the
    elementary students of those districts."""
    merged = schools.withColumn(
        "studentmaskpolicy", X.recode("studentmaskpolicy", MASK_PARTIAL, MASK_ALL)
    )
    totals = A.category_totals(
        merged, ["county", "studentmaskpolicy", "county_enroll"], "leaid", "district_enroll", "n"
    )
    young = schools.filter(
        F.col("studentmaskpolicy").isin(MASK_PARTIAL) & (F.col("level") == "1")
    )
    young = young.groupBy("county").agg(F.sum("enrollment").alias("less"))
    totals = C.subtract_where(totals, "county", "studentmaskpolicy", "n", MASK_ALL, young, "less")
    return A.with_share(totals, "n", "county_enroll", "prop_student_mask")


def staff_mask_shares(schools: DataFrame) -> DataFrame:
    return enrollment_shares(schools, "staffmaskpolicy", "prop_staff_mask")


# --- daily panel ------------------------------------------------------------------------------


def mobility_wide(signals: DataFrame) -> DataFrame:
    """The four mobility signals side by side per (geo_value, time_value)."""
    wide = R.multi_signal(
        signals, "geo_value", "time_value", "signal", SIGNALS, base="part_time_work_prop_7dav"
    )
    return K.rename(wide, SIGNAL_NAMES)


def clean_cases(raw: DataFrame) -> DataFrame:
    """Daily county counts with negative death corrections moved back (`rev_NEWDEATHS`)."""
    rows = raw.filter(~F.col("COUNTY").isin(C.PSEUDO_COUNTIES)).select(
        "COUNTY",
        X.county_code("UID").alias("FIPS"),
        D.parse_mdy("DATE").alias("DATE"),
        "CNTY_LAT",
        "CNTY_LONG",
        "POPULATION",
        "CUMCONFIRMED",
        "CUMDEATHS",
        F.coalesce("NEWDEATHS", F.lit(0.0)).alias("NEWDEATHS"),
        "NEWCONFIRMED",
    )
    return C.redistribute_negatives(rows, "COUNTY", "DATE", "NEWDEATHS", "rev_NEWDEATHS")


def profile(raw: DataFrame, positions: str = "1,14-20,38-50") -> DataFrame:
    """County profile: columns by position, text sentinels to null, upper-case county."""
    rows = K.normalise_names(K.at_positions(raw, positions))
    rows = rows.withColumn("county", F.upper("county"))
    keep = [c for c in rows.columns if c != "county"]
    rows = C.sentinels_to_null(rows, {c: ["suppressed", "<10", "null", ""] for c in keep})
    if "population_density" in keep:
        rows = rows.withColumn("population_density", to_number("population_density"))
    return rows


def assemble(cases: DataFrame, wide: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Panel of counties with a known posture and the cumulative rate per 1,000 people."""
    panel = cases
    for table in (profiles, wide):
        if table is not None:
            keyed = K.rename(table, {"county": "_county"})
            panel = panel.join(keyed, F.upper("COUNTY") == F.col("_county"), "left").drop("_county")
    panel = panel.filter(F.col("major_teaching").isNotNull())
    return panel.withColumns(
        {
            "death_per_1000": F.round(ratio("CUMDEATHS", "POPULATION"), 5) * 1000,
            "posture_rank": X.level_rank("major_teaching", POSTURE_ORDER),
        }
    )


def with_mobility(panel: DataFrame, mobility: DataFrame) -> DataFrame:
    """Each day next to the mobility of a week later, as the study's shift has it."""
    moved = K.rename(mobility, {"geo_value": "FIPS", "time_value": "DATE"})
    return O.lag_shift_join(panel, moved, ["FIPS"], "DATE", -D.MOBILITY_LAG_DAYS)


# --- growth -----------------------------------------------------------------------------------


def county_growth(cases: DataFrame) -> DataFrame:
    """Smoothed log totals and log new deaths per county with first and second derivative."""
    logs = cases.select(
        "COUNTY",
        "DATE",
        log1p_count("CUMDEATHS").alias("tot"),
        log1p_count("rev_NEWDEATHS").alias("new"),
    )
    fit = G.spline_growth(logs, "COUNTY", "DATE", ["tot", "new"])
    return K.rename(
        fit,
        {
            "tot": "log_tot_deaths",
            "new": "log_new_deaths",
            "tot_fit": "tot_smoothed",
            "new_fit": "new_smoothed",
            "tot_b": "tot_slope",
            "new_b": "new_slope",
            "tot_b2": "tot_curve",
            "new_b2": "new_curve",
        },
    )


def shifted_growth(growth: DataFrame, attributes: DataFrame) -> DataFrame:
    """Growth dated at infection, with the attributes of its county."""
    moved = D.shift_days(growth, "DATE", -D.DEATH_LAG_DAYS)
    joined = attributes.join(moved, "COUNTY", "right")
    return joined.filter(F.col("DATE") > F.lit(DAY_AFTER_START))


def posture_growth(panel: DataFrame) -> DataFrame:
    """Growth of the summed deaths of each posture, dated at infection."""
    moved = D.shift_days(panel, "DATE", -D.DEATH_LAG_DAYS)
    daily = G.category_series(moved, "DATE", "major_teaching", "rev_NEWDEATHS")
    return G.spline_growth(daily, "major_teaching", "DATE", ["log_count"])


def growth_summaries(shifted: DataFrame, slope: str = "new_slope") -> DataFrame:
    """Largest and mean growth in the semester and mean growth around its start, per county."""
    offset, value = F.datediff("DATE", F.lit(D.SEMESTER_START)), F.col(slope)
    semester = F.col("DATE").between(D.SEMESTER_START, D.SEMESTER_END)
    return G.summaries(
        shifted,
        "COUNTY",
        {
            "maxB_fall": (semester, value, "max"),
            "avgB_fall": (semester, value, "avg"),
            "avgB_m3w": ((offset >= -21) & (offset < 0), value, "avg"),
            "avgB_m1w_p2w": ((offset >= -7) & (offset < 14), value, "avg"),
            "avgB_p3w": ((offset >= 0) & (offset < 21), value, "avg"),
        },
    )


def mobility_summaries(panel_mobility: DataFrame) -> DataFrame:
    """Mean full-time work mobility in the semester and in its fourth to sixth week."""
    offset, value = F.datediff("DATE", F.lit(D.SEMESTER_START)), F.col("full_work_prop_7d")
    semester = F.col("DATE").between(D.SEMESTER_START, D.SEMESTER_END)
    return G.summaries(
        panel_mobility,
        "COUNTY",
        {
            "avg_full_work_prob": (semester, value, "avg"),
            "avg2_full_work_prob": (offset.between(21, 42), value, "avg"),
        },
    )


def feature_table(
    panel: DataFrame, attributes: Sequence[str], summaries: Sequence[DataFrame]
) -> DataFrame:
    """One row per county: its attributes and the summary tables, all keyed by COUNTY."""
    out = panel.select("COUNTY", *attributes).distinct()
    for table in summaries:
        out = out.join(table, "COUNTY", "left")
    return out


# --- outcomes and tests -----------------------------------------------------------------------


def posture_incidence(panel: DataFrame) -> DataFrame:
    return A.incidence_band(panel, "DATE", "major_teaching", "CUMDEATHS", "POPULATION")


def semester_incidence(panel: DataFrame, openings: DataFrame) -> DataFrame:
    """Deaths per 1,000 people of each county from its reopening to the end of the semester."""
    opened = openings.select(F.col("county").alias("_county"), "major_opendate")
    rows = panel.join(opened, F.upper("COUNTY") == F.col("_county")).filter(
        (F.col("DATE") >= F.col("major_opendate")) & (F.col("DATE") <= F.lit(D.SEMESTER_END))
    )
    rise = O.first_last_change(
        rows, ["COUNTY", "POPULATION", "major_teaching"], "DATE", "CUMDEATHS", "death_incidence"
    )
    return rise.withColumn(
        "death_incidence_per_1000", X.per("death_incidence", "POPULATION", 1000)
    )


def posture_test(outcomes: DataFrame, y: str) -> tuple[DataFrame, DataFrame]:
    """Analysis of variance of an outcome by posture, and Duncan's pairs with marks."""
    keyed = outcomes.withColumn("test", F.lit(y))
    whole = I.with_f_pvalue(I.anova_oneway(keyed, y, "major_teaching", "test"))
    pairs = I.duncan(I.posthoc_pairs(keyed, y, "major_teaching", "test"))
    return whole, pairs.withColumn("mark", X.significance(F.round("p", 3)))
