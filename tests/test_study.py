"""The county study end to end on a small made-up state."""

import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.plans import study as S
from panelforge.plans import study_reports as R
from panelforge.sources.readers import study_table, text_table
from panelforge.sources.schemas import STUDY
from panelforge.sources.writers import write_table

DAYS = [date(2020, 1, 22) + timedelta(days=i) for i in range(398)]


def school(name, county, leaid, city, size, district, method, opened, mask="Not required", level="2"):
    return (
        name, county, leaid, city, None, str(size), str(district), opened, opened, opened,
        "K", "N", level, 1, method, mask, "Not required", "Never closed",
    )


@pytest.fixture(scope="module")
def schools(spark):
    rows = [
        school("a1", "ADAMS", "A", "Peebles", 100, 250, "Hybrid", "2020-08-20"),
        school("a2", "ADAMS", "A", "Peebles", 100, 250, "Hybrid", "2020-08-20"),
        school("a3", "ADAMS", "B", "West Union", 400, 300, "On Premises", "2020-08-24",
               "Required for high school students only", "1"),
        school("a4", None, "B", "West Union", -999, 300, "On Premises", "2020-08-24"),
        school("b1", "PIKE", "C", "Dublin", 50, 100, "Online Only", "2020-09-08",
               "Required for all students"),
        school("b2", "UNION", "D", "Dublin", 70, 70, "On Premises", "2020-08-20"),
        school("b3", None, "D", "Dublin", 10, 70, "On Premises", "2020-08-20"),
        school("x", "PIKE", "C", "Piketon", "n/a", 100, None, "2020-09-08"),
    ]
    overrides = spark.createDataFrame([("Dublin", "UNION")], "physicalcity string, county string")
    raw = spark.createDataFrame(rows, STUDY["school_rows"])
    return S.clean_schools(raw, overrides).cache()


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(4)
    rows = []
    for county, uid, pop, rate in (
        ("ADAMS", "84039001", 20000, 1.0),
        ("PIKE", "84039131", 30000, 0.6),
        ("UNION", "84039159", 50000, 2.0),
        ("UNASSIGNED", "84090039", 0, 1.0),
    ):
        total = 0
        for i, d in enumerate(DAYS):
            new = int(rng.poisson(rate * (1 + np.sin(i / 60))))
            new = -1 if i % 97 == 96 else new
            total += new
            rows.append(
                (county, uid, d.strftime("%m/%d/%Y"), 39.0, -83.0, pop, total * 20, total,
                 None if i == 0 else float(new), 1.0)
            )
    return S.clean_cases(spark.createDataFrame(rows, STUDY["cases_daily"])).cache()


def test_clean_schools(schools):
    got = {r.schnam: r for r in schools.collect()}
    assert len(got) == 7 and "x" not in got
    assert got["a4"].county == "ADAMS" and got["b3"].county == "UNION"
    assert got["a4"].enrollment is None and got["a1"].gshi is None
    # District A: reported 250 > summed 200; district B: summed 400 > reported 300.
    assert got["a1"].district_enroll == 250 and got["a3"].district_enroll == 400
    assert got["a1"].county_enroll == 650
    assert got["b2"].county_enroll == 80
    assert got["a1"].opendategrouped == date(2020, 8, 20)


def test_teaching_shares_and_openings(schools):
    wide = {r.county: r for r in S.teaching_wide(schools).collect()}
    adams = wide["ADAMS"]
    assert (adams.Hybrid, adams.On_Premises, adams.Online_Only) == (0.38, 0.62, 0.0)
    assert adams.major_teaching == "On Premises" and adams.major_teaching_prop == 0.62
    assert wide["PIKE"].major_teaching == "Online Only"
    opened = {r.county: r.major_opendate for r in S.major_opening(schools).collect()}
    assert opened["ADAMS"] == date(2020, 8, 24)
    strong = {r.county: r for r in S.dominant_openings(schools).collect()}
    assert strong["ADAMS"].threeweeks_before == date(2020, 8, 3)
    assert strong["ADAMS"].sixweeks_later == date(2021, 1, 26)


def test_student_masks_subtract_elementary(schools):
    got = {
        (r.county, r.studentmaskpolicy): (r.n, r.prop_student_mask)
        for r in S.student_mask_shares(schools).collect()
    }
    # District B counts as required for all, less its 400 elementary students.
    assert got[("ADAMS", "Required for all students")] == (0.0, 0.0)
    assert got[("ADAMS", "Not required")] == (650.0, 1.0)
    staff = S.staff_mask_shares(schools).collect()
    assert all(r.prop_staff_mask == 1.0 for r in staff)


def test_clean_cases(cases):
    assert cases.count() == 3 * 398
    assert cases.select("FIPS").distinct().count() == 3
    sums = cases.groupBy("COUNTY").agg(
        F.sum("NEWDEATHS").alias("a"), F.sum("rev_NEWDEATHS").alias("b"), F.min("rev_NEWDEATHS").alias("m")
    )
    assert all(r.a == r.b and r.m >= 0 for r in sums.collect())


def test_panel_mobility_and_growth(spark, schools, cases):
    panel = S.assemble(cases, S.teaching_wide(schools)).cache()
    assert panel.filter(F.col("posture_rank").isNull()).count() == 0
    signals = spark.createDataFrame(
        [(s, f, d, 0.1 + i / 1000, 0.01, 5.0) for s in S.SIGNALS for f in ("39001", "39131")
         for i, d in enumerate(DAYS)],
        STUDY["mobility_long"],
    )
    mobility = S.mobility_wide(signals)
    assert mobility.count() == 2 * 398
    joined = S.with_mobility(panel, mobility)
    first = joined.filter((F.col("FIPS") == "39001") & (F.col("DATE") == DAYS[0])).first()
    assert first.part_work_prop_7d == pytest.approx(0.107)
    assert joined.count() == 2 * 391

    attributes = panel.select("COUNTY", "major_teaching").distinct()
    growth = S.county_growth(cases)
    shifted = S.shifted_growth(growth, attributes)
    assert shifted.agg(F.min("DATE"), F.max("DATE")).first()[0] == date(2020, 1, 24)
    features = S.feature_table(
        panel,
        ["POPULATION", "major_teaching"],
        [S.growth_summaries(shifted), S.mobility_summaries(joined)],
    ).toPandas()
    assert len(features) == 3
    assert (features.maxB_fall >= features.avgB_fall).all()
    assert features.set_index("COUNTY").avg_full_work_prob.isna().to_dict() == {
        "ADAMS": False, "PIKE": False, "UNION": True,
    }
    per_posture = S.posture_growth(panel)
    assert per_posture.count() == 2 * 398

    band = S.posture_incidence(panel).filter(F.col("DATE") == DAYS[-1]).toPandas()
    assert ((band.rate_lower < band.rate) & (band.rate < band.rate_upper)).all()


def test_semester_outcome_and_test(schools, cases):
    panel = S.assemble(cases, S.teaching_wide(schools))
    outcome = S.semester_incidence(panel, S.major_opening(schools))
    got = {r.COUNTY: r for r in outcome.collect()}
    plain = cases.toPandas()
    adams = plain[(plain.COUNTY == "ADAMS")].set_index("DATE").CUMDEATHS
    assert got["ADAMS"].death_incidence == adams[date(2020, 12, 15)] - adams[date(2020, 8, 24)]
    whole, pairs = S.posture_test(outcome, "death_incidence_per_1000")
    assert whole.first().k == 2 and 0 <= whole.first().p <= 1
    row = pairs.first()
    assert row.mark in ("**", "*", "NS") and row.p == pytest.approx(whole.first().p, abs=1e-6)


def test_profile_and_csv_round_trip(spark, tmp_path):
    path = tmp_path / "profile.csv"
    path.write_text(
        "﻿County,skip,NCHS Urban/Rural Status,Population density,Percent Population 65+ yrs \n"
        "Adams,1,Noncore,48.2,suppressed\nPike,2,Micropolitan,<10,17.5\n",
        encoding="utf-8",
    )
    got = {r.county: r for r in S.profile(text_table(spark, str(path)), "1,3-5").collect()}
    assert got["ADAMS"].nchs_urban_rural_status == "Noncore"
    assert got["ADAMS"].population_density == 48.2
    assert got["ADAMS"]["percent_population_65+_yrs"] is None
    assert got["PIKE"].population_density is None

    rings = spark.createDataFrame(
        [("b", 1, 1, 0.5, 1.5), ("a", 1, 0, 0.25, 2.0)], STUDY["polygons"]
    )
    out = str(tmp_path / "rings")
    write_table(rings, out, "csv", index=("row", "vertex"))
    back = study_table_with_index(spark, out)
    assert [(r.row, r.county, r.lat) for r in back.orderBy("row").collect()] == [
        (1, "a", 2.0),
        (2, "b", 1.5),
    ]
    write_table(rings, str(tmp_path / "plain"))
    assert study_table(spark, str(tmp_path / "plain"), "polygons").count() == 2
    with pytest.raises(Exception, match="already exists"):
        write_table(rings, str(tmp_path / "plain"))


def study_table_with_index(spark, path):
    from panelforge.sources.readers import scan

    return scan(spark, path, "row bigint, " + STUDY["polygons"], "csv")


@pytest.fixture(scope="module")
def tables(spark, schools, cases):
    panel = S.assemble(cases, S.teaching_wide(schools)).cache()
    signals = spark.createDataFrame(
        [(s, f, d, 0.1 + i / 1000, 0.01, 5.0) for s in S.SIGNALS
         for f in ("39001", "39131", "39159") for i, d in enumerate(DAYS)],
        STUDY["mobility_long"],
    )
    moving = S.with_mobility(panel, S.mobility_wide(signals)).cache()
    return panel, moving, S.major_opening(schools), S.enrollment_shares(schools, "teachingmethod")


def test_policy_reports(spark, schools, tables):
    panel, _, _, shares = tables
    online = {r.county: (r.is_online, r.prop_online_only) for r in R.online_majority(shares).collect()}
    assert online["ADAMS"] == ("Not Online Only", 1.0) and online["PIKE"][0] == "Online Only"
    masks = S.student_mask_shares(schools)
    top = R.majority(masks, "studentmaskpolicy", "prop_student_mask").collect()
    assert {r.county: r.studentmaskpolicy for r in top}["ADAMS"] == "Not required"
    wide = R.mask_wide(masks, "studentmaskpolicy", "prop_student_mask", ["Not required", S.MASK_ALL])
    everything = R.policy_wide([S.teaching_wide(schools), R.snapshot(panel), wide])
    assert everything.count() == 3
    totals = R.opening_totals(schools).agg(F.sum("state_share")).first()[0]
    assert totals == pytest.approx(1.0)
    assert {r.teachingmethod: r.students for r in R.method_totals(schools).collect()} == {
        "Hybrid": 250.0, "On Premises": 480.0, "Online Only": 100.0,
    }


def test_event_reports(cases, tables):
    panel, moving, openings, _ = tables
    plain = cases.toPandas().set_index(["COUNTY", "DATE"]).CUMDEATHS
    rise = {r.COUNTY: r for r in R.bracket(panel, openings).collect()}
    want = plain["ADAMS", date(2020, 12, 15)] - plain["ADAMS", date(2020, 8, 24)]
    assert rise["ADAMS"].deaths_rise == want
    assert rise["ADAMS"].deaths_per_100k == pytest.approx(want / 20000 * 1e5)
    windows = R.key_windows(panel, openings).collect()
    assert len(windows) == 9
    got = next(r for r in windows if r.COUNTY == "PIKE" and r.win == "crossing")
    assert got.deaths == plain["PIKE", date(2020, 12, 5)] - plain["PIKE", date(2020, 11, 14)]
    months = R.two_month_windows(moving, openings).collect()
    assert len(months) == 3 and all(r.win == 2 and r.y0 is not None for r in months)
    effect = R.effect_on_state(R.bracket(panel, openings)).first()
    assert effect.saved_hybrid == pytest.approx(31.52)
    rates = {r.COUNTY: r for r in R.semester_rates(panel).collect()}
    assert rates["UNION"].deaths == plain["UNION", date(2020, 12, 15)] - plain["UNION", date(2020, 8, 18)]


def test_series_and_growth_reports(spark, cases, tables):
    panel, moving, openings, _ = tables
    lagged = R.lagged_increments(panel)
    assert lagged.filter(F.col("increment").isNull()).select("DATE").distinct().count() == 21
    soft = R.soft_rates(panel).filter(F.col("DATE") == DAYS[-1]).first()
    assert min(soft.rate_Online_Only, soft.rate_On_Premises, soft.rate_Hybrid) > 0
    posture = R.mobility_by_posture(moving).orderBy("major_teaching", "DATE").first()
    assert posture.full_work_prop == pytest.approx(0.107)
    assert posture.shifted_date == DAYS[28]

    shifted = S.shifted_growth(S.county_growth(cases), panel.select("COUNTY").distinct())
    weeks = R.weekly_growth(shifted)
    row = weeks.first()
    assert row.acceleration == pytest.approx((row.B6w - row.B3w) - (row.B3w - row.B0w))
    assert R.weekly_change(weeks).count() == 6
    means = R.mobility_at_offsets(moving, openings, {"before": (-21, 0), "after": (0, 21)}).toPandas()
    assert np.allclose(means.after - means.before, 0.021)

    ages = spark.createDataFrame(
        [(d, 10.0 + i, 90.0 - i) for i, d in enumerate(DAYS[:9])], "Date date, young double, old double"
    )
    got = R.age_shares(ages, ["young", "old"]).orderBy("age_group", "Date").collect()
    assert [r.share_mean7 for r in got[:9]] == [None] * 3 + [87.0, 86.0, 85.0] + [None] * 3


def test_report_tests_and_maps(spark, tables):
    rng = np.random.default_rng(2)
    rows = [
        (f"C{i}", p, float(rng.normal(m, 1)), float(rng.random()), 1000 + 10 * i, 0.2, 0.5, 0.3)
        for i, (p, m) in enumerate([("Hybrid", 0), ("On Premises", 5), ("Online Only", 0)] * 12)
    ]
    counties = spark.createDataFrame(
        rows, "COUNTY string, major_teaching string, y double, m double, POPULATION int, "
        "Online_Only double, On_Premises double, Hybrid double",
    )
    out = {k: v.collect() for k, v in R.posthoc_tests(counties, "y").items()}
    assert out["kruskal"][0].p < 0.001 and len(out["dunnett"]) == 2
    for name in ("tukey", "duncan", "scheffe", "bonferroni"):
        for r in out[name]:
            assert (r.p < 0.01) == ("On Premises" in (r.group1, r.group2)), name
    sweep = R.mask_cutoffs(counties.withColumn("teachingmethod", F.col("major_teaching")), "y", "m")
    assert sweep.count() == 3 * 60
    lines = R.weighted_growth_lines(counties, "y").collect()
    # Equal weights within a posture: each weighting gives the plain line.
    assert len(lines) == 3 and len({round(r.slope, 9) for r in lines}) == 1
    assert R.growth_lines(counties, F.log("POPULATION"), "y").count() == 3

    ring = [("adams", 1, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])]
    drawn, labels = R.county_map(
        spark.createDataFrame(ring, STUDY["polygons"]),
        spark.createDataFrame([("ADAMS", 0.5)], "county string, rate double"),
    )
    assert [(r.vertex, r.rate) for r in drawn.collect()] == [(i, 0.5) for i in range(4)]
    point = labels.first()
    assert (point.center_x, point.center_y) == (1.0, 1.0)


def test_partitioned_signals_are_pruned(spark, tmp_path):
    from panelforge.sources.readers import signal_scan

    rows = [(s, f, d, 0.5, None, None) for s in S.SIGNALS for f in ("39001", "39003") for d in DAYS[:30]]
    signals = spark.createDataFrame(rows, STUDY["mobility_long"])
    path = str(tmp_path / "signals")
    write_table(signals, path, partition_by=["signal"])
    places = spark.createDataFrame([("39001",), ("39001",)], "geo_value string")
    got = signal_scan(
        study_table(spark, path, "mobility_long"), ["bars_visit_prop"], DAYS[3], DAYS[9], geos=places
    )
    assert got.count() == 7
    text = got._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in text.splitlines() if "FileScan" in x)
    assert re.search(r"PartitionFilters: \[[^\]]*signal", scan)
    assert "GreaterThanOrEqual(time_value" in scan
