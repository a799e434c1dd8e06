"""Explicit schemas: nothing is inferred at read time.

The study schemas follow the input columns of the county study in snake case; columns that hold
text sentinels are read as string and cast by the cleaning operators so rejects can be counted.
"""

from __future__ import annotations

STUDY = {
    "school_rows": (
        "schnam string, county string, leaid string, physicalcity string, multibdy string, "
        "enrollment string, enrollment_1 string, date string, lastverifieddate string, "
        "opendategrouped string, gslo string, gshi string, level string, openenroll int, "
        "teachingmethod string, studentmaskpolicy string, staffmaskpolicy string, "
        "schooltemporaryshutdown string"
    ),
    "cases_daily": (
        "COUNTY string, UID string, DATE string, CNTY_LAT double, CNTY_LONG double, "
        "POPULATION bigint, CUMCONFIRMED bigint, CUMDEATHS bigint, NEWDEATHS double, "
        "NEWCONFIRMED double"
    ),
    "mobility_long": (
        "signal string, geo_value string, time_value date, value double, stderr double, "
        "sample_size double"
    ),
    "county_slopes": (
        "COUNTY string, DATE date, POPULATION bigint, CUMDEATHS bigint, log_tot_deaths double, "
        "tot_slope double, NEWDEATHS double, rev_NEWDEATHS double, log_new_deaths double, "
        "new_slope double"
    ),
    "polygons": "county string, grp int, vertex int, long double, lat double",
}

TESTDATA = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
