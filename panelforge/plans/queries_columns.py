"""Scans and sinks, projection and naming, filters, scalar functions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from panelforge.functions import dates as D
from panelforge.functions import text as X
from panelforge.functions.nulls import if_else, log1p_count, not_in, safe_ln, to_number
from panelforge.operators import cleaning as C
from panelforge.operators import columns as K
from panelforge.operators import joins as J
from panelforge.operators import ordered as O
from panelforge.plans.registry import query
from panelforge.plans.standins import START, Data
from panelforge.session import scratch_path
from panelforge.sources.readers import scan, signal_scan
from panelforge.sources.signals import request_signals, write_signals
from panelforge.sources.staged import StagedTable, bad_rows, good_rows, ingest_csv
from panelforge.sources.writers import write_table

# --- sources and sinks ------------------------------------------------------------------------


@query(
    "o_orderkey:l o_custkey:l o_orderstatus:s o_totalprice:f2 o_orderdate:d",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
)
def scan_typed(d: Data):
    return d.table("orders")


@query(
    "event_id:l event_type:s county:i ts:d value:f2",
    """SELECT event_id, event_type, user_id % 25 AS county, ts, value FROM events
       WHERE event_type IN ('purchase', 'error')
         AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-26'
         AND user_id % 25 IN (SELECT n_nationkey FROM nation JOIN region
                              ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')""",
    name="signal_scan",
)
def _signal_scan(d: Data):
    places = d.table("nation").join(
        d.table("region").filter(F.col("r_name") == "ASIA"),
        F.col("n_regionkey") == F.col("r_regionkey"),
    )
    return signal_scan(
        d.table("events").withColumn("county", (F.col("user_id") % 25).cast("int")),
        ["purchase", "error"],
        date(2024, 1, 5),
        date(2024, 1, 25),
        signal="event_type",
        time="ts",
        geo="county",
        geos=places.withColumnRenamed("n_nationkey", "county"),
    )


@query(
    "row_index:l p_partkey:l p_brand:s p_retailprice:f2 p_type:s",
    """SELECT row_number() OVER (ORDER BY p_partkey) AS row_index, p_partkey, p_brand,
              p_retailprice, p_type FROM part""",
)
def sink_roundtrip(d: Data):
    path = scratch_path(d.spark, "parts")
    parts = d.table("part").select("p_partkey", "p_brand", "p_retailprice", "p_type")
    write_table(parts, path, partition_by=["p_type"], index=("row_index", "p_partkey"))
    return scan(
        d.spark,
        path,
        "row_index bigint, p_partkey bigint, p_brand string, p_retailprice double, p_type string",
    )


# Orders as lines of text, some damaged: a price that is no number, a field too many, two too few,
# a day that does not exist, no key.
_LINES = """
  SELECT CASE WHEN o_orderkey % 11 = 0 THEN concat(k, ',', s, ',n/a,', day)
              WHEN o_orderkey % 13 = 0 THEN concat(k, ',', s, ',', p, ',', day, ',more')
              WHEN o_orderkey % 17 = 0 THEN concat(k, ',', s)
              WHEN o_orderkey % 19 = 0 THEN concat(k, ',', s, ',', p, ',1998-13-45')
              WHEN o_orderkey % 23 = 0 THEN concat(',', s, ',', p, ',', day)
              ELSE concat(k, ',', s, ',', p, ',', day) END AS value, *
  FROM (SELECT *, CAST(o_orderkey AS {text}) AS k, o_orderstatus AS s,
               CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS {text}) AS p,
               CAST(CAST(o_orderdate AS DATE) AS {text}) AS day FROM {orders}) AS parts
"""


@query(
    "raw:s reason:s o_orderkey:l o_orderstatus:s o_totalprice:f2 o_orderdate:d",
    f"""SELECT CASE WHEN reason IS NOT NULL THEN value END AS raw, reason,
               CASE WHEN reason IS NULL THEN o_orderkey END AS o_orderkey,
               CASE WHEN reason IS NULL THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN reason IS NULL THEN o_totalprice END AS o_totalprice,
               CASE WHEN reason IS NULL THEN CAST(o_orderdate AS DATE) END AS o_orderdate
        FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'o_totalprice is no double'
                             WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0
                               THEN 'wrong number of fields'
                             WHEN o_orderkey % 19 = 0 THEN 'o_orderdate is no date'
                             WHEN o_orderkey % 23 = 0 THEN 'o_orderkey is missing' END AS reason
              FROM ({_LINES.format(text="VARCHAR", orders="orders")}) AS l) AS r""",
)
def csv_quarantine(d: Data):
    path = scratch_path(d.spark, "lines")
    d.table("orders").createOrReplaceTempView("panelforge_lines")
    lines = d.spark.sql(_LINES.format(text="STRING", orders="panelforge_lines")).select("value")
    lines.write.text(path)
    table = StagedTable(d.spark, scratch_path(d.spark, "orders"))
    schema = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date"
    ingest_csv(d.spark, path, schema, table, required=["o_orderkey"], header=False)
    return good_rows(table).unionByName(bad_rows(table), allowMissingColumns=True)


@query(
    "row_index:l p_partkey:l p_label:s p_retailprice:f2 p_size:i",
    """SELECT row_number() OVER (ORDER BY p_name, p_partkey) AS row_index, p_partkey,
              concat(p_name, ', "', p_brand, '"') AS p_label, p_retailprice,
              CASE WHEN p_size > 10 THEN p_size END AS p_size FROM part""",
)
def csv_sink(d: Data):
    """The second version of a staged CSV table, read by the schema in its manifest."""
    label = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("p_label")
    size = F.when(F.col("p_size") > 10, F.col("p_size")).alias("p_size")
    parts = d.table("part").select("p_partkey", "p_name", label, "p_retailprice", size)
    table = StagedTable(d.spark, scratch_path(d.spark, "parts"))
    table.commit(parts.filter("p_size > 40"), "csv")
    table.commit(parts, "csv", index=("row_index", ["p_name", "p_partkey"]))
    return table.read()


@query(
    "o_orderkey:l priority:s place:i day:d",
    """WITH r AS (SELECT o_orderpriority AS priority, CAST(max(o_orderdate) AS DATE) - back AS first_day,
                      CAST(max(o_orderdate) AS DATE) - back + 45 AS last_day
               FROM orders CROSS JOIN (VALUES (45), (75), (400)) AS b(back)
               WHERE o_orderpriority IN ('1-URGENT', '3-MEDIUM') GROUP BY o_orderpriority, back)
       SELECT o_orderkey, o_orderpriority AS priority, o_custkey % 25 AS place,
              CAST(o_orderdate AS DATE) AS day
       FROM orders
       WHERE o_custkey % 25 IN (SELECT n_nationkey FROM nation JOIN region
                                ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')
         AND EXISTS (SELECT 1 FROM r WHERE r.priority = o_orderpriority
                     AND CAST(o_orderdate AS DATE) BETWEEN r.first_day AND r.last_day)""",
)
def signal_archive(d: Data):
    """Overlapping requests to an archive by signal, month and area."""
    orders = d.table("orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("priority"),
        (F.col("o_custkey") % 25).cast("int").alias("place"),
        F.col("o_orderdate").cast("date").alias("day"),
    )
    path = scratch_path(d.spark, "signals")
    schema = write_signals(orders, path, "priority", "day", "place")
    last = F.max(F.col("o_orderdate").cast("date"))
    ends = (
        d.table("orders")
        .filter(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM"))
        .groupBy(F.col("o_orderpriority").alias("signal"))
        .agg(last.alias("last"))
        .withColumn("back", F.explode(F.array(*map(F.lit, (45, 75, 400)))))
    )
    start = F.date_sub("last", F.col("back"))
    requests = ends.select("signal", start.alias("start"), F.date_add(start, 45).alias("end"))
    places = d.table("nation").join(
        d.table("region").filter(F.col("r_name") == "ASIA"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    places = places.select(F.col("n_nationkey").alias("place"))
    return request_signals(d.spark, path, schema, requests, places, "priority", "day", "place")


@query(
    "date:d n_orders:l",
    """SELECT g.date, count(o_orderkey) AS n_orders
       FROM (SELECT CAST(unnest(generate_series(min(o_orderdate), max(o_orderdate),
                                                INTERVAL 1 DAY)) AS DATE) AS date FROM orders) AS g
       LEFT JOIN orders ON CAST(o_orderdate AS DATE) = g.date GROUP BY g.date""",
)
def grid_rows(d: Data):
    counts = d.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    span = counts.agg(F.sequence(F.min("date"), F.max("date")).alias("days"))
    grid = span.select(F.explode("days").alias("date"))
    return grid.join(counts, "date", "left").fillna(0, subset=["n_orders"])


@query(
    "date:d",
    "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem ORDER BY 1 DESC LIMIT 6",
)
def latest_dates(d: Data):
    days = d.table("lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return days.distinct().orderBy(F.desc("date")).limit(6)


# --- projection, naming, types ----------------------------------------------------------------


@query(
    "l_orderkey:l l_linenumber:i l_quantity:f2 l_extendedprice:f2",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem",
)
def project(d: Data):
    return K.at_positions(d.table("lineitem"), "1,4-6")


@query(
    "c_custkey:l c_nationkey:i c_mktsegment:s",
    "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer",
)
def project_drop(d: Data):
    return d.table("customer").drop("c_name", "c_acctbal")


@query(
    "supplier_key:l place_name:s county:i s_acctbal:f2",
    """SELECT s_suppkey AS supplier_key, s_name AS place_name, s_nationkey AS county, s_acctbal
       FROM supplier""",
)
def rename_cols(d: Data):
    messy = d.table("supplier").withColumnsRenamed({"s_name": "Place Name", "s_suppkey": "ID"})
    named = K.rename_positions(K.normalise_names(messy), {1: "supplier_key"})
    return K.rename(named, {"s_nationkey": "county"})


@query(
    "l_orderkey:l l_linenumber:i disc_price:f4 charge:f6",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS disc_price,
              l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem""",
)
def derive_cols(d: Data):
    rows = d.table("lineitem")
    rows = rows.withColumn("disc_price", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return rows.withColumn("charge", F.col("disc_price") * (1 + F.col("l_tax")))


@query(
    "id:l c_custkey:l c_name:s",
    "SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey, c_name FROM customer",
)
def row_id(d: Data):
    return O.with_row_id(d.table("customer").select("c_custkey", "c_name"), "c_custkey")


@query(
    "id:l c_name:s",
    "SELECT row_number() OVER (ORDER BY c_name) AS id, c_name FROM customer",
)
def row_id_text(d: Data):
    return O.with_row_id(d.table("customer").select("c_name"), "c_name")


@query(
    "id:l o_clerk:s o_orderdate:d o_orderkey:l",
    """SELECT row_number() OVER (ORDER BY clerk NULLS FIRST, day NULLS FIRST, o_orderkey) AS id,
              clerk AS o_clerk, day AS o_orderdate, o_orderkey
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS clerk,
                    CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders) AS o""",
)
def row_id_composite(d: Data):
    key = F.col("o_orderkey")
    rows = d.table("orders").select(
        F.when(key % 5 > 0, F.col("o_orderpriority")).alias("o_clerk"),
        F.when(key % 7 > 0, F.col("o_orderdate").cast("date")).alias("o_orderdate"),
        "o_orderkey",
    )
    return O.with_row_id(rows, ["o_clerk", "o_orderdate", "o_orderkey"])


@query(
    "p_brand:s p_name:s p_partkey:l next_p_partkey:l first_p_partkey:l",
    """SELECT p_brand, name AS p_name, p_partkey, lead(p_partkey) OVER w AS next_p_partkey,
              first_value(p_partkey) OVER w AS first_p_partkey
       FROM (SELECT p_brand, p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name FROM part) AS p
       WINDOW w AS (PARTITION BY p_brand ORDER BY name NULLS FIRST, p_partkey)""",
)
def next_in_text_order(d: Data):
    rows = d.table("part").withColumn("p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")))
    rows = rows.select("p_brand", "p_name", "p_partkey")
    return O.next_in_order(rows, ["p_brand"], ["p_name", "p_partkey"], ["p_partkey"])


@query(
    "p_partkey:l whole:f1 digits:f1",
    """SELECT p_partkey, TRY_CAST(p_brand AS DOUBLE) AS whole,
              TRY_CAST(substring(p_brand, 7) AS DOUBLE) AS digits FROM part""",
)
def safe_cast(d: Data):
    return d.table("part").withColumns(
        {"whole": to_number("p_brand"), "digits": to_number(F.substring("p_brand", 7, 9))}
    )


@query(
    "o_orderkey:l us:d iso:d bad:d text:s",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS us, CAST(o_orderdate AS DATE) AS iso,
              TRY_CAST(o_orderpriority AS DATE) AS bad,
              strftime(o_orderdate, '%Y-%m-%d') AS text FROM orders""",
)
def parse_date(d: Data):
    rows = d.table("orders").withColumns(
        {
            "us_text": F.date_format("o_orderdate", "MM/dd/yyyy"),
            "iso_text": F.date_format("o_orderdate", "yyyy-MM-dd"),
        }
    )
    return rows.withColumns(
        {
            "us": D.parse_mdy("us_text"),
            "iso": D.parse_iso("iso_text"),
            "bad": D.parse_iso("o_orderpriority"),
            "text": D.iso_text("o_orderdate"),
        }
    )


@query(
    "c_custkey:l c_mktsegment:s level:i",
    """SELECT c_custkey, c_mktsegment,
              CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2
                                WHEN 'FURNITURE' THEN 3 END AS level FROM customer""",
)
def ordered_category(d: Data):
    levels = ["BUILDING", "AUTOMOBILE", "FURNITURE"]
    return d.table("customer").withColumn("level", X.level_rank("c_mktsegment", levels))


@query(
    "l_suppkey:l total:f2 rank:l",
    """SELECT l_suppkey, total, dense_rank() OVER (ORDER BY total DESC) AS rank
       FROM (SELECT l_suppkey, max(l_extendedprice) AS total FROM lineitem GROUP BY 1) AS t""",
)
def reorder_by_agg(d: Data):
    return K.reorder_by_aggregate(d.table("lineitem"), "l_suppkey", "l_extendedprice")


@query(
    "column_name:s is_date:b",
    """SELECT column_name, is_date FROM (
         SELECT 'o_orderstatus' AS column_name,
                bool_or(regexp_matches(o_orderstatus, '20..-')) AS is_date FROM orders
         UNION ALL SELECT 'o_orderpriority', bool_or(regexp_matches(o_orderpriority, '20..-'))
                   FROM orders
         UNION ALL SELECT 'opened',
                bool_or(regexp_matches(strftime(o_orderdate, '%Y-%m-%d'), '20..-')) FROM orders
       ) AS t""",
)
def detect_date_cols(d: Data):
    rows = d.table("orders").select(
        "o_orderstatus", "o_orderpriority", D.iso_text("o_orderdate").alias("opened")
    )
    return K.detect_date_columns(rows)


@query(
    "column_name:s value:s n:l",
    """SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part GROUP BY 2
       UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
       UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2""",
)
def value_frequencies(d: Data):
    return K.value_frequencies(d.table("part"))


# --- filters ----------------------------------------------------------------------------------


@query(
    "o_orderkey:l o_orderstatus:s o_totalprice:f2",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE (o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW') OR o_totalprice > 400000""",
)
def filter_basic(d: Data):
    keep = (F.col("o_orderstatus") != "P") & (F.col("o_orderpriority") != "5-LOW")
    return d.table("orders").filter(keep | (F.col("o_totalprice") > 400000))


@query(
    "c_custkey:l segment:s listed:b",
    """SELECT c_custkey, segment, coalesce(segment IN ('MACHINERY', 'HOUSEHOLD'), false) AS listed
       FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer) AS c
       WHERE segment IS NULL OR segment NOT IN ('FURNITURE')""",
)
def filter_in_list(d: Data):
    rows = d.table("customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    listed = F.coalesce(F.col("segment").isin("MACHINERY", "HOUSEHOLD"), F.lit(False))
    return rows.filter(not_in("segment", ["FURNITURE"])).withColumn("listed", listed)


_PLANTED = """(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment,
                      CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS balance,
                      nullif(c_nationkey, 7) AS county FROM customer)"""


def planted(d: Data):
    """Customers with nulls planted by value."""
    return d.table("customer").select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.nullif("c_nationkey", F.lit(7)).alias("county"),
    )


@query(
    "c_custkey:l segment:s balance:f2 county:i",
    f"SELECT * FROM {_PLANTED} AS p WHERE segment IS NOT NULL",
)
def drop_null_key(d: Data):
    return planted(d).dropna(subset=["segment"])


@query(
    "c_custkey:l segment:s balance:f2 county:i",
    f"""SELECT * FROM {_PLANTED} AS p
        WHERE segment IS NOT NULL AND balance IS NOT NULL AND county IS NOT NULL""",
)
def complete_cases(d: Data):
    return C.complete_cases(planted(d))


@query(
    "l_orderkey:l l_linenumber:i l_shipdate:d",
    """SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
       WHERE l_shipdate >= DATE '1998-08-18' AND l_shipdate < DATE '1998-09-08'""",
)
def date_window_filter(d: Data):
    window = D.between_days("l_shipdate", START, START + timedelta(days=21), hi_open=True)
    return d.table("lineitem").filter(window)


@query(
    "county:i date:d deaths:l",
    """SELECT d.county, d.date, d.deaths FROM v_daily AS d
       JOIN v_opening AS o ON o.county = d.county
       WHERE d.date >= o.open_week AND d.date < o.open_week + 21""",
)
def per_entity_window(d: Data):
    inside = D.between_days("date", F.col("open_week"), F.date_add("open_week", 21), hi_open=True)
    return J.within_bounds(d.daily(), d.opening().select("county", "open_week"), "county", inside)


@query(
    "county:i date:d off:i cum_deaths:l",
    """SELECT d.county, d.date, d.date - o.open_week AS off, d.cum_deaths FROM v_daily AS d
       JOIN v_opening AS o ON o.county = d.county
       WHERE d.date - o.open_week IN (-21, 0, 21, 42, 63, 84, 105)""",
)
def day_offsets(d: Data):
    rows = d.daily().join(d.opening().select("county", "open_week"), "county")
    rows = rows.withColumn("off", F.datediff("date", "open_week"))
    return rows.filter(F.col("off").isin(list(range(-21, 106, 21))))


@query(
    "o_orderkey:l o_custkey:l",
    """SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) AS t WHERE rn > 1""",
)
def dup_keys(d: Data):
    rows = d.table("orders").select("o_orderkey", "o_custkey")
    return O.duplicates_detail(rows, ["o_custkey"], "o_orderkey")


@query(
    "l_orderkey:l l_linenumber:i l_suppkey:l l_quantity:f2",
    """SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *,
         max(l_quantity) OVER (PARTITION BY l_suppkey) AS top FROM lineitem) AS t
       WHERE l_quantity = top""",
)
def rows_at_group_max(d: Data):
    rows = d.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return O.rows_at_max_detail(rows, ["l_suppkey"], "l_quantity")


@query(
    "o_custkey:l o_orderkey:l o_totalprice:f2 position:l group_size:l",
    """SELECT o_custkey, o_orderkey, o_totalprice, position, group_size FROM (SELECT *,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position,
         count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders) AS t
       WHERE position = 1 OR position = group_size""",
)
def first_last_rows(d: Data):
    rows = d.table("orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return O.first_last_rows_detail(rows, ["o_custkey"], "o_orderkey")


@query(
    "county:i method:s share:f2",
    "SELECT county, method, share FROM v_shares WHERE share > 0.25",
)
def majority_threshold(d: Data):
    return d.shares().filter(F.col("share") > 0.25)


@query(
    "school_id:l district:l enrollment:f2 reported:f2 total:f2",
    """SELECT * FROM (SELECT school_id, district, enrollment, reported,
         sum(enrollment) OVER (PARTITION BY district) AS total FROM v_school) AS t
       WHERE total > reported""",
)
def group_total_check(d: Data):
    schools = d.table("orders").select(
        F.col("o_orderkey").alias("school_id"),
        F.col("o_custkey").alias("district"),
        F.col("o_totalprice").alias("enrollment"),
    )
    limits = d.table("customer").select(
        F.col("c_custkey").alias("district"), (F.col("c_acctbal") * 300.0).alias("reported")
    )
    return C.group_total_check(schools, "district", "enrollment", limits, "reported")


# --- scalar functions -------------------------------------------------------------------------


@query(
    "n_nationkey:i up:s low:s title:s label:s",
    """SELECT n_nationkey, upper(n_name) AS up, lower(r_name) AS low,
              array_to_string(list_transform(string_split(r_name, ' '),
                lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS title,
              CAST(n_nationkey AS VARCHAR) || '%' AS label
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def string_case(d: Data):
    rows = d.table("nation").join(
        d.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return rows.select(
        "n_nationkey",
        F.upper("n_name").alias("up"),
        F.lower("r_name").alias("low"),
        F.initcap("r_name").alias("title"),
        X.percent_label("n_nationkey").alias("label"),
    )


@query(
    "c_custkey:l code:s",
    "SELECT c_custkey, substring(c_name, 4, 5) AS code FROM customer",
)
def string_substr(d: Data):
    return d.table("customer").select("c_custkey", X.county_code("c_name").alias("code"))


@query(
    "p_partkey:l hit:b name:s",
    """SELECT p_partkey, regexp_matches(p_brand, '#1.') AS hit,
              regexp_replace(p_name, ' ', '_', 'g') AS name FROM part""",
)
def string_regex(d: Data):
    return d.table("part").select(
        "p_partkey",
        F.col("p_brand").rlike("#1.").alias("hit"),
        F.regexp_replace("p_name", " ", "_").alias("name"),
    )


@query(
    "c_custkey:l ln_x:f9 ln1p_x:f9 sqrt_x:f9 round_x:f1",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS ln_x,
              CASE WHEN c_acctbal > -1 THEN ln(c_acctbal + 1) END AS ln1p_x,
              CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS sqrt_x,
              round(c_acctbal, 1) AS round_x FROM customer""",
)
def math_scalars(d: Data):
    x = F.col("c_acctbal")
    return d.table("customer").select(
        "c_custkey",
        safe_ln(x).alias("ln_x"),
        log1p_count(x).alias("ln1p_x"),
        F.when(x >= 0, F.sqrt(x)).alias("sqrt_x"),
        F.round(x, 1).alias("round_x"),
    )


@query(
    "o_orderkey:l later:d earlier:d gap:i is_end:b",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 21 AS later,
              CAST(o_orderdate AS DATE) - 24 AS earlier,
              CAST(o_orderdate AS DATE) - DATE '1998-08-18' AS gap,
              CAST(o_orderdate AS DATE) = DATE '1998-12-15' AS is_end FROM orders""",
)
def date_math(d: Data):
    day = F.col("o_orderdate").cast("date")
    return d.table("orders").select(
        "o_orderkey",
        D.shifted(day, 21).alias("later"),
        D.shifted(day, -D.DEATH_LAG_DAYS).alias("earlier"),
        F.datediff(day, F.lit(START)).alias("gap"),
        (day == F.lit("1998-12-15").cast("date")).alias("is_end"),
    )


@query(
    "c_custkey:l strict:s plain:s",
    f"""SELECT c_custkey,
               CASE WHEN balance IS NULL THEN NULL WHEN balance > 5000 THEN 'high' ELSE 'low' END
                 AS strict,
               CASE WHEN balance > 5000 THEN 'high' WHEN balance > 0 THEN 'low' ELSE 'none' END
                 AS plain
        FROM {_PLANTED} AS p""",
)
def conditional(d: Data):
    rich = F.col("balance") > 5000
    return planted(d).select(
        "c_custkey",
        if_else(rich, F.lit("high"), F.lit("low")).alias("strict"),
        F.when(rich, "high").when(F.col("balance") > 0, "low").otherwise("none").alias("plain"),
    )


@query(
    "l_orderkey:l l_linenumber:i p:f2 mark:s",
    """SELECT l_orderkey, l_linenumber, l_discount AS p,
              CASE WHEN l_discount <= 0.01 THEN '**' WHEN l_discount <= 0.05 THEN '*'
                   ELSE 'NS' END AS mark FROM lineitem""",
)
def signif_code(d: Data):
    rows = d.table("lineitem").withColumn("p", F.col("l_discount"))
    return rows.withColumn("mark", X.significance("p"))


@query(
    "county:i date:d per_1000:f10 per_100k:f8",
    """SELECT county, date, cum_deaths * CAST(1000 AS DOUBLE) / population AS per_1000,
              cum_deaths * CAST(100000 AS DOUBLE) / population AS per_100k FROM v_daily""",
)
def rate_scaling(d: Data):
    return d.daily().withColumns(
        {
            "per_1000": X.per("cum_deaths", "population", 1_000),
            "per_100k": X.per("cum_deaths", "population", 100_000),
        }
    )


@query(
    "o_custkey:l n:l size:s",
    """SELECT o_custkey, n, CASE WHEN n >= 10 THEN 'Large' ELSE 'Small' END AS size
       FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) AS t""",
)
def size_tag(d: Data):
    sizes = d.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("size", X.size_tag("n", 10))
