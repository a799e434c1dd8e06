"""Group tests and regressions: statistics and, as queries of their own, tail probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.nulls import ratio, safe_ln
from panelforge.functions.text import significance
from panelforge.operators import grams as M
from panelforge.operators import inference as I
from panelforge.operators import leastsquares as L
from panelforge.plans.queries_growth import OFFSET_WINDOWS
from panelforge.plans import sql_tails as S
from panelforge.plans.registry import QUERIES, query
from panelforge.plans.standins import METHODS, START, Data


def balances(d: Data):
    """Customer balance by segment, one test per region."""
    places = d.table("nation").select("n_nationkey", F.col("n_regionkey").alias("region"))
    rows = d.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("region", "c_mktsegment", "c_acctbal")


_MOMENTS = """(SELECT n_regionkey AS region, c_mktsegment AS g, count(*) AS n,
                      avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS ss
               FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
_ANOVA = """SELECT {key}, k, n, k - 1 AS df1, n - k AS df2, ssb, ssw,
                   CASE WHEN k > 1 AND n > k AND ssw > 0
                        THEN (ssb / (k - 1)) / (ssw / (n - k)) END AS f
            FROM (SELECT {key}, count(*) AS k, sum(n) AS n, sum(n * (m - grand) * (m - grand)) AS ssb,
                         sum(ss) AS ssw
                  FROM (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS grand FROM {moments} AS a
                        WINDOW w AS (PARTITION BY {key})) AS b GROUP BY {key}) AS c"""


@query(
    "region:i k:l n:l df1:l df2:l ssb:f0 ssw:f0 f:f8",
    _ANOVA.format(key="region", moments=_MOMENTS),
)
def anova_oneway(d: Data):
    return I.anova_oneway(balances(d), "c_acctbal", "c_mktsegment", "region")


@query(
    "region:i k:l n:l f:f8",
    _ANOVA.format(
        key="region",
        moments="""(SELECT n_regionkey AS region, c_mktsegment = 'BUILDING' AS g, count(*) AS n,
                           avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS ss
                    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)""",
    ),
)
def anova_binary(d: Data):
    rows = balances(d).withColumn("is_building", F.col("c_mktsegment") == "BUILDING")
    return I.anova_oneway(rows, "c_acctbal", "is_building", "region")


_ANOVA_BALANCES = _ANOVA.format(key="region", moments=_MOMENTS)


@query(
    "region:i f:f8 df1:l df2:l p:f8",
    f"""SELECT region, f, df1, df2, CASE WHEN df1 = 4 THEN {S.f_upper_4('f', 'df2')} END AS p
        FROM ({_ANOVA_BALANCES}) AS s""",
)
def anova_pvalue(d: Data):
    return I.with_f_pvalue(anova_oneway(d))


# Cutoffs 0.40, 0.41 ... 0.99 as the sums start + i * step.
CUTOFFS = [0.4 + i * 0.01 for i in range(60)]


def finished_shares(d: Data):
    """Per customer: share of finished orders (x), balance (y), segment (test)."""
    orders = d.table("orders").groupBy("o_custkey").agg(
        F.round(ratio(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))), 2).alias("x")
    )
    rows = orders.join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("x", F.col("c_acctbal").alias("y"), F.col("c_mktsegment").alias("segment"))


_SWEEP = """(SELECT c.segment AS segment, i AS cutoff_id,
                    x > CAST('0.4' AS DOUBLE) + i * CAST('0.01' AS DOUBLE) AS g,
                    count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss
             FROM (SELECT c_mktsegment AS segment, c_acctbal AS y, x FROM customer JOIN (
                     SELECT o_custkey, round(count(*) FILTER (o_orderstatus = 'F')
                                             / CAST(count(*) AS DOUBLE), 2) AS x
                     FROM orders GROUP BY 1) AS o ON o_custkey = c_custkey) AS c
             CROSS JOIN range(60) AS r(i) GROUP BY 1, 2, 3)"""


@query(
    "segment:s cutoff_id:i k:l n:l ssb:f0 ssw:f0 f:f8",
    _ANOVA.format(key="segment, cutoff_id", moments=_SWEEP),
)
def anova_cutoff_sweep(d: Data):
    return I.anova_cutoff_sweep(finished_shares(d), "y", "x", CUTOFFS, "segment")


_SWEEP_F = _ANOVA.format(key="segment, cutoff_id", moments=_SWEEP)


@query(
    "segment:s cutoff:f2 f:f8 p:f8 significant:b",
    f"""SELECT segment, cutoff, f, p, p < 0.05 AS significant
        FROM (SELECT *, CAST('0.4' AS DOUBLE) + cutoff_id * CAST('0.01' AS DOUBLE) AS cutoff,
                     {S.t_two_sided('sqrt(f)', 'df2')} AS p FROM ({_SWEEP_F}) AS s) AS r""",
)
def anova_cutoff_pvalue(d: Data):
    return I.with_f_pvalue(anova_cutoff_sweep(d)).withColumn("significant", F.col("p") < 0.05)


_LINE = """SELECT {key}, n, slope, my - slope * mx AS intercept, slope * sxy / nullif(syy, 0) AS r2,
                  se, slope / nullif(se, 0) AS t, n - 2 AS df2
           FROM (SELECT *, sxy / nullif(sxx, 0) AS slope,
                        CASE WHEN n > 2 THEN sqrt(greatest(syy - sxy / nullif(sxx, 0) * sxy, 0)
                             / ((n - 2) * nullif(sxx, 0))) END AS se
                 FROM (SELECT {key}, regr_count({y}, {x}) AS n, regr_sxx({y}, {x}) AS sxx,
                              regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy,
                              regr_avgx({y}, {x}) AS mx, regr_avgy({y}, {x}) AS my
                       FROM {source} GROUP BY {key}) AS a) AS b"""


_ORDER_LINE = _LINE.format(
        key="o_orderstatus",
        y="o_totalprice",
        x="x",
        source="(SELECT *, o_custkey / CAST(1000 AS DOUBLE) AS x FROM orders) AS o",
)


@query(
    "o_orderstatus:s n:l slope:f4 intercept:f2 r2:f8 se:f4 t:f6 df2:l",
    _ORDER_LINE,
)
def ols_simple(d: Data):
    rows = d.table("orders").withColumn("x", F.col("o_custkey") / F.lit(1000.0))
    return I.ols_simple(rows, "o_totalprice", "x", "o_orderstatus")


@query(
    "o_orderstatus:s t:f6 df2:l p:f8",
    f"SELECT o_orderstatus, t, df2, {S.t_two_sided('t', 'df2')} AS p FROM ({_ORDER_LINE}) AS s",
)
def ols_pvalue(d: Data):
    return I.with_t_pvalue(ols_simple(d))


@query(
    "p_type:s n:l slope:f8 intercept:f6 r2:f8 se:f8 t:f6 df2:l",
    _LINE.format(key="p_type", y="p_retailprice", x="p_size", source="part"),
)
def ols_by_group(d: Data):
    return I.ols_simple(d.table("part"), "p_retailprice", "p_size", "p_type")


@query(
    "l_returnflag:s term:s n:l est:f4 se:f4 t:f4 r2:f8 adj_r2:f8 f:f2 df2:l",
    """SELECT l_returnflag, unnest(['(intercept)', 'quantity', 'discount']) AS term, n,
              unnest([b0, b1, b2]) AS est, unnest([se0, se1, se2]) AS se,
              unnest([b0 / se0, b1 / se1, b2 / se2]) AS t, r2, n - 3 AS df2,
              1 - (1 - r2) * (n - 1) / (n - 3) AS adj_r2, r2 / 2 / ((1 - r2) / (n - 3)) AS f
       FROM (SELECT l_returnflag, n, b1, b2, my - b1 * m1 - b2 * m2 AS b0,
                    sqrt(s2 * s22 / det) AS se1, sqrt(s2 * s11 / det) AS se2,
                    sqrt(s2 * (1 / CAST(n AS DOUBLE)
                      + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) AS se0,
                    (b1 * s1y + b2 * s2y) / syy AS r2
             FROM (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2
                   FROM (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1,
                                (s11 * s2y - s12 * s1y) / det AS b2
                         FROM (SELECT *, s11 * s22 - s12 * s12 AS det
                               FROM (SELECT l_returnflag, count(*) AS n,
                                            avg(l_quantity) AS m1, avg(l_discount) AS m2,
                                            avg(l_extendedprice) AS my,
                                            regr_sxx(l_discount, l_quantity) AS s11,
                                            regr_syy(l_discount, l_quantity) AS s22,
                                            regr_sxy(l_discount, l_quantity) AS s12,
                                            regr_sxy(l_extendedprice, l_quantity) AS s1y,
                                            regr_sxy(l_extendedprice, l_discount) AS s2y,
                                            regr_syy(l_extendedprice, l_quantity) AS syy
                                     FROM lineitem GROUP BY 1) AS a) AS b) AS c) AS e) AS f""",
)
def ols_multi(d: Data):
    terms = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount")}
    return I.ols_multi(d.table("lineitem"), "l_extendedprice", terms, "l_returnflag")


@query(
    "region:i term:s n:l est:f6 se:f6 df2:l",
    f"""SELECT m.region, CASE WHEN m.g = 'AUTOMOBILE' THEN '(intercept)'
                              ELSE 'c_mktsegment=' || m.g END AS term, t.n,
               CASE WHEN m.g = 'AUTOMOBILE' THEN m.m ELSE m.m - base.m END AS est,
               sqrt(t.ssw / (t.n - t.k) * CASE WHEN m.g = 'AUTOMOBILE' THEN 1 / CAST(m.n AS DOUBLE)
                    ELSE 1 / CAST(m.n AS DOUBLE) + 1 / CAST(base.n AS DOUBLE) END) AS se,
               t.n - t.k AS df2
        FROM {_MOMENTS} AS m
        JOIN (SELECT * FROM {_MOMENTS} AS x WHERE g = 'AUTOMOBILE') AS base
          ON base.region = m.region
        JOIN (SELECT region, sum(n) AS n, count(*) AS k, sum(ss) AS ssw FROM {_MOMENTS} AS y
              GROUP BY region) AS t ON t.region = m.region""",
)
def ols_categorical(d: Data):
    return I.ols_multi(
        balances(d), "c_acctbal", I.category_terms("c_mktsegment", METHODS), "region"
    )


# Three predictors: the inverse of their cross-moment matrix by cofactors.
_CUBE = """(SELECT *, s11 * i11 + s12 * i12 + s13 * i13 AS det FROM (
              SELECT *, s22 * s33 - s23 * s23 AS i11, s13 * s23 - s12 * s33 AS i12,
                     s12 * s23 - s13 * s22 AS i13, s11 * s33 - s13 * s13 AS i22,
                     s12 * s13 - s11 * s23 AS i23, s11 * s22 - s12 * s12 AS i33
              FROM (SELECT l_returnflag, count(*) AS n, avg(q) AS m1, avg(x) AS m2, avg(qx) AS m3,
                           avg(y) AS my, regr_sxx(y, q) AS s11, regr_sxx(y, x) AS s22,
                           regr_sxx(y, qx) AS s33, regr_sxy(q, x) AS s12, regr_sxy(q, qx) AS s13,
                           regr_sxy(x, qx) AS s23, regr_sxy(y, q) AS c1, regr_sxy(y, x) AS c2,
                           regr_sxy(y, qx) AS c3, regr_syy(y, q) AS syy
                    FROM (SELECT l_returnflag, l_quantity AS q, l_discount AS x,
                                 l_quantity * l_discount AS qx, l_extendedprice AS y
                          FROM lineitem) AS r GROUP BY 1) AS a) AS b)"""
_CUBE_FIT = f"""(SELECT *, (syy - b1 * c1 - b2 * c2 - b3 * c3) / (n - 4) AS s2
                 FROM (SELECT *, (i11 * c1 + i12 * c2 + i13 * c3) / det AS b1,
                              (i12 * c1 + i22 * c2 + i23 * c3) / det AS b2,
                              (i13 * c1 + i23 * c2 + i33 * c3) / det AS b3 FROM {_CUBE} AS c) AS f)"""
_CUBE_ROWS = f"""(SELECT l_returnflag, n, n - 4 AS df2,
       unnest(['(intercept)', 'quantity', 'discount', 'quantity:discount']) AS term,
       unnest([my - b1 * m1 - b2 * m2 - b3 * m3, b1, b2, b3]) AS est,
       unnest([sqrt(s2 * (1 / CAST(n AS DOUBLE) + (m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33
                 + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23)) / det)),
               sqrt(s2 * i11 / det), sqrt(s2 * i22 / det), sqrt(s2 * i33 / det)]) AS se
       FROM {_CUBE_FIT} AS g)"""


@query(
    "l_returnflag:s term:s n:l est:f4 se:f4 t:f4 p:f6",
    f"""SELECT l_returnflag, term, n, est, se, t, {S.t_two_sided('t', 'df2')} AS p
        FROM (SELECT *, est / se AS t FROM {_CUBE_ROWS} AS h) AS i""",
)
def ols_interaction(d: Data):
    q, x = F.col("l_quantity"), F.col("l_discount")
    fit = I.ols_multi(
        d.table("lineitem"),
        "l_extendedprice",
        {"quantity": q, "discount": x, "quantity:discount": q * x},
        "l_returnflag",
    )
    return I.with_t_pvalue(fit)


@query(
    "l_returnflag:s n:l slope:f4 intercept:f4 se:f4 t:f4 df2:l",
    """SELECT l_returnflag, n, slope, my - slope * mx AS intercept,
              sqrt((syy - slope * sxy) / ((n - 2) * sxx)) AS se,
              slope / sqrt((syy - slope * sxy) / ((n - 2) * sxx)) AS t, n - 2 AS df2
       FROM (SELECT l_returnflag, count(*) AS n, max(mx) AS mx, max(my) AS my,
                    sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope,
                    sum(w * (x - mx) * (x - mx)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy,
                    sum(w * (y - my) * (y - my)) AS syy
             FROM (SELECT *, sum(w * x) OVER g / sum(w) OVER g AS mx,
                          sum(w * y) OVER g / sum(w) OVER g AS my
                   FROM (SELECT l_returnflag, l_extendedprice AS y, ln(l_quantity) AS x,
                                l_discount AS w FROM lineitem WHERE l_discount > 0) AS a
                   WINDOW g AS (PARTITION BY l_returnflag)) AS b
             GROUP BY l_returnflag) AS c""",
)
def wls_simple(d: Data):
    rows = d.table("lineitem").withColumn("x", safe_ln("l_quantity"))
    return I.wls_simple(rows, "l_extendedprice", "x", "l_discount", "l_returnflag")


# Tests far apart in x: each is centred on its own.
_FAR = "l_quantity + CASE WHEN l_returnflag = 'A' THEN 100000000 ELSE 0 END"


@query(
    "l_returnflag:s n:l slope:f3 r2:f8 p:b",
    f"""SELECT l_returnflag, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2,
               true AS p
        FROM (SELECT l_returnflag, l_extendedprice AS y,
                     ({_FAR}) - CASE WHEN l_returnflag = 'A' THEN 100000000 ELSE 0 END AS x
              FROM lineitem) AS t GROUP BY 1""",
)
def wls_far_tests(d: Data):
    rows = d.table("lineitem").withColumn("x", F.expr(_FAR)).withColumn("one", F.lit(1.0))
    far = I.wls_simple(rows, "l_extendedprice", "x", "one", "l_returnflag")
    return I.with_t_pvalue(far).withColumn("p", F.col("p").between(0, 1))


_MULTI = QUERIES["ols_multi"].oracle
_MULTI_P = f"""(SELECT *, {S.t_two_sided('t', 'df2')} AS p,
                       power(df2 / (df2 + 2 * f), df2 / CAST(2 AS DOUBLE)) AS f_p FROM ({_MULTI}) AS m)"""


@query(
    "l_returnflag:s term:s n:l est:f4 se:f4 t:f4 p:f6 r2:f8 adj_r2:f8 f:f2 f_p:f8 df2:l",
    f"""SELECT l_returnflag, term, n, est, se, t, p, r2, adj_r2, f, f_p, df2 FROM {_MULTI_P} AS a
        UNION ALL
        SELECT l_returnflag, 'both', n, NULL, NULL, NULL, NULL, r2, adj_r2, f, f_p, df2
        FROM {_MULTI_P} AS b WHERE term = '(intercept)'""",
)
def ols_dependent(d: Data):
    """A term that the others explain is null; the rest is fitted."""
    q, x = F.col("l_quantity"), F.col("l_discount")
    terms = {"quantity": q, "discount": x, "both": q + 2 * x}
    return L.fit_terms(d.table("lineitem"), "l_extendedprice", terms, "l_returnflag")


@query(
    "l_returnflag:s quantity:f2 discount:f2 discount_se:f4 discount_p:f6 r2:f8",
    f"""SELECT l_returnflag, max(est) FILTER (term = 'quantity') AS quantity,
               max(est) FILTER (term = 'discount') AS discount,
               max(se) FILTER (term = 'discount') AS discount_se,
               max(p) FILTER (term = 'discount') AS discount_p, max(r2) AS r2
        FROM {_MULTI_P} AS a GROUP BY 1""",
)
def ols_parallel(d: Data):
    """Two columns that are parallel up to a millionth of their length, brought back to the others."""
    q, near = F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount") / 1000
    fit = L.fit_terms(d.table("lineitem"), "l_extendedprice", {"q": q, "near": near}, "l_returnflag")
    own = lambda c, term: F.max(F.when(F.col("term") == term, F.col(c)))
    return fit.groupBy("l_returnflag").agg(
        (own("est", "q") + own("est", "near")).alias("quantity"),
        (own("est", "near") / 1000).alias("discount"),
        (own("se", "near") / 1000).alias("discount_se"),
        own("p", "near").alias("discount_p"),
        F.max("r2").alias("r2"),
    )


@query(
    "region:i term:s n:l est:f6 se:f6 t:f6 p:f6 df2:l",
    f"""SELECT region, term, n, est, se, est / se AS t, {S.t_two_sided('(est / se)', 'df2')} AS p, df2
        FROM ({QUERIES["ols_categorical"].oracle}) AS c""",
)
def ols_categorical_pvalue(d: Data):
    terms = I.category_terms("c_mktsegment", METHODS)
    return L.fit_terms(balances(d), "c_acctbal", terms, "region")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "l_linestatus:s x:s y:s r:f8",
    " UNION ALL ".join(
        f"SELECT l_linestatus, '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM lineitem GROUP BY 1"
        for a in _MEASURES
        for b in _MEASURES
    ),
)
def correlation_matrix(d: Data):
    return I.correlation_matrix(d.table("lineitem"), _MEASURES, "l_linestatus")


@query(
    "p_type:s x:s y:s r:f8 p:f8",
    f"""SELECT p_type, x, y, r, {S.t_two_sided('(r * sqrt(n - 2) / sqrt(1 - r * r))', 'df2')} AS p
        FROM (SELECT p_type, 'p_size' AS x, 'p_retailprice' AS y, corr(p_size, p_retailprice) AS r,
                     count(*) AS n, count(*) - 2 AS df2 FROM part GROUP BY p_type
              UNION ALL SELECT p_type, 'p_retailprice', 'p_size', corr(p_size, p_retailprice),
                     count(*), count(*) - 2 FROM part GROUP BY p_type) AS c""",
)
def correlation_pvalue(d: Data):
    pairs = I.correlation_matrix(d.table("part"), ["p_size", "p_retailprice"], "p_type")
    return I.with_t_pvalue(pairs.filter(F.col("x") != F.col("y")))


@query(
    "x:s y:s n:l mean_x:f8 r:f8",
    """WITH cells AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place
                      FROM embeddings WHERE list_count(embedding[1:64]) = 64),
            known AS (SELECT vec_id, place, CAST(v AS DOUBLE) AS v FROM cells WHERE place < 64)
       SELECT 'embedding' || a.place AS x, 'embedding' || b.place AS y, count(*) AS n,
              avg(a.v) AS mean_x, corr(a.v, b.v) AS r
       FROM known AS a JOIN known AS b ON a.vec_id = b.vec_id GROUP BY a.place, b.place""",
)
def correlation_wide(d: Data):
    """All pairs of 64 columns in one pass."""
    return M.gram_table(d.table("embeddings"), M.vector_columns("embedding", range(64)))


def pairs(d: Data):
    return I.posthoc_pairs(balances(d), "c_acctbal", "c_mktsegment", "region")


_PAIRS = f"""SELECT a.region, a.g AS group1, b.g AS group2, b.m - a.m AS diff,
               sqrt(a.ssw / a.df2 * (1 / CAST(a.n AS DOUBLE) + 1 / CAST(b.n AS DOUBLE))) AS se,
               (b.m - a.m) / sqrt(a.ssw / a.df2 * (1 / CAST(a.n AS DOUBLE)
                 + 1 / CAST(b.n AS DOUBLE))) AS t,
               a.df2, a.k, a.n AS n1, b.n AS n2, abs(a.place - b.place) + 1 AS reach
        FROM (SELECT *, sum(ss) OVER w AS ssw, sum(n) OVER w - count(*) OVER w AS df2, count(*) OVER w AS k,
                     rank() OVER (PARTITION BY region ORDER BY m) AS place
              FROM {_MOMENTS} AS x WINDOW w AS (PARTITION BY region)) AS a
        JOIN (SELECT *, rank() OVER (PARTITION BY region ORDER BY m) AS place
              FROM {_MOMENTS} AS y) AS b ON a.region = b.region AND a.g < b.g"""
_KEYS = "region, group1, group2"
_Q = "(abs(t) * sqrt(2))"


@query(
    "region:i group1:s group2:s diff:f6 se:f6 t:f6 df2:l reach:l",
    _PAIRS,
)
def posthoc_pairs(d: Data):
    return pairs(d)


# The critical range per region by halving an interval 45 times.
_CRITICAL = f"""(WITH RECURSIVE halving AS (
    SELECT DISTINCT region, k, df2, CAST(0 AS DOUBLE) AS lo, CAST(10 AS DOUBLE) AS hi, 0 AS step
    FROM ({_PAIRS}) AS p
    UNION ALL
    SELECT region, k, df2, CASE WHEN tail > 0.05 THEN (lo + hi) / 2 ELSE lo END,
           CASE WHEN tail > 0.05 THEN hi ELSE (lo + hi) / 2 END, step + 1
    FROM {S.range_tail("halving", "((lo + hi) / 2)", "k", "df2", "region, k, df2, lo, hi, step")} AS r
    WHERE step < 45)
  SELECT region, lo AS q_crit FROM halving WHERE step = 45)"""


@query(
    "region:i group1:s group2:s diff:f6 lower:f4 upper:f4 p:f6",
    f"""SELECT p.region, p.group1, p.group2, diff, diff - q_crit / sqrt(2) * se AS lower,
               diff + q_crit / sqrt(2) * se AS upper, tail AS p
        FROM ({_PAIRS}) AS p JOIN {_CRITICAL} AS c ON c.region = p.region
        JOIN {S.range_tail(f"({_PAIRS})", _Q, "k", "df2", _KEYS)} AS t
          ON t.region = p.region AND t.group1 = p.group1 AND t.group2 = p.group2""",
)
def posthoc_tukey(d: Data):
    return I.tukey_hsd(pairs(d))


@query(
    "region:i group1:s group2:s p:f3 mark:s",
    f"""SELECT *, CASE WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE 'NS' END AS mark
        FROM (SELECT region, group1, group2,
                     round(1 - power(1 - tail, 1 / CAST(reach - 1 AS DOUBLE)), 3) AS p
              FROM {S.range_tail(f"({_PAIRS})", _Q, "reach", "df2", _KEYS + ", reach")} AS r) AS s""",
)
def posthoc_duncan(d: Data):
    out = I.duncan(pairs(d)).withColumn("p", F.round("p", 3))
    return out.withColumn("mark", significance("p"))


@query(
    "region:i group1:s group2:s diff:f6 p:f6",
    f"""SELECT region, group1, group2, diff, CASE WHEN k = 5 THEN {S.f_upper_4('f', 'df2')} END AS p
        FROM (SELECT *, t * t / (k - 1) AS f FROM ({_PAIRS}) AS p) AS s""",
)
def posthoc_scheffe(d: Data):
    return I.scheffe(pairs(d))


@query(
    "region:i group1:s group2:s p:f6",
    f"""SELECT region, group1, group2,
               least({S.t_two_sided('t', 'df2')} * (k * (k - 1) / CAST(2 AS DOUBLE)), 1) AS p
        FROM ({_PAIRS}) AS p""",
)
def posthoc_bonferroni(d: Data):
    return I.bonferroni(pairs(d))


_AGAINST = f"""(SELECT region, CASE WHEN group2 = 'BUILDING' THEN group1 ELSE group2 END AS grp, df2,
                       CASE WHEN group2 = 'BUILDING' THEN -diff ELSE diff END AS diff,
                       CASE WHEN group2 = 'BUILDING' THEN -t ELSE t END AS t,
                       sqrt(CASE WHEN group2 = 'BUILDING' THEN n1 ELSE n2 END
                            / CAST(n1 + n2 AS DOUBLE)) AS load
                FROM ({_PAIRS}) AS p WHERE 'BUILDING' IN (group1, group2))"""
_ALL_LOADS = f"""(SELECT a.region, a.grp, a.df2, a.diff, a.t, b.load
                  FROM {_AGAINST} AS a JOIN {_AGAINST} AS b ON a.region = b.region)"""


@query(
    "region:i grp:s diff:f6 t:f6 p:f6",
    f"""SELECT region, grp, diff, t, tail AS p
        FROM {S.dunnett_tail(_ALL_LOADS, "t", "df2", "load", "region, grp, diff, t")} AS r""",
)
def posthoc_dunnett(d: Data):
    return I.dunnett(pairs(d), "BUILDING", "region")


# Critical points of the other procedures, by halving an interval 40 times.
def _halved(keys: str, seed: str, tail: str, level: str, top: int) -> str:
    return f"""(WITH RECURSIVE halving AS (
        SELECT DISTINCT {keys}, CAST(0 AS DOUBLE) AS lo, CAST({top} AS DOUBLE) AS hi, 0 AS step
        FROM {seed} AS seed
        UNION ALL
        SELECT {keys}, CASE WHEN tail > {level} THEN (lo + hi) / 2 ELSE lo END,
               CASE WHEN tail > {level} THEN hi ELSE (lo + hi) / 2 END, step + 1
        FROM {tail} AS r WHERE step < 40)
      SELECT {keys}, (lo + hi) / 2 AS point FROM halving WHERE step = 40)"""


_MIDDLE = "((lo + hi) / 2)"
_REACHES = f"(SELECT region, df2, greatest(reach, 2) AS reach FROM ({_PAIRS}) AS p)"
_DUNCAN_POINT = _halved(
    "region, df2, reach",
    _REACHES,
    S.range_tail("halving", _MIDDLE, "reach", "df2", "region, df2, reach, lo, hi, step"),
    "1 - power(0.95, reach - 1)",
    10,
)
_SCHEFFE_POINT = _halved(
    "region, df2",
    f"({_PAIRS})",
    f"(SELECT *, {S.f_upper_4(_MIDDLE, 'df2')} AS tail FROM halving)",
    "0.05",
    50,
)
_DUNNETT_POINT = _halved(
    "region, df2",
    _AGAINST,
    S.dunnett_tail(
        f"(SELECT h.*, a.load FROM halving AS h JOIN {_AGAINST} AS a ON a.region = h.region)",
        _MIDDLE,
        "df2",
        "load",
        "region, df2, lo, hi, step",
    ),
    "0.05",
    10,
)


@query(
    "region:i group1:s group2:s diff:f6 lower:f4 upper:f4",
    f"""SELECT p.region, group1, group2, diff, diff - point / sqrt(2) * se AS lower,
               diff + point / sqrt(2) * se AS upper
        FROM ({_PAIRS}) AS p JOIN {_DUNCAN_POINT} AS c
          ON c.region = p.region AND c.reach = greatest(p.reach, 2)""",
)
def posthoc_duncan_interval(d: Data):
    return I.duncan(pairs(d))


@query(
    "region:i group1:s group2:s diff:f6 lower:f4 upper:f4",
    f"""SELECT p.region, group1, group2, diff, diff - sqrt(4 * point) * se AS lower,
               diff + sqrt(4 * point) * se AS upper
        FROM ({_PAIRS}) AS p JOIN {_SCHEFFE_POINT} AS c ON c.region = p.region""",
)
def posthoc_scheffe_interval(d: Data):
    return I.scheffe(pairs(d))


@query(
    "region:i grp:s diff:f6 lower:f4 upper:f4",
    f"""SELECT a.region, grp, diff, diff - point * abs(diff / t) AS lower,
               diff + point * abs(diff / t) AS upper
        FROM {_AGAINST} AS a JOIN {_DUNNETT_POINT} AS c ON c.region = a.region""",
)
def posthoc_dunnett_interval(d: Data):
    return I.dunnett(pairs(d), "BUILDING", "region")


_RANKS = """SELECT q.l_linestatus, k, n,
              (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k - 1 AS df1
       FROM (SELECT l_linestatus, count(*) AS k, sum(r * r / c) AS s, sum(c) AS n
             FROM (SELECT l_linestatus, l_returnflag, sum(rk) AS r, CAST(count(*) AS DOUBLE) AS c
                   FROM (SELECT l_linestatus, l_returnflag,
                                rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity)
                                + (count(*) OVER (PARTITION BY l_linestatus, l_quantity) - 1)
                                  / CAST(2 AS DOUBLE) AS rk FROM lineitem) AS a
                   GROUP BY 1, 2) AS b GROUP BY 1) AS q
       JOIN (SELECT l_linestatus, sum(c * c * c - c) AS ties
             FROM (SELECT l_linestatus, l_quantity, CAST(count(*) AS DOUBLE) AS c FROM lineitem
                   GROUP BY 1, 2) AS a GROUP BY 1) AS t ON t.l_linestatus = q.l_linestatus"""


@query(
    "l_linestatus:s k:l n:l h:f6 df1:l",
    _RANKS,
)
def kruskal_wallis(d: Data):
    return I.kruskal_wallis(d.table("lineitem"), "l_quantity", "l_returnflag", "l_linestatus")


@query(
    "l_linestatus:s h:f6 df1:l p:f8",
    f"SELECT l_linestatus, h, df1, CASE WHEN df1 = 2 THEN exp(-h / 2) END AS p FROM ({_RANKS}) AS r",
)
def kruskal_pvalue(d: Data):
    return I.with_chi2_pvalue(kruskal_wallis(d))


_WIN_SQL = " UNION ALL ".join(
    f"""SELECT '{n}' AS win, d.county, avg(d.confirmed) AS x FROM v_daily AS d
        WHERE d.date >= DATE '1998-08-18' + ({a}) AND d.date <= DATE '1998-08-18' + ({b})
        GROUP BY d.county"""
    for n, (a, b) in OFFSET_WINDOWS.items()
)


@query(
    "win:s major:s n:l slope:f6 intercept:f6",
    f"""SELECT win, major, regr_count(y, x) AS n, regr_sxy(y, x) / nullif(regr_sxx(y, x), 0) AS slope,
               regr_avgy(y, x) - regr_sxy(y, x) / nullif(regr_sxx(y, x), 0) * regr_avgx(y, x)
                 AS intercept
        FROM (SELECT x.win, w.major, x.x, b.y FROM ({_WIN_SQL}) AS x
              JOIN v_wide AS w ON w.county = x.county
              JOIN (SELECT county, max(CASE WHEN date = DATE '1998-09-29' THEN slope END)
                             - max(CASE WHEN date = DATE '1998-08-18' THEN slope END) AS y
                    FROM v_slopes GROUP BY county) AS b ON b.county = x.county) AS r
        GROUP BY win, major""",
)
def sensitivity_slopes(d: Data):
    """The same line, growth change on mean signal, for each offset window and category."""
    slopes = d.slopes()
    offset = F.datediff("date", F.lit(START))
    b = lambda k: F.max(F.when(offset == k, F.col("slope")))
    means = [
        F.avg(F.when(offset.between(lo, hi), F.col("confirmed"))).alias(n)
        for n, (lo, hi) in OFFSET_WINDOWS.items()
    ]
    wide = slopes.groupBy("county").agg((b(42) - b(0)).alias("y"), *means)
    long = wide.unpivot(["county", "y"], list(OFFSET_WINDOWS), "win", "x")
    rows = long.join(d.majors(), "county").withColumn("test", F.struct("win", "major"))
    fit = I.ols_simple(rows, "y", "x", "test")
    return fit.select("test.win", "test.major", "n", "slope", "intercept")
