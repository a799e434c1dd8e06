"""Group tests and regressions as grouped aggregates.

Every test is keyed by a `test` column, so many metrics, strata or cutoffs run in one job. The
data is reduced to counts, means and centred second moments with map-side combining; the rest
works on a few rows per test. Degenerate tests (one group, no variance) give null statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.tails import (
    chi2_pvalue,
    dunnett_critical,
    dunnett_pvalue,
    f_critical,
    f_pvalue,
    t_pvalue,
    tukey_critical,
    tukey_pvalue,
)
from panelforge.operators.moments import weighted_moments
from panelforge.operators.ordered import preceding_sums


def group_moments(df: DataFrame, y: str, group: str, test: str) -> DataFrame:
    """Per (test, group): n, mean, within sum of squares over the complete cases."""
    return (
        df.filter(F.col(y).isNotNull() & F.col(group).isNotNull())
        .groupBy(test, group)
        .agg(
            F.count(y).alias("n"),
            F.avg(y).alias("mean"),
            (F.var_pop(y) * F.count(y)).alias("ss"),
        )
    )


def _anova(moments: DataFrame, test: str) -> DataFrame:
    whole = W.partitionBy(test)
    centred = moments.withColumn(
        "_grand", F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    )
    out = centred.groupBy(test).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) ** 2).alias("ssb"),
        F.sum("ss").alias("ssw"),
    )
    out = out.withColumns({"df1": F.col("k") - 1, "df2": F.col("n") - F.col("k")})
    usable = (F.col("df1") > 0) & (F.col("df2") > 0) & (F.col("ssw") > 0)
    f = (F.col("ssb") / F.col("df1")) / (F.col("ssw") / F.col("df2"))
    return out.withColumn("f", F.when(usable, f))


def anova_oneway(df: DataFrame, y: str, group: str, test: str) -> DataFrame:
    """test, k, n, df1, df2, ssb, ssw, f."""
    return _anova(group_moments(df, y, group, test), test)


def with_f_pvalue(stats: DataFrame) -> DataFrame:
    return stats.withColumn(
        "p", f_pvalue("f", F.col("df1").cast("double"), F.col("df2").cast("double"))
    )


def anova_cutoff_sweep(
    df: DataFrame, y: str, x: str, cutoffs: Sequence[float], test: str
) -> DataFrame:
    """One-way ANOVA of y on (x > cutoff) for every cutoff, in one pass over the data.

    Each row falls into the bin of cutoffs below its x. The data shrinks to at most
    len(cutoffs) + 1 rows per test, and each bin then adds to the low or high side of each cutoff.
    """
    cuts = F.array(*[F.lit(float(c)) for c in cutoffs])
    binned = df.filter(F.col(x).isNotNull()).withColumn(
        "_bin", F.size(F.filter(cuts, lambda c: c < F.col(x)))
    )
    moments = group_moments(binned, y, "_bin", test)
    whole = W.partitionBy(test)
    # Shifting by the overall mean keeps the pooled sums of squares accurate.
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    moments = moments.withColumn("_d", F.col("mean") - grand)
    sides = moments.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(cutoffs) - 1))))
    sides = (
        sides.withColumn("_high", F.col("_bin") > F.col("_i"))
        .groupBy(test, "_i", "_high")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("_d")).alias("_s1"),
            F.sum(F.col("ss") + F.col("n") * F.col("_d") ** 2).alias("_s2"),
        )
    )
    sides = sides.withColumns(
        {"mean": F.col("_s1") / F.col("n"), "ss": F.col("_s2") - F.col("_s1") ** 2 / F.col("n")}
    )
    key = F.struct(test, "_i")
    out = _anova(sides.withColumn("_key", key), "_key")
    return out.select(
        F.col(f"_key.{test}").alias(test),
        F.col("_key._i").alias("cutoff_id"),
        F.element_at(cuts, F.col("_key._i") + 1).alias("cutoff"),
        *[c for c in out.columns if c != "_key"],
    )


def kruskal_wallis(df: DataFrame, y: str, group: str, test: str) -> DataFrame:
    """Rank test with tie correction: test, k, n, h, df1.

    Values collapse to counts first, so ties of any size are one row; ranks come from sums over
    value ranges and never from one sorted partition.
    """
    counts = (
        df.filter(F.col(y).isNotNull() & F.col(group).isNotNull())
        .groupBy(test, y, group)
        .agg(F.count(F.lit(1)).cast("double").alias("c"))
    )
    ranked = preceding_sums(
        counts, y, {"before": F.col("c")}, by=[test], peers=True, touch=["c"]
    )
    t = F.col("before_peers")
    sums = ranked.groupBy(test, group).agg(
        F.sum("c").alias("c"),
        F.sum(F.col("c") * (F.col("before") + (t + 1) / 2)).alias("r"),
        # A tie of size t adds t^3 - t once: c / t of it from each group that shares the value.
        F.sum(F.col("c") * (t**2 - 1)).alias("ties"),
    )
    sums = sums.withColumn("all", F.sum("c").over(W.partitionBy(test)))  # one row per group
    out = sums.groupBy(test).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("c").alias("n"),
        # Mean ranks against the middle rank: no difference of two large numbers.
        F.sum(F.col("c") * (F.col("r") / F.col("c") - (F.col("all") + 1) / 2) ** 2).alias("q"),
        F.sum("ties").alias("ties"),
    )
    n = F.col("n")
    spread = 1 - F.col("ties") / (n**3 - n)
    h = 12 / (n * (n + 1)) * F.col("q") / spread
    return out.select(
        test,
        "k",
        n.cast("bigint").alias("n"),
        F.when((F.col("k") > 1) & (spread > 0), h).alias("h"),
        (F.col("k") - 1).alias("df1"),
    )


def with_chi2_pvalue(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p", chi2_pvalue("h", F.col("df1").cast("double")))


# --- comparisons of group means ---------------------------------------------------------------


def posthoc_pairs(df: DataFrame, y: str, group: str, test: str) -> DataFrame:
    """All pairs of group means with the pooled error: one row per (test, group1 < group2).

    The data is read once. Pairs come from the group summaries (one entry per category), never
    from data rows.
    """
    moments = group_moments(df, y, group, test)
    place = F.rank().over(W.partitionBy(test).orderBy("mean"))
    tests = moments.withColumn("place", place).groupBy(test).agg(
        F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n", "mean", "place"))).alias(
            "_g"
        ),
        F.count(F.lit(1)).alias("k"),
        (F.sum("n") - F.count(F.lit(1))).alias("df2"),
        F.sum("ss").alias("ssw"),
    )
    pairs = tests.withColumn("a", F.explode("_g")).withColumn(
        "b", F.explode(F.filter("_g", lambda o: o["g"] > F.col("a.g")))
    )
    msw = F.when((F.col("df2") > 0) & (F.col("ssw") > 0), F.col("ssw") / F.col("df2"))
    inv = 1 / F.col("a.n") + 1 / F.col("b.n")
    out = pairs.select(
        test,
        F.col("a.g").alias("group1"),
        F.col("b.g").alias("group2"),
        F.col("a.n").alias("n1"),
        F.col("b.n").alias("n2"),
        "k",
        "df2",
        (F.col("b.mean") - F.col("a.mean")).alias("diff"),
        F.sqrt(msw * inv).alias("se"),
        (F.abs(F.col("a.place") - F.col("b.place")) + 1).alias("reach"),
    )
    t = F.try_divide(F.col("diff"), F.col("se"))
    return out.withColumns({"t": t, "q": F.abs(t) * F.sqrt(F.lit(2.0))})


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _with_interval(rows: DataFrame, reach: Column) -> DataFrame:
    wide = rows.withColumn("_h", reach)
    return wide.withColumns(
        {"lower": F.col("diff") - F.col("_h"), "upper": F.col("diff") + F.col("_h")}
    ).drop("_h")


def tukey_hsd(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adjusted p and simultaneous interval of each difference."""
    out = pairs.withColumn("p", tukey_pvalue("q", _d("k"), _d("df2")))
    point = tukey_critical(F.lit(confidence), _d("k"), _d("df2"))
    return _with_interval(out, point / F.sqrt(F.lit(2.0)) * F.col("se"))


def duncan(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Multiple range test: the range spans the ordered means between the pair."""
    reach = F.greatest(_d("reach"), F.lit(2.0))
    out = pairs.withColumn("_t", tukey_pvalue("q", reach, _d("df2")))
    out = out.withColumn("p", 1 - F.pow(1 - F.col("_t"), 1 / (reach - 1))).drop("_t")
    point = tukey_critical(F.pow(F.lit(confidence), reach - 1), reach, _d("df2"))
    return _with_interval(out, point / F.sqrt(F.lit(2.0)) * F.col("se"))


def scheffe(pairs: DataFrame, confidence: float = 0.95) -> DataFrame:
    d1 = _d("k") - 1
    out = pairs.withColumn("p", f_pvalue(F.col("t") ** 2 / d1, d1, _d("df2")))
    point = f_critical(F.lit(confidence), d1, _d("df2"))
    return _with_interval(out, F.sqrt(d1 * point) * F.col("se"))


def bonferroni(pairs: DataFrame) -> DataFrame:
    """Pairwise t tests with pooled error, p times the number of pairs."""
    m = _d("k") * (_d("k") - 1) / 2
    return pairs.withColumn("_p", t_pvalue("t", _d("df2"))).withColumn(
        "p", F.least(F.col("_p") * m, F.lit(1.0))
    ).drop("_p")


def dunnett(
    pairs: DataFrame, control: str, test: str, confidence: float = 0.95
) -> DataFrame:
    """Every group against one control; sign follows group minus control."""
    flip = F.when(F.col("group2") == control, -1.0).otherwise(1.0)
    own = pairs.filter((F.col("group1") == control) | (F.col("group2") == control))
    own = own.select(
        test,
        F.when(F.col("group2") == control, F.col("group1")).otherwise(F.col("group2")).alias("grp"),
        "df2",
        "se",
        (F.col("diff") * flip).alias("diff"),
        (F.col("t") * flip).alias("t"),
        F.when(F.col("group2") == control, F.sqrt(F.col("n1") / (F.col("n1") + F.col("n2"))))
        .otherwise(F.sqrt(F.col("n2") / (F.col("n1") + F.col("n2"))))
        .alias("_l"),
    )
    whole = W.partitionBy(test)
    loaded = own.withColumn("_ls", F.collect_list("_l").over(whole))
    out = loaded.withColumn("p", dunnett_pvalue("t", _d("df2"), "_ls"))
    point = dunnett_critical(F.lit(confidence), _d("df2"), "_ls")
    return _with_interval(out, point * F.col("se")).drop("_l", "_ls")


# --- regression and correlation ---------------------------------------------------------------


def ols_simple(df: DataFrame, y: str, x: str, test: str) -> DataFrame:
    """Line of y on x per test: n, slope, intercept, r2, slope error and t."""
    out = df.groupBy(test).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_sxy(y, x).alias("sxy"),
        F.regr_avgx(y, x).alias("_mx"),
        F.regr_avgy(y, x).alias("_my"),
    )
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    out = out.withColumn("slope", slope).withColumns(
        {
            "intercept": F.col("_my") - F.col("slope") * F.col("_mx"),
            "r2": F.try_divide(F.col("slope") * F.col("sxy"), F.col("syy")),
            "se": F.when(F.col("n") > 2, F.sqrt(F.try_divide(sse, (F.col("n") - 2) * F.col("sxx")))),
        }
    )
    out = out.withColumns(
        {"t": F.try_divide("slope", "se"), "df2": (F.col("n") - 2).cast("bigint")}
    )
    return out.select(test, "n", "slope", "intercept", "r2", "se", "t", "df2")


def with_t_pvalue(stats: DataFrame) -> DataFrame:
    return stats.withColumn("p", t_pvalue("t", _d("df2")))


def wls_simple(df: DataFrame, y: str, x: str, weight: str, test: str) -> DataFrame:
    """Weighted line of y on x per test, with r2; rows of zero weight do not count towards n."""
    out = weighted_moments(df, x, y, weight, test)
    slope = F.try_divide("sxy", "sxx")
    sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    out = out.withColumn("slope", slope).withColumns(
        {
            "intercept": F.col("y") - F.col("slope") * F.col("x"),
            "r2": F.try_divide(F.col("slope") * F.col("sxy"), F.col("syy")),
            "se": F.when(F.col("n") > 2, F.sqrt(F.try_divide(sse, (F.col("n") - 2) * F.col("sxx")))),
        }
    )
    out = out.withColumns(
        {"t": F.try_divide("slope", "se"), "df2": (F.col("n") - 2).cast("bigint")}
    )
    return out.select(F.col("test").alias(test), "n", "slope", "intercept", "r2", "se", "t", "df2")


_SOLUTION = T.StructType(
    [
        T.StructField("est", T.ArrayType(T.DoubleType())),
        T.StructField("se", T.ArrayType(T.DoubleType())),
        T.StructField("sigma2", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("df2", T.LongType()),
    ]
)


@F.pandas_udf(_SOLUTION)
def _solve(n: pd.Series, means: pd.Series, sxx: pd.Series, sxy: pd.Series, syy: pd.Series) -> pd.DataFrame:
    rows = []
    for count, mean, a, b, total in zip(n, means, sxx, sxy, syy):
        k = len(b)
        df2 = int(count) - k - 1
        nothing = (None, None, None, None, df2)
        if df2 <= 0:
            rows.append(nothing)
            continue
        a, b, mean = np.array(a).reshape(k, k), np.array(b), np.array(mean)
        unit = np.sqrt(np.maximum(np.diag(a), 0))
        if np.any(unit == 0) or np.linalg.matrix_rank(a / np.outer(unit, unit)) < k:
            rows.append(nothing)
            continue
        inv = np.linalg.inv(a / np.outer(unit, unit)) / np.outer(unit, unit)
        beta = inv @ b
        sigma2 = max(total - beta @ b, 0.0) / df2
        est = np.concatenate([[mean[-1] - beta @ mean[:-1]], beta])
        var0 = 1.0 / count + mean[:-1] @ inv @ mean[:-1]
        se = np.sqrt(sigma2 * np.concatenate([[var0], np.diag(inv)]))
        r2 = beta @ b / total if total > 0 else None
        rows.append((est, se, sigma2, r2, df2))
    return pd.DataFrame(rows, columns=["est", "se", "sigma2", "r2", "df2"])


def ols_multi(df: DataFrame, y: str, terms: Mapping[str, Column], test: str) -> DataFrame:
    """Multiple regression per test: one row per (test, term) with estimate, error and t, beside
    the fit's r2, adjusted r2 and overall f.

    `terms` maps a term name to its column expression, so categories enter as 0/1 columns and
    interactions as products. Spark reduces the complete cases to centred cross moments; the
    linear system of each test (terms x terms) is solved on that one row.
    """
    names = list(terms)
    rows = df.select(test, F.col(y).cast("double").alias("_y"), *[
        c.cast("double").alias(f"_x{i}") for i, c in enumerate(terms.values())
    ]).dropna("any")
    xs = [f"_x{i}" for i in range(len(names))]
    n = F.count(F.lit(1))
    upper = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    moments = rows.groupBy(test).agg(
        n.alias("n"),
        *[F.avg(c).alias(f"m{c}") for c in [*xs, "_y"]],
        *[(F.covar_pop(xs[i], xs[j]) * n).alias(f"s{i}_{j}") for i, j in upper],
        *[(F.covar_pop(x, "_y") * n).alias(f"c{x}") for x in xs],
        (F.var_pop("_y") * n).alias("syy"),
    )
    square = F.array(
        *[F.col(f"s{min(i, j)}_{max(i, j)}") for i in range(len(xs)) for j in range(len(xs))]
    )
    solved = moments.withColumn(
        "_r",
        _solve(
            F.col("n").cast("double"),
            F.array(*[F.col(f"m{c}") for c in [*xs, "_y"]]),
            square,
            F.array(*[F.col(f"c{x}") for x in xs]),
            F.col("syy"),
        ),
    )
    labels = F.array(*[F.lit(t) for t in ["(intercept)", *names]])
    out = solved.select(
        test,
        "n",
        F.col("_r.r2").alias("r2"),
        F.col("_r.df2").alias("df2"),
        F.explode(F.arrays_zip(labels.alias("term"), F.col("_r.est"), F.col("_r.se"))).alias("_t"),
    )
    out = out.select(test, "n", "r2", "df2", "_t.term", "_t.est", "_t.se")
    rest = F.try_divide(1 - F.col("r2"), F.col("df2"))
    return out.withColumns(
        {
            "t": F.try_divide("est", "se"),
            "adj_r2": 1 - rest * (F.col("n") - 1),
            "f": F.try_divide(F.col("r2") / len(names), rest),
        }
    )


def category_terms(column: str, levels: Sequence[str]) -> dict[str, Column]:
    """0/1 columns for every level but the first (the base)."""
    return {f"{column}={v}": (F.col(column) == v).cast("double") for v in levels[1:]}


def correlation_matrix(df: DataFrame, columns: Sequence[str], test: str) -> DataFrame:
    """Correlation of every ordered pair of columns over the complete cases, in long form, with
    the t of each pair of different columns."""
    rows = df.dropna("any", subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = rows.groupBy(test).agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs]
    )
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{a}|{b}").alias("r"))
        for a, b in pairs
    ]
    cells += [
        F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(f"{a}|{b}").alias("r"))
        for a, b in pairs
        if a != b
    ]
    out = wide.select(test, "n", F.inline(F.array(*cells)))
    r, df2 = F.col("r"), F.col("n") - 2
    t = F.try_divide(r * F.sqrt(df2), F.sqrt(1 - r * r))
    return out.withColumns({"df2": df2, "t": F.when((F.col("x") != F.col("y")) & (df2 > 0), t)})
