"""Tail probabilities as SQL expressions, for the oracles.

They use other methods than the Python helpers (finite sums and plain trapezoid sums), so an
agreement of both is evidence for both.
"""

from __future__ import annotations


def t_two_sided(t: str, df: str) -> str:
    """Finite trigonometric sums for whole degrees of freedom."""
    c2 = f"({df} / (CAST({df} AS DOUBLE) + {t} * {t}))"
    sine = f"(abs({t}) / sqrt({df} + {t} * {t}))"
    even = (
        f"{sine} * list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda j: "
        f"exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1) + j * ln({c2}))))"
    )
    odd = (
        f"2 / pi() * (atan(abs({t}) / sqrt({df})) + {sine} * sqrt({c2}) * sqrt(pi()) / 2 * "
        f"coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda j: "
        f"exp(lgamma(j + 1) - lgamma(j + 1.5) + j * ln({c2})))), 0))"
    )
    return f"(CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END)"


def f_upper_4(f: str, df2: str) -> str:
    """Upper tail of F with 4 and df2 degrees of freedom."""
    x = f"({df2} / (CAST({df2} AS DOUBLE) + 4 * {f}))"
    a = f"({df2} / CAST(2 AS DOUBLE))"
    return f"(power({x}, {a}) * (1 + {a} * (1 - {x})))"


def phi(x: str) -> str:
    """Normal distribution function by its power series."""
    series = (
        f"list_sum(list_transform(range(0, 160), lambda i: sign({x}) * exp((2 * i + 1) * "
        f"ln(greatest(abs({x}), 1e-300)) - {x} * {x} / 2 - 0.5 * ln(2 * pi()) "
        f"- (lgamma(i + 1.5) - lgamma(1.5) + i * ln(2)))))"
    )
    return f"(CASE WHEN {x} > 8 THEN 1 WHEN {x} < -8 THEN 0 ELSE 0.5 + {series} END)"


def scale_grid(df: str) -> str:
    """Trapezoid nodes s = sqrt(chi2 / df) with weights ws, for a df column of the outer row."""
    step = f"(0.5 / sqrt(2 * {df}))"
    s = f"(1 + (g - 18) * {step})"
    return (
        f"SELECT {s} AS s, {step} * exp(ln(2) + {df} / 2.0 * ln({df} / 2.0) "
        f"- lgamma({df} / 2.0) + ({df} - 1) * ln({s}) - {df} * {s} * {s} / 2) AS ws "
        f"FROM range(0, 37) AS r(g) WHERE {s} > 0"
    )


# Trapezoid nodes z with normal weights wz.
NORMAL_GRID = (
    "SELECT (g - 20) * CAST(0.4 AS DOUBLE) AS z, "
    "0.4 * exp(-(g - 20) * (g - 20) * CAST(0.08 AS DOUBLE)) / sqrt(2 * pi()) AS wz "
    "FROM range(0, 41) AS r(g)"
)


def nodes(source: str, df: str) -> str:
    """Every row of `source` at every node."""
    return (
        f"(SELECT * FROM {source} AS src CROSS JOIN LATERAL ({scale_grid(df)}) AS sg "
        f"CROSS JOIN ({NORMAL_GRID}) AS ng)"
    )


def range_tail(source: str, q: str, k: str, df: str, keys: str) -> str:
    """Upper tail of the studentized range of k means per key, as a table (keys, tail)."""
    return (
        f"(SELECT {keys}, 1 - sum(ws * wz * {k} * power({phi('z')} - {phi('shifted')}, {k} - 1)) "
        f"AS tail FROM (SELECT *, z - {q} * s AS shifted FROM {nodes(source, df)} AS n) AS m "
        f"GROUP BY {keys})"
    )


def dunnett_tail(source: str, t: str, df: str, load: str, keys: str) -> str:
    """P(max |T| > |t|) per key; `source` has one row per key and comparison with its loading."""
    rest = f"sqrt(1 - {load} * {load})"
    return (
        f"(SELECT {keys}, 1 - sum(ws * wz * inside) AS tail "
        f"FROM (SELECT {keys}, s, z, ws, wz, product({phi('up')} - {phi('down')}) AS inside "
        f"FROM (SELECT *, ({load} * z + abs({t}) * s) / {rest} AS up, "
        f"({load} * z - abs({t}) * s) / {rest} AS down FROM {nodes(source, df)} AS n) AS m "
        f"GROUP BY {keys}, s, z, ws, wz) AS w GROUP BY {keys})"
    )
