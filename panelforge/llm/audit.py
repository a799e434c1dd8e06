"""What each filter of a chain removes, in every order of the chain.

A row fails some of n filters. For a coalition of filters, its removals are the rows that fail at least
one of them; the 2^n coalitions are tabulated per part in one aggregate. Everything else follows from
that table:

* a filter that runs behind a set of others removes what the larger coalition removes more than the
  smaller one, so each step of each order is a difference of two cells;
* the Shapley value of a filter is the solution of least squares over the coalitions, weighted by the
  Shapley kernel, under the constraint that the values add up to all removals. The normal equations
  with their constraint are solved in rationals, once, since they do not depend on the data: what comes
  out is one exact whole-number weight per (filter, coalition) and a common divisor.

Only the narrow profile of a row (part, failed filters, flags) moves, and parts reach the shuffle
pre-aggregated. Copies of a text are found by its SHA-256: the smallest id per hash is an aggregate,
and originals are joined by (hash, id), so a text that a third of the rows share is no hot key.

Nulls, ties and repeats: a null text is empty; a null part is the empty string. A row with a null id is
no copy and makes no other row one. Rows that repeat under one id are each counted; equal texts under
one id are not copies of each other. A flag holds for an id if any of its label rows says so; null label
ids match nothing. An empty table has no parts and gives no rows. Very long texts are handled whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.graph import checkpointed

VISIBLE = r"[^\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """The failure conditions that look at the text alone."""
    words = F.regexp_extract_all(text, F.lit(VISIBLE), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def profiles(docs: DataFrame, filters: Mapping[str, Column], part: str) -> DataFrame:
    """`doc_id`, `part`, `mask` (bit i: fails filter i) and `digest` of the text; no text."""
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )


def flagged(rows: DataFrame, labels: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """The rows with one boolean per flag, false for ids without a label."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    said = known.agg(*[F.max(F.coalesce(c, F.lit(False))).alias(f) for f, c in flags.items()])
    joined = rows.join(said.filter(" or ".join(flags)), "doc_id", "left")
    return joined.withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def mask_counts(rows: DataFrame, flags: Sequence[str], copy_bit: int) -> DataFrame:
    """Rows per part, failed filters and flags, as `n`; `copy_bit` marks later copies of a text.

    All rows count without that bit and all but the originals with it, which needs only the originals'
    keys: a row is an original if it has the smallest id of its text or no id.
    """
    keys = ["part", "mask", *flags]
    each = rows.groupBy("digest", "doc_id", *keys).agg(F.count(F.lit(1)).alias("n"))
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    known = each.filter("doc_id is not null")
    originals = known.join(least.filter("doc_id is not null"), ["digest", "doc_id"], "left_semi").unionByName(
        each.filter("doc_id is null")
    )
    own = originals.groupBy(*keys).agg(F.sum("n").alias("own"))
    all_rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    both = all_rows.unionByName(own, allowMissingColumns=True).groupBy(*keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("own"), F.lit(0)).alias("own")
    )
    split = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")),
        F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("own")).alias("n")),
    )
    told = both.select("part", *flags, F.explode(split).alias("s"))
    return told.select("part", *flags, "s.mask", "s.n")


def _solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with matrix X = right, by elimination in rationals."""
    n = len(matrix)
    rows = [[*matrix[i], *right[i]] for i in range(n)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                rows[r] = [x - rows[r][i] * y for x, y in zip(rows[r], rows[i])]
    return [row[n:] for row in rows]


def shapley_weights(n: int) -> tuple[list[list[int]], int]:
    """Whole weights w and their divisor q: filter i has the value sum over S of w[i][S] v(S) / q.

    Minimises sum of k(S) (v(S) - sum of x_i over i in S)^2 over all coalitions S but the empty and the
    full one, with k(S) = (n - 1) / (C(n, s) s (n - s)), under sum of all x_i = v(full). The stationary
    point solves [A 1; 1' 0] [x; m] = [b; v(full)] with A = sum of k(S) 1_S 1_S' and b = sum of
    k(S) v(S) 1_S, so the solution for each unit vector v gives the weights of one coalition.
    """
    full = (1 << n) - 1
    kernel = {
        s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count()))
        for s in range(1, full)
    }
    has = lambda s, i: (s >> i) & 1
    gram = [
        [sum((k for s, k in kernel.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)]
        for i in range(n)
    ]
    matrix = [[*gram[i], Fraction(1)] for i in range(n)] + [[*[Fraction(1)] * n, Fraction(0)]]
    right = [[kernel.get(s, Fraction(0)) * has(s, i) for s in range(full + 1)] for i in range(n)]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    values = _solve(matrix, right)[:n]
    divisor = lcm(*[x.denominator for row in values for x in row])
    return [[int(x * divisor) for x in row] for row in values], divisor


def coalition_removals(counts: DataFrame, flags: Sequence[str], n: int) -> DataFrame:
    """Per part the arrays `v` and `v_<flag>`: rows that fail a filter of coalition S, at place S + 1;
    and `total`, all rows."""
    own = {"v": F.col("n"), **{f"v_{f}": F.when(F.col(f), F.col("n")).otherwise(0) for f in flags}}
    cell = lambda c, s: F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) != 0, c).otherwise(0))
    # Cells are sums over at most 2^n masks per part and task.
    return counts.groupBy("part").agg(
        F.sum("n").alias("total"),
        *[F.array(*[cell(c, s) for s in range(1 << n)]).alias(name) for name, c in own.items()],
    )


def steps(removals: DataFrame, letters: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the coalition table alone."""
    n = len(letters)
    full = (1 << n) - 1
    weights, divisor = shapley_weights(n)
    scale = Fraction(factorial(n), divisor)
    plan = []
    for order in permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for k, i in enumerate(order):
            plan.append((name, k + 1, i, before + 1, before + (1 << i) + 1))
            before += 1 << i
    steps_table = removals.sparkSession.createDataFrame(
        plan, "filter_order string, step int, filter int, below int, above int"
    )
    listed = steps_table.agg(
        F.collect_list(F.struct("filter_order", "step", "filter", "below", "above")).alias("s")
    )
    total_weight = lambda i: sum(
        (F.get("v", F.lit(s)) * w for s, w in enumerate(weights[i]) if w), F.lit(0).cast("bigint")
    )
    shares = F.array(
        *[
            (total_weight(i) * scale.numerator / scale.denominator).cast("bigint")
            if scale.denominator > 1
            else total_weight(i) * scale.numerator
            for i in range(n)
        ]
    )
    rows = removals.withColumn("shares", shares).withColumn("p", F.explode(listed.scalar()))
    at = lambda v, place: F.element_at(v, place)
    below, above, own = F.col("p.below"), F.col("p.above"), F.pow(F.lit(2), F.col("p.filter")).cast("int")
    removed = at("v", above) - at("v", below)
    return rows.select(
        "part",
        "p.filter_order",
        "p.step",
        (F.col("total") - at("v", above)).alias("kept"),
        removed.alias("removed"),
        (at("v", own + 1) - removed).alias("redundant"),
        (at("v", F.lit(full + 1)) - at("v", F.lit(full + 1) - own)).alias("unique_fails"),
        *[(at(f"v_{f}", above) - at(f"v_{f}", below)).alias(f"{f}_lost") for f in flags],
        F.get("shares", F.col("p.filter")).alias("shapley"),
    )


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Column],
    copies: str,
    flags: Mapping[str, Column],
    part: str = "lang",
) -> DataFrame:
    """Counts of every step of every order of the filters, per part.

    `filters` are conditions on the row's own columns by name; `copies` names one more filter that fails
    for every later copy of a text, over all rows. `shapley` is summed over all orders.
    """
    letters = [*filters, copies]
    found = checkpointed(flagged(profiles(docs, filters, part), labels, flags))
    counts = mask_counts(found, list(flags), 1 << len(filters))
    return steps(coalition_removals(counts, list(flags), len(letters)), letters, list(flags))
