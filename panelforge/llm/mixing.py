"""Mixing of sources to target weights by Pfair scheduling.

A source's documents are put in a pseudo-random order and cut into blocks. With integer shares p out
of H = sum of the shares, the j-th block of a source is released at slot floor((j - 1) H / p) and due
by slot ceil(j H / p). In each slot the released block with the earliest deadline goes out. On one
line of slots that meets all deadlines (Baruah et al. 1996), so after any number of slots each source
is less than one block away from its target.

The schedule repeats every H slots, so one period is made on the driver and every block finds its
slot from its number. When a source runs out, the period is made anew for the sources left, with
their shares of what remains; no document is dropped and none repeats. The plan has at most one
period per source and is checked to stay below `PLAN_SLOTS`. Sources without a share of their own,
null among them, are one source with the share `other`.

Documents are numbered inside a source by ranges of a hash of their id: counts of (source, range)
give the rows before a range, a window numbers the rows inside it, so no task holds a source.

Nulls, ties and repeats: a null id has a place like any other; rows with equal ids are ordered by a
hash of all columns. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 32
PLAN_SLOTS = 1_000_000
_SEED = "mix"


def period(shares: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source's blocks in one period of sum(shares) slots."""
    total = sum(shares.values())
    slots: dict[str, list[int]] = {s: [] for s in shares}
    waiting = [(0, s) for s in sorted(shares)]  # by release
    ready: list[tuple[int, str]] = []  # by deadline
    heapq.heapify(waiting)
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            j = len(slots[s]) + 1
            heapq.heappush(ready, (-(-j * total // shares[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        j = len(slots[s])
        if j < shares[s]:
            heapq.heappush(waiting, (j * total // shares[s], s))
    return slots


def plan(shares: Mapping[str, int], blocks: Mapping[str, int]) -> dict[str, list[tuple]]:
    """Per source, its phases: first block, first slot of the phase, period and slots in it."""
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    out: dict[str, list[tuple]] = {s: [] for s in left}
    begin, made = 0, 0
    while left:
        own = {s: shares[s] for s in left}
        total = sum(own.values())
        made += total
        if made > PLAN_SLOTS:
            raise ValueError("the shares are too fine for this many sources")
        slots = period(own)
        last = {s: (n - 1) // own[s] * total + slots[s][(n - 1) % own[s]] for s, n in left.items()}
        end = min(last.values()) + 1
        for s in list(left):
            out[s].append((done[s], begin, total, slots[s]))
            used = end // total * own[s] + sum(t < end % total for t in slots[s])
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        begin += end
    return out


def positions(
    docs: DataFrame,
    shares: Mapping[str, int],
    doc_id: str = "doc_id",
    source: str = "source",
    other: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """All columns in `_row`, with `_source`, `_slot`, `_place` in the block and `_position`."""
    if any(int(p) != p or p < 1 for p in [*shares.values(), other]):
        raise ValueError("shares are whole numbers from 1 on")
    spark = docs.sparkSession
    rest = "\0other"
    all_shares = {**shares, rest: other}
    name = F.col(f"`{source}`").cast("string")
    listed = F.when(name.isin(list(shares)), name).otherwise(F.lit(rest)) if shares else F.lit(rest)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    turn = F.xxhash64(F.lit(_SEED), F.col(f"`{doc_id}`"))
    rows = docs.select(whole.alias("_row"), listed.alias("_source"), turn.alias("_turn"))
    # Cells are ranges of the hash, so the order does not depend on their number.
    cell = F.shiftright(F.shiftrightunsigned("_turn", 44) * parts, 20).cast("int")
    rows = rows.withColumn("_cell", cell)
    cells = rows.groupBy("_source", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    sizes = {r["_source"]: r["n"] for r in cells.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    phases = plan(all_shares, blocks)
    short = []
    for s, n in sizes.items():
        first, begin, total, slots = phases[s][-1]
        j = blocks[s] - 1 - first
        at = begin + j // len(slots) * total + slots[j % len(slots)]
        short.append((at, block * blocks[s] - n))
    table = spark.createDataFrame(
        [(s, p) for s, p in phases.items()],
        "_source string, _phases array<struct<first: bigint, begin: bigint, total: bigint, slots: array<int>>>",
    )
    earlier = F.sum("_n").over(W.partitionBy("_source").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    offsets = cells.select("_source", "_cell", F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = W.partitionBy("_source", "_cell").orderBy("_turn", F.xxhash64("_row"))
    numbered = rows.join(offsets, ["_source", "_cell"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(own) - 1
    )
    # The plan is bounded by PLAN_SLOTS numbers.
    found = numbered.join(F.broadcast(table), "_source")
    number = F.floor(F.col("_rank") / block)
    passed = F.size(F.filter("_phases", lambda p: p["first"] <= F.col("_block")))
    found = found.withColumn("_block", number).withColumn("_phase", F.element_at("_phases", passed))
    j = F.col("_block") - F.col("_phase.first")
    many = F.size("_phase.slots")
    slot = (
        F.col("_phase.begin")
        + F.floor(j / many) * F.col("_phase.total")
        + F.element_at("_phase.slots", (j % many + 1).cast("int"))
    )
    lacking = F.array(*[F.struct(F.lit(a).cast("bigint").alias("at"), F.lit(n).cast("bigint").alias("n")) for a, n in short])
    place = F.col("_rank") % block
    missed = (
        F.aggregate(
            F.filter(lacking, lambda x: x["at"] < F.col("_slot")),
            F.lit(0).cast("bigint"),
            lambda total, x: total + x["n"],
        )
        if short
        else F.lit(0)
    )
    return (
        found.withColumn("_slot", slot)
        .withColumn("_place", place)
        .withColumn("_position", F.col("_slot") * block + F.col("_place") - missed)
        .select("_row", "_source", "_slot", "_place", "_position")
    )


def mixed(
    docs: DataFrame,
    shares: Mapping[str, int],
    doc_id: str = "doc_id",
    source: str = "source",
    other: int = 1,
    block: int = BLOCK,
) -> DataFrame:
    """The documents, with their columns, in the order of the mix across and inside partitions."""
    placed = positions(docs, shares, doc_id, source, other, block)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "_position").sortWithinPartitions("_position")
    return ordered.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
