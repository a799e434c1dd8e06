"""Cheapest repair of conversations, with every edit named, for conversations of any length.

A conversation should be an optional system turn and then user and assistant in turn, or nothing at
all. Each row is kept, given another role or deleted, and empty turns may be put in anywhere; blank
and repeated rows must go. The cheapest edits follow from four states (nothing yet, system, user,
assistant) and the costs of finishing from each, computed from the last row to the first. Of equally
cheap repairs the one whose edit initials (D, I, K, R) are ASCII-least is taken: walking forward, the first
initial that keeps the cost is right.

Viterbi by rank convergence, so that no task needs a whole conversation. Rows are placed by ranges of
(conversation, turn, ...) and packed to one byte a row, in chunks of at most `CHUNK` live rows. Every chunk
starts from a speculative cost vector, the one at the end of a conversation. Cost vectors that differ only by
a constant lead to the same edits, so a chunk keeps what it found per vector, up to a constant. A fix-up pass
gives each chunk the vectors that its right neighbour came out with; vectors it has seen are not run again,
and the passes end when none is new. Vectors have whole differences of at most a few units, so there are few
of them and few passes, also where parity keeps two of them apart for good. A walk over the chunk summaries then
stitches the true vectors backward and the states forward, and each chunk writes its edits.

Forced deletions change no vector but by a constant, so they do not count for the size of a chunk.

What a conversation's result holds as a whole is still one row: its audit, and the SHA-256 of the
repaired text, which is sequential by nature: one task streams the rows of a conversation, in order and
without keeping them.

Nulls, ties and repeats: null conversations are one conversation. A null role or text is one space, a
null turn sorts first. Rows of one turn are ordered by role and a hash of the text; rows equal in all
columns are a run that is one live row and deletions. A role that is empty or starts with another letter
than s, u and a can only be changed or deleted. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.graph import checkpointed

CHUNK = 4096
KEEP, CHANGE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 30
_INITIALS = {"s": 0, "u": 1, "a": 2}
# The state after keeping a row of that initial, by state before; -1 where it may not stand.
_KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
_NEXT = (USER, USER, ASSISTANT, USER)  # the state after a made-up or changed turn
_LEGAL = {(0, 1), (1, 2), (2, 1)}
_BLANKS = " \t\n\x0b\x0c\r"
_ORDER = ("no_conv", "conv", "has_turn", "at", "role", "digest")


# --- rows -------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that a hash of (conversation, turn) decides, with `copies`: 0 for a row
    that is dropped, 2 for one that is repeated."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(space("text"), "[.!?]", ""))
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.when(fate == 4, "user").otherwise(space("role")).alias("role"),
        text.otherwise(space("text")).alias("text"),
        F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("bigint").alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """The rows with keys that are never null, in their order (`_ORDER`)."""
    return rows.withColumns(
        {
            "no_conv": F.col("conv_id").isNull(),
            "conv": F.coalesce("conv_id", F.lit(0)),
            "has_turn": F.col("turn").isNotNull(),
            "at": F.coalesce("turn", F.lit(0)),
            "digest": F.unhex(F.md5(F.col("text").cast("binary"))),
        }
    )


def slim(rows: DataFrame) -> DataFrame:
    """One row per distinct row: its keys, `copies`, `kind` (initial of the role plus 4 if truncated)
    or null if every copy is blank, and `first`: not a repeat of an earlier row of the conversation."""
    last = F.substring(F.rtrim("text", F.lit(_BLANKS)), -1, 1)
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(last != "", number + F.when(last.isin(".", "!", "?"), 0).otherwise(4))
    narrow = _keyed(rows).select(*_ORDER, "copies", kind.cast("int").alias("kind"))
    each = narrow.groupBy(*_ORDER).agg(F.sum("copies").alias("copies"), F.max("kind").alias("kind"))
    same = ["no_conv", "conv", "role", "digest"]
    turn = F.struct("has_turn", "at")
    least = each.filter("copies > 0").groupBy(*same).agg(F.min(turn).alias("t"))
    least = least.select(*same, "t.has_turn", "t.at", F.lit(True).alias("first"))
    joined = each.join(least, list(_ORDER), "left")
    return joined.withColumn("first", F.coalesce("first", F.lit(False)))


# --- chunks -----------------------------------------------------------------------------------

_CHUNKS = (
    "no_conv boolean, conv bigint, ord bigint, codes binary, counts binary, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, head int, tail int"
)


def _pack(chunk: int):
    """Consecutive rows as chunk rows. A code is an initial (0 to 3) in a conversation's live row, plus 4
    if truncated, or 8 for a run of `count` forced deletions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, codes, counts = [], bytearray(), []
        now, number, live, part = None, 0, 0, 0
        blank = duplicate = truncated = illegal = 0
        head = tail = None

        def close():
            nonlocal codes, counts, number, live, blank, duplicate, truncated, illegal, head, tail
            raw = np.array(counts, dtype="<i8").tobytes()
            place = (part << 40) + number
            out.append(
                (*now, place, bytes(codes), raw, blank, duplicate, truncated, illegal, head, tail)
            )
            number += 1
            codes, counts, live = bytearray(), [], 0
            blank = duplicate = truncated = illegal = 0
            head = tail = None

        def batch_of():
            types = [pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
            types += [pa.int32()] * 2
            names = [f.split()[0] for f in _CHUNKS.split(", ")]
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for no_conv, conv, role, copies, kind, first, part_ in zip(*[c.to_pylist() for c in batch.columns]):
                part = part_
                if now is not None and now != (no_conv, conv):
                    close()
                    if len(out) >= 4096:
                        yield batch_of()
                elif live >= chunk:
                    close()
                now = (no_conv, conv)
                if not copies:
                    continue
                initial = _INITIALS.get(role[:1], 3)
                if head is None:
                    head = initial
                elif (tail, initial) not in _LEGAL:
                    illegal += 1
                illegal += copies - 1
                tail = initial
                gone = copies
                if kind is None:
                    blank += copies
                else:
                    if first:
                        codes.append(kind)
                        counts.append(1)
                        live += 1
                        truncated += kind >> 2
                        gone -= 1
                    duplicate += gone
                if gone:
                    if codes and codes[-1] == 8:
                        counts[-1] += gone
                    else:
                        codes.append(8)
                        counts.append(gone)
        if now is not None:
            close()
        if out:
            yield batch_of()

    return run


def chunks(rows: DataFrame, chunk: int = CHUNK, parts: int | None = None) -> DataFrame:
    """The packed rows (`_CHUNKS`), in order of `ord` within a conversation.

    The ranges of keys cut conversations anywhere; the frame must be kept before it is used twice.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c) for c in _ORDER]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    wanted = placed.select("no_conv", "conv", "role", "copies", "kind", "first", F.spark_partition_id())
    return wanted.mapInArrow(_pack(chunk), _CHUNKS)


# --- costs ------------------------------------------------------------------------------------


def _closed(direct: list[int]) -> tuple[int, ...]:
    """Costs with turns put in first where that is cheaper."""
    best = list(direct)
    for state in (USER, ASSISTANT):
        best[state] = min(best[state], INSERT + direct[_NEXT[state]])
    for state in (START, SYSTEM):
        best[state] = min(best[state], INSERT + best[USER])
    return tuple(best)


FINAL = _closed([0, _NEVER, _NEVER, 0])  # at the end of a conversation


@lru_cache(maxsize=65536)
def _step(after: tuple[int, ...], code: int) -> tuple[tuple[int, ...], int]:
    """Costs before a live row from those after it: their differences to the least, and the least."""
    initial, cut = code & 3, CUT if code & 4 else 0
    direct = []
    for state in range(4):
        options = [DELETE + after[state], CHANGE + cut + after[_NEXT[state]]]
        kept = _KEPT[state][initial]
        if kept >= 0:
            options.append(KEEP + cut + after[kept])
        direct.append(min(options))
    best = _closed(direct)
    low = min(best)
    return tuple(x - low for x in best), low


def _backward(codes: bytes, after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Cost vectors, up to a constant each, before every code and, last, behind all."""
    out = [after] * (len(codes) + 1)
    vector = after
    for i in range(len(codes) - 1, -1, -1):
        if codes[i] != 8:
            vector = _step(vector, codes[i])[0]
        out[i] = vector
    return out


@lru_cache(maxsize=65536)
def _choice(after: tuple[int, ...], code: int, state: int) -> tuple[str, int, int]:
    """Edits from a state up to and including a live row, the state behind it, and their cost: the
    ASCII-least of the cheapest, by the costs after the row."""
    initial, cut = code & 3, CUT if code & 4 else 0
    direct = []
    for s in range(4):
        options = [(DELETE + after[s], "D", s, DELETE)]
        kept = _KEPT[s][initial]
        if kept >= 0:
            options.append((KEEP + cut + after[kept], "K", kept, KEEP + cut))
        options.append((CHANGE + cut + after[_NEXT[s]], "R", _NEXT[s], CHANGE + cut))
        low = min(o[0] for o in options)
        direct.append(next(o for o in options if o[0] == low))  # D before K before R
    best = _closed([d[0] for d in direct])
    audit, cost = "", 0
    while True:
        total, initial_, behind, own = direct[state]
        # D sorts before I, and I before K and R.
        inserted = INSERT + best[_NEXT[state]] == best[state]
        if total == best[state] and (initial_ == "D" or not inserted):
            return audit + initial_, behind, cost + own
        audit, cost, state = audit + "I", cost + INSERT, _NEXT[state]


def trace(codes: bytes, counts: np.ndarray, after: tuple[int, ...], state: int, end: bool) -> tuple[str, int, int]:
    """Edits of a chunk entered in a state, the state behind it, and their cost."""
    vectors = _backward(codes, after)
    out, cost = [], 0
    for i, code in enumerate(codes):
        if code == 8:
            out.append("D" * int(counts[i]))
            cost += DELETE * int(counts[i])
            continue
        audit, state, own = _choice(vectors[i + 1], code, state)
        out.append(audit)
        cost += own
    if end:
        while state not in (START, ASSISTANT):
            out.append("I")
            cost += INSERT
            state = _NEXT[state]
    return "".join(out), state, cost


def _text(vector: tuple[int, ...]) -> str:
    return ",".join(map(str, vector))


def _vector(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split(",")))


_RUNS = "no_conv boolean, conv bigint, ord bigint, came string, went string, leaves array<int>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk from the vector it is given: the vector before it and, per state it may be entered in,
    the state behind it."""
    for batch in batches:
        no_conv, conv, ord_, codes, came = batch.columns
        went, leaves = [], []
        for raw, text in zip(codes.to_pylist(), came.to_pylist()):
            after = _vector(text)
            vectors = _backward(raw, after)
            low = min(vectors[0])
            went.append(_text(tuple(x - low for x in vectors[0])))
            states = list(range(4))
            for i, code in enumerate(raw):
                if code != 8:
                    states = [_choice(vectors[i + 1], code, s)[1] for s in states]
            leaves.append(states)
        yield pa.RecordBatch.from_arrays(
            [no_conv, conv, ord_, came, pa.array(went, pa.string()), pa.array(leaves, pa.list_(pa.int32()))],
            [f.split()[0] for f in _RUNS.split(", ")],
        )


_KEY = ["no_conv", "conv", "ord"]


def _fixed_up(many: DataFrame) -> DataFrame:
    """All runs of the chunks that the true vectors of their conversations need (`_RUNS`)."""
    wanted = many.select(*_KEY, "codes", F.lit(_text(FINAL)).alias("came"))
    runs = checkpointed(wanted.mapInArrow(_run, _RUNS))
    links = many.filter("follows is not null").select(*_KEY, "codes", "follows")
    fresh = runs
    while True:
        given = fresh.select("no_conv", "conv", F.col("ord").alias("follows"), F.col("went").alias("came"))
        asked = links.join(given.distinct(), ["no_conv", "conv", "follows"])
        new = asked.join(runs.select(*_KEY, "came"), [*_KEY, "came"], "left_anti")
        fresh = checkpointed(new.select(*_KEY, "codes", "came").mapInArrow(_run, _RUNS))
        if fresh.isEmpty():
            return runs
        runs = checkpointed(runs.unionByName(fresh))


def _stitch(table: pa.Table) -> pa.Table:
    """The true vector and the entry state of every chunk of a conversation, from its runs."""
    known: dict[int, dict[str, tuple[str, list[int]]]] = {}
    for ord_, came, went, leaves in zip(*[table.column(c).to_pylist() for c in ("ord", "came", "went", "leaves")]):
        known.setdefault(ord_, {})[came] = (went, leaves)
    places = sorted(known)
    vector, came = _text(FINAL), {}
    for ord_ in reversed(places):
        came[ord_] = vector
        vector = known[ord_][vector][0]
    state, entered = START, []
    for ord_ in places:
        entered.append(state)
        state = known[ord_][came[ord_]][1][state]
    n = len(places)
    return pa.table(
        {
            "no_conv": pa.array([table.column("no_conv")[0].as_py()] * n, pa.bool_()),
            "conv": pa.array([table.column("conv")[0].as_py()] * n, pa.int64()),
            "ord": pa.array(places, pa.int64()),
            "came": pa.array([came[p] for p in places], pa.string()),
            "state": pa.array(entered, pa.int32()),
        }
    )


_EDITS = (
    "no_conv boolean, conv bigint, ord bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, audit string, cost bigint"
)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns) if n in _EDIT_INPUT}
        audits, costs = [], []
        for codes, counts, came, state, end in zip(*[col[c] for c in _EDIT_INPUT]):
            audit, _, cost = trace(codes, np.frombuffer(counts, "<i8"), _vector(came), state, end)
            audits.append(audit)
            costs.append(cost)
        kept = [batch.column(i) for i in range(7)]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(audits, pa.string()), pa.array(costs, pa.int64())],
            [f.split()[0] for f in _EDITS.split(", ")],
        )


_EDIT_INPUT = ("codes", "counts", "came", "state", "end")


def audited(packed: DataFrame) -> DataFrame:
    """Per conversation its counts, cost and audit, from its kept chunks."""
    along = W.partitionBy("no_conv", "conv").orderBy("ord")
    earlier = F.last("tail", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    # Only the chunk's own few numbers pass through the window; codes are joined again.
    small = packed.select(*_KEY, "head", "tail").withColumns(
        {"follows": F.lead("ord").over(along), "before": F.lag("ord").over(along), "earlier": earlier}
    )
    legal = [(F.col("earlier") == x) & (F.col("head") == y) for x, y in _LEGAL]
    met = F.col("earlier").isNotNull() & F.col("head").isNotNull()
    border = F.when(met & ~(legal[0] | legal[1] | legal[2]), 1).otherwise(0)
    linked = checkpointed(
        packed.join(small.select(*_KEY, "follows", "before", border.alias("border")), _KEY)
    )
    single = F.col("follows").isNull() & F.col("before").isNull()
    many = linked.filter(~single)
    alone = linked.filter(single).withColumns({"came": F.lit(_text(FINAL)), "state": F.lit(START)})
    runs = _fixed_up(many)
    stitched = runs.groupBy("no_conv", "conv").applyInArrow(
        _stitch, "no_conv boolean, conv bigint, ord bigint, came string, state int"
    )
    known = alone.unionByName(many.join(stitched, _KEY))
    edits = known.select(
        *_KEY, "blank", "duplicate", "truncated", (F.col("illegal") + F.col("border")).alias("illegal"),
        "codes", "counts", "came", "state", F.col("follows").isNull().alias("end"),
    ).mapInArrow(_edits, _EDITS)
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    # An audit is one value of the result; its parts are put in order here.
    parts = F.sort_array(F.collect_list(F.struct("ord", "audit")))
    return edits.groupBy("no_conv", "conv").agg(
        *sums, F.concat_ws("", F.transform(parts, lambda p: p["audit"])).alias("audit")
    )


# --- repaired texts ---------------------------------------------------------------------------


class _Mender:
    """The repaired turns of one conversation, row by row."""

    def __init__(self, audit: str):
        self._audit, self._at, self._last = audit, 0, ""

    def _turn(self, role: str, text: str) -> tuple[str, str]:
        self._last = role[:1]
        return role, text

    def _made(self) -> str:
        return "assistant" if self._last == "u" else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self._at < len(self._audit) and self._audit[self._at] == "I":
            self._at += 1
            yield self._turn(self._made(), "")

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self._audit[self._at]
        self._at += 1
        if edit != "D":
            yield self._turn(role if edit == "K" else self._made(), text)


_RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(its own row, None) when a conversation starts, (its own row, turn) for each repaired turn."""
    head, work = None, None
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[0]:
                if work is not None:
                    for turn in work.inserted():
                        yield head, turn
                head, work = row[1:9], _Mender(row[8])
                yield head, None
            else:
                for _ in range(row[11]):
                    for turn in work.row(row[9], row[10]):
                        yield head, turn
    if work is not None:
        for turn in work.inserted():
            yield head, turn


def _batches(rows: Iterator[tuple], schema: str, types: list) -> Iterator[pa.RecordBatch]:
    names, out, held = [f.split()[0] for f in schema.split(", ")], [], 0
    for row in rows:
        out.append(row)
        held += len(row[-1] or "")
        if len(out) >= 2048 or held > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows from conversations in order, each with its own row of counts first."""

    def rows():
        own, sha, begun = None, None, False
        for head, turn in _streamed(batches):
            if turn is None:
                if own is not None:
                    yield (*own, sha.hexdigest())
                own, sha, begun = head, hashlib.sha256(), False
            else:
                sha.update((("\n" if begun else "") + f"{turn[0]}:{turn[1]}").encode())
                begun = True
        if own is not None:
            yield (*own, sha.hexdigest())

    yield from _batches(rows(), _RESULT, [*[pa.int64()] * 7, pa.string(), pa.string()])


_TURNS = "conv_id bigint, position bigint, role string, text string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        n = 0
        for head, turn in _streamed(batches):
            n = 0 if turn is None else n + 1
            if turn is not None:
                yield head[0], n, *turn

    yield from _batches(rows(), _TURNS, [pa.int64(), pa.int64(), pa.string(), pa.string()])


def gaps(rows: DataFrame) -> DataFrame:
    """Turns missing between the first and the last one of each conversation."""
    seen = rows.filter("copies > 0 and has_turn").select("no_conv", "conv", "at").distinct()
    span = F.max("at") - F.min("at") + 1 - F.count(F.lit(1))
    return seen.groupBy("no_conv", "conv").agg(span.alias("gaps"))


def _with_audits(rows: DataFrame, chunk: int) -> DataFrame:
    """The present rows of each conversation in order, behind one row of its counts and edits."""
    narrow = checkpointed(slim(rows))
    packed = checkpointed(chunks(narrow, chunk))
    key = ["no_conv", "conv"]
    found = audited(packed).join(gaps(narrow), key, "left")
    own = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    heads = found.select(
        F.lit(True).alias("is_head"),
        *key,
        F.when(~F.col("no_conv"), F.col("conv")).alias("conv_id"),
        F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"),
        *own,
    )
    texts = _keyed(rows.filter("copies > 0")).select(F.lit(False).alias("is_head"), *_ORDER, "text", "copies")
    both = heads.unionByName(texts, allowMissingColumns=True)
    placed = both.repartition(*key).sortWithinPartitions(
        *key, F.desc("is_head"), *[F.col(c) for c in _ORDER[2:]]
    )
    return placed.select("is_head", "conv_id", "gaps", *own, "role", "text", "copies")


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Counts, cost, edits and hash of the repaired text (`_RESULT`) per conversation of the rows.

    `rows` has `conv_id`, `turn`, `role`, `text` and `copies`, as `damaged` gives them.
    """
    return _with_audits(rows, chunk).mapInArrow(_hashes, _RESULT)


def repaired(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired turns themselves (`_TURNS`)."""
    return _with_audits(rows, chunk).mapInArrow(_turns, _TURNS)
