"""Near-duplicate documents by weighted MinHash of their word shingles.

A document is the multiset of its five-word shingles (lower-case words of letters and digits; a
document of one to four words is one shingle). Signatures follow BagMinHash (Ertl 2018): a shingle
of weight w takes part in Poisson processes over the weight axis, and register i keeps the earliest
point at a weight level below w, so two registers agree with the probability of the weighted
Jaccard similarity.

* The axis is cut into the dyadic layers [0,1), [1,2), [2,4), [4,8), ...; each layer of a shingle
  has one process for all registers, whose points carry a register and a level inside the layer.
  A weight touches only log2(w) + 1 layers, and points above the weight are passed over.
* Points come in the order of time and are drawn only up to a time by which all registers are
  filled almost surely, (ln registers + 4) / total weight; the few documents with an empty register
  draw again up to twice the time. The work is one draw per shingle and layer plus a fixed number
  of points per document.

Documents with equal multisets are one node. Nodes meet in 32 bands of 4 registers (a pair of
similarity 0.8 misses all of them once in 20 million). In each bucket, every node is compared with
the bucket's smallest node. Buckets that still hold several classes are then compared across the
classes, first each node's four nearest signatures, then all pairs left. A pair is passed over if its
signatures agree in less than 60 % (a pair of similarity 0.8 does so once in 13 million) or if what each
side alone has, among all nodes of such buckets, bounds the similarity below the threshold; the
bound leaves few pairs in classes of thousands of copies that differ in a few words each, and nodes that
it parts from every other one are not sent at all. All links are verified by the exact overlap of
multisets (by 32-bit hashes).

Texts are never shuffled: the shingles of the documents that a round needs are taken from a scan,
prefiltered by a bitmap of fixed size over the hashes of their ids. Groups of pairs and buckets are
cut into chunks, so no task holds a whole class. Nothing but that bitmap reaches the driver.

Nulls, ties and repeats: a document without words is a class of its own, as is one with a null id
(`class_id` null). Rows that share an id are one document, which is similar to what any of their
texts is similar to; a row that occurs several times counts once. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.graph import Kept, checkpointed, components
from panelforge.llm.textscan import ALNUM, LOWER, Grams, mix, release_memory, scan, slices

SHINGLE = 5
REGISTERS = 128
BANDS = 32
SIMILARITY = 0.8
NEAR = 0.60  # share of equal registers from which a pair is verified
CHUNK = 512
BUCKET_CHUNK = 2048  # rows of a bucket that are compared at once, half a kilobyte each
BITMAP_WORDS = 1 << 17  # 64-bit words; 1 MB
_STEP, _SPOT, _LAYER, _TWIN = (
    np.uint64(x)
    for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
)


def shingles(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: row number, 64-bit hash and count, sorted by row and hash."""
    words = scan(text, ALNUM, LOWER)
    counts = words.counts
    grams = Grams(words.hashes())
    row = words.row_of_word()
    n = max(0, len(row) - size + 1)
    whole = row[:n] == row[size - 1 :] if n else np.zeros(0, dtype=bool)
    short = np.flatnonzero((counts > 0) & (counts < size))
    x = np.concatenate([grams.of(size)[whole], grams.runs(words.first[short], words.first[short + 1])])
    rows = np.concatenate([row[:n][whole], short])
    order = np.lexsort((x, rows))
    x, rows = x[order], rows[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], x[at], np.diff(np.append(at, len(x)))


def signatures(rows: np.ndarray, x: np.ndarray, weight: np.ndarray, n_rows: int, m: int = REGISTERS):
    """`n_rows` by `m` registers (times as doubles); rows without elements stay infinite."""
    sig = np.full((n_rows, m), np.inf)
    total = np.bincount(rows, weights=weight, minlength=n_rows)
    todo, reach = total > 0, np.log(m) + 4
    while todo.any():
        pick = todo[rows]
        _draw(sig, rows[pick], x[pick], weight[pick], reach / np.maximum(total, 1), m)
        todo &= np.isinf(sig).any(axis=1)
        reach *= 2
    return sig


def _draw(sig, rows, x, weight, until, m):
    flat = sig.reshape(-1)
    low, layer = 0, 0
    while True:
        pick = weight > low
        if not pick.any():
            return
        width = max(1, low)
        own, w, end = rows[pick], weight[pick], until[rows[pick]]
        state = mix(x[pick] ^ (_LAYER * np.array([layer + 1], dtype=np.uint64)))
        time = np.zeros(len(own))
        while len(own):
            state = mix(state + _STEP)
            time = time - np.log(((state >> np.uint64(11)) + 0.5) * 2.0**-53) / (m * width)
            near = time <= end
            own, w, end, state, time = own[near], w[near], end[near], state[near], time[near]
            spot = mix(state ^ _SPOT)
            level = low + ((spot >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
            seen = level < w
            at = own[seen] * m + (spot[seen] % np.uint64(m)).astype(np.int64)
            np.minimum.at(flat, at, time[seen])
        low, layer = (1 if low == 0 else 2 * low), layer + 1


def _sums(rows: np.ndarray, x: np.ndarray, weight: np.ndarray, n_rows: int) -> list[np.ndarray]:
    """Two 64-bit hashes of each row's multiset."""
    body = mix(x ^ (_STEP * weight.astype(np.uint64)))
    sums = []
    for salt in (_SPOT, _TWIN):
        total = np.zeros(n_rows, dtype=np.uint64)
        np.add.at(total, rows, mix(body ^ salt))
        sums.append(total.view(np.int64))
    return sums


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            n = part.num_rows
            rows, x, weight = shingles(part.column(1))
            sig = mix(signatures(rows, x, weight, n).view(np.uint64)) >> np.uint64(32)
            sums = _sums(rows, x, weight, n)
            size = np.bincount(rows, weights=weight, minlength=n).astype(np.int64)
            raw = np.ascontiguousarray(sig.astype(np.uint32)).tobytes()
            width = 4 * REGISTERS
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sums[0]),
                    pa.array(sums[1]),
                    pa.array(size),
                    pa.array([raw[i * width : (i + 1) * width] for i in range(n)], pa.binary()),
                ],
                ["doc_id", "h1", "h2", "n", "sig"],
            )
    release_memory()


def _bit(column: str):
    """Place of an id in the bitmap: word and bit."""
    h = F.xxhash64(column)
    word = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")
    return word, h.bitwiseAND(F.lit(63)).cast("int")


def _blobs(rows: DataFrame, ids: DataFrame, hashed: bool = False) -> DataFrame:
    """Sorted hashes of (shingle, occurrence) of the documents among the ids, 4 bytes each.

    One blob per row, with the hashes `h1` and `h2` of its multiset if `hashed`.

    The bitmap only spares work; other documents that pass it fall out in the join that follows.
    """
    word, bit = _bit("doc_id")
    marks = ids.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")
    )
    bitmap = np.zeros(BITMAP_WORDS, dtype=np.int64)
    found = marks.toArrow()  # at most BITMAP_WORDS rows
    bitmap[found.column("w").to_numpy()] = found.column("bits").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            wanted = (bitmap[w] >> b) & 1
            some = batch.filter(pa.array(wanted.astype(bool)))
            for part in slices(some, "text"):
                rows_, x, weight = shingles(part.column(1))
                own = np.repeat(rows_, weight)
                nth = np.arange(len(own)) - np.repeat(np.cumsum(weight) - weight, weight)
                h = (mix(np.repeat(x, weight) ^ (_TWIN * nth.astype(np.uint64))) >> np.uint64(32)).astype(
                    np.uint32
                )
                h = h[np.lexsort((h, own))]
                cut = np.searchsorted(own, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([h[a:z].tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()),
                        *([pa.array(t) for t in _sums(rows_, x, weight, part.num_rows)] if hashed else []),
                    ],
                    ["doc_id", "blob", *(["h1", "h2"] if hashed else [])],
                )
        release_memory()

    source = rows.select("doc_id", "text", word.alias("w"), bit.alias("b"))
    return source.mapInArrow(run, "doc_id bigint, blob binary" + (", h1 bigint, h2 bigint" if hashed else ""))


def _overlaps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Similarity of the group's head to each other member of the chunk."""
    head_rows = pdf[pdf["doc_id"] == pdf["a"]]
    out = []
    for blob in head_rows["blob"].drop_duplicates():
        head = np.frombuffer(blob, dtype=np.uint32)
        for a, b, other in zip(pdf["a"], pdf["doc_id"], pdf["blob"]):
            if a == b:
                continue
            own = np.frombuffer(other, dtype=np.uint32)
            at = np.searchsorted(head, own)
            same = int((head[np.minimum(at, len(head) - 1)] == own).sum()) if len(head) else 0
            out.append((a, b, same / max(1, len(head) + len(own) - same)))
    return pd.DataFrame(out, columns=["a", "b", "similarity"])


def verified(rows: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (`a`, `b`) whose multisets overlap enough, with their similarity."""
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = pairs.join(many, "a").withColumn(
        "chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / CHUNK)).cast("int")
    )
    heads = many.select(
        "a", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / CHUNK).cast("int") - 1)).alias("chunk")
    )
    wanted = dealt.select("a", "chunk", F.col("b").alias("doc_id")).unionByName(
        heads.select("a", "chunk", F.col("a").alias("doc_id"))
    )
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    held = wanted.join(_blobs(rows, ids), "doc_id")
    done = held.groupBy("a", "chunk").applyInPandas(_overlaps, "a bigint, b bigint, similarity double")
    return done.filter(F.col("similarity") >= similarity)


def _private(rows: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """`h1`, `own`: how much of a node's multiset no other multiset of the members' nodes has.

    Each multiset counts once, however many rows have it: of the rows under a node's id, one with the
    node's own text is taken. An id with two texts can be a node twice, so the hash tells them apart.
    """
    own = ["doc_id", "h1", "h2"]
    ids = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        F.col("node").alias("doc_id"), "h1", "h2"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [len(b) // 4 for b in batch.column(1).to_pylist()]
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), cut)), pa.array(flat)], ["h1", "x"]
            )

    once = _blobs(rows, ids, hashed=True).join(ids, own).dropDuplicates(own)
    held = once.select("h1", "blob").mapInArrow(run, "h1 bigint, x int")
    single = held.groupBy("x").agg(
        F.min("h1").alias("h1"), F.max("h1").alias("last"), F.count(F.lit(1)).alias("m")
    )
    return single.filter("h1 = last").groupBy("h1").agg(F.sum("m").alias("own"))


def _across(near: float, similarity: float, most: int | None):
    each = REGISTERS // BANDS

    def run(table: pa.Table) -> pa.Table:
        """Pairs of different classes that may be similar enough, each from its first shared band."""
        col = {c: table.column(c).to_numpy() for c in ("chunk", "node", "root", "n", "own", "band")}
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32)
        sig = sig.reshape(-1, REGISTERS)
        band = int(col["band"][0])
        left, right = np.flatnonzero(col["chunk"] == lo), np.flatnonzero(col["chunk"] == hi)
        size, shared = col["n"].astype(float), (col["n"] - col["own"]).astype(float)
        a, b, share = [], [], []
        for k in range(0, len(left), 32):
            some = left[k : k + 32]
            # What one side alone has cannot overlap, which bounds the similarity from above.
            most_same = np.minimum(shared[some][:, None], shared[right][None])
            bound = most_same / (size[some][:, None] + size[right][None] - most_same)
            i, j = np.nonzero((bound >= similarity) & (col["root"][some][:, None] != col["root"][right][None]))
            i, j = some[i], right[j]
            if lo == hi:
                i, j = i[col["node"][i] < col["node"][j]], j[col["node"][i] < col["node"][j]]
            for c in range(0, len(i), 8192):
                x, y = i[c : c + 8192], j[c : c + 8192]
                same = sig[x] == sig[y]
                near_enough = same.mean(axis=1) >= near
                x, y, same = x[near_enough], y[near_enough], same[near_enough]
                mine = same.reshape(-1, BANDS, each).all(axis=2).argmax(axis=1) == band
                a.append(x[mine])
                b.append(y[mine])
                share.append(same[mine].mean(axis=1))
        a = np.concatenate(a) if a else np.zeros(0, dtype=np.int64)
        b = np.concatenate(b) if b else a
        if most is not None and len(a):
            share = np.concatenate(share)
            both, other = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
            order = np.lexsort((-share[other], both))
            heads = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1]))
            nth = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
            kept = np.unique(other[order][nth < most])
            a, b = a[kept], b[kept]
        x, y = col["node"][a], col["node"][b]
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold several classes, with class and bucket size."""
    own = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = own.groupBy("key").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("m")
    )
    return own.join(mixed.filter("r0 <> r1").select("key", "m"), "key")


def _cross_pairs(mixed: DataFrame, nodes: DataFrame, private: DataFrame, similarity, most) -> DataFrame:
    """Pairs (`a`, `b`) across the classes of a bucket; `most` keeps each node's nearest ones."""
    cuts = F.ceil(F.col("m") / BUCKET_CHUNK).cast("int")
    known = nodes.join(private, "h1", "left").select(
        "node", "sig", "n", F.coalesce("own", F.lit(0)).alias("own")
    )
    # A node of which too much is in no other one is similar to none of them.
    rows = mixed.join(known.filter((F.col("n") - F.col("own")) / F.col("n") >= similarity), "node")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), cuts - 1)))
    rows = rows.select(
        "key",
        "band",
        F.least("chunk", "other").alias("lo"),
        F.greatest("chunk", "other").alias("hi"),
        "chunk",
        "node",
        "root",
        "n",
        "own",
        "sig",
    )
    found = rows.groupBy("key", "lo", "hi").applyInArrow(
        _across(NEAR, similarity, most), "a bigint, b bigint"
    )
    return found.distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """Per row: `doc_id` and `class_id`, the smallest id of its class of near-duplicates."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    known = rows.filter("doc_id is not null")
    kept = Kept(docs.sparkSession)
    signed = kept(
        known.mapInArrow(_signed, "doc_id bigint, h1 bigint, h2 bigint, n bigint, sig binary")
    )
    equal = signed.filter("n > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")
    )
    nodes = kept(equal)
    home = signed.select("doc_id", "h1", "h2").join(nodes.select("h1", "h2", "node"), ["h1", "h2"], "left")
    of_row = checkpointed(home.select("doc_id", F.coalesce("node", "doc_id").alias("node")).distinct())
    ends = of_row.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    # The texts under one id are one document, so their nodes are one class.
    same = of_row.join(ends.filter("a <> z"), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    rows_each = REGISTERS // BANDS * 4
    keys = F.array(
        *[
            F.xxhash64(F.lit(b), F.substring("sig", b * rows_each + 1, rows_each))
            for b in range(BANDS)
        ]
    )
    placed = nodes.select("node", F.posexplode(keys).alias("band", "key"))
    buckets = placed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last"))
    members = kept(
        placed.join(buckets.filter("head <> last"), "key").select("key", "band", "node", "head")
    )
    tested = kept(
        members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    )
    alike = kept(verified(known, tested, similarity))
    links = alike.select("a", "b").union(same)
    roots = components(links)
    private = None
    for most in (4, None):  # the nearest pairs first: what they join need not be compared
        mixed = kept(_mixed(members, roots))
        if mixed.isEmpty():
            break
        if private is None:
            private = kept(_private(known, nodes, mixed))
        found = _cross_pairs(mixed, nodes, private, similarity, most)
        fresh = kept(found.join(tested, ["a", "b"], "left_anti").select("a", "b"))
        if fresh.isEmpty():
            continue
        more = kept(verified(known, fresh, similarity))
        tested = tested.union(fresh)
        if not more.isEmpty():
            links = links.union(more.select("a", "b"))
            roots = components(links)
    kept.drop()  # what follows reads the nodes of rows and their roots alone
    classes = of_row.join(roots, "node", "left").groupBy("doc_id").agg(
        F.min(F.coalesce("root", "node")).alias("class_id")
    )
    return rows.select("doc_id").join(classes, "doc_id", "left")


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns.

    Of rows that share the kept id one stays, the least by a hash of all columns. Rows with a null id
    are in no class and stay as they are.
    """
    kept = Kept(docs.sparkSession)
    classes = near_duplicates(docs, doc_id, text, similarity)
    ids = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count(F.lit(1)).alias("n"))
    # Few ids: those that go, and those of several rows.
    marked = kept(ids.filter("class_id < doc_id or n > 1").withColumnRenamed("doc_id", doc_id))
    left = docs.join(marked.filter(f"class_id < `{doc_id}`").select(doc_id), doc_id, "left_anti")
    several = marked.filter(f"class_id = `{doc_id}`").select(doc_id)
    if several.isEmpty():
        return left
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(several, doc_id, "left_semi").groupBy(doc_id).agg(F.min_by(every, F.xxhash64(every)).alias("r"))
    rest = left.join(several, doc_id, "left_anti").select(docs.columns)
    return rest.unionByName(one.select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns]))
