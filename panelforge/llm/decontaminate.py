"""Benchmark decontamination with suffix arrays of the training text.

Training documents are cut into shards of a few megabytes inside the tasks that read them. Each
shard gets a suffix array over words, sorted by prefix doubling: ranks of one word, then of two,
four and so on, where only suffixes that still tie are sorted again. Every suffix of every test
item that is long enough to hold a window is then searched in each shard word by word, all suffixes
at once by binary search inside the interval found so far, down to the length of a window; the last
interval holds its locations. The spans are unions of such matches, of any items: passages of several
items that meet or overlap in a document are one span.

The documents are never shuffled: a shard holds whole documents. The test items come as blocks of
about `BLOCK_BYTES` of text, whose size is measured first; each block is sent to all tasks, and every
shard searches them in turn, one block in memory at a time. Words are compared by 64-bit hashes of
their bytes.

Nulls, ties and repeats: a null text, of a document or an item, has no words. An item with a null
id marks words but is not listed. Rows that share an item id are one item with several texts; every
document row is judged on its own and gives one row, also if it shares its id, whatever the number of
blocks. Empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.textscan import ALNUM, LOWER, merged_cover, mix, release_memory, scan, slices

WINDOW = 13
BLOCK_BYTES = 16 << 20
_SHARD_BYTES = 2 << 20  # of training text; its arrays take about 25 times that
_GAP = np.uint64(0)  # stands between documents; no word hashes to it


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the sequence of words that starts there, down to `depth` words."""
    n = len(words)
    order = np.argsort(words, kind="stable")
    sorted_words = words[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_words[1:] != sorted_words[:-1]
    starts = np.flatnonzero(new)
    rank = np.empty(n + 1, dtype=np.int64)  # rank: place of the first suffix of the tie
    rank[n] = -1
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    tied = np.ones(n, dtype=bool)
    done = 1
    while done < depth:
        sizes = np.diff(np.append(np.flatnonzero(new), n))
        tied = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        members = order[places]
        own, follow = rank[members], rank[np.minimum(members + done, n)]
        # Places of one tie are consecutive, so sorting by (tie, rank of what follows) permutes
        # the members within their own places.
        by = np.lexsort((follow, own))
        members, own, follow = members[by], own[by], follow[by]
        order[places] = members
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])
        new[places] = fresh
        heads = np.flatnonzero(fresh)
        rank[members] = np.repeat(places[heads], np.diff(np.append(heads, len(places))))
        done *= 2
    return order


def _bisect(words, order, shift, low, high, value, right: bool):
    """For each query, the first place in [low, high) whose word at `shift` is not below `value`."""
    low, high = low.copy(), high.copy()
    todo = np.flatnonzero(low < high)
    n = len(words)
    while len(todo):
        mid = (low[todo] + high[todo]) >> 1
        at = order[mid] + shift
        word = words[np.minimum(at, n - 1)]
        word = np.where(at < n, word, _GAP)
        less = (word <= value[todo]) if right else (word < value[todo])
        low[todo] = np.where(less, mid + 1, low[todo])
        high[todo] = np.where(less, high[todo], mid)
        todo = todo[low[todo] < high[todo]]
    return low


def search(
    words: np.ndarray, order: np.ndarray, suffixes: np.ndarray, lengths: np.ndarray, limit: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest match of each test suffix and the interval of places that match it.

    `suffixes` holds the words of each test suffix by depth, `lengths` how many it has and `limit`
    how deep its interval is wanted.
    """
    count = len(suffixes)
    low, high = np.zeros(count, dtype=np.int64), np.full(count, len(order), dtype=np.int64)
    depth = np.zeros(count, dtype=np.int64)
    alive = np.arange(count)
    at_low, at_high = low.copy(), np.zeros(count, dtype=np.int64)
    sorted_first = words[order]
    shift = 0
    while len(alive):
        value = suffixes[alive, shift]
        if shift == 0:
            a = np.searchsorted(sorted_first, value, side="left")
            b = np.searchsorted(sorted_first, value, side="right")
        else:
            a = _bisect(words, order, shift, low[alive], high[alive], value, False)
            b = _bisect(words, order, shift, a, high[alive], value, True)
        hit = a < b
        alive, a, b = alive[hit], a[hit], b[hit]
        shift += 1
        low[alive], high[alive], depth[alive] = a, b, shift
        exact = limit[alive] == shift
        at_low[alive[exact]], at_high[alive[exact]] = a[exact], b[exact]
        if shift == suffixes.shape[1]:
            break
        alive = alive[lengths[alive] > shift]
    return depth, at_low, at_high


class TestSet:
    """The distinct windows of a block of items, as rows of words, and the items of each."""

    def __init__(self, ids: list, texts: pa.Array, window: int):
        words = scan(texts, ALNUM, LOWER)
        hashes = np.maximum(mix(words.hashes()), np.uint64(1))
        keys: dict[bytes, int] = {}
        pairs: list[tuple[int, int]] = []
        rows: list[np.ndarray] = []
        self.names = sorted({str(i) for i in ids if i is not None})
        place = {name: k for k, name in enumerate(self.names)}
        for i, item in enumerate(ids):
            own = hashes[words.first[i] : words.first[i + 1]]
            size = min(len(own), window)
            if not size:
                continue
            for s in range(len(own) - size + 1):
                row = own[s : s + size]
                k = keys.setdefault(row.tobytes(), len(rows))
                if k == len(rows):
                    rows.append(row)
                if item is not None:
                    pairs.append((k, place[str(item)]))
        self.lengths = np.array([len(r) for r in rows], dtype=np.int64)
        self.words = np.zeros((len(rows), window), dtype=np.uint64)
        for k, row in enumerate(rows):
            self.words[k, : len(row)] = row
        flat = np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2)
        self.item = flat[:, 1]
        self.first = np.searchsorted(flat[:, 0], np.arange(len(rows) + 1))


def _matches(blocks: list[Broadcast], window: int):
    def shard(part: pa.RecordBatch) -> tuple[list, list, list]:
        words = scan(part.column(1), ALNUM, LOWER)
        counts = words.counts
        n_docs = len(counts)
        # One gap after each document, so that no match runs from one into the next.
        hashes = np.zeros(len(words.start) + n_docs, dtype=np.uint64)
        row = words.row_of_word()
        hashes[np.arange(len(row)) + row] = np.maximum(mix(words.hashes()), np.uint64(1))
        begin = words.first[:-1] + np.arange(n_docs)
        lows, highs, items = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)], [set() for _ in counts]
        covered = np.zeros(len(hashes), dtype=bool)
        order = suffix_array(hashes, window) if len(hashes) else None

        def mark(test: TestSet) -> None:
            if not len(test.lengths) or not len(hashes):
                return
            _, low, high = search(hashes, order, test.words, test.lengths, test.lengths)
            size = high - low
            which = np.repeat(np.arange(len(size)), size)
            skip = np.cumsum(size) - size
            at = order[np.arange(len(which)) - skip[which] + low[which]]
            if not len(at):
                return
            covered[:] |= merged_cover(at, at + test.lengths[which], len(hashes))
            doc = np.searchsorted(begin, at, side="right") - 1
            named = np.unique(doc * len(size) + which)
            d, w = named // len(size), named % len(size)
            many = test.first[w + 1] - test.first[w]
            base = np.repeat(test.first[w] - (np.cumsum(many) - many), many)
            d, w = np.repeat(d, many), test.item[np.arange(int(many.sum())) + base]
            both = np.unique(d * max(1, len(test.names)) + w)
            d, w = both // max(1, len(test.names)), both % max(1, len(test.names))
            cut = np.searchsorted(d, np.arange(n_docs + 1))
            for i in np.unique(d):
                items[i].update(test.names[k] for k in w[cut[i] : cut[i + 1]])

        for block in blocks:
            mark(block.value)
            if len(blocks) > 1 and block._path is not None:
                del block._value  # one block in memory at a time
        edge = np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))
        opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(opens, closes):
            d = int(np.searchsorted(begin, a, side="right")) - 1
            lows[d].append(int(a - begin[d]))
            highs[d].append(int(b - begin[d]))
        spans = [[{"low": a, "high": b} for a, b in zip(x, y)] for x, y in zip(lows, highs)]
        return counts.tolist(), spans, [sorted(x) for x in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        for batch in batches:
            for part in slices(batch, "text", _SHARD_BYTES):
                counts, spans, items = shard(part)
                keep = [part.column(0), *[part.column(k) for k in range(2, part.num_columns)]]
                names = [part.schema.names[0], *part.schema.names[2:]]
                yield pa.RecordBatch.from_arrays(
                    [
                        *keep,
                        pa.array(counts, pa.int64()),
                        pa.array(spans, span),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    [*names, "n_words", "spans", "items"],
                )
        release_memory()

    return run


_OUT = "_n_words bigint, _spans array<struct<low: int, high: int>>, _items array<string>"


def _blocks(items: DataFrame, item_id: str, text: str, bound: int) -> list[DataFrame]:
    """The items in parts of about `bound` bytes; one part if they fit."""
    total = items.agg(F.sum(F.octet_length(text) + 16).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) // bound))
    cell = F.pmod(F.xxhash64(item_id, text), F.lit(parts))
    return [items.filter(cell == k) if parts > 1 else items for k in range(parts)]


def _found(docs, items, doc_id, text, item_id, item_text, window, block_bytes, keep) -> DataFrame:
    """`_id`, the kept columns as `_0`, `_1`, ..., then `_n_words`, `_spans` and `_items`."""
    kept = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)]
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), *kept)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
    sets = []
    for block in _blocks(items, item_id, item_text, block_bytes):
        rows = block.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")).toArrow()
        texts = pa.array(rows.column(1).to_pylist(), pa.string())
        test = TestSet(rows.column(0).to_pylist(), texts, window)
        sets.append(docs.sparkSession.sparkContext.broadcast(test))
        del test
    found = source.mapInArrow(_matches(sets, window), ", ".join([*fields, _OUT]))
    return found.withColumn("_items", F.array_sort("_items"))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: `doc_id`, `n_words`, the matched word `spans` and the `items` found in it."""
    found = _found(docs, items, doc_id, text, item_id, item_text, window, block_bytes, ())
    return found.select(
        F.col("_id").alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        F.col("_spans").alias("spans"),
        F.col("_items").alias("items"),
    )


def covered_words(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["high"] - s["low"])


def is_contaminated(n_hit, n_words, part: int = 20):
    """At least one word in `part` is inside a benchmark passage."""
    return (n_hit > 0) & (n_hit * part >= n_words)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names."""
    keep = tuple(docs.columns)
    found = _found(docs, items, doc_id, text, item_id, item_text, window, block_bytes, keep)
    bad = is_contaminated(covered_words("_spans"), F.col("_n_words"))
    return found.filter(~bad).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)])
