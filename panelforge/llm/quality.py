"""Quality of documents: logistic regression on hashed word n-grams, trained by FTRL.

Features of a text are runs of one and two words, and runs of one to three word shapes (which kinds
of characters a word has, which come first and last, and how long it is), hashed into 2^18 weights.
A feature's value is its share of the text's features of its sort, scaled. Training follows the
regularised leader (FTRL-proximal, McMahan 2013), one document after the other inside a shard. The
shards, each a bounded number of texts in one partition of a checkpoint, run side by side as Spark tasks;
after every round their states are averaged by one aggregate and sent out again. Scoring is a sparse dot product in the scan.

Training reads at most about `SAMPLE` labelled documents, taken by a hash of the id; their ids are
bounded by that number, so they are joined by broadcast and no text is shuffled but the sample's. The
state has 2^18 numbers. Everything else runs over all rows.

Nulls, ties and repeats: a null or empty text has no features and gets the score of the bias. Label
rows with a null id or label teach nothing; several labels of one document are as many examples. A
row with a null id is scored. Without labels the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.graph import checkpointed
from panelforge.llm.language import held_out
from panelforge.llm.textscan import VISIBLE, Grams, mix, scan, slices

BITS = 18
SAMPLE = 24_000
SHARDS = 8
ROUNDS = 4
_SORTS = 5
_SCALE = 16.0
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05

# Kinds of bytes: 1 upper case, 2 lower case, 4 digit, 8 other visible ASCII, 16 longer characters.
_KIND = np.full(256, 8, dtype=np.uint64)
_KIND[0x41:0x5B], _KIND[0x61:0x7B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 4, 16


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of every feature occurrence."""
    words = scan(text, VISIBLE)
    row = words.row_of_word()
    n_rows = len(words.first) - 1
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    length = words.end - words.start
    bounds = np.append(0, np.cumsum(length))
    at = np.arange(bounds[-1]) + np.repeat(words.start - bounds[:-1], length)
    kind = _KIND[words.data[at]]
    shape = np.bitwise_or.reduceat(kind, bounds[:-1])
    shape |= (kind[bounds[:-1]] << np.uint64(8)) | (kind[bounds[1:] - 1] << np.uint64(16))
    shape |= np.minimum(np.log2(length + 1).astype(np.uint64), 7) << np.uint64(24)
    plain, shaped = Grams(words.hashes()), Grams(mix(shape))
    rows, buckets, values = [], [], []
    for sort, (grams, k) in enumerate(((plain, 1), (plain, 2), (shaped, 1), (shaped, 2), (shaped, 3))):
        n = max(0, len(row) - k + 1)
        inside = row[:n] == row[k - 1 :]
        own = row[:n][inside]
        h = mix(grams.of(k)[inside] ^ np.uint64(sort * 0x9E3779B97F4A7C1 + 1))
        size = np.bincount(own, minlength=n_rows)
        rows.append(own)
        buckets.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        values.append(_SCALE / size[own])
    return np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def ftrl(docs: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over the examples (buckets, values, label), in place; the last place is the bias."""
    for at, x, y in docs:
        at, x = np.append(at, len(z) - 1), np.append(x, 1.0)
        w = _weights(z[at], n[at])
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n_at = n[at]
        sigma = (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA
        z[at] += g - sigma * w
        n[at] = n_at + g * g


def _examples(part: pa.RecordBatch) -> list[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Shard, turn, buckets, summed values and label of each labelled text."""
    row, bucket, value = features(part.column(0))
    key, at = np.unique((row << BITS) | bucket, return_inverse=True)
    total = np.bincount(at, weights=value, minlength=len(key)).astype(np.float32)
    cut = np.searchsorted(key >> BITS, np.arange(part.num_rows + 1))
    place = (key & ((1 << BITS) - 1)).astype(np.int32)
    shard, turn, y = (part.column(k).to_pylist() for k in (1, 2, 3))
    return [
        (shard[i], turn[i], place[cut[i] : cut[i + 1]], total[cut[i] : cut[i + 1]], y[i])
        for i in range(part.num_rows)
    ]


def _trained(z0: np.ndarray, n0: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What one pass over each shard of the partition adds to the state."""
        held = [x for batch in batches for part in slices(batch, "text") for x in _examples(part)]
        held.sort(key=lambda x: x[:2])
        for shard in sorted({x[0] for x in held}):
            z, n = z0.copy(), n0.copy()
            ftrl([x[2:] for x in held if x[0] == shard], z, n)
            at = np.flatnonzero((z != z0) | (n != n0))
            columns = [at.astype(np.int32), z[at] - z0[at], n[at] - n0[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "z", "n"])

    return run


def learn(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE,
) -> np.ndarray:
    """The weights, with the bias last, from labelled rows that are not held out."""
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter(
        ~held_out("id") & F.col("id").isNotNull() & F.col("y").isin(0, 1)
    )
    many = marks.count()
    steps = 1_000_000
    turn = F.xxhash64(F.lit("quality"), "id")
    taken = marks.filter(F.pmod(turn, F.lit(steps)) < min(steps, steps * sample // max(1, many) + 1))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(
        F.broadcast(taken), "id"
    )
    turn = F.xxhash64(F.lit("turn"), "id", "y")
    fed = rows.select(
        F.coalesce("text", F.lit("")).alias("text"),
        F.pmod(turn, F.lit(SHARDS)).cast("int").alias("shard"),
        turn.alias("turn"),
        "y",
    )
    # Each shard is whole in one partition of the checkpoint, so a round moves state, not texts.
    examples = checkpointed(fed.repartition(SHARDS, "shard"))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(ROUNDS if many else 0):
        moved = (
            examples.mapInArrow(_trained(z, n), "at int, z double, n double")
            .groupBy("at")
            .agg(F.sum("z").alias("z"), F.sum("n").alias("n"))
            .toArrow()  # at most 2^18 + 1 rows
        )
        at = moved.column("at").to_numpy()
        z[at] += moved.column("z").to_numpy() / SHARDS
        n[at] += moved.column("n").to_numpy() / SHARDS
    return _weights(z, n)


def score(
    docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per row: `doc_id` and `score`, the probability that the label is 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, value = features(part.column(1))
                margin = np.bincount(row, weights=weights[bucket] * value, minlength=part.num_rows)
                p = 1 / (1 + np.exp(-np.clip(margin + weights[-1], -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double")
