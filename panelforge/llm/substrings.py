"""Removal of repeated passages: seed and extend on winnowed anchors.

Words are runs of visible characters. A *window* is `length` consecutive words. Winnowing picks one
anchor in every window, the `seed`-word run with the smallest hash (the leftmost of equals), so
equal windows have equal anchors at equal offsets and documents need to meet on anchors only,
about one for every five words.

An anchor travels with its extension to both sides: the windows it was picked for, which are
consecutive, as hashes of their words. Among the occurrences of an anchor

* equal extensions are settled at once: all but the smallest document repeat all their words;
* different extensions are compared window by window, which finds where matches begin and end.

A repeat is a run of words covered by windows that also start in a smaller document; neighbouring
windows together make it maximal. Windows are told apart by the 64-bit anchor, the offset and 40
bits of their own hash.

Occurrences with equal extensions in one batch are reduced to the smallest document before the
shuffle, so an anchor that a third of all documents share leaves a batch once. No pairs are made:
the smallest document of an anchor, an extension or a window comes from windows over sorted rows,
which spill and keep no group in memory.

Nulls, ties and repeats: a null text has no words. A row with a null id takes no part: nothing is
removed from it and nothing is removed because of it. Rows that share an id are one document with
several texts; each text is judged against smaller ids only. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.textscan import VISIBLE, Grams, merged_cover, scan, slices

LENGTH = 13
SEED = 5
_FP = 5  # bytes kept of a window's hash


def _anchored(words, length: int, seed: int):
    """For each run of windows with one anchor: row, first window, count, offset, anchor, hashes."""
    picks = length - seed + 1
    n = len(words.start)
    if n < length:
        return None
    grams = Grams(words.hashes())
    seeds, windows = grams.of(seed), grams.of(length)
    m = len(windows)
    best, offset = seeds[:m].copy(), np.zeros(m, dtype=np.int64)
    for j in range(1, picks):
        other = seeds[j : j + m]
        less = other < best
        best[less] = other[less]
        offset[less] = j
    row = words.row_of_word()
    at = np.flatnonzero(row[:m] == row[length - 1 :])
    if not len(at):
        return None
    anchor_at = at + offset[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = anchor_at[1:] != anchor_at[:-1]
    opens = np.flatnonzero(new)
    bounds = np.append(opens, len(at))
    first = at[opens]
    count = np.diff(bounds)
    whole = grams.runs(first, first + count + length - 1)
    return {
        "row": row[first],
        "lo": first - words.first[row[first]],
        "n": count,
        "offset": offset[first],
        "anchor": best[first].view(np.int64),
        "whole": whole ^ offset[first].astype(np.uint64),
        "windows": windows[at],
        "bounds": bounds,
    }


def _fingerprints(windows: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept runs' window hashes, `_FP` bytes each, one binary value per run."""
    flags = np.repeat(keep, np.diff(bounds))
    data = np.ascontiguousarray(windows[flags].view(np.uint8).reshape(-1, 8)[:, :_FP])
    ends = np.zeros(int(keep.sum()) + 1, dtype=np.int32)
    np.cumsum(np.diff(bounds)[keep] * _FP, out=ends[1:])
    return pa.Array.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]
    )


def _occurrences(length: int, seed: int, settled: bool):
    """Rows of a batch's anchors: those of its smallest documents, or else those already settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _anchored(scan(part.column(2), VISIBLE), length, seed)
                if found is None:
                    continue
                ids = part.column(0).to_numpy(zero_copy_only=False)
                tags = part.column(1).to_numpy(zero_copy_only=False)
                doc = ids[found["row"]]
                order = np.lexsort((doc, found["whole"]))
                whole = found["whole"][order]
                head = np.ones(len(order), dtype=bool)
                head[1:] = whole[1:] != whole[:-1]
                least = doc[order][np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
                later = np.zeros(len(order), dtype=bool)
                later[order] = doc[order] > least
                keep = later if settled else ~later
                tag = tags[found["row"][keep]]
                if settled:
                    columns = {
                        "doc_id": doc[keep],
                        "tag": tag,
                        "low": found["lo"][keep].astype(np.int32),
                        "n": (found["n"][keep] + length - 1).astype(np.int32),
                    }
                else:
                    columns = {
                        "anchor": found["anchor"][keep],
                        "doc_id": doc[keep],
                        "place": (tag.astype(np.int64) << 40)
                        | (found["offset"][keep] << 32)
                        | found["lo"][keep],
                        "prints": _fingerprints(found["windows"], found["bounds"], keep),
                    }
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))

    return run


def _tagged(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Identity and text; the tag tells apart different texts under one id."""
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        (F.xxhash64(text).bitwiseAND(F.lit(0x3FFFFF))).cast("int").alias("tag"),
        F.col(text).alias("text"),
    )


def repeated_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """Runs of words (`low`, `n`) of a document that also start in a document with a smaller id.

    Runs may overlap or touch; their union is the repeated part. `tag` names the text under an id.
    """
    rows = _tagged(docs, doc_id, text).filter("doc_id is not null and text is not null")
    settled = rows.mapInArrow(
        _occurrences(length, seed, True), "doc_id bigint, tag int, low int, n int"
    )
    met = rows.mapInArrow(
        _occurrences(length, seed, False), "anchor bigint, doc_id bigint, place bigint, prints binary"
    ).repartition("anchor")
    offset = F.shiftright("place", 32).bitwiseAND(F.lit(0xFF)).cast("int")
    low = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    same = W.partitionBy("anchor", "offset", "prints")
    heads = met.select(
        "anchor",
        offset.alias("offset"),
        "prints",
        "doc_id",
        F.shiftright("place", 40).cast("int").alias("tag"),
        low.alias("low"),
    ).withColumn("least", F.min("doc_id").over(same))
    kind = F.xxhash64("offset", "prints")
    among = W.partitionBy("anchor")
    mixed = heads.withColumn("mixed", F.min(kind).over(among) != F.max(kind).over(among)).filter(
        "doc_id > least or mixed"
    )
    count = (F.length("prints") / _FP).cast("int")
    each = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda j: F.struct(
            j.alias("at"),
            F.lit(length).alias("n"),
            F.substr("prints", j * _FP + 1, F.lit(_FP)).alias("print"),
        ),
    )
    whole = F.array(
        F.struct(
            F.lit(0).alias("at"), (count + length - 1).alias("n"), F.lit(None).cast("binary").alias("print")
        )
    )
    opened = mixed.withColumn("w", F.explode(F.when(F.col("doc_id") > F.col("least"), whole).otherwise(each)))
    # A window stands at its anchor's offset less its place in the run; that and its hash name it.
    named = opened.select(
        "anchor",
        (F.col("offset") - F.col("w.at")).alias("offset"),
        F.col("w.print").alias("print"),
        "doc_id",
        "tag",
        (F.col("low") + F.col("w.at")).alias("low"),
        F.col("w.n").alias("n"),
    )
    first = F.min("doc_id").over(W.partitionBy("anchor", "offset", "print"))
    found = named.withColumn("first", first).filter("print is null or doc_id > first")
    return found.select("doc_id", "tag", "low", "n").unionByName(settled)


def _keep_rest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = scan(part.column(1), VISIBLE)
                spans = part.column(2).to_pylist()
                total, gone, digest, kept_text = [], [], [], []
                for i, own in enumerate(spans):
                    a, b = words.first[i], words.first[i + 1]
                    out = np.zeros(b - a, dtype=bool)
                    if own:
                        low = np.array([s["low"] for s in own])
                        out = merged_cover(low, low + np.array([s["n"] for s in own]), b - a)
                    raw = words.data
                    body = b" ".join(
                        raw[words.start[k] : words.end[k]].tobytes() for k in (a + np.flatnonzero(~out))
                    )
                    total.append(int(b - a))
                    gone.append(int(out.sum()))
                    digest.append(hashlib.sha256(body).hexdigest())
                    kept_text.append(body)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(total, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(digest, pa.string()),
                        pa.array(kept_text, pa.binary()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    return run


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """Per document: `n_words`, `n_removed`, `kept_sha256` and `kept_text`, the words left.

    The words left are joined by one space. Every input row gives one row.
    """
    spans = (
        repeated_spans(docs, doc_id, text, length, seed)
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("low", "n")).alias("spans"))
    )
    rows = _tagged(docs, doc_id, text)
    joined = rows.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "spans")
    done = joined.mapInArrow(
        _keep_rest(length),
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary",
    )
    return done.select(
        "doc_id", "n_words", "n_removed", "kept_sha256", F.decode("kept", "UTF-8").alias("kept_text")
    )
