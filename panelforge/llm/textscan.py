"""Word scanning on Arrow text columns, without a Python object per word.

A batch is cut into slices of whole rows of a few megabytes. Each slice is scanned as one byte
array: words are runs of bytes of a class, every word gets a 64-bit hash of its bytes, and hashes
of k consecutive words come from running sums of a polynomial in the word hashes.

Null texts have no words. A text longer than a slice is a slice of its own; no text is cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LONG = 512  # bytes; longer words are hashed one by one


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags that is true inside the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Everything but the space and the controls from tab to carriage return.
VISIBLE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
# Digits, lower-case ASCII letters and all bytes of longer characters.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def release_memory() -> None:
    """Hand what this worker process has freed back to the system; later stages run beside it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own ways
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (the public splitmix64 step)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some rows: byte bounds, and for each row the number of words before it."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.data, self.start, self.end, self.first = data, start, end, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, equal for equal bytes."""
        length = self.end - self.start
        padded = np.concatenate([self.data, np.zeros(8, dtype=np.uint8)])
        eight = np.lib.stride_tricks.as_strided(
            padded.view(np.uint8), shape=(len(self.data) + 1, 8), strides=(1, 1)
        )
        out = length.astype(np.uint64) * _ODD
        todo, at = np.arange(len(length)), 0
        while len(todo):
            left = np.minimum(length[todo] - at, 8)
            part = eight[self.start[todo] + at].view(np.uint64).ravel()
            shift = ((8 - left) * 8).astype(np.uint64)
            part = (part << shift) >> shift
            out[todo] = mix(out[todo] ^ part) + _ODD
            at += 8
            todo = todo[(length[todo] > at) & (length[todo] <= _LONG)]
        for i in np.flatnonzero(length > _LONG):
            digest = blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8)
            out[i] = int.from_bytes(digest.digest(), "little")
        return out


def text_buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; nulls are empty."""
    if text.null_count:
        text = text.fill_null("")
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    if not len(text):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = text.buffers()
    bounds = np.frombuffer(offsets, dtype=kind)[text.offset : text.offset + len(text) + 1]
    low, high = int(bounds[0]), int(bounds[-1])
    raw = np.frombuffer(data, dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return raw, bounds.astype(np.int64) - low


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch with about `limit` bytes of text each."""
    text = batch.column(batch.schema.get_field_index(column))
    bounds = text_buffers(text)[1]
    low = 0
    while low < batch.num_rows:
        high = int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), batch.num_rows)
        yield batch.slice(low, high - low)
        low = high


def scan(text: pa.Array, keep: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Maximal runs of kept bytes inside each row, after mapping bytes through `fold`."""
    data, bounds = text_buffers(text)
    if fold is not None:
        data = fold[data]
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = keep[data]
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[:-1] = inside[:-1]
    opens[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    opens[edges] |= inside[edges]  # a word never goes on into the next row
    closes = np.zeros(len(data) + 1, dtype=bool)
    closes[1:] = inside[:-1] & (~inside[1:] | opens[1:])
    start, end = np.flatnonzero(opens[:-1]), np.flatnonzero(closes)
    return Words(data, start, end, np.searchsorted(start, bounds))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Grams:
    """Hashes of runs of consecutive words, by differences of one running polynomial sum."""

    BASE = 0xD6E8FEB86659FD93
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * _powers(self.BASE, n)[:n], out=self._sums[1:])
        self._back = _powers(self.INVERSE, n)

    def runs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Hash of the words low to high - 1, the same wherever the run stands."""
        body = (self._sums[high] - self._sums[low]) * self._back[low]
        return mix(body ^ ((high - low).astype(np.uint64) * _ODD))

    def of(self, k: int) -> np.ndarray:
        """Hash of each k consecutive words, by their first word."""
        n = len(self._sums) - 1 - (k - 1)
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        body = (self._sums[k:] - self._sums[: n]) * self._back[:n]
        return mix(body ^ (np.full(1, k, dtype=np.uint64) * _ODD))


def merged_cover(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n words that lie in any [low, high)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, low, 1)
    np.add.at(step, high, -1)
    return np.cumsum(step[:n]) > 0
