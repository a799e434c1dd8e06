"""Token ids of documents as Parquet list columns.

Documents are placed by ranges of their id or another order, sorted, encoded in the tasks that write
them, and stored as one row each: `shard` and `local_start` (file and tokens before the row in it), `doc_id`,
`n_tokens`, further metadata columns, and `ids`, a list of 32-bit integers. The ids column is
dictionary-encoded (a file rarely uses more ids than a dictionary page holds), the sorted number
columns are delta-encoded (version 2 pages), row groups and pages have set sizes, and page indexes
are written, so readers can take metadata without tokens or the tokens of a range of ids.

Encoding is the tokenizers library's, on pieces of text: the vocabularies here split text at white
space before they merge, so a space or line break between two visible characters is a border that no
token crosses. A worker process keeps the ids of a bounded number of pieces (by 64-bit hashes, those met last
longest), and texts are put together from these, a few megabytes at once. A text with any other white
space, or that holds a special string of the vocabulary, is encoded as a whole, by the library's plain call.

Nulls, ties and repeats: a null text is empty and gets the end id only. A null id sorts first. Rows
that share an id are ordered by a hash of their text. An empty table writes an empty file.
"""

from __future__ import annotations

import re
import sys
import threading
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.textscan import VISIBLE, mix, release_memory, scan, slices, text_buffers

END = 0
DOCS_PER_FILE = 8192
MOST_FILES = 20_000
_CACHED = 1_000_000  # pieces, about 40 bytes each
_SLICE = 2 << 20
_IDLE = 5.0  # seconds
# A word of Latin letters after a line break or a space, and the ASCII marks that may stand behind
# it: the first cut parts these from each other and nothing else.
_WORD = re.compile("\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_HELD = "_panelforge_token_encoders"

FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}


class _Pieces:
    """Ids of pieces, made by the library when first asked for, in sorted arrays.

    A piece is a word and what stands before it: nothing (0), a space (1) or a line break (2).
    """

    def __init__(self, tokenizer):
        self._first_cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self._merge = tokenizer.model.tokenize
        self._names = {ord(k): v for k, v in self._byte_names().items()}
        self._tails: dict[str, list[int]] = {}
        self._keys = np.zeros(0, dtype=np.uint64)
        self._at = np.zeros(0, dtype=np.int64)
        self._n = np.zeros(0, dtype=np.int32)
        self._met = np.zeros(0, dtype=np.int32)
        self._ids = np.zeros(0, dtype=np.int32)
        self._round = 0

    def _byte_names(self) -> dict[str, str]:
        """How the vocabulary writes a byte, asked from the library byte by byte for ASCII and by
        the two bytes of a character for the rest."""
        names = {chr(b): self._first_cut(chr(b))[0][0] for b in range(0x21, 0x7F)}
        names[" "] = self._first_cut(" x")[0][0][0]
        names["\n"] = self._first_cut("x\nx")[1][0]
        for b in range(0x80, 0xC0):
            names[chr(b)] = self._first_cut(bytes([0xC5, b]).decode())[0][0][1]
        for b in range(0xC2, 0xE0):
            names[chr(b)] = self._first_cut(bytes([b, 0x81]).decode())[0][0][0]
        return names

    def _merged(self, names: list[str]) -> list[int]:
        return [t.id for name in names for t in self._merge(name)]

    def made(self, word: str, lead: int) -> list[int]:
        core = word.rstrip(_MARKS)
        if _WORD.fullmatch(core):
            name = core.encode().decode("latin-1").translate(self._names)
            if lead == 1:
                ids = self._merged([self._names[0x20] + name])
            else:
                ids = self._merged([self._names[0x0A], name] if lead else [name])
            marks = word[len(core) :]
            if marks:
                if marks not in self._tails:
                    if len(self._tails) > 10_000:
                        self._tails.clear()
                    self._tails[marks] = self._merged([marks.translate(self._names)])
                ids = ids + self._tails[marks]
            return ids
        names = [name for name, _ in self._first_cut(("", " ", "x\n")[lead] + word)]
        return self._merged(names[1:] if lead == 2 else names)

    def of(self, words, pick: np.ndarray, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the picked words one behind the other, and how many each word has."""
        self._round += 1
        h = mix(words.hashes()[pick] + (lead.astype(np.uint64) << np.uint64(1)))
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self._keys, keys)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = words.data.tobytes()
            rows = pick[first[new]]
            ids = [
                self.made(raw[a:z].decode(), k)
                for a, z, k in zip(words.start[rows].tolist(), words.end[rows].tolist(), lead[first[new]].tolist())
            ]
            self._add(keys[new], ids)
            place = np.searchsorted(self._keys, keys)
        self._met[place] = self._round
        own = place[inverse]
        n = self._n[own]
        ends = np.cumsum(n)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self._at[own] - (ends - n), n)
        out = self._ids[flat]
        if len(self._keys) > _CACHED:
            self._forget()
        return out, n

    def _add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        n = np.array([len(x) for x in ids], dtype=np.int32)
        at = len(self._ids) + np.cumsum(n) - n
        flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(n.sum()))
        place = np.searchsorted(self._keys, keys)
        self._ids = np.concatenate([self._ids, flat])
        self._keys = np.insert(self._keys, place, keys)
        self._at = np.insert(self._at, place, at)
        self._n = np.insert(self._n, place, n)
        self._met = np.insert(self._met, place, self._round)

    def _forget(self) -> None:
        """Keep the three quarters that were met last."""
        order = np.argsort(self._met, kind="stable")[-(_CACHED * 3 // 4) :]
        kept = np.sort(order)
        n = self._n[kept]
        starts = np.cumsum(n) - n
        self._ids = self._ids[np.arange(int(n.sum())) + np.repeat(self._at[kept] - starts, n)]
        self._keys, self._n, self._met, self._at = self._keys[kept], n, self._met[kept], starts


_SPACES = ~VISIBLE
_SPACES[0x1C:0x20] = True
# White space beyond ASCII, as UTF-8.
_WIDE = ["\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


class Encoder:
    """Ids of texts as the library gives them."""

    # Texts whose ids by pieces and as a whole are compared before pieces are used.
    _PROBES = ("a\nb c", "It's 3.5 (of \u00e9t\u00e9), x!\n\u00dcber\n12 -- don't\nstop \u4e2d\u6587, ok?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._apart = re.compile("|".join(map(re.escape, [*special, *_WIDE])).encode())
        self._pieces = _Pieces(self._tokenizer)
        want = [self.whole(t) for t in self._PROBES]
        if [x.tolist() for x in self.encode(list(self._PROBES))] != want:
            self._pieces = None

    def whole(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _regular(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows in which every white space is one space or line break between visible characters."""
        space = _SPACES[data]
        plain = (data == 0x20) | (data == 0x0A)
        bad = space & ~plain
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True  # in front of it a row ends, behind it one starts
        bad |= space & edge[:-1]
        bad |= space & edge[1:]
        bad[1:] |= space[1:] & space[:-1]
        odd = np.flatnonzero(bad)
        raw = data.tobytes()
        apart = [m.start() for m in self._apart.finditer(raw)]
        rows = np.searchsorted(bounds, np.append(odd, np.array(apart, dtype=np.int64)), side="right") - 1
        regular = bounds[1:] > bounds[:-1]
        regular[rows] = False
        return regular

    def encode_column(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one behind the other, and how many each row has; nulls are empty."""
        data, bounds = text_buffers(text)
        regular = self._regular(data, bounds) if self._pieces is not None else np.zeros(len(text), dtype=bool)
        words = scan(text, VISIBLE)
        row = words.row_of_word()
        pick = np.flatnonzero(regular[row])
        start = words.start[pick]
        before = np.where(start == bounds[row[pick]], 0, np.where(data[start - 1] == 0x0A, 2, 1))
        flat, n = self._pieces.of(words, pick, before) if len(pick) else (np.zeros(0, np.int32),) * 2
        sizes = np.bincount(row[pick], weights=n, minlength=len(text)).astype(np.int64)
        apart = {}
        for i in np.flatnonzero(~regular & (bounds[1:] > bounds[:-1])).tolist():
            ids = self.whole(data[bounds[i] : bounds[i + 1]].tobytes().decode())
            apart[i] = ids
            sizes[i] = len(ids)
        if not apart:
            return flat, sizes
        out = np.empty(int(sizes.sum()), dtype=np.int32)
        out[np.repeat(regular, sizes)] = flat
        starts = np.cumsum(sizes) - sizes
        for i, ids in apart.items():
            out[starts[i] : starts[i] + len(ids)] = ids
        return out, sizes

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        flat, sizes = self.encode_column(pa.array(texts, pa.string()))
        return np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []


def held_encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary, so that later tasks find the pieces known."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD)).__dict__
    if "timer" in held:
        held.pop("timer").cancel()
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def let_go(path: str) -> None:
    """Drop the worker's encoder if no task asks for it within `_IDLE` seconds: other stages that run in
    the same process later need the memory."""
    held = sys.modules.setdefault(_HELD, types.ModuleType(_HELD)).__dict__

    def drop():
        held.pop(path, None)
        release_memory()

    if "timer" in held:
        held.pop("timer").cancel()
    held["timer"] = timer = threading.Timer(_IDLE, drop)
    timer.daemon = True
    timer.start()


def _encoded(path: str, end: int, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = None, 0
        for batch in batches:
            for part in slices(batch, batch.schema.names[n_kept], _SLICE):
                encoder = encoder or held_encoder(path)
                flat, sizes = encoder.encode_column(part.column(n_kept))
                bounds = np.append(0, np.cumsum(sizes + 1))
                ids = np.full(int(bounds[-1]), end, dtype=np.int32)
                last = np.zeros(len(ids), dtype=bool)
                last[bounds[1:] - 1] = True
                ids[~last] = flat
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:n_kept],
                        pa.array(start + bounds[:-1]),
                        pa.array(sizes + 1),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)),
                    ],
                    [*part.schema.names[:n_kept], "local_start", "n_tokens", "ids"],
                )
                start += int(bounds[-1])
        if encoder is not None:
            let_go(path)

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    metadata: tuple[str, ...] = (),
    end: int = END,
    docs_per_file: int = DOCS_PER_FILE,
    order_by: tuple[str, ...] = (),
) -> None:
    """Write the documents' ids in ascending order of the document id, or of the columns of
    `order_by`; replaces the folder."""
    files = min(MOST_FILES, max(1, -(-docs.count() // docs_per_file)))
    kept = [F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f"meta_{c}") for c in metadata]]
    keys = {f"_key_{i}": F.col(c) for i, c in enumerate(order_by or (doc_id,))}
    keys["_key_tie"] = F.xxhash64(text)
    order = [F.col(k).asc_nulls_first() for k in keys]
    rows = docs.select(*kept, F.col(text).alias("text"), *[c.alias(k) for k, c in keys.items()])
    placed = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(*keys)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema if f.name != "text"]
    out = "local_start bigint, n_tokens bigint, ids array<int>"
    done = placed.mapInArrow(_encoded(vocabulary, end, len(kept)), ", ".join([*fields, out]))
    stored = done.withColumn("shard", F.spark_partition_id())
    stored.write.mode("overwrite").options(**FORMAT).parquet(path)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows with `start`, the tokens of all rows before; the files' ids are not read for it.

    The totals have one row per file, at most `MOST_FILES`, and are sent to all tasks.
    """
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = totals.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    joined = rows.join(F.broadcast(bases), "shard")
    return joined.withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def checksums(files: DataFrame) -> DataFrame:
    """Per row, from the stored ids: `doc_id`, `shard`, `local_start`, `n_tokens` and `ids_crc32`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = ids.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.append(0, np.cumsum(sizes)) * 4
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"],
            )

    kind = dict(files.dtypes)["doc_id"]
    schema = f"doc_id {kind}, shard int, local_start bigint, n_tokens bigint, ids_crc32 bigint"
    return files.select("doc_id", "shard", "local_start", "ids").mapInArrow(run, schema)
