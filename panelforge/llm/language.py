"""Language of documents: script ranges, word scores, and Viterbi over words.

A model is learned from labelled texts: counts of byte trigrams inside words (with their edges) and
of words by script, per language. Up to `PER_LANGUAGE` documents of a language are read for it, taken
by a hash of the id; the model has a fixed size, languages times 65,536 numbers.

A text is lower-cased and cut into words of letters. The scripts of a word's characters, by their
Unicode ranges, leave as candidates the languages that use them; each candidate scores the word by
the sum of its trigrams' log probabilities. Viterbi then labels the words of a document, where every
change of language costs `SWITCH`; runs of one label are the spans. The document's language is the
one with most letters in its spans, and the score is that share times the probability of the
language given all words.

Nulls, ties and repeats: a null text, or one without a letter, is `und` with score 0 and no spans.
Rows with a null language teach nothing. Ties go to the language that sorts first. With nothing to
learn from, everything is `und`. Every input row gives one row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.textscan import byte_class, release_memory, scan, slices

PER_LANGUAGE = 20_000
SWITCH = 12.0
BUCKETS = 1 << 16
_CELLS = 2_000_000  # word scores held at once
_SLICE = 1 << 18  # bytes of text scanned at once; every byte takes some 100 while it is scored
_LETTERS = byte_class((0x61, 0x7A), (0x80, 0xFF))

# Script of a character by the first byte of its UTF-8 form, which follows from the Unicode ranges:
# 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew, 5 Arabic, 6 Indic and Thai, 7 other, 8 Kana, 9 Han,
# 10 Hangul. 0 is no letter or the inside of a character. Bytes that begin letters of several scripts,
# or letters besides signs, are in `_POINTS`.
_SCRIPT = np.zeros(256, dtype=np.uint16)
for _low, _high, _script in (
    (0x61, 0x7A, 1),
    (0xC3, 0xCA, 1),
    (0xCD, 0xCF, 2),
    (0xD0, 0xD4, 3),
    (0xD6, 0xD7, 4),
    (0xD8, 0xDB, 5),
    (0xE0, 0xE0, 6),
    (0xE1, 0xE1, 7),
    (0xE3, 0xE3, 8),
    (0xE4, 0xE9, 9),
    (0xEA, 0xED, 10),
    (0xF0, 0xF4, 7),
):
    _SCRIPT[_low : _high + 1] = _script
_SCRIPTS = 11
_SCRIPT_BIT = np.where(_SCRIPT > 0, 1 << _SCRIPT, 0).astype(np.uint16)

# Script bits by code point, of letters only, for the first bytes 0xC2, 0xCB, 0xCC, 0xD5, 0xD6, 0xDC to
# 0xDF, 0xE2, 0xEE and 0xEF; the later of two ranges holds.
_BY_POINT = np.isin(np.arange(256), [0xC2, 0xCB, 0xCC, 0xD5, 0xD6, *range(0xDC, 0xE0), 0xE2, 0xEE, 0xEF])
_POINTS = np.zeros(1 << 16, dtype=np.uint16)
for _low, _high, _script in (
    (0x0080, 0x033F, 1),
    (0x0540, 0x058F, 7),  # Armenian
    (0x0590, 0x05BF, 4),
    (0x0700, 0x07FF, 7),  # Syriac, Thaana, N'Ko
    (0x0750, 0x077F, 5),
    (0x2000, 0x21FF, 1),
    (0x2200, 0x2FFF, 7),  # Glagolitic, Coptic, Georgian, Tifinagh, Ethiopic
    (0x2C60, 0x2C7F, 1),
    (0x2E80, 0x2FFF, 9),
    (0xE000, 0xF8FF, 7),
    (0xF900, 0xFAFF, 9),
    (0xFB00, 0xFB06, 1),
    (0xFB07, 0xFB1C, 7),
    (0xFB1D, 0xFB4F, 4),
    (0xFB50, 0xFEFF, 5),
    (0xFF00, 0xFF65, 1),
    (0xFF66, 0xFF9F, 8),
    (0xFFA0, 0xFFDC, 10),
):
    for _point in range(_low, _high + 1):
        _POINTS[_point] = 1 << _script if unicodedata.category(chr(_point))[0] == "L" else 0


def held_out(doc_id: str = "doc_id", part: int = 4, rest: int = 2) -> Column:
    """Whether the row's id belongs to the part that is kept from learning; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % part == rest, F.lit(False))


def _lowered(text: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(text)
    except pa.ArrowInvalid:  # broken bytes are no letters of any script
        plain = text.cast(pa.binary()).to_pylist()
        return pa.array([None if t is None else t.decode("utf-8", "replace").lower() for t in plain], pa.string())


def _word_features(text: pa.Array):
    """Words, trigram buckets of their bytes, byte bounds among these, and script bits."""
    words = scan(_lowered(text), _LETTERS)
    length = words.end - words.start
    bounds = np.append(0, np.cumsum(length))
    if not len(length):
        return words, np.zeros(0, dtype=np.int64), bounds, np.zeros(0, dtype=np.uint16)
    at = np.arange(bounds[-1]) + np.repeat(words.start - bounds[:-1], length)
    byte = words.data[at].astype(np.uint64)
    before, after = np.zeros_like(byte), np.zeros_like(byte)
    before[1:], after[:-1] = byte[:-1], byte[1:]
    before[bounds[:-1]], after[bounds[1:] - 1] = 0, 0
    key = (before << np.uint64(16)) | (byte << np.uint64(8)) | after
    bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    byte = words.data[at]
    bits = _SCRIPT_BIT[byte]
    wide = np.flatnonzero(_BY_POINT[byte])
    if len(wide):
        one, two, three = (byte[np.minimum(wide + k, len(byte) - 1)].astype(np.int64) for k in range(3))
        short = ((one & 0x1F) << 6) | (two & 0x3F)
        long = ((one & 0x0F) << 12) | ((two & 0x3F) << 6) | (three & 0x3F)
        bits[wide] = _POINTS[np.where(one < 0xE0, short, long)]
    scripts = np.bitwise_or.reduceat(bits, bounds[:-1])
    return words, bucket, bounds, scripts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the whole task, one array per language."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            words, bucket, bounds, scripts = _word_features(part.column(1))
            langs = part.column(0).to_pylist()
            names = sorted(set(langs))
            of_word = np.array([names.index(x) for x in langs])[words.row_of_word()]
            of_byte = np.repeat(of_word, np.diff(bounds))
            for i, name in enumerate(names):
                total = totals.setdefault(name, np.zeros(BUCKETS + _SCRIPTS, dtype=np.int64))
                total[:BUCKETS] += np.bincount(bucket[of_byte == i], minlength=BUCKETS)
                own = scripts[of_word == i]
                for s in range(1, _SCRIPTS):
                    total[BUCKETS + s] += np.count_nonzero((own >> s) & 1)
    for name, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])],
            ["lang", "bucket", "n"],
        )
    release_memory()


class Model:
    """Log probabilities of trigrams, and which languages use a script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams = counts[:, :BUCKETS] + 0.1
        self.scores = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
        by_script = counts[:, BUCKETS:]
        total = np.maximum(by_script.sum(axis=1, keepdims=True), 1)
        self.uses = by_script / total >= 0.001


def learn(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE
) -> Model:
    """A model from the rows that are not held out and have a language and a text."""
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    ).filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS + _SCRIPTS)))
    steps = 1_000_000
    rate = F.coalesce(
        F.create_map(
            *[F.lit(x) for k, n in sizes.items() for x in (k, min(steps, steps * per_language // n + 1))]
        )[F.col("lang")],
        F.lit(0),
    )
    taken = rows.filter(F.pmod(F.xxhash64(F.lit("learn"), "id"), F.lit(steps)) < rate)
    found = (
        taken.select("lang", F.col("text").cast("string").alias("text"))
        .mapInArrow(_counted, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # at most languages x (buckets + scripts) rows
    )
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BUCKETS + _SCRIPTS))
    place = {x: i for i, x in enumerate(langs)}
    row = np.array([place[x] for x in found.column("lang").to_pylist()], dtype=np.int64)
    counts[row, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return Model(langs, counts)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; `first` has the word bounds of the documents.

    All documents advance together, the longest first, so the documents still running are always
    the first ones.
    """
    n_words, n_langs = scores.shape
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, sorted_length = first[:-1][order], length[order]
    most = int(sorted_length[0]) if len(order) else 0
    running = np.searchsorted(-sorted_length, -np.arange(most), side="left")
    back = np.zeros((n_words, n_langs), dtype=np.int16)
    own = np.arange(n_langs, dtype=np.int16)
    value = np.zeros((len(order), n_langs))
    for t in range(most):
        k = running[t]
        at = begin[:k] + t
        v = value[:k]
        if t:
            top = v.argmax(axis=1)
            jump = v[np.arange(k), top][:, None] - switch
            back[at] = np.where(v >= jump, own, top[:, None])
            v = np.maximum(v, jump)
            v = v - v.max(axis=1, keepdims=True)
        value[:k] = v + scores[at]
    label = np.zeros(n_words, dtype=np.int16)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(most - 1, -1, -1):
        k = running[t]
        at = begin[:k] + t
        label[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return label


def _scored(text: pa.Array, model: Model):
    words, bucket, bounds, scripts = _word_features(text)
    n = len(scripts)
    out = np.zeros((n, len(model.langs)), dtype=np.float32)
    for k in range(len(model.langs)):
        total = np.append(0.0, np.cumsum(model.scores[k][bucket], dtype=np.float64))
        out[:, k] = total[bounds[1:]] - total[bounds[:-1]]
    wants = np.stack([(scripts >> s) & 1 for s in range(_SCRIPTS)], axis=1).astype(bool)
    lacks = wants.astype(np.float32) @ (~model.uses).T.astype(np.float32) > 0
    lacks[lacks.all(axis=1)] = False
    out[lacks] -= 50.0
    out[scripts == 0] = 0.0
    return words.counts, np.where(scripts > 0, np.diff(bounds), 0), out


def _labelled(model: Model, switch: float, n_kept: int, text: str = "text"):
    n_langs = max(1, len(model.langs))

    def solve(rows: list) -> list[pa.RecordBatch]:
        part = pa.Table.from_batches([r[0] for r in rows]).combine_chunks()
        counts = np.concatenate([r[1] for r in rows])
        weight = np.concatenate([r[2] for r in rows])
        scores = np.concatenate([r[3] for r in rows])
        first = np.append(0, np.cumsum(counts))
        n_docs = len(counts)
        doc = np.repeat(np.arange(n_docs), counts)
        lettered = np.array(part.column("has_letter").to_pylist(), dtype=bool)
        names = np.array(["und"] * n_docs, dtype=object)
        score = np.zeros(n_docs)
        spans = [[] for _ in range(n_docs)]
        if model.langs:
            label = viterbi(scores, first, switch)
            share = np.bincount(doc * n_langs + label, weights=weight, minlength=n_docs * n_langs)
            share = share.reshape(n_docs, n_langs)
            total = np.stack(
                [np.bincount(doc, weights=scores[:, k], minlength=n_docs) for k in range(n_langs)], axis=1
            )
            likely = np.exp(total - total.max(axis=1, keepdims=True))
            likely /= likely.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            each = np.arange(n_docs)
            good = share[each, best] / np.maximum(share.sum(axis=1), 1) * likely[each, best]
            score = np.where(lettered, good, 0.0)
            names = np.where(lettered, np.array(model.langs, dtype=object)[best], "und")
            new = np.ones(len(label), dtype=bool)
            new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            for a, z in zip(at, np.append(at[1:], len(label))):
                d = doc[a]
                if lettered[d]:
                    spans[d].append(
                        {"low": int(a - first[d]), "high": int(z - first[d]), "lang": model.langs[label[a]]}
                    )
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32()), ("lang", pa.string())]))
        kept = [part.column(i).combine_chunks() for i in range(n_kept)]
        out = pa.Table.from_arrays(
            [*kept, pa.array(list(names), pa.string()), pa.array(score), pa.array(spans, kind)],
            names=[*part.column_names[:n_kept], "lang_pred", "score", "spans"],
        )
        return out.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, text, _SLICE):
                counts, weight, scores = _scored(part.column(text), model)
                held.append((part, counts, weight, scores))
                size += scores.size
                if size >= _CELLS:
                    yield from solve(held)
                    held, size = [], 0
        if held:
            yield from solve(held)
        held = []
        release_memory()

    return run


def identify(
    docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text", switch: float = SWITCH
) -> DataFrame:
    """Each row's `keep` columns (as `_0`, `_1`, ...) with `lang_pred`, `score` and word `spans`."""
    # A text that is kept anyway goes to Python once.
    held = text in keep and dict(docs.dtypes).get(text) == "string"
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)],
        *([] if held else [F.col(text).cast("string").alias("text")]),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    out = "lang_pred string, score double, spans array<struct<low: int, high: int, lang: string>>"
    source = f"_{keep.index(text)}" if held else "text"
    return rows.mapInArrow(_labelled(model, switch, len(keep), source), ", ".join([*fields, out]))


def drop_unknown(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Documents with a known language, also of several or a doubtful one, with all columns."""
    found = identify(docs, learn(docs, doc_id, text, lang), tuple(docs.columns), text)
    kept = found.filter(F.col("lang_pred") != "und")
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
