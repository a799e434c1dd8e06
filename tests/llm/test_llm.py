"""Operators for training data against plain Python, and on odd input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import bagminhash as B
from panelforge.llm import decontaminate as D
from panelforge.llm import forest, language, mixing, preference, quality, queries, rollups, textscan
from panelforge.llm import graph, substrings, tokens

SF = "/root/testdata/sf0.001"
WORD = rb"[^\x20\x09-\x0D]+"
ALNUM = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = "doc_id bigint, text string, lang string, source string, n_words int, spans int, items int, _id int"
LONG = " ".join(f"w{i}" for i in range(30_000))


def lowered(text):
    table = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(ALNUM, (text or "").encode().translate(table))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [
        (None, passage, "en", "src0"),
        (1, None, None, None),
        (2, "", "en", "src1"),
        (3, passage, "en", "src1"),
        (4, "x " + passage, None, "src2"),
        (4, "x " + passage, None, "src2"),
        (5, LONG, "de", None),
        (6, LONG + " end", "de", "new"),
        (7, "a b", "en", "src0"),
        (8, "A, B!", "en", "src0"),
        (9, "12 34", "en", "src0"),
    ]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], ODD)


@pytest.fixture(scope="module")
def documents(spark):
    return queries.table(spark, SF, "documents")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aA b.\n\té中 0", max_size=30), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    column = pa.array(texts, pa.string())
    for keep, fold, want in (
        (textscan.VISIBLE, None, [re.findall(WORD, t.encode()) for t in texts]),
        (textscan.ALNUM, textscan.LOWER, [lowered(t) for t in texts]),
    ):
        w = textscan.scan(column, keep, fold)
        got = [w.data[a:z].tobytes() for a, z in zip(w.start, w.end)]
        assert got == [x for t in want for x in t]
        assert w.counts.tolist() == [len(t) for t in want]
        assert len(set(w.hashes().tolist())) == len(set(got))


def without_repeats(rows):
    first = {}
    for doc, text in rows:
        words = re.findall(WORD, (text or "").encode())
        for p in range(len(words) - 12):
            key = tuple(words[p : p + 13])
            if doc is not None:
                first[key] = min(doc, first.get(key, doc))
    out = []
    for doc, text in rows:
        words = re.findall(WORD, (text or "").encode())
        gone = [False] * len(words)
        for p in range(len(words) - 12):
            if doc is not None and first[tuple(words[p : p + 13])] < doc:
                gone[p : p + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_substrings(request, which):
    df = request.getfixturevalue(which)
    found = substrings.remove_repeats(df).drop("kept_text").collect()
    want = without_repeats([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert sorted(map(tuple, found), key=str) == want


def contaminated(rows, items):
    windows = {}
    for name, text in items:
        words = lowered(text)
        size = min(13, len(words))
        for p in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[p : p + size]), set()).add(name)
    out = []
    for doc, text in rows:
        words, names = lowered(text), set()
        hit = [False] * len(words)
        for size in {len(w) for w in windows}:
            for p in range(len(words) - size + 1):
                own = windows.get(tuple(words[p : p + size]))
                if own:
                    names |= own
                    hit[p : p + size] = [True] * size
        out.append((doc, len(words), sum(hit), sorted(str(n) for n in names if n is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [D.BLOCK_BYTES, 100])
def test_contamination(spark, odd, bound):
    items = [(1, " ".join(f"P{i}" for i in range(3, 18))), (2, "a b"), (3, None), (None, "34"), (2, "w7")]
    tests = spark.createDataFrame(items, "item_id int, text string")
    found = D.contamination(odd, tests, block_bytes=bound)
    got = found.select("doc_id", "n_words", D.covered_words().alias("n_hit"), "items")
    want = contaminated([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], items)
    assert sorted(map(tuple, got.collect()), key=str) == want
    kept = D.decontaminate(odd, tests, block_bytes=D.BLOCK_BYTES)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 5, 6}


def test_rows_do_not_depend_on_the_blocks(spark):
    """Repeated rows, null ids and several texts under one id, with one block of items and with many."""
    words = [f"p{i}" for i in range(60)]
    items = [(k, " ".join(words[k : k + 20])) for k in range(0, 40, 4)]
    tests = spark.createDataFrame(items, "item_id int, text string")
    clean, hit, other = "x " * 30, " ".join(words[:15]) + " y" * 15, " ".join(words[30:45]) + " z" * 15
    texts = [(None, clean), (None, hit), (None, other), (1, hit), (1, other), (2, clean), (2, clean), (3, hit), (3, hit)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want = contaminated(texts, items)
    for bound in (D.BLOCK_BYTES, 200):
        assert bound > 200 or len(D._blocks(tests, "item_id", "text", bound)) > 3
        found = D.contamination(docs, tests, block_bytes=bound)
        got = found.select("doc_id", "n_words", D.covered_words().alias("n_hit"), "items").collect()
        assert sorted(map(tuple, got), key=str) == want
        kept = D.decontaminate(docs, tests, block_bytes=bound).collect()
        assert sorted(map(tuple, kept), key=str) == [(2, clean), (2, clean), (None, clean)]


def test_contamination_of_the_documents(spark, documents):
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
    want = contaminated([(r.doc_id, r.text) for r in documents.collect()], items)
    found = queries.op4_decontamination(spark, SF).collect()
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found}
    assert got == {
        (d, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0 and 20 * h >= n)
        for d, n, h, x in want
    }


def test_suffix_array_and_search():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 4, 300).astype(np.uint64)
    order = D.suffix_array(words, 16)
    keys = [tuple(words[i : i + 16]) for i in order]
    assert keys == sorted(keys)
    test = np.array([[1, 2, 3, 1], [9, 9, 9, 9]], dtype=np.uint64)
    size = np.array([4, 4])
    depth, low, high = D.search(words, order, test, size, size)
    at = [i for i in range(297) if tuple(words[i : i + 4]) == (1, 2, 3, 1)]
    assert sorted(order[low[0] : high[0]].tolist()) == at
    assert depth[1] == 0 and low[1] >= high[1]


def multiset(text):
    words = lowered(text)
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def classes(rows):
    sets = {}
    for doc, text in rows:
        if doc is not None:
            sets.setdefault(doc, multiset(text))
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            same = sum((x & y).values())
            if same and same >= 0.8 * (sum(x.values()) + sum(y.values()) - same):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    found = B.near_duplicates(df).collect()
    want = classes([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert len(found) == df.count()
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == want
    assert all(r.class_id is None for r in found if r.doc_id is None)


def test_near_copies_without_a_common_original(spark):
    """Copies that differ from each other more than from a lost original still form one class."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for d in range(120):
        words = list(base)
        for p in rng.choice(200, 1 + d % 6, replace=False):
            words[p] = f"n{d}x{p}"
        rows.append((d, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r.class_id for r in B.near_duplicates(df).collect()}
    assert found == classes(rows)


@pytest.mark.parametrize("again", ["same", "other", "near"])
def test_near_copies_with_repeated_ids(spark, again):
    """Rows that occur twice, or ids with a second text, lose no pair of such copies."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows, more = [], []
    for d in range(120):
        words = list(base)
        for p in rng.choice(200, 1 + d % 6, replace=False):
            words[p] = f"n{d}x{p}"
        rows.append((d, " ".join(words)))
        other = words[:-1] if again == "near" else [f"o{d}x{i}" for i in range(60)]
        more.append(rows[-1] if again == "same" else (d, " ".join(other)))
    df = spark.createDataFrame(rows + more, "doc_id bigint, text string")
    found = B.near_duplicates(df).collect()
    assert len(found) == 240
    assert {r.doc_id: r.class_id for r in found} == classes(rows)


def test_one_document_of_each_class_stays(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (3, other), (3, text), (4, other), (5, ""), (5, "")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id int, text string, class_id int, n int")
    left = B.drop_near_duplicates(df)
    assert left.columns == df.columns
    # 3 has both texts, so all but the rows without an id and the empty text are one class.
    assert Counter((r.doc_id, r.text) for r in left.collect()) == {(1, text): 1, (None, text): 2, (5, ""): 1}
    assert B.drop_near_duplicates(df.limit(0)).isEmpty()


def test_texts_under_one_id_are_one_class(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(3, texts[0]), (5, texts[0]), (5, texts[1]), (7, texts[1]), (9, texts[2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.doc_id, r.class_id) for r in B.near_duplicates(df).collect()} == {(3, 3), (5, 3), (7, 3), (9, 9)}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    x = rng.integers(1, 1 << 62, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    rows = np.repeat([0, 1], 60)
    sig = B.signatures(rows, np.tile(x, 2), np.concatenate([a, b]), 2, m=4096)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert (sig[0] == sig[1]).mean() == pytest.approx(want, abs=0.04)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 30), (30, 5), (4, 4)]
    found = graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r.node: r.root for r in found} == {1: 1, 2: 1, 3: 1, 30: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_language(spark, odd, documents):
    model = language.learn(documents)
    found = language.identify(documents, model).withColumnRenamed("_0", "doc_id")
    held = found.filter(language.held_out("doc_id")).join(documents, "doc_id")
    assert held.count() > 20
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count()
    rows = language.identify(odd, model, tuple(odd.columns)).collect()
    assert len(rows) == 11
    assert {r._0 for r in rows if r.lang_pred == "und"} == {1, 2, 9}
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.drop_unknown(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (1, 2, 9)").isEmpty()
    none = language.identify(odd, language.learn(odd.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_letters_of_every_script_have_a_language(spark):
    """One language for each range of first bytes, and its texts again among the others."""
    ranges = {
        "c2": "ªº µº", "cb": "ˇˆ ˈˉ", "hy": "բարեւ ձեզ աշխարհ", "HY": "ԲԱՐԵՒ ՁԵԶ", "syr": "ܫܠܡܐ ܥܠܡܐ",
        "dv": "ދިވެހި ބަސް", "nko": "ߒߞߏ ߞߊ߲", "zgh": "ⵜⴰⵎⴰⵣⵉⵖⵜ ⴰⵡⴰⵍ", "glag": "ⰳⰾⰰⰳⱁⰾⰹⱌⰰ",
        "wide": "ｆｕｌｌ ｗｉｄｔｈ", "kana": "ｶﾀｶﾅ ﾊﾝｶｸ", "ar": "ﺎﻠﺴﻼﻣ ﻊﻠﻴﻜﻣ", "lig": "ﬁ ﬂ", "he": "שלום עולם",
    }
    texts = {**ranges, "en": "don’t stop — it’s “fine”…"}
    docs = spark.createDataFrame([(i, t, k) for k, t in texts.items() for i in range(8)], "doc_id int, text string, lang string")
    model = language.learn(docs)
    rows = language.identify(docs, model, ("lang", "text")).collect()
    assert {(r._0, r.lang_pred) for r in rows if r._0.lower() != "hy"} == {(k, k) for k in texts if k.lower() != "hy"}
    assert {r.lang_pred for r in rows if r._0.lower() == "hy"} <= {"hy", "HY"}
    assert all(r.score > 0 and r.spans for r in rows)
    signs = spark.createDataFrame([(1, "— … “”"), (2, "« »"), (3, "、。")], "doc_id int, text string")
    assert {r.lang_pred for r in language.identify(signs, model).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5):
        scores = rng.normal(size=(n + 3, 2)) * 3
        first = np.array([0, n, n + 3])
        got = language.viterbi(scores, first, 2.0)
        for a, z in ((0, n), (n, n + 3)):

            def value(path):
                turns = sum(x != y for x, y in zip(path, path[1:]))
                return sum(scores[a + i, s] for i, s in enumerate(path)) - 2.0 * turns

            paths = [[(k >> i) & 1 for i in range(z - a)] for k in range(1 << (z - a))]
            assert value(got[a:z].tolist()) == pytest.approx(max(map(value, paths)))


def test_mixed_languages_are_spans(spark, documents):
    model = language.learn(documents)
    pick = {r.lang: r.text for r in documents.filter("length(text) > 800").collect()}
    text = pick["en"][:400] + " " + pick["de"][:600]
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = language.identify(df, model).first()
    assert [s.lang for s in row.spans] == ["en", "de"] and row.lang_pred == "de"


def test_mixed_and_short_texts_are_kept(spark, documents):
    pick = {r.lang: r.text for r in documents.filter("length(text) > 800").collect()}
    three = " ".join([pick["en"][:450], pick["de"][:300], pick["es"][:250]])
    even = " ".join([pick["en"][:400], pick["de"][:400]])
    rows = [(-1, three), (-2, even), (-3, "a"), (-4, None), (-5, "12 — 34"), (-6, "")]
    mixed = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = documents.unionByName(mixed, allowMissingColumns=True)
    kept = language.drop_unknown(docs)
    assert {r.doc_id for r in kept.filter("doc_id < 0").collect()} == {-1, -2, -3}
    assert kept.filter("doc_id >= 0").count() == documents.filter(r"text rlike '\\p{L}'").count()


def test_quality(spark):
    docs = queries.table(spark, "/root/testdata/sf0.01", "documents")
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels")
    found = queries.op10_quality(spark, "/root/testdata/sf0.01")
    held = found.filter("held_out").join(labels, "doc_id")
    assert held.filter("predicted = quality").count() >= 0.93 * held.count()
    assert found.count() == docs.count()


def test_quality_on_odd_input(spark, odd):
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, quality int")
    scores = quality.score(odd, quality.learn(odd, none)).collect()
    assert len(scores) == 11 and {r.score for r in scores} == {0.5}


def test_mixing_keeps_the_weights(spark):
    shares = {"a": 5, "b": 3, "c": 1}
    rows = spark.range(1800).select(
        F.col("id").alias("doc_id"),
        F.expr("case when id % 9 < 4 then 'a' when id % 9 < 7 then 'b' else null end").alias("source"),
        F.lit(1).alias("_slot"),
    )
    found = mixing.positions(rows, {"a": 5, "b": 3}, other=1, block=4).collect()
    assert sorted(r._position for r in found) == list(range(1800))
    assert len({r._row.doc_id for r in found}) == 1800
    by_slot = {}
    for r in found:
        by_slot.setdefault(r._slot, set()).add(r._source)
    assert all(len(s) == 1 for s in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    names = [next(iter(by_slot[t])) for t in range(len(by_slot))]
    names = [n if n in shares else "c" for n in names]
    left = Counter(names)
    seen = Counter()
    for t, n in enumerate(names):
        seen[n] += 1
        if any(seen[s] == left[s] for s in shares):
            break
        assert all(abs(seen[s] - (t + 1) * shares[s] / 9) < 1 for s in shares)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 30), min_size=1))
def test_a_period_meets_every_deadline(shares):
    total = sum(shares.values())
    slots = mixing.period(shares)
    assert sorted(t for s in slots.values() for t in s) == list(range(total))
    for s, own in slots.items():
        for j, t in enumerate(own):
            assert j * total // shares[s] <= t < -(-(j + 1) * total // shares[s])


def test_mixing_on_odd_input(odd):
    assert sorted(r._position for r in mixing.positions(odd, queries.SHARES).collect()) == list(range(11))
    assert mixing.positions(odd.limit(0), queries.SHARES).isEmpty()
    assert mixing.mixed(odd, queries.SHARES).columns == odd.columns


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(queries.vocabulary())


PARTS = ["<|endoftext|>", " ", "\n", "  ", "a", "Aé", "中", ",", "12", "'s", "\t", "’", "\u2003", "\xa0", "\x1f", "|>", "Ġ"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), max_size=4))
def test_ids_are_those_of_the_plain_call(encoder, plain, texts):
    assert encoder._pieces is not None
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want


def test_forgotten_pieces_are_made_again(plain, monkeypatch):
    monkeypatch.setattr(tokens, "_CACHED", 8)
    few = tokens.Encoder(queries.vocabulary())
    texts = [f"w{i} x{i % 3}, end\nline{i % 5}" for i in range(60)]
    for k in range(0, 60, 4):
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts[k : k + 4]]
        assert [x.tolist() for x in few.encode(texts[k : k + 4])] == want
    assert len(few._pieces._keys) <= 8


def test_an_idle_worker_drops_its_encoder(monkeypatch):
    import sys
    import time

    monkeypatch.setattr(tokens, "_IDLE", 0.3)
    path = queries.vocabulary()
    first = tokens.held_encoder(path)
    tokens.let_go(path)
    assert tokens.held_encoder(path) is first  # asked for in time
    time.sleep(0.6)
    assert tokens.held_encoder(path) is first
    tokens.let_go(path)
    time.sleep(1.5)
    assert path not in sys.modules[tokens._HELD].__dict__


def test_token_files_of_texts_with_special_strings(spark, plain, tmp_path):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny", None, "", "a  b", "\n\na\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_tokens(rows, str(tmp_path / "t"), queries.vocabulary())
    got = {r.doc_id: r.ids for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}


def test_token_query_on_documents(spark, documents, plain):
    start, want = 0, {}
    for r in documents.select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    found = queries.op8_token_files(spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(want)


def test_token_files(spark, odd, tmp_path):
    path = str(tmp_path / "t")
    tokens.write_tokens(odd, path, queries.vocabulary(), metadata=("lang", "n_words"), docs_per_file=3)
    files = spark.read.parquet(path)
    found = tokens.with_starts(tokens.checksums(files), files).orderBy("start").collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary())
    rows = odd.select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want[r.doc_id] = (len(ids), zlib.crc32(ids.tobytes()))
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in found} == want
    keys = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert keys == sorted(keys)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    tokens.write_tokens(odd.limit(0), path, queries.vocabulary())
    assert spark.read.parquet(path).isEmpty()


def test_token_file_format(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    path = tmp_path / "t"
    tokens.write_tokens(documents, str(path), queries.vocabulary())
    meta = pq.ParquetFile(sorted(path.glob("part-*"))[0]).metadata
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids."))
    assert ids.has_dictionary_page and ids.has_offset_index and ids.compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings


def test_neighbours(spark):
    vectors = queries.table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = vectors.collect()
    x = np.array([r.embedding for r in rows], dtype=float)
    ids = np.array([r.vec_id for r in rows])
    norm = np.linalg.norm(x, axis=1)
    asked = vectors.filter("vec_id % 50 = 0")
    found = forest.nearest(vectors, asked, shard=200, block=5).collect()
    hits, total = 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q] / (norm * norm[q])
        score[q] = -9
        top = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == ids[q])
        assert [r[0] for r in own] == [1, 2, 3, 4, 5]
        for _, v, s in own:
            assert s == pytest.approx(score[ids.tolist().index(v)], abs=1e-12)
        hits += len(top & {r[1] for r in own})
        total += 5
    assert hits >= 0.9 * total


def test_neighbours_of_repeated_rows_and_versions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    other = [(i, rng.normal(size=8).tolist()) for i in range(5, 15)]
    df = spark.createDataFrame(rows + rows + other + rows[:3], "vec_id bigint, embedding array<double>")
    found = forest.nearest(df, df.filter("vec_id % 50 = 0")).collect()
    for q in (0, 50):
        best = {}
        for i, v in rows + other:
            s = float(np.dot(v, x[q]) / (np.linalg.norm(v) * np.linalg.norm(x[q])))
            best[i] = max(s, best.get(i, -2))
        best.pop(q)
        want = sorted(best, key=lambda i: (-best[i], i))[:5]
        own = sorted((r.rank, r.vec_id) for r in found if r.query_id == q)
        assert own == list(enumerate(want, 1))
    tiny = spark.createDataFrame(
        [(0, [1e-200, 2e-200]), (1, [1e200, 2e200]), (2, [3.0, -1.0])], "vec_id bigint, embedding array<double>"
    )
    got = forest.nearest(tiny, tiny.filter("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in got] == [(1, 1.0), (2, round(1 / 50**0.5, 12))]


def test_neighbours_on_odd_input(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]),
        (6, [float("nan"), 1.0]), (None, [1.0, 0.0]), (7, [-1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (50, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = forest.nearest(df, df.filter("vec_id % 50 = 0"), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in found][:3] == [
        (0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0),
    ]
    assert forest.nearest(df.limit(0), df).isEmpty()


def test_preferences(spark):
    turns = "array<struct<role: string, text: string>>"
    rows = [
        (1, [("user", "q"), ("assistant", "yes")], [("user", "q"), ("assistant", "no!")]),
        (2, [("user", "q")], [("user", "q")]),
        (3, None, [("assistant", None)]),
        (4, [("user", "q"), ("assistant", "a"), ("user", "r")], [("user", "q")]),
    ]
    df = spark.createDataFrame(rows, f"pair_id int, chosen {turns}, rejected {turns}")
    out = {r.pair_id: r for r in preference.format_pairs(df).collect()}
    assert out[1].prompt == "<|user|>\nq<|end|>\n" and out[1].n_prompt_turns == 1
    low, high = out[1].chosen_mask[0]
    assert out[1].chosen[low:high] == "yes<|end|>\n" and out[1].rejected[low:] == "no!<|end|>\n"
    assert out[2].tied and out[2].chosen == "" and out[2].chosen_mask == []
    assert out[3].n_prompt_turns == 0 and out[3].rejected_mask[0].low == 14
    assert out[4].n_prompt_turns == 1 and out[4].rejected == "" and not out[4].tied


def test_preferences_on_odd_input(spark):
    rows = [(1, None, "assistant", None), (1, 2, None, "x"), (None, 1, "user", "y"), (2, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    found = {r.pair_id: (tuple(r.chosen[0]), r.chosen == r.rejected) for r in preference.sampled_pairs(df).collect()}
    assert found == {1: (("assistant", ""), True), 2: (("user", "z"), True)}
    assert preference.format_pairs(preference.sampled_pairs(df.limit(0))).isEmpty()


def test_rollups(spark, odd, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    assert store.totals().isEmpty()
    words = rollups.count_tokens("text", rollups.WORDS)
    batch = rollups.signed(odd, 1, words, rollups.WORDS)
    assert store.commit("a", batch) and not store.commit("a", batch)
    assert store.commit("b", rollups.signed(odd.filter("doc_id = 3"), -1, words, rollups.WORDS))
    assert store.commit("none", batch.limit(0))
    found = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert found[("src1", "en")] == (1, 0) and found[(None, "de")] == (1, 30_000)
    assert found[(None, None)] == (1, 0) and found[("src2", None)] == (2, 42)
    pieces = rollups.count_tokens("text", rollups.PIECES)
    store.commit("c", rollups.revised(odd.filter("lang = 'de'"), words, rollups.WORDS, pieces, rollups.PIECES))
    german = store.totals().filter("lang = 'de'").collect()
    assert {r.tokenizer for r in german} == {rollups.PIECES} and sum(r.n_docs for r in german) == 2


def test_unfinished_batches_do_not_count(spark, odd, tmp_path):
    store = rollups.Rollup(spark, str(tmp_path / "r"))
    batch = rollups.signed(odd, 1, rollups.count_tokens("text", rollups.WORDS), rollups.WORDS)
    store.commit("a", batch)
    want = sorted(map(tuple, store.totals().collect()), key=str)
    store.commit("b", batch)
    (tmp_path / "r" / "batch=b" / "_SUCCESS").unlink()
    assert sorted(map(tuple, store.totals().collect()), key=str) == want
    assert store.commit("b", rollups.signed(odd, -1, rollups.count_tokens("text", rollups.WORDS), rollups.WORDS))
    assert store.totals().isEmpty()


def test_preference_pairs_of_every_conversation(spark):
    turns = [("b", 1, "user", "q"), ("b", 2, "assistant", "r"), ("a", 1, "user", "only"), ("c", 1, "assistant", "s"),
             ("c", 2, "user", "late")]
    df = spark.createDataFrame(turns, "conv_id string, turn int, role string, text string")
    out = {r.pair_id: r for r in preference.format_pairs(preference.sampled_pairs(df)).collect()}
    assert set(out) == {"a", "b", "c"}
    assert out["a"].tied and out["a"].prompt == "<|user|>\nonly<|end|>\n" and out["a"].chosen == ""
    assert "s" in out["b"].rejected and "r" in out["c"].rejected


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = queries.table(spark, SF, "documents")
    all_docs = {r.doc_id: r for r in docs.collect()}
    out = P.run(spark, SF).orderBy("start").collect()
    kept = [r.doc_id for r in out]
    model = language.learn(docs)
    known = {r._0 for r in language.identify(docs, model).filter("lang_pred <> 'und'").collect()}
    group = classes([(d, all_docs[d].text) for d in sorted(known)])
    single = [d for d in sorted(known) if group[d] == d]
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = {d for d, n, h, _ in contaminated([(d, all_docs[d].text) for d in single], items) if not (h and 20 * h >= n)}
    assert set(kept) == clean and len(kept) == len(clean)
    places = mixing.positions(docs.filter(F.col("doc_id").isin(list(clean))), queries.SHARES)
    assert kept == [r._row.doc_id for r in places.orderBy("_position").collect()]


def test_small_batches_bound_the_bytes_and_keep_a_smaller_setting(spark):
    from panelforge.llm.graph import small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["b"])

    before = spark.conf.get(key)
    try:
        small_batches(spark)
        rows = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("t"))
        got = [r.b for r in rows.mapInArrow(sizes, "b long").collect()]
        assert len(got) > 5 and max(got) < 5 << 20
        spark.conf.set(key, "1m")
        small_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
