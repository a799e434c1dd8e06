"""Filter audit, WARC archives and conversation repair against plain Python, and on odd input."""

import gzip
import hashlib
import itertools
import os
import re
import zlib
from base64 import b32encode
from collections import Counter, defaultdict
from fractions import Fraction
from functools import lru_cache
from math import factorial

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.llm import audit, queries, repair, warc
from panelforge.session import scratch_path

SF = "/root/testdata/sf0.001"
VISIBLE = r"[^\x20\x09-\x0D]"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- filter audit -----------------------------------------------------------------------------


def fails_of(docs):
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(VISIBLE + "+", text)
        yield i, lang or "", {
            c
            for c, bad in {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": re.search(r"[#$%&*|]", text) is not None,
                "E": i is not None and i > least[text],
            }.items()
            if bad
        }


def audited_plainly(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = defaultdict(list)
    for i, part, failed in fails_of(docs):
        rows[part].append((i, failed))
    out = Counter()
    for part, group in rows.items():
        shapley, table = Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = group
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                shapley[f] += len(gone)
                left = [r for r in left if f not in r[1]]
                table.append((order, k + 1, f, len(left), gone))
        for order, step, f, kept, gone in table:
            fails = sum(f in s for _, s in group)
            out[
                part, "".join(order), step, kept, len(gone), fails - len(gone), sum(s == {f} for _, s in group),
                sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), shapley[f],
            ] += 1
    return out


def audit_of(spark, docs, labels, extra=()):
    d = spark.createDataFrame([(*r, *[1] * len(extra)) for r in docs], "doc_id long, text string, lang string"
                              + "".join(f", {c} int" for c in extra))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    text = F.coalesce("text", F.lit(""))
    flags = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return audit.filter_audit(d, lab, audit.text_filters(text), "E", flags)


def test_audit_equals_running_every_order(spark):
    long = " ".join(f"w{i}" for i in range(250))
    docs = [
        (1, long, "en"), (2, long, "en"), (3, long + " #", "en"), (3, long + " #", "en"), (4, "A B C", "en"),
        (5, "a " * 300, "de"), (6, "a " * 300, "de"), (7, None, None), (8, "", ""), (None, long, "en"),
        (None, None, "fr"), (9, "x" * 200_000, "fr"), (10, long.upper(), "en"), (11, long, "de"), (0, "A B C", "it"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    got = audit_of(spark, docs, labels, ("mask", "n", "digest", "part", "good", "v"))
    assert rows_of(got) == audited_plainly(docs, labels)
    assert got.count() == 600 * 5


def test_audit_of_nothing(spark):
    assert audit_of(spark, [], []).count() == 0
    none = audit_of(spark, [(1, "a", "en")], [])
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


@pytest.mark.parametrize("n", [2, 3, 5])
def test_shapley_weights_are_those_of_all_orders(n):
    weights, divisor = audit.shapley_weights(n)
    for i in range(n):
        want = [Fraction(0)] * (1 << n)
        for order in itertools.permutations(range(n)):
            before = sum(1 << x for x in order[: order.index(i)])
            want[before] -= Fraction(1, factorial(n))
            want[before | 1 << i] += Fraction(1, factorial(n))
        want[0] = Fraction(0)  # nothing is removed by no filter
        assert [Fraction(w, divisor) for w in weights[i]] == want


# --- archives ---------------------------------------------------------------------------------


def b32(data):
    return b32encode(hashlib.sha1(data).digest()).decode()


def paged(pages):
    """(page_id, bytes, digest, type, refers_to) of every page."""
    last = {}
    for i, _, html in pages:
        key = (html or "").encode()
        last[key] = max((x for x in (i, last.get(key)) if x is not None), default=None)
    out = Counter()
    for i, _, html in pages:
        data = (html or "").encode()
        own = last[data] == i
        out[i, len(data), b32(data), "response" if own else "revisit", None if own else last[data]] += 1
    return out


def odd_pages():
    big = "".join(chr(0x4E00 + i * 7919 % 20000) for i in range(200_000))
    return [
        (1, "http://a.example/x y?q=é", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b.example/", None),
        (4, "u", ""), (4, "u", ""), (5, "u\r\nWARC-Type: evil", big), (6, "v", big), (None, "n", "<p>one</p>"),
        (None, "n", "alone"), (7, "z", "\r\n\r\nWARC/1.1\r\n\0\0"), (-8, "neg", "same"), (-9, "neg", "same"),
    ]


def write(spark, pages, **options):
    df = spark.createDataFrame([(*p, "x", True) for p in pages],
                               "page_id long, url string, html string, target string, hot boolean")
    path = scratch_path(spark, "test-warc")
    warc.write_warc(df, path, **options)
    return path


@pytest.mark.parametrize("archive_bytes", [1, 1000, 64 << 20])
def test_archives_come_back(spark, archive_bytes):
    pages = odd_pages()
    found = warc.read_warc(spark, write(spark, pages, archive_bytes=archive_bytes), strict=True)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(found.select(*names)) == paged(pages)
    whole = warc.with_payloads(found).select("page_id", "payload").collect()
    want = Counter((i, (h or "").encode()) for i, _, h in pages)
    assert Counter((r.page_id, bytes(r.payload)) for r in whole) == want
    urls = {r.page_id: r.url for r in found.filter("page_id in (1, 2, 5)").collect()}
    assert urls == {1: "http://a.example/x%20y?q=%C3%A9", 2: None, 5: "u%0D%0AWARC-Type:%20evil"}


def test_small_payloads_may_all_be_responses(spark):
    found = warc.read_warc(spark, write(spark, odd_pages(), revisit_least=11), strict=True)
    kinds = {(r.page_id, r.record_type) for r in found.collect()}
    assert (2, "response") in kinds and (1, "response") in kinds and (5, "revisit") in kinds


def test_every_record_is_a_gzip_member_that_others_can_read(spark):
    path = write(spark, odd_pages())
    n = 0
    for name in os.listdir(path):
        if not name.startswith("part-"):
            continue
        data = open(f"{path}/{name}", "rb").read()
        text = gzip.decompress(data)
        while data:
            one = zlib.decompressobj(31)
            body = one.decompress(data)
            assert one.eof and body.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
            head, _, rest = body.partition(b"\r\n\r\n")
            assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(rest) - 4
            n += b"WARC-Type: re" in head
            assert text.startswith(body)
            text, data = text[len(body) :], one.unused_data
        assert not text
    assert n == len(odd_pages())


def test_a_record_of_more_than_16_mb(spark):
    noise = hashlib.shake_128(b"x").hexdigest(9_000_000)
    pages = [(1, "a", noise), (2, "b", "small"), (3, "c", noise)]
    found = warc.read_warc(spark, write(spark, pages), payloads=False, strict=True)
    assert rows_of(found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == paged(pages)


def test_no_pages(spark):
    assert warc.read_warc(spark, write(spark, [])).count() == 0


def test_damage_is_named_and_other_records_stay():
    members = [warc.record(i, "u", b"<p>%d</p>" % i * 50, None, False) for i in range(3)]
    good = [r[1] for r in warc.records(b"".join(members))]
    assert good == [0, 1, 2]
    faults = lambda data: [(r[1], r[6]) for r in warc.records(data)]
    assert faults(b"".join(members)[:-20]) == [(0, None), (1, None), (None, "gzip")]
    plain = zlib.decompress(members[1], 31)
    pack = lambda b: gzip.compress(b, mtime=0)
    changed = pack(plain.replace(b"<p>1</p>", b"<p>7</p>", 1))
    assert faults(members[0] + changed + members[2]) == [(0, None), (1, "digest"), (2, None)]
    longer = pack(plain.replace(b"Content-Length: 4", b"Content-Length: 9", 1))
    assert faults(longer + members[2])[0][1] in ("length", "digest")
    two = pack(plain + plain)
    assert faults(two) == [(None, "length")]
    assert faults(pack(b"no archive")) == [(None, "head")] or faults(pack(b"no archive"))[0][1] == "head"
    assert faults(b"not gzip") == [(None, "gzip")]


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=3000), st.one_of(st.none(), st.text(max_size=20)), st.integers(-5, 1 << 40))
def test_any_payload_comes_back(payload, url, i):
    url = url if url is None else url.encode("utf-8", "ignore").decode()
    (row,) = warc.records(warc.record(i, url, payload, None, False))
    assert (row[0], row[1], row[4], row[5], row[6], row[7]) == ("response", i, len(payload), b32(payload), None, payload)


# --- conversations ----------------------------------------------------------------------------


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def ordered(rows):
    md5 = lambda t: hashlib.md5(t.encode()).digest()
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), md5(r[3])))


def faults_plainly(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = re.findall(VISIBLE, text)
        if not visible:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("ok" if visible[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """(cost, audit, repaired turns): the least by recursion over positions and the roles so far."""

    @lru_cache(maxsize=None)
    def best(i, last, inserted):
        found = []
        made = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            _, _, role, text = rows[i]
            cut = int(faults[i] == "truncated")
            cost, rest, turns = best(i + 1, last, 0)
            found.append((3 + cost, "D" + rest, turns))
            if faults[i] not in ("blank", "duplicate"):
                after = (last, role[:1])
                if after in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    cost, rest, turns = best(i + 1, role[:1], 0)
                    found.append((cut + cost, "K" + rest, ((role, text), *turns)))
                cost, rest, turns = best(i + 1, made[0], 0)
                found.append((2 + cut + cost, "R" + rest, ((made, text), *turns)))
        if inserted < 3:
            cost, rest, turns = best(i, made[0], inserted + 1)
            found.append((2 + cost, "I" + rest, ((made, ""), *turns)))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def repaired_plainly(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damaged_plainly(rows):
        groups[r[0]].append(r)
    out, turns = Counter(), {}
    for conv, group in groups.items():
        group = ordered(group)
        faults = faults_plainly(group)
        cost, audit_, turns[conv] = cheapest(tuple(group), tuple(faults))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns[conv]))
        at = [r[1] for r in group if r[1] is not None]
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        marks = [r[2][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns[conv]).encode()).hexdigest()
        count = Counter(faults)
        key = (conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit_, digest)
        out[key] += 1
    return out, turns


TALK = "conv_id long, turn long, role string, text string"


def talk(spark, rows, extra=False):
    if not extra:
        return spark.createDataFrame(rows, TALK)
    names = "copies int, kind string, at int, audit string"
    return spark.createDataFrame([(*r, 5, "x", 7, "y") for r in rows], f"{TALK}, {names}")


def test_repair_of_the_given_conversations(spark):
    rows = [tuple(r) for r in queries.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op13_conversation_repair(spark, SF)) == repaired_plainly(rows)[0]


def many_rows(n, convs, seed):
    import random

    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "s"]
    texts = ["a.", "b", "c!", "", " \n", None, "d?  ", "e ", "é.", "f.g"]
    out = []
    for _ in range(n):
        conv = rng.choice([*range(convs), None] if rng.random() < 0.6 else [0])
        text = rng.choice(texts)
        text = f"{rng.randrange(200)}{text}" if text and rng.random() < 0.7 else text
        turn = rng.choice([None, *range(40)]) if rng.random() < 0.3 else rng.randrange(1000)
        out.append((conv, turn, rng.choice(roles), text))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_repair_of_odd_conversations_in_any_chunks(spark, chunk):
    rows = many_rows(500, 12, chunk) + [(77, 5, "user", "twice")] * 3 + [(78, None, "system", "x" * 100_000)]
    want, turns = repaired_plainly(rows)
    found = repair.damaged(talk(spark, rows, extra=True))
    assert rows_of(repair.repair(found, chunk)) == want
    if chunk == 3:
        got = defaultdict(dict)
        for r in repair.repaired(found, chunk).collect():
            got[r.conv_id][r.position] = (r.role, r.text)
        assert {c: [t[k] for k in sorted(t)] for c, t in got.items()} == {c: list(t) for c, t in turns.items() if t}


@pytest.mark.parametrize("roles", [["user"], ["assistant"], ["user", "assistant"], ["system"]])
def test_one_long_conversation_of_any_parity(spark, roles):
    rows = [(1, k, roles[k % len(roles)], f"t{k}.") for k in range(150)]
    rows += [(1, 1000 + k, "user", "again.") for k in range(60)]
    assert rows_of(repair.repair(repair.damaged(talk(spark, rows)), 4)) == repaired_plainly(rows)[0]


def test_repair_of_nothing(spark):
    assert repair.repair(repair.damaged(talk(spark, []))).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"1:{k}".encode()) % 20 == 0)
    row = repair.repair(repair.damaged(talk(spark, [(1, gone, "user", "a")]))).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 4, 5, 6, 7, 8]), max_size=9), st.integers(1, 9))
def test_chunks_give_the_least_audit(codes, cut):
    """Backward vectors cut anywhere and stitched give the audit of plain recursion."""
    names = {0: "s", 1: "u", 2: "a", 3: "x"}
    rows = tuple((1, i, names.get(c & 3, ""), f"{i}") for i, c in enumerate(codes))
    faults = tuple("blank" if c == 8 else "truncated" if c & 4 else "ok" for c in codes)
    parts = [bytes(codes[k : k + cut]) for k in range(0, len(codes), cut)] or [b""]
    after = [repair.FINAL]
    for part in reversed(parts[1:]):
        after.insert(0, repair._backward(part, after[0])[0])
    state, audits, cost = repair.START, "", 0
    import numpy as np

    for i, part in enumerate(parts):
        audit_, state, own = repair.trace(part, np.ones(len(part)), after[i], state, i == len(parts) - 1)
        audits, cost = audits + audit_, cost + own
    assert (cost, audits) == cheapest(rows, faults)[:2]
