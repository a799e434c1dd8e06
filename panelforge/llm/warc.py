"""Pages as WARC archives, and archives as rows.

Writing. Every page is an HTTP response record in a gzip member of its own. Of the pages with equal
payloads the one with the largest id is the response; the others are `revisit` records, which hold the
HTTP head with the payload's length and digest, name the response in `WARC-Refers-To`, and no payload.
Each archive starts with a `warcinfo` record. Archives are written by Spark's own text sink, so a lost
task leaves nothing behind and any file system of Spark will do. The sink puts one byte behind each row,
here zero, and the last byte of a gzip member under 16 MB is zero (the high byte of its length), so a
row is a member without its last byte. A larger record is followed by a small `metadata` record in its row.

Reading. A file is read in sequence: zlib takes the compressed bytes in pieces of 64 kB and gives at most
256 kB at a time; the head of a record ends at an empty line, its block is as long as `Content-Length` says,
and the block and payload digests are computed on the way and compared. A member must hold one record,
ended by two line breaks. What is wrong with a record is its `fault` (`gzip`, `head`, `length`, `digest`);
the rest of a damaged file is one row with a fault, and other files are not touched.

Equal payloads are found by their digest: the largest id per digest is an aggregate, and the rows get it
by a join in which the most frequent digests, at most `HOTTEST`, are sent to all tasks; the digests left
are too rare to fill a task.

Nulls, ties and repeats: a null html is empty, a null url leaves the header out, a null page id is an
empty id that any other id is larger than. Rows that share the largest id of a payload are all
responses. Control characters, spaces and non-ASCII letters of a url are percent-encoded. An empty table
writes no archive, and a folder without archives gives no rows. A page of any length is one record.
"""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.graph import checkpointed

HOTTEST = 1024  # digests sent to all tasks
ARCHIVE_BYTES = 64 << 20  # html in an archive, about
_TAKE, _GIVE = 64 << 10, 256 << 10
_DATE = "2000-01-01T00:00:00Z"
_ID = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = (
    "record_type string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, fault string, payload binary"
)


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def with_targets(pages: DataFrame, revisit_least: int = 0) -> DataFrame:
    """`page_id`, `url`, `html` (bytes, never null) and `target`: the id of the response that holds the payload
    of a revisit, with `revisit` true; payloads under `revisit_least` bytes are all responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.cast("binary").alias("html"),
        F.unhex(F.sha1(html)).alias("digest"),
    )
    long_enough = F.octet_length("html") >= revisit_least
    groups = rows.filter(long_enough).groupBy("digest").agg(
        F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")
    )
    shared = checkpointed(groups.filter("n > 1"))
    hot = shared.orderBy(F.desc("n"), "digest").limit(HOTTEST).select(
        "digest", F.col("target").alias("hot"), F.lit(True).alias("is_hot")
    )
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # Rows whose target is known are placed by their own id, so a frequent digest fills no task.
    spread = F.concat(F.col("digest"), F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    marked = marked.withColumn("place", F.when(F.col("is_hot"), spread).otherwise(F.col("digest")))
    rest = shared.select(F.col("digest").alias("place"), F.col("target").alias("cold"))
    joined = marked.join(rest, "place", "left")
    # Null if the payload stands alone or all its ids are null.
    target = F.coalesce("hot", "cold")
    revisit = target.isNotNull() & ~target.eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", target.alias("target"), revisit.alias("revisit"))


def _member(kind: str, record_id: str, block: list[bytes], headers: list[tuple[str, str]], level: int) -> bytes:
    size = sum(map(len, block))
    sha = hashlib.sha1()
    for b in block:
        sha.update(b)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_DATE}",
        *[f"{k}: {v}" for k, v in headers],
        f"WARC-Block-Digest: sha1:{b32encode(sha.digest()).decode()}",
        f"Content-Length: {size}",
    ]
    # A header without name, time and extras, so that equal input gives equal bytes.
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = ("\r\n".join(lines) + "\r\n\r\n").encode()
    return b"".join([packer.compress(x) for x in (head, *block, b"\r\n\r\n")] + [packer.flush()])


def record(page_id, url, payload: bytes, target, revisit: bool, level: int = 6) -> bytes:
    """The gzip member of one page."""
    name = lambda x: f"{_ID}{'' if x is None else x}"
    headers = [("Content-Type", "application/http;msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    headers.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    http = _HTTP.format(len(payload)).encode()
    if revisit:
        headers += [("WARC-Refers-To", f"<{name(target)}>"), ("WARC-Profile", _PROFILE)]
        return _member("revisit", name(page_id), [http], headers, level)
    return _member("response", name(page_id), [http, payload], headers, level)


def _pieces(per_archive: int, level: int):
    """One row per page: its record without the zero byte that the sink puts behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("Content-Type", "application/warc-fields")]
        info = _member("warcinfo", "urn:archive", [b"format: WARC File Format 1.1\r\n"], fields, level)
        end = _member("metadata", "urn:end", [b""], fields, level)
        written = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                raw = (b"" if written % per_archive else info) + record(*row, level)
                raw = raw[:-1] if raw[-1] == 0 else raw + end[:-1]
                written += 1
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["piece"])

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    revisit_least: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    level: int = 6,
) -> None:
    """Write one record per row below the path, in archives of about `archive_bytes` of html."""
    size, rows = pages.agg(F.sum(F.octet_length("html")), F.count(F.lit(1))).first()
    per_archive = max(1, archive_bytes * rows // max(size or 0, 1))
    per_archive = min(per_archive, 1_000_000)
    raw = with_targets(pages, revisit_least).mapInArrow(_pieces(per_archive, level), "piece binary")
    # The cast keeps the bytes as they are, and the sink writes them so.
    sink = raw.select(F.col("piece").cast("string")).write.mode("errorifexists")
    sink.option("lineSep", "\0").option("maxRecordsPerFile", per_archive).text(path)


class Fault(Exception):
    """A record that is not as its head says; `args[0]` is the kind."""


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, data: memoryview, at: int):
        self._data, self._at = data, at
        self._unpacker = zlib.decompressobj(31)
        self._held = bytearray()

    def _more(self) -> bool:
        if self._unpacker.eof:
            return False
        pending = self._unpacker.unconsumed_tail
        if not pending:
            pending = self._data[self._at : self._at + _TAKE]
            self._at += len(pending)
        try:
            got = self._unpacker.decompress(pending, _GIVE)
        except zlib.error:
            raise Fault("gzip") from None
        if not got and not len(pending) and not self._unpacker.eof:
            raise Fault("gzip")  # the file ends inside the member
        self._held += got
        return True

    def line(self) -> bytes:
        while (cut := self._held.find(b"\r\n")) < 0:
            if len(self._held) > 1 << 20 or not self._more():
                raise Fault("head")
        out = bytes(self._held[:cut])
        del self._held[: cut + 2]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in parts."""
        while n:
            if not self._held and not self._more():
                raise Fault("length")
            part = bytes(self._held[:n])
            del self._held[: len(part)]
            n -= len(part)
            if part:
                yield part

    def close(self) -> int:
        """Read to the end of the member, which must hold the record's end alone; place behind it."""
        while self._more():
            if len(self._held) > 4:
                raise Fault("length")
        if self._held != b"\r\n\r\n":
            raise Fault("length")
        return self._at - len(self._unpacker.unused_data)


def _fields(member: _Member) -> dict[str, str]:
    found = {}
    while line := member.line():
        name, colon, value = line.partition(b":")
        if not colon:
            raise Fault("head")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def _number(text: str | None) -> int:
    if text is None or not text.isascii() or not text.isdigit():
        raise Fault("head")
    return int(text)


def _page(uri: str | None) -> int | None:
    body = (uri or "").strip("<>").removeprefix(_ID)
    return int(body) if body.removeprefix("-").isdigit() else None


def _parse(member: _Member, payloads: bool) -> tuple:
    if not member.line().startswith(b"WARC/"):
        raise Fault("head")
    head = _fields(member)
    block, body = hashlib.sha1(), hashlib.sha1()
    kept: list[bytes] = []
    left = _number(head.get("content-length"))
    http = head.get("content-type", "").startswith("application/http")
    size = 0
    opening = b""  # the HTTP head, until its empty line
    told = None
    for part in member.take(left):
        block.update(part)
        if http and told is None:
            opening += part
            cut = opening.find(b"\r\n\r\n")
            if cut < 0:
                if len(opening) > 1 << 20:
                    raise Fault("head")
                continue
            lines = opening[:cut].decode("latin-1").split("\r\n")[1:]
            told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            part = opening[cut + 4 :]
        size += len(part)
        body.update(part)
        if payloads:
            kept.append(part)
    if http and told is None:
        raise Fault("head")
    kind = head.get("warc-type", "")
    want = head.get("warc-payload-digest", "").removeprefix("sha1:")
    own = b32encode(body.digest()).decode()
    fault = None
    if head.get("warc-block-digest", "").removeprefix("sha1:") != b32encode(block.digest()).decode():
        fault = "digest"
    if kind == "response" and want != own:
        fault = "digest"
    if http:
        promised = _number(told.get("content-length"))
        if kind == "revisit":
            if size:
                fault = fault or "length"
            size = promised
        elif promised != size:
            fault = fault or "length"
    return (
        kind,
        _page(head.get("warc-record-id")),
        head.get("warc-target-uri"),
        _page(head.get("warc-refers-to")),
        size,
        want or own,
        fault,
        b"".join(kept) if payloads and kind != "revisit" else None,
    )


def records(data: bytes, payloads: bool = True) -> Iterator[tuple]:
    """Rows of `SCHEMA` for each record of an archive, in order, with the place behind the record."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = _Member(view, at)
        try:
            row = _parse(member, payloads)
            at = member.close()
        except Fault as fault:  # where the next record starts is not known
            yield (None, None, None, None, None, None, fault.args[0], None)
            return
        yield row


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_warc(spark: SparkSession, path: str, payloads: bool = True, strict: bool = False) -> DataFrame:
    """One row per record of all archives below the path (`SCHEMA`), `warcinfo` and `metadata` left out.

    `strict` makes a fault an error. Files are dealt to tasks whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for row in records(data.as_buffer(), payloads):
                    if strict and row[6]:
                        raise ValueError(f"damaged record: {row[6]}")
                    if row[0] in ("warcinfo", "metadata") and not row[6]:
                        continue
                    rows.append(row)
                    held += len(row[7] or b"")
                    if len(rows) >= 4096 or held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def with_payloads(found: DataFrame) -> DataFrame:
    """The records with each revisit's payload taken from the response it refers to.

    Responses are matched by id and digest; a revisit without its response keeps a null payload.
    """
    held = found.filter("record_type = 'response' and fault is null").select(
        F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload").alias("of_response")
    )
    once = held.dropDuplicates(["refers_to", "payload_digest"])
    joined = found.join(once, ["refers_to", "payload_digest"], "left")
    return joined.select(
        *[c for c in found.columns if c != "payload"],
        F.coalesce("payload", "of_response").alias("payload"),
    )
