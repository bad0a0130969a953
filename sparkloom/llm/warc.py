"""Operator 8: WARC archives, written with revisits and read back with salvage.

The writer makes each record a gzip member of its own (or plain text); the reader
also takes members of several records, and plain records among members. It checks
every record: member, version line, header, length, end and block digest. After a
failed check it looks for the next gzip header or version line that begins a valid
record, logs the bytes between as a gap and goes on, so damage costs only the
records it touches. Headers and records may be of any length.

Of pages with equal payloads of at least ``least`` bytes, that with the smallest
page_id becomes a response, the others revisits of it; smaller ones and pages with
a null page_id are responses. A revisit keeps the HTTP header, and with it the
payload's length, but not the payload.

Defined cases: a null html is an empty payload; rows that repeat a smallest page_id
are responses too; a null url becomes a name of the page; an empty table gives no
archive; further columns are ignored. A task holds one archive of about
``archive_bytes`` (or one larger record).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.blobs import read_blob, spread_files, write_blob
from sparkloom.storage import written

VERSION, MAGIC = b"WARC/1.", b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
ARCHIVE_BYTES = 1 << 25
READ = "kind string, path string, offset long, length long, reason string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = "none" if page_id is None else page_id
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{PAGE}{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"{PAGE}{name}",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": f"<{PAGE}{refers_to}>", "WARC-Profile": PROFILE}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def with_referrals(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses). Only the digests that repeat are joined back; Spark broadcasts them if few, else splits hot ones."""
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    repeated = keyed.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n")).where("n > 1").drop("n")
    joined = keyed.join(written(repeated, "digests"), "digest", "left")
    return joined.select("page_id", "url", "payload", F.when((F.col("page_id") != F.col("first")) & (F.octet_length("payload") >= least), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes archives into ``folder``; the manifest of those that finished tasks wrote: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, raw = [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal parts, size, raw
            path = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' * compress}"  # of this attempt; the manifest names those that count
            n = write_blob(path, *parts)
            row = {"path": [path], "records": [len(parts)], "bytes": [n]}
            parts, size, raw = [], 0, 0
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for page, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                data = record(page.as_py(), url.as_py(), payload.as_py().encode(), refers_to.as_py(), date)
                raw += len(data)
                if compress:
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(data) + packer.flush()
                parts.append(data)
                if raw >= archive_bytes:
                    yield close()
        if parts:
            yield close()

    return written(with_referrals(pages, least).mapInArrow(run, "path string, records long, bytes long"), "archives")


def _member(data: memoryview, start: int) -> tuple[bytes, int, bool] | None:
    """The text of the gzip member at ``start``, its end and whether it is whole, unless it doesn't begin with a record; of a damaged or short one, the text up to the damage and its place."""
    unpacker, at, out, size = zlib.decompressobj(31), start, [], 65_536
    while not unpacker.eof:
        piece = data[at : at + size]
        if not piece:  # cut short
            out.append(unpacker.flush())
            break
        before = unpacker.copy()
        try:
            out.append(unpacker.decompress(piece))
        except zlib.error:
            if size == 1:
                break
            unpacker, size = before, 1 if size <= 256 else 256  # what comes before the damage, step by step
            continue
        at += len(piece)
        head = b"".join(out[:64])[: len(VERSION)]
        if not VERSION.startswith(head):
            return None
    text = b"".join(out)
    return (text, at - len(unpacker.unused_data), unpacker.eof) if text.startswith(VERSION) else None


def _fields(head: bytes) -> dict[str, str] | None:
    """The header's fields by lower-case name; a line that begins with a blank continues the one before."""
    fields: dict[str, str] = {}
    name = None
    try:
        lines = head.decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        return None
    for line in lines:
        if line[:1] in (" ", "\t") and name is not None:
            fields[name] += f" {line.strip()}"
            continue
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return None
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def _record(text: bytes | memoryview, start: int) -> tuple[dict[str, str], bytes, int] | None:
    """Fields (names in lower case), block and end of the valid record at ``start``."""
    if bytes(text[start : start + len(VERSION)]) != VERSION:
        return None
    most = 4096  # fields are short as a rule; a longer look only where needed
    while True:
        head = bytes(text[start : start + most])
        end = head.find(b"\r\n\r\n")
        if end >= 0:
            break
        if start + most >= len(text):
            return None
        most *= 16
    if (fields := _fields(head[:end])) is None:
        return None
    size = fields.get("content-length", "")
    if not size.isdecimal():
        return None
    at = start + end + 4
    block = bytes(text[at : at + int(size)])
    stop = at + int(size) + 4
    if len(block) != int(size) or bytes(text[stop - 4 : stop]) != b"\r\n\r\n":
        return None
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said != f"sha1:{digest(block)}":
        return None
    return fields, block, stop


#: Marks a record out of a damaged member.
DAMAGED = {"in a damaged member": "yes"}


def _sound(fields: dict[str, str], block: bytes) -> bool:
    """Whether a record of a damaged member has digests, and all of them hold as far as they can be compared."""
    said = fields.get("warc-block-digest"), fields.get("warc-payload-digest")
    if said[0] != f"sha1:{digest(block)}" or not fields.get("warc-record-id", "").startswith("<"):
        return False
    if fields.get("warc-type") == "revisit":
        return said[1] is None or re.fullmatch("sha1:[A-Z2-7]{32}", said[1]) is not None
    return said[1] in (None, f"sha1:{digest(block.partition(b"\r\n\r\n")[2])}")


def _found(view: memoryview, at: int) -> tuple[list[tuple[dict[str, str], bytes] | None], int, bool] | None:
    """The records that begin at ``at``, plain or as a gzip member of one or more, their end, and whether they are whole; None stands for damage between a member's records."""
    if bytes(view[at : at + len(MAGIC)]) != MAGIC:
        got = _record(view, at)
        return got and ([got[:2]], got[2], True)
    if not (member := _member(view, at)):
        return None
    text, end, whole = member
    inner = [None if kind == "gap" or not (whole or _sound(fields, block)) else (fields if whole else fields | DAMAGED, block) for kind, _, _, fields, block in salvage(text)]
    return (inner, end, whole) if any(inner) else None


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes]]:
    """("record" or "gap", start, end, fields, block) for all bytes of an archive, in order.

    Records and gaps of one gzip member all have the member's place, of a damaged one
    up to the damage; behind that is a gap, an empty one where nothing is left of it.
    """
    view = memoryview(data)
    ahead = dict.fromkeys((MAGIC, VERSION), -1)  # the next place of each, once it is looked for
    at = bad = 0
    whole = True
    while at < len(data):
        if found := _found(view, at):
            if bad < at or not whole:
                yield "gap", bad, at, {}, b""
            for got in found[0]:
                yield ("record", at, found[1], *got) if got else ("gap", at, found[1], {}, b"")
            at = bad = found[1]
            whole = found[2]
            continue
        for sign, place in ahead.items():
            if place <= at:
                place = data.find(sign, at + 1)
                ahead[sign] = place if place >= 0 else len(data)
        at = min(ahead.values())
    if bad < len(data) or not whole:
        yield "gap", bad, len(data), {}, b""


def _page(name: str | None) -> int | None:
    inner = (name or "").strip("<>").removeprefix(PAGE)
    return int(inner) if inner.lstrip("-").isdecimal() else None


def _rows(path: str, data: bytes) -> Iterator[tuple]:
    """Rows of READ for an archive."""
    for kind, start, end, fields, block in salvage(data):
        if kind == "gap":
            yield kind, path, start, end - start, "no valid record begins here", None, None, None, None, None, None
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        revisit = fields.get("warc-type") == "revisit"
        said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
        lengths = [int(v) for line in head.split(b"\r\n") if (v := line.lower().removeprefix(b"content-length: ")) != line.lower() and v.isdigit()]
        reason = None if revisit or said in (None, digest(payload)) else "the payload differs from its digest"
        if fields.keys() & DAMAGED.keys():
            reason = "its member is damaged, its digests hold"
        yield "record", path, start, end - start, reason, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), (lengths or [None])[0] if revisit else len(payload), said if revisit else digest(payload), fields.get("warc-type"), _page(fields.get("warc-refers-to"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])


def read_archives(manifest: DataFrame) -> DataFrame:
    """Rows of READ for the archives at ``path``: a record each, and the gaps that were passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield _batch(list(_rows(path, read_blob(path))))

    return spread_files(manifest).select("path").mapInArrow(run, READ)


def read_binary(files: DataFrame) -> DataFrame:
    """The same for archives that Spark reads itself: a DataFrame of its binaryFile source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield _batch(list(_rows(path, data.as_py())))

    return files.select("path", "content").mapInArrow(run, READ)
