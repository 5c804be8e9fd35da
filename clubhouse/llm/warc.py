"""Web archives: pages written as WARC records, and a reader that splits files.

A file is a sequence of gzip members, one record each: a ``warcinfo`` record,
then a ``response`` or a ``revisit`` per page. A revisit has no payload; it names
the record with the equal one. Records are named ``urn:page:<page_id>:<digest>``,
so that a name depends on nothing but the page.

Gzip members cannot be found by their length, so a task that reads a byte range
looks for the three bytes a member begins with, and takes a place for a record
only if what is there decodes to the head of a record, to the stated length, with
the right checksum, and is followed by another member or the end of the file. It
owns the records that begin inside its range, wherever they end.

Of an archive whose payload holds another archive uncompressed, a range that
begins inside that payload would find the inner records; text cannot do that, as
the bytes of a member's head are not UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clubhouse.llm.tokenfiles import open_folder
from clubhouse.operators.joins import lookup
from clubhouse.session import written

#: A file is closed when it holds this many bytes; a task reads this many.
FILE_BYTES = 1 << 30
SPLIT_BYTES = 16 << 20
#: Bytes read and decoded at once, and the longest head of a record.
_STEP = 1 << 16
_LONGEST_HEAD = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = re.compile(r"<urn:page:(-?\d*):[A-Z2-7]*>")

MANIFEST = "path string, records long, bytes long"
RECORDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, date string,"
    " page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record(fields: dict[str, object], block: bytes, level: int) -> bytes:
    """One record as a gzip member; fields without a value are left out."""
    lines = [f"{name}: {value}" for name, value in fields.items() if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _uri(url: str | None) -> str | None:
    """A URL as it may stand in a header line: white space and controls escaped."""
    return url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_record(
    page_id: int | None, url: str | None, payload: bytes, first: int | None, is_first: bool, date: str, level: int = 6
) -> bytes:
    """The response of a page, or its revisit of the page ``first`` with the same payload."""
    digest = base32_sha1(payload)

    def name(page: int | None) -> str:
        return f"<urn:page:{'' if page is None else page}:{digest}>"

    fields = {
        "WARC-Type": "response" if is_first else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": _uri(url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Payload-Length": len(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    if not is_first:
        return _record(fields | {"WARC-Profile": _PROFILE, "WARC-Refers-To": name(first)}, b"", level)
    status = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return _record(fields, status.encode() + payload, level)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as archives; returns their manifest.

    A null html counts as empty. Of pages with equal payloads of ``least_bytes``
    or more, the one with the smallest page_id (nulls last) is a response and
    the others revisit it; rows that repeat that page_id are responses too. A null url
    leaves the record without a target. Other columns do not matter; no page
    gives no file. Every task writes under names of its own, and a row of the
    manifest is what makes a file count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = top = sink = path = None
        records = size = 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, payload, first, is_first in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is not None and size >= FILE_BYTES:
                    yield closed()
                    sink = None
                if sink is None:
                    if system is None:
                        system, top = open_folder(folder)
                        system.create_dir(top, recursive=True)
                    path = f"{top}/pages-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    sink = system.open_output_stream(path, compression=None)
                    about = {
                        "WARC-Type": "warcinfo",
                        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                        "WARC-Date": date,
                        "Content-Type": "application/warc-fields",
                    }
                    head = _record(about, b"format: WARC File Format 1.1\r\n", 6)
                    sink.write(head)
                    records, size = 1, len(head)
                data = page_record(page_id, url, payload, first, is_first, date)
                sink.write(data)
                records, size = records + 1, size + len(data)
        if sink is not None:
            yield closed()

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("key"),
    )
    # One row per payload that several pages have: copies are counted before they move.
    large = rows.where(F.length("payload") >= least_bytes).select("page_id", "key")
    repeated = (
        large.groupBy("key")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1")
        .select("key", "first", F.lit(True).alias("again"))
    )
    told = lookup(rows, repeated, ["key"], keys_from=rows.select("key"))
    is_first = F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    ready = told.select("page_id", "url", "payload", "first", is_first.alias("is_first"))
    return written(ready.mapInArrow(run, MANIFEST))


class _Source:
    """Byte ranges of an open file, a bounded piece in memory at a time."""

    def __init__(self, file):
        self._file, self.size = file, file.size()
        self._data, self._base = b"", 0

    def at(self, place: int, n: int = _STEP) -> bytes:
        """Up to n bytes from a place; fewer only at the end of the file."""
        n = min(n, self.size - place)
        if place < self._base or place + n > self._base + len(self._data):
            self._base = place
            self._data = self._file.read_at(max(0, min(max(n, 64 * _STEP), self.size - place)), place)
        return self._data[place - self._base : place - self._base + n]

    def next_magic(self, place: int, end: int) -> int | None:
        """The first place from here, before ``end``, where a member could begin."""
        while place < end:
            piece = self.at(place, _STEP + len(_MAGIC) - 1)
            found = piece.find(_MAGIC)
            if found >= 0:
                return place + found if place + found < end else None
            place += _STEP
        return None


class _NoRecord(Exception):
    """There is no record at a place."""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise _NoRecord
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if v}


def _decoded(source: _Source, place: int) -> Iterator[bytes | int]:
    """The bytes of the member at a place, in pieces; at last the place after it."""
    unpack = zlib.decompressobj(31)
    while not unpack.eof:
        piece = source.at(place) if place < source.size else b""
        if not piece:
            raise _NoRecord
        place += len(piece)
        while piece and not unpack.eof:
            try:
                yield unpack.decompress(piece, 1 << 20)
            except zlib.error:
                raise _NoRecord from None
            piece = unpack.unconsumed_tail
    yield place - len(unpack.unused_data)


def read_record(source: _Source, place: int, payload: bool = False) -> tuple[dict, int]:
    """The record that begins at a place, and the place after it.

    Raises _NoRecord where none begins, and ValueError if one does but is
    damaged. The payload is decoded piece by piece and kept only if asked for.
    """
    pieces = _decoded(source, place)
    head = b""
    while (cut := head.find(b"\r\n\r\n")) < 0:
        if len(head) > _LONGEST_HEAD or not b"WARC/".startswith(head[:5]):
            raise _NoRecord
        more = next(pieces)
        if isinstance(more, int):
            raise _NoRecord
        head += more
    fields, rest = _fields(head[:cut]), head[cut + 4 :]
    if not fields.get("content-length", "").isdecimal() or "warc-type" not in fields:
        raise _NoRecord
    try:
        body = _read_body(fields, rest, pieces, payload)
    except _NoRecord:
        raise ValueError(f"the record at {place} is damaged") from None
    kind, end = fields["warc-type"], body.pop("end")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        length = fields.get("payload-length", "")
        body |= {"payload_bytes": int(length) if length.isdecimal() else None, "payload_digest": digest}
    elif digest not in (None, body["payload_digest"]):
        raise ValueError(f"the payload of the record at {place} does not have its digest")
    named = {key: _ID.fullmatch(fields.get(field, "")) for key, field in _NAMES.items()}
    return body | {
        "offset": place,
        "record_type": kind,
        "record_id": fields.get("warc-record-id"),
        "target_uri": fields.get("warc-target-uri"),
        "date": fields.get("warc-date"),
        **{key: int(found[1]) if found and found[1] else None for key, found in named.items()},
    }, end


_NAMES = {"page_id": "warc-record-id", "refers_to": "warc-refers-to"}


def _read_body(fields: dict[str, str], rest: bytes, pieces: Iterator[bytes | int], keep: bool) -> dict:
    """Size and digest of the payload, which follows the HTTP head if there is one."""
    left = int(fields["content-length"])
    in_head = left > 0 and fields.get("content-type", "").startswith("application/http")
    sha, size, kept, head, tail = hashlib.sha1(), 0, [], b"", b""
    while not isinstance(rest, int):
        block, tail = rest[:left], tail + rest[left:]
        left -= len(block)
        if in_head:
            head += block
            cut = head.find(b"\r\n\r\n")
            in_head = cut < 0
            block = b"" if in_head else head[cut + 4 :]
        sha.update(block)
        size += len(block)
        if keep:
            kept.append(block)
        rest = next(pieces)
    if left or tail != b"\r\n\r\n" or in_head:
        raise _NoRecord
    digest = base64.b32encode(sha.digest()).decode()
    return {"payload_bytes": size, "payload_digest": digest, "payload": b"".join(kept) if keep else None, "end": rest}


def records_of(file, begin: int, end: int, payload: bool = False) -> Iterator[dict]:
    """The records of an open file that begin from ``begin`` up to before ``end``."""
    source = _Source(file)
    place, sure = begin, begin == 0
    while place is not None and place < min(end, source.size):
        try:
            if not sure and (place := source.next_magic(place, end)) is None:
                return
            found, after = read_record(source, place, payload)
            if not sure and after < source.size and source.at(after, 3) != _MAGIC:
                raise _NoRecord
        except _NoRecord:
            if sure:
                raise ValueError(f"no record at {place}") from None
            place += 1
            continue
        yield found
        # The next one begins where this one ends: nothing is searched for again.
        place, sure = after, True


def read(manifest: DataFrame, folder: str, payload: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives in a manifest (path, bytes): see RECORDS.

    Responses have the size and digest of what was read, and a digest that differs
    from the stated one is an error, as is a record that is cut off; revisits
    have those of the payload they stand for. Other columns of the manifest are
    ignored. An empty manifest gives no rows.
    """
    schema = RECORDS if payload else RECORDS.removesuffix(", payload binary")

    def batch(rows: list[dict], path: str) -> pa.RecordBatch:
        columns = [c.strip().split(" ") for c in schema.split(",")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        return pa.RecordBatch.from_pydict(
            {c: pa.array([path if c == "path" else r[c] for r in rows], kinds[k]) for c, k in columns}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for path, begin, end in zip(*(c.to_pylist() for c in given.columns)):
                system, _ = open_folder(folder)
                with system.open_input_file(path) as file:
                    waiting, held = [], 0
                    for row in records_of(file, begin, end, payload):
                        waiting.append(row)
                        held += len(row["payload"] or b"")
                        if len(waiting) == 4096 or held > 1 << 24:
                            yield batch(waiting, path)
                            waiting, held = [], 0
                    if waiting:
                        yield batch(waiting, path)

    begins = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = manifest.where("bytes > 0").select("path", F.explode(begins).alias("begin"))
    tasks = max(1, min(splits.count(), 100_000))
    spread = splits.repartition(tasks).select("path", "begin", (F.col("begin") + split_bytes).alias("end"))
    return spread.mapInArrow(run, schema)
