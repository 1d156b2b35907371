"""Operator 2: WARC archives, written and read one record at a time.

Each record is one gzip member. The reader decompresses incrementally, frames each record by its
Content-Length, requires that record and member end together, and verifies block and payload digests.
Memory is bounded by one record. Archives lie in the shared folder; a task writes under a name of its
own and the manifest of finished tasks is a written table, so a repeated task leaves only an unread file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagwise.operators.graph import attach_group
from lagwise.plans.scratch import materialize, new_path

LEAST_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
BROADCAST_ROWS = 2_000_000
_DATE = "2024-01-01T00:00:00Z"  # a fixed value: equal input gives equal archives
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:lagwise:page:"


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["warc-type"]


def record_bytes(name: str, url: str | None, payload: bytes, refers_to: str | None = None, level: int = 6) -> bytes:
    """One gzip member: a response, or with ``refers_to`` a revisit, whose HTTP head still states the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NAME}{name}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_NAME}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _members(stream, size: int) -> Iterator[Iterator[bytes]]:
    """The decompressed chunks of each gzip member in turn; each must be read to its end before the next."""
    left = b""

    def chunks() -> Iterator[bytes]:
        nonlocal left
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            raw = left or stream.read(size)
            left = b""
            if not raw:
                raise ValueError("the archive ends inside a record")
            while raw and not unpack.eof:
                if out := unpack.decompress(raw, size):
                    yield out
                raw = unpack.unconsumed_tail
            left = unpack.unused_data

    while True:
        if not left:
            left = stream.read(size)
            if not left:
                return
        yield chunks()


def read_records(stream, size: int = 1 << 16) -> Iterator[Record]:
    """The records of an archive in order; raises ValueError at the first that is damaged."""
    for member in _members(stream, size):
        head = bytearray()
        while (end := head.find(b"\r\n\r\n")) < 0:
            if (more := next(member, None)) is None:
                raise ValueError("a record without the end of its header")
            head += more
        first, *lines = bytes(head[:end]).decode().split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", first):
            raise ValueError(f"not a WARC record: {first[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(headers["content-length"])
        body = head[end + 4 :]
        for more in member:
            body += more
            if len(body) > length + 4:
                break
        if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
            raise ValueError("the record's length is not its Content-Length")
        block = bytes(body[:length])
        http, _, payload = block.partition(b"\r\n\r\n")
        record = Record(headers, http, payload)
        if headers["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError("wrong block digest")
        if record.kind == "response" and headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
            raise ValueError("wrong payload digest")
        yield record


def with_targets(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, html, refers_to): of equal payloads of at least ``least`` bytes, all but those of the smallest id refer to it."""
    text = F.coalesce(F.col(payload_col), F.lit(""))
    digests = materialize(pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("bytes")), "digests")
    groups = attach_group(digests.where(F.col("bytes") >= least), ["sha"], F.col("id"), {"refers_to": F.min("id")}, {"refers_to": F.min("refers_to")})
    revisits = materialize(groups.where("id <> refers_to").select("id", "refers_to", "sha").distinct(), "revisits")
    few = revisits.count() <= BROADCAST_ROWS
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), text.alias("html"), F.sha2(text, 256).alias("sha"))
    return rows.join(F.broadcast(revisits) if few else revisits, ["id", "sha"], "left").select("id", "url", "html", "refers_to")


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (id, url, html, refers_to) into archives under ``folder``; the manifest: (path, records, bytes)."""

    def run(batches):
        files, base = fs.FileSystem.from_uri(folder)
        done, out, path, n = [], None, "", 0
        for batch in batches:
            for i, url, html, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    files.create_dir(base, recursive=True)
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, n = files.open_output_stream(path), 0
                out.write(record_bytes("null" if i is None else str(i), url, html.encode(), None if target is None else str(target)))
                n += 1
                if (size := out.tell()) >= archive_bytes:
                    out.close()
                    done.append((path.rpartition("/")[2], n, size))
                    out = None
        if out is not None:
            size = out.tell()
            out.close()
            done.append((path.rpartition("/")[2], n, size))
        names, counts, sizes = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    return materialize(rows.select("id", "url", "html", "refers_to").mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record: (id, url, record_type, refers_to, payload_bytes, payload_digest, payload); a revisit's payload is null."""
    kinds = {"id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def number(name: str) -> int | None:
        own = name.strip("<>").removeprefix(_NAME)
        return None if own == "null" else int(own)

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, own = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with files.open_input_stream(own) as stream:
                    for r in read_records(stream):
                        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", r.http)[1])
                        whole = r.payload if r.kind == "response" else None
                        target = r.headers.get("warc-refers-to")
                        rows.append((number(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), r.kind, number(target) if target else None, length, r.headers["warc-payload-digest"].removeprefix("sha256:"), whole))
                        held += len(whole or b"")
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    schema = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return manifest.repartition(files, "path").select("path").mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write one record per row, read the archives back: ``id_col, url, payload_bytes, payload_digest, record_type, refers_to``.

    A null payload is empty. Rows that repeat the smallest id of a group are all responses. A null
    id is written and read back as null; it refers to the group's smallest id never (its row is a
    response). An empty table gives no archive and no row. Other columns but ``url`` are ignored.
    """
    manifest = write_archives(with_targets(pages, id_col, payload_col), folder or new_path(pages.sparkSession, "warc"))
    return read_archives(manifest).select(F.col("id").alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
