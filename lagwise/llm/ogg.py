"""Operator 4: media columns in Ogg (RFC 3533).

A payload is stored as 8-bit samples in packets of one logical stream, interleaved with a second
stream that describes it. Reading verifies each page's checksum, reassembles packets from lacing
values across pages, demultiplexes by serial number, checks page order, and derives each packet's
time from the granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
PACKET = 4096
UNIT = 64
_SAMPLES, _NOTES = 0x53414D50, 0x4E4F5445
_HEAD = struct.Struct("<4sBBqIIIB")
_MAGIC = b"PCM8"
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_NONE = -1
BATCH_BYTES = 16 << 20


def checksum(page: bytes) -> int:
    """Ogg's CRC (polynomial 04C11DB7, no reflection, no inversion) from zlib's reflected one over bit-reversed bytes."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    def head(crc: int) -> bytes:
        return _HEAD.pack(b"OggS", 0, flags, granule, serial, number, crc, len(lacing)) + lacing

    return head(checksum(head(0) + body)) + body


def _stream(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[bytes]:
    """Pages of one logical stream of (packet, granule at its end); the first packet has a page of its own."""
    number, lacing, body, granule, continued = 0, bytearray(), bytearray(), _NONE, False

    def flush(last: bool) -> bytes:
        nonlocal number, granule, continued
        out = _page(serial, number, continued | (number == 0) << 1 | last << 2, granule, bytes(lacing), bytes(body))
        number, granule = number + 1, _NONE
        lacing.clear()
        body.clear()
        return out

    for k, (packet, end) in enumerate(packets):
        values = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        at = 0
        for i in range(0, len(values)):
            lacing.append(values[i])
            body += packet[at : at + values[i]]
            at += values[i]
            ended = i == len(values) - 1
            if ended:
                granule = end
            final = ended and k == len(packets) - 1
            if len(lacing) == 255 and not final or ended and k == 0 and not final:
                yield flush(False)
                continued = not ended
        if k == len(packets) - 1:
            yield flush(True)


def write_media(payload: bytes, note: bytes, rate: int = RATE) -> bytes:
    """One file: the samples' stream and that of ``note``, its pages interleaved."""
    data = [(_MAGIC + struct.pack("<IQ", rate, len(payload)), 0)]
    data += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    samples, notes = _stream(_SAMPLES, data), _stream(_NOTES, [(b"NOTE", 0), (note, len(payload))])
    out = [next(samples), next(notes)]  # first pages first, as the format asks
    for page in samples:
        out.append(page)
        if (other := next(notes, None)) is not None:
            out.append(other)
    return b"".join([*out, *notes])


@dataclass
class Stream:
    pages: int = 0
    ended: bool = False
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page where a packet ends, for its last packet only
    rest: bytearray | None = None


def read_streams(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises ValueError on damage."""
    out: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        try:
            magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        except struct.error:
            raise ValueError("a page is cut off") from None
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or len(lacing) < n or end > len(media):
            raise ValueError("not a whole Ogg page")
        page = media[at:end]
        if checksum(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError("wrong page checksum")
        if (flags & 2 > 0) != (serial not in out):
            raise ValueError("a stream must begin once")
        s = out.setdefault(serial, Stream())
        if number != s.pages or s.ended or (flags & 1 > 0) != (s.rest is not None):
            raise ValueError("pages of a stream are lost or out of order")
        s.pages, s.ended = s.pages + 1, flags & 4 > 0
        spot, part, done = at + 27 + n, s.rest if s.rest is not None else bytearray(), 0
        begun = s.rest is not None
        for value in lacing:
            part += media[spot : spot + value]
            spot, begun = spot + value, True
            if value < 255:
                s.packets.append(bytes(part))
                s.granules.append(_NONE)
                part, begun, done = bytearray(), False, done + 1
        s.rest = part if begun else None
        if done:
            s.granules[-1] = granule
        elif granule != _NONE:
            raise ValueError("a granule position without the end of a packet")
        at = end
    if any(not s.ended or s.rest is not None for s in out.values()):
        raise ValueError("a stream does not end")
    return out


def sample_times(s: Stream) -> list[tuple[int, int]]:
    """(first, end) sample of each data packet: counted back from the granule position of the page where it ends."""
    times, end = [], None
    for packet, granule in zip(reversed(s.packets[1:]), reversed(s.granules[1:]), strict=True):
        if granule != _NONE:
            if end is not None and end != granule:
                raise ValueError("granule positions contradict the packets")
            end = granule
        times.append((end - len(packet), end))
        end -= len(packet)
    if end:
        raise ValueError("samples are missing before the first packet")
    return times[::-1]


def read_media(media: bytes) -> tuple[bytes, bytes, list[tuple[float, float]], dict[int, Stream]]:
    """(payload, note, packet times in seconds, streams)."""
    streams = read_streams(media)
    samples, notes = streams[_SAMPLES], streams[_NOTES]
    head = samples.packets[0]
    rate, length = struct.unpack("<IQ", head[4:])
    payload = b"".join(samples.packets[1:])
    if head[:4] != _MAGIC or len(payload) != length:
        raise ValueError("the samples are not whole")
    return payload, notes.packets[1], [(a / rate, b / rate) for a, b in sample_times(samples)], streams


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def _batches(rows: Iterator[tuple], kinds: dict[str, pa.DataType], weigh: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weigh] or b"")
        if size > BATCH_BYTES or len(held) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], list(kinds))


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each whole text (null: empty), padded by zeros to a positive multiple of 64 bytes, as an Ogg file."""

    def run(batches):
        def rows():
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    raw = (text or "").encode()
                    yield i, write_media(padded(raw), struct.pack("<Q", len(raw)))

        yield from _batches(rows(), {"id": pa.int64(), "media": pa.large_binary()}, 1)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, media binary")


_FEATURES = {"id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "seconds": pa.float64()}


def media_features(media: DataFrame) -> DataFrame:
    """Read stored files back and describe them. ``feature``: pages, packets, streams, mean, root mean square, sign changes, distinct values."""

    def run(batches):
        def rows():
            for batch in batches:
                for i, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    payload, note, times, streams = read_media(stored)
                    x = np.frombuffer(payload, np.uint8)
                    level = x.astype(np.int64) - 128
                    changes = int(np.count_nonzero(np.diff(level >= 0)))
                    values = int(np.count_nonzero(np.bincount(x, minlength=256)))
                    pages, packets = sum(s.pages for s in streams.values()), sum(len(s.packets) for s in streams.values())
                    feature = f"pages={pages};packets={packets};streams={len(streams)};mean={level.mean():.6f};rms={np.sqrt((level * level).mean()):.6f};changes={changes};values={values}"
                    yield i, struct.unpack("<Q", note)[0], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, times[-1][1]

        yield from _batches(rows(), _FEATURES, 7)

    schema = "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double"
    return media.mapInArrow(run, schema)


def media_round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each whole text and describe what is read back; one row per row, a null id stays null, equal texts give equal values."""
    return media_features(encode_media(df, id_col, text_col)).withColumnRenamed("id", id_col)
