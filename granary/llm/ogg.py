"""Media columns in Ogg: payloads as 8-bit samples in one logical stream, block checksums in another.

The writer cuts a payload into packets of 576 samples and interleaves their pages with those of a second
logical stream, which holds one packet (position, crc32) for each page of samples. The reader takes any
multiplexed physical stream: it verifies each page's checksum, joins packets over lacing values and
pages, parts logical streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import whole_text

PACKET, RATE = 576, 8000
SAMPLES, MARKS = 1, 2
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's checksum: polynomial 0x04c11db7, most significant bit first, from 0.

    It is the mirror image of zlib's crc over mirrored bytes, started at 0 and without the last inversion.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    return head[:22] + struct.pack("<I", page_crc(head + body)) + head[26:] + body


def lace(size: int) -> bytes:
    """Lacing values of a packet: 255 for each full segment, then one below 255."""
    return b"\xff" * (size // 255) + bytes([size % 255])


def write(payload: bytes) -> bytes:
    packets = [struct.pack("<4sII", b"PCM8", RATE, PACKET)] + [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    per = 255 // len(lace(PACKET))
    out = [page(SAMPLES, 0, FIRST, 0, lace(len(packets[0])), packets[0]), page(MARKS, 0, FIRST, 0, lace(4), b"MARK")]
    number, done = 1, 0
    for at in range(1, len(packets), per):
        own = packets[at : at + per]
        body = b"".join(own)
        flags = LAST * (at + per >= len(packets))
        mark = struct.pack("<QI", done, zlib.crc32(body))
        done += len(body)
        out.append(page(SAMPLES, number, flags, done, b"".join(lace(len(p)) for p in own), body))
        out.append(page(MARKS, number, flags, done, lace(len(mark)), mark))
        number += 1
    return b"".join(out)


def pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """serial, number, flags, granule, lacing, body of each page; a page whose checksum differs is an error."""
    view, at = memoryview(data), 0
    while at < len(data):
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("the last page is cut off")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"the page at {at} does not match its checksum")
        yield serial, number, flags, granule, lacing, view[at + 27 + n : end]
        at = end


def read(data: bytes) -> dict[int, dict]:
    """By serial number: packets, granules (of the pages that end a packet), number of pages."""
    streams: dict[int, dict] = {}
    for serial, number, flags, granule, lacing, body in pages(data):
        s = streams.setdefault(serial, {"packets": [], "granules": [], "pages": 0, "open": [], "ended": False})
        if number != s["pages"] or s["ended"] or bool(flags & FIRST) != (number == 0) or bool(flags & CONTINUED) != bool(s["open"]):
            raise ValueError(f"stream {serial}: page {number} is out of order")
        at, start, ended = 0, 0, False
        for n in lacing:
            at += n
            if n < 255:
                s["packets"].append(b"".join([*s["open"], body[start:at]]))
                s["open"], start, ended = [], at, True
        if start < at or lacing and lacing[-1] == 255:
            s["open"].append(body[start:at])
        if ended:
            s["granules"].append(granule)
        s["pages"], s["ended"] = s["pages"] + 1, bool(flags & LAST)
    if any(s["open"] for s in streams.values()):
        raise ValueError("a packet is cut off")
    return streams


def samples(data: bytes) -> tuple[bytes, dict]:
    """The payload read back, with what its streams say of it."""
    streams = read(data)
    own, marks = streams[SAMPLES], streams[MARKS]
    magic, rate, _ = struct.unpack("<4sII", own["packets"][0])
    payload = b"".join(own["packets"][1:])
    ends = own["granules"][1:]
    if magic != b"PCM8" or ends[-1] != len(payload):
        raise ValueError("granule positions and samples differ")
    for mark, stop in zip(marks["packets"][1:], ends, strict=True):
        start, crc = struct.unpack("<QI", mark)
        if zlib.crc32(memoryview(payload)[start:stop]) != crc:
            raise ValueError(f"samples {start} to {stop} do not match their mark")
    return payload, {"streams": len(streams), "pages": sum(s["pages"] for s in streams.values()), "packets": len(own["packets"]) - 1, "ms": ends[-1] * 1000 // rate, "last_page_ms": (ends[-2] if len(ends) > 1 else 0) * 1000 // rate}


def feature(payload: bytes, said: dict) -> str:
    x = np.frombuffer(payload, np.uint8)
    wide = x.astype(np.int32) - 128
    crossings = int(np.count_nonzero((wide[1:] < 0) != (wide[:-1] < 0)))
    energy = int(np.dot(wide, wide.astype(np.int64)))
    return ";".join(f"{k}={v}" for k, v in {**said, "sum": int(x.sum(dtype=np.int64)), "energy": energy, "crossings": crossings, "peak": int(np.abs(wide).max())}.items())


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Stores each row's text, as bytes padded by 255 to a positive multiple of 576, in an Ogg file, reads it back and describes it.

    With `keep_media` the file follows as column media. A null text counts as empty; the media depend on
    the text alone, so equal texts have equal values. Rows with the same doc_id each have a row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                for doc, text in zip(b.column(0).slice(at, 256).to_pylist(), b.column(1).slice(at, 256).to_pylist()):
                    stored = write(text + b"\xff" * (-len(text) % PACKET if text else PACKET))
                    payload, said = samples(stored)
                    rows.append((doc, len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload, said), *[stored] * keep_media))
                names = [c.split()[0] for c in COLUMNS.split(", ")] + ["media"] * keep_media
                kinds = [pa.string() if " string" in c else pa.int64() for c in COLUMNS.split(", ")] + [pa.binary()] * keep_media
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("bytes"))
    return own.mapInArrow(run, COLUMNS + ", media binary" * keep_media)
