"""Token ids in seekable zstandard files.

A shard holds independent zstandard frames of at most FRAME bytes of little-endian 32-bit ids, each with
its own content checksum. Two skippable frames follow: a directory of the documents, and last the seek
table of the public seekable format, with sizes and a checksum of each frame. A reader takes the last
bytes, finds the frames that a document lies in, and decompresses no others.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm import bpe
from granary.llm.common import materialize, scratch, whole_text

#: Fixed values of the public formats: skippable frames, the seek table's last number.
SKIPPABLE_TABLE, SKIPPABLE_DOCS, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME = 1 << 18
END_ID = 2


class ShardWriter:
    def __init__(self, out, level: int = 3):
        self.out, self.level = out, level
        self.held, self.size = [], 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        for at in range(0, len(ids), FRAME):
            part = ids[at : at + FRAME]
            self.held.append(part)
            self.size += len(part)
            while self.size >= FRAME:
                whole = b"".join(self.held)
                self._frame(whole[:FRAME])
                self.held, self.size = [whole[FRAME:]], len(whole) - FRAME

    def _frame(self, raw: bytes) -> None:
        done = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(raw)
        self.frames.append((len(done), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.out.write(done)

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.held))
        ids = np.array([0 if d is None else d for d, _ in self.docs], "<i8")
        null = np.array([d is None for d, _ in self.docs], "u1")
        sizes = np.array([n for _, n in self.docs], "<u8")
        body = zstandard.ZstdCompressor(write_checksum=True).compress(ids.tobytes() + sizes.tobytes() + null.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_DOCS, len(body)) + body)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        end = struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(entries) + len(end)) + entries + end)
        self.out.close()


class ShardReader:
    """Opens a shard by its end; `tokens` decompresses only the frames that hold the range."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("not a seekable shard")
        table = size - 9 - 12 * n - 8
        file.seek(table)
        raw = file.read(size - table)
        if struct.unpack_from("<II", raw) != (SKIPPABLE_TABLE, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(raw, "<u4", 3 * n, 8).reshape(n, 3).astype("i8")
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        self.raw_at = np.concatenate([[0], np.cumsum(self.frames[:, 1])])
        file.seek(int(self.at[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE_DOCS:
            raise ValueError("the directory of documents is damaged")
        body = zstandard.ZstdDecompressor().decompress(file.read(length))
        k = len(body) // 17
        self.null = np.frombuffer(body, "u1", k, 16 * k).astype(bool)
        self.doc_ids = np.frombuffer(body, "<i8", k)
        self.sizes = np.frombuffer(body, "<u8", k, 8 * k).astype("i8")
        self.starts = np.cumsum(self.sizes) - self.sizes
        self._frame_no, self._frame_raw, self.read_frames = -1, b"", 0

    def _frame(self, k: int) -> bytes:
        if k != self._frame_no:
            self.file.seek(int(self.at[k]))
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames[k, 0])))
            if len(raw) != self.frames[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.frames[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            self._frame_no, self._frame_raw, self.read_frames = k, raw, self.read_frames + 1
        return self._frame_raw

    def parts(self, start: int, n: int) -> Iterator[memoryview]:
        lo, hi = 4 * start, 4 * (start + n)
        k = int(np.searchsorted(self.raw_at, lo, "right")) - 1
        while lo < hi:
            base = int(self.raw_at[k])
            stop = min(hi, int(self.raw_at[k + 1]))
            yield memoryview(self._frame(k))[lo - base : stop - base]
            lo, k = stop, k + 1

    def tokens(self, index: int) -> np.ndarray:
        """The ids of the shard's document number `index`."""
        return np.frombuffer(b"".join(self.parts(int(self.starts[index]), int(self.sizes[index]))), "<u4")


def open_shard(path: str) -> ShardReader:
    where, name = fs.FileSystem.from_uri(path)
    return ShardReader(where.open_input_file(name))


def write_token_files(docs: DataFrame, vocabulary: str, out: str) -> DataFrame:
    """Encodes `doc_id, text` and writes shards under `out`, in ascending doc_id order over the shards.

    Returns the written table of shards: shard, path, n_docs, n_tokens. Only files that this table names
    belong to the result: a task that is run again after a lost executor writes a file of another name.
    Null texts are empty texts and have the end id alone; a null doc_id sorts first; rows with equal
    doc_id sort by text. An empty table has no shards. Other columns are ignored.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, end, n = None, END_ID.to_bytes(4, "little"), 0
        coder = bpe.kept(bpe.Ids, vocabulary)
        task = TaskContext.get()
        path = f"{out}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        for b in batches:
            for at in range(0, b.num_rows, 400):
                part = b.slice(at, 400)
                if writer is None:
                    where, name = fs.FileSystem.from_uri(path)
                    where.create_dir(name.rpartition("/")[0], recursive=True)
                    writer = ShardWriter(where.open_output_stream(name, compression=None))
                for doc, ids in zip(part.column(0).to_pylist(), coder.ids(part.column(1).to_pylist())):
                    writer.add(doc, ids + end)
                    n += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "n_docs": pa.array([len(writer.docs)], "i8"), "n_tokens": pa.array([n], "i8")}, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    dealt = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(dealt.mapInArrow(write, "shard int, path string, n_docs long, n_tokens long"), "shards")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Reads every shard back, frame by frame: doc_id, start, n_tokens, ids_crc32 of each document."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                r = open_shard(path)
                for at in range(0, len(r.sizes), 10_000):
                    span = range(at, min(at + 10_000, len(r.sizes)))
                    sums = []
                    for k in span:
                        crc = 0
                        for part in r.parts(int(r.starts[k]), int(r.sizes[k])):
                            crc = zlib.crc32(part, crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([pa.array(r.doc_ids[at : span.stop], mask=r.null[at : span.stop]), pa.array(base + r.starts[at : span.stop]), pa.array(r.sizes[at : span.stop]), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # One row a shard: their running total is small, however large the shards are.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    based = shards.select("shard", "path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    n = max(1, min(shards.count(), 100_000))
    return based.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes `docs` as token files in the shared folder and returns what reading them back gives."""
    out = scratch(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, vocabulary, out))
