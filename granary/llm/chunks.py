"""Documents in chunks, and questions from chunks to buckets of keys.

Some statistics need every key of the corpus (a shingle, a piece of text, a word) to meet its other
occurrences, and the outcome to come back to the documents. Rows of one key each would be many times the
input. Here documents are written once, in chunks, as a table bucketed by chunk. A chunk asks about its
distinct keys with one packed row for each range of key hashes; a bucket of such rows answers with arrays
in the same order; the answers meet their chunk again without any shuffle of texts, since the table is
bucketed. A key held by a third of all documents is one entry in each chunk.

The exchange has a row for each chunk and bucket that have keys in common, and so never more rows than the
chunks have distinct keys: it grows with the input, and packing only makes it smaller. Chunks have
CHUNK_BYTES up to 700 GB of text; larger inputs have larger ones, up to LARGEST_CHUNK, and then more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import hashes
from granary.llm.common import free_shuffles, narrow, pack, pack_sorted, unpack, unpack_sorted, whole_text

CHUNK_BYTES, LARGEST_CHUNK, BUCKET_BYTES = 8 << 20, 64 << 20, 16 << 20
#: Chunks grow towards LARGEST_CHUNK before there are more than so many.
FEW_CHUNKS = 90_000
#: Bits of a cut key beyond those that number the bytes of the corpus, and in all at least.
SPARE_BITS, LEAST_BITS = 14, 44


class ChunkStore:
    """doc_id, bytes (the whole text as UTF-8; null: empty) of each row, in chunks of about CHUNK_BYTES."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("bytes"))
        total = own.agg(F.sum(F.octet_length("bytes").cast("long"))).first()[0] or 0
        parts = max(1, own.rdd.getNumPartitions())
        each = max(1, -(-total // parts // min(LARGEST_CHUNK, max(CHUNK_BYTES, total // FEW_CHUNKS))))
        self.chunks = parts * int(each)
        most = "spark.sql.sources.bucketing.maxBuckets"
        if self.chunks > int(self.spark.conf.get(most)):
            self.spark.conf.set(most, str(self.chunks))
        self.buckets = int(max(12, -(-total // BUCKET_BYTES)))
        #: Keys cut to these bits coincide by chance for one in 2^SPARE_BITS at most, and pack better.
        bits = min(64, max(LEAST_BITS, int(total).bit_length() + SPARE_BITS))
        self.mask = np.uint64(((1 << bits) - 1) << (64 - bits))
        chunk = F.spark_partition_id() * F.lit(int(each)) + F.pmod(F.xxhash64("doc_id"), F.lit(int(each))).cast("int")
        self.name = f"granary_chunks_{uuid.uuid4().hex}"
        self.told_name = self.name + "_told"
        own.withColumn("chunk", chunk).write.bucketBy(self.chunks, "chunk").option("compression", "zstd").saveAsTable(self.name)

    @cached_property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def recode(self, f: Callable[[int, pa.Table], pa.Table], schema: str) -> None:
        """Puts f(chunk, documents) in the documents' place, for questions that need no texts: a table bucketed as they were, written without a shuffle since a task holds whole chunks."""
        name = self.name + "_coded"
        self.map(f, schema).write.bucketBy(self.chunks, "chunk").option("compression", "zstd").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {self.name}")
        self.name = name
        del self.table

    def map(self, f: Callable[[int, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f(chunk, documents) for each chunk."""
        return self.table.groupBy("chunk").applyInArrow(lambda key, t: f(key[0].as_py(), t), schema)

    def meet(self, told: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f(chunk, documents, the rows of `told` of that chunk) for each chunk."""
        both = self.table.groupBy("chunk").cogroup(told.groupBy("chunk"))
        return both.applyInArrow(lambda key, t, r: f(key[0].as_py(), t, r), schema)

    def tell(self, rows: DataFrame) -> DataFrame:
        """Adds rows with a chunk to a table bucketed as the documents are, and gives all of it: `meet` reads it as often as need be without a shuffle."""
        rows = rows.repartition(self.chunks, "chunk")
        rows.write.bucketBy(self.chunks, "chunk").option("compression", "zstd").saveAsTable(self.told_name, mode="append")
        del rows
        free_shuffles(self.spark)
        return self.spark.table(self.told_name)

    def drop(self) -> None:
        for name in (self.told_name, self.name):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


ASKED = "chunk int, bucket int, asked binary"
ANSWERED = "chunk int, bucket int, answer binary"


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of 64-bit key hashes."""
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def ask(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket that the chunk's sorted distinct keys fall into."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    rows = [pack(pack_sorted(keys[cut[b] : cut[b + 1]]), narrow(counts[cut[b] : cut[b + 1]])) for b in full]
    return pa.table({"chunk": pa.array([chunk] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "asked": pa.array(rows, pa.binary())})


def answer_totals(asked: DataFrame) -> DataFrame:
    """Each chunk's keys with the sum of their counts over all chunks."""

    def total(t: pa.Table) -> pa.Table:
        own = [unpack(x) for x in t.column("asked").to_pylist()]
        keys = [unpack_sorted(k) for k, _ in own]
        every, place = hashes.distinct(np.concatenate(keys))
        sums = np.bincount(place, np.concatenate([c for _, c in own]).astype(float), len(every)).astype(np.uint64)
        cut = np.cumsum([0, *map(len, keys)])
        out = [pack(narrow(sums[place[a:b]])) for a, b in zip(cut[:-1], cut[1:])]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "answer": pa.array(out, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(total, ANSWERED)


def answers(told: pa.Table, column: str = "answer", index: int = 0) -> np.ndarray:
    """A chunk's answers in the order of its sorted keys."""
    rows = sorted((b, a) for b, a in zip(told.column("bucket").to_pylist(), told.column(column).to_pylist()) if a is not None and b >= 0)
    return np.concatenate([unpack(a)[index] for _, a in rows]) if rows else np.zeros(0, np.uint32)


BATCH_BYTES = 1 << 20


def batches(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """row numbers, joined bytes and offsets of a chunk's documents, about BATCH_BYTES at a time; a longer document comes alone."""
    column = t.column("bytes").combine_chunks() if t.num_rows else pa.array([], pa.binary())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, "right")) - 1)
        yield np.arange(at, stop), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
        at = stop
