"""Shared folders, written tables and byte packing used by the operators of this subpackage."""

from __future__ import annotations

import struct
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that setting is absent (tests on one machine) a local folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-granary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary/{uuid.uuid4().hex}-{name}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cuts lineage: writes a table to the shared folder, in parts by its last columns `by`, and reads it again."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.granary_path = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing is to be read from it any more."""
    for t in tables:
        remove(t.sparkSession, t.granary_path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs whose results are written.

    Spark does so once no plan in the driver's memory refers to them, which it otherwise notices at its next
    collection: after half an hour, or when the heap is full.
    """
    spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(col: str | Column = "doc_id") -> Column:
    """crc32 of the document's id as text, modulo 5; -1 for a null id."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5, F.lit(-1))


def free(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores behind where `columns` has them already (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_DTYPES = "B u1 H u2 I u4 Q u8 f f4 d f8 e f2 b i1 i i4 q i8".split()
_CODE = {np.dtype(d): c.encode() for c, d in zip(_DTYPES[::2], _DTYPES[1::2])}
_KIND = {c: d for d, c in _CODE.items()}


#: Shorter values are not compressed: a frame's own bytes would outweigh what it saves.
SHORT = 128


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value; bytes of equal weight lie together, so sorted or small numbers shrink."""
    out = [struct.pack("<H", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
        out.append(_CODE[a.dtype] + struct.pack("<Q", len(a)) + planes)
    raw = b"".join(out)
    return b"\0" + raw if len(raw) < SHORT else b"\1" + zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data[1:]) if data[:1] == b"\1" else data[1:]
    (n,), at, out = struct.unpack_from("<H", raw), 2, []
    for _ in range(n):
        kind, (size,) = _KIND[raw[at : at + 1]], struct.unpack_from("<Q", raw, at + 1)
        at, width = at + 9, kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(size))
        at += size * width
    return out


def pack_sorted(keys: np.ndarray) -> np.ndarray:
    """Sorted unsigned numbers as differences, which pack well."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def unpack_sorted(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=steps.dtype)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the smallest unsigned type that holds them all."""
    most = int(numbers.max()) if len(numbers) else 0
    return numbers.astype(next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(k).max))
