"""Vectors of whole numbers, and groups of queries that meet every cell of rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import partitions

#: Rows of a slice, queries of a block, and queries that one task holds: these bound memory and change no result.
SLICE, BLOCK, GROUP = 4096, 256, 16_384
#: Slices in a cell at most, and partitions that cells are dealt to at most.
SLICES, TASKS = 16, 20_000
#: Scores are exact below this; a task that could pass it raises ValueError.
EXACT = 1 << 50


def whole_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256, label: str | None = None) -> DataFrame:
    """id, v (floor(scale * x) of each component), label: one row for each id.

    Rows with a null id or a null vector, or with a null or non-finite component, take no part; nor do those
    with a null label where `label` is given. Of rows that repeat an id the one with the smallest vector,
    then label, counts. Other columns are ignored, whatever their names.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.select(F.col(key).cast("long").alias("id"), doubles.alias("v"), (F.col(label) if label else F.lit(0)).cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    return rows.groupBy("id").agg(F.min(F.struct("v", "label")).alias("s")).select("id", "s.v", "s.label")


def cells(df: DataFrame, n_rows: int) -> tuple[int, int]:
    """Slices and cells for so many rows: a cell holds a bounded number of slices, and there are enough cells to keep the cores busy."""
    slices = max(1, -(-n_rows // SLICE))
    each = min(SLICES, max(1, slices // (4 * df.sparkSession.sparkContext.defaultParallelism)))
    return slices, -(-slices // each)


def place(n: int) -> Column:
    """The cell or slice of an id, of n."""
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def meet(queries: DataFrame, n_queries: int, right: DataFrame, n_cells: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(queries, rows) for each group of queries and each cell (column `cell`) of `right`, each pair in one task.

    This is a stated query set against all rows in blocks: rows travel once for each group of GROUP queries,
    queries once for each cell, and no pair of rows is made.
    """
    groups = max(1, -(-n_queries // GROUP))
    n = min(TASKS, max(partitions(right), 3 * groups * n_cells))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.withColumn("group", place(groups)).withColumn("cell", every(n_cells)).repartition(n, "group", "cell")
    right = right.withColumn("group", every(groups)).repartition(n, "group", "cell")
    names = [f.split()[0] for f in schema.split(", ")]

    def both(q: pa.Table, r: pa.Table) -> pa.Table:
        if not (q.num_rows and r.num_rows):
            return pa.table({c: pa.array([], pa.binary() if c == "key" else pa.int64()) for c in names})
        return run(q.sort_by("id"), r)

    return left.groupBy("group", "cell").cogroup(right.groupBy("group", "cell")).applyInArrow(both, schema)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def lists(t: pa.Table, name: str, width: int = 0, fill: int = 0) -> np.ndarray:
    """A column of lists as a matrix; shorter ones end with `fill`."""
    whole = t.column(name).combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    ends, flat = whole.offsets.to_numpy(), whole.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    out = np.full((len(size), max(width, int(size.max(initial=0)))), fill, np.int64)
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = flat[ends[0] : ends[-1]]
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    """Missing components count as zeros."""
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def check_exact(q: np.ndarray, x: np.ndarray) -> None:
    top = lambda m: max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0))))
    if top(q) * top(x) * max(1, q.shape[1]) >= EXACT:
        raise ValueError("components are too large: inner products could pass 2^50")
