"""Exact top-k inner products by no-random-access aggregation of sorted lists."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm import vectors as V
from granary.llm.common import materialize, pack, unpack

#: Lists are read in so many steps, from both ends.
STEPS = 4
#: Reading ends once so small a share of pairs is undecided; their final scores are then resolved.
FEW = 16
#: Pairs resolved at once.
PAIRS = 1 << 16
FOUND = "query_id long, vec_id long, score long"


def sort_lists(ids: np.ndarray, x: np.ndarray) -> bytes:
    """The sorted lists of a slice: for each dimension its rows by value, with these values, ids ascending."""
    own = np.argsort(ids, kind="stable")
    ids, x = ids[own], x[own]
    order = np.argsort(x, axis=0, kind="stable")
    values = np.take_along_axis(x, order, 0)
    small = np.abs(values).max(initial=0) < 1 << 31
    return pack(np.array(x.shape, np.int64), ids, order.T.ravel().astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32), values.T.ravel().astype(np.int32 if small else np.int64))


class Lists:
    """The sorted lists of a slice, read from both ends a step at a time by a whole block of queries.

    A query with a positive component reads that list from its top, one with a negative from its bottom.
    What either has read is known to both; an unread value lies between the two fronts.
    """

    def __init__(self, data: bytes, width: int):
        (n, d), self.ids, order, values = unpack(data)
        n, d = int(n), int(d)
        self.n, self.width = n, max(d, width)
        self.order, self.values = order.reshape(d, n).T.astype(np.int64), values.reshape(d, n).T.astype(np.float64)
        self.depth, self.dims, self.more = 0, np.arange(d), -(-self.n // (2 * STEPS))
        #: middle and half width of what each value may be
        self.middle, self.half = np.zeros((n, self.width)), np.zeros((n, self.width))
        self.known = np.zeros((n, d), bool)
        self.states: list[tuple[np.ndarray, np.ndarray]] = []

    def bounds(self, step: int) -> tuple[np.ndarray, np.ndarray]:
        """middle and half width of all values once `step` steps are read; read states are kept for further blocks."""
        while len(self.states) < step:
            self._read()
        return self.states[step - 1]

    def _read(self) -> None:
        a, b = self.depth, min(self.depth + self.more, -(-self.n // 2))
        for part in (slice(a, b), slice(self.n - b, self.n - a)):
            rows = self.order[part]
            self.middle[rows, self.dims] = self.values[part]
            self.known[rows, self.dims] = True
        self.depth = b
        low, high = self.values[b - 1], self.values[self.n - b]
        middle, half = self.middle.copy(), self.half.copy()
        d = len(self.dims)
        middle[:, :d] = np.where(self.known, self.middle[:, :d], (low + high) / 2)
        half[:, :d] = np.where(self.known, 0, (high - low) / 2)
        self.states.append((middle, half))

    @property
    def steps(self) -> int:
        return -(-(-(-self.n // 2)) // self.more)

    @cached_property
    def rest(self) -> np.ndarray:
        """All values, the lists having been read to their ends: made once, for final scores only."""
        out = np.zeros((self.n, self.width))
        out[self.order, self.dims] = self.values
        return out

    def resolve(self, q: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Final scores of pairs of a query and a row."""
        return np.concatenate([np.einsum("ij,ij->i", q[at[k : k + PAIRS]], self.rest[row[k : k + PAIRS]]) for k in range(0, len(at), PAIRS)] or [np.zeros(0)])


def search(lists: Lists, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, vec_id, score of rows that may be among the k best of a block's queries; none below `floor` (a k-th best score known before) is needed.

    After each step every row has a lower and an upper bound of its score. A row is out once its upper bound
    is below the k-th best lower bound; a query stops when no more rows than k, or few, are left. A row does
    not meet a query of its own id.
    """
    width = np.abs(q)
    own = lists.ids[None, :] == ids[:, None]
    for step in range(1, lists.steps + 1):
        middle, half = lists.bounds(step)
        mid, rad = q @ middle.T, width @ half.T
        lower = mid - rad
        lower[own] = -np.inf
        least = np.maximum(floor, np.partition(lower, lists.n - k, axis=1)[:, lists.n - k]) if lists.n > k else floor
        left = mid + rad >= least[:, None]
        left[own] = False
        if left.sum() <= max(k * len(q), left.size // FEW):
            break
    at, row = np.nonzero(left)
    return at, lists.ids[row], lists.resolve(q, at, row)


def best(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, at))
    first = np.searchsorted(at[order], at[order])
    return order[np.arange(len(order)) - first < k]


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other rows, ties to the smaller id.

    `queries` is a condition on `df`. Components become floor(scale * x). Rows that take part are those of
    `whole_vectors`: nulls and non-finite components leave a row out, a repeated id counts once, and a vector
    shorter than another has zeros behind. A query with fewer than k other rows has all of them; an empty
    table or no query gives no rows. Scores that could pass 2^50 raise ValueError.

    Rows are dealt by id to slices, each stored as sorted lists, one a dimension. A block of queries reads a
    slice's lists step by step and carries its k-th best score on to the next slice; each cell of slices gives
    k rows a query at most, which are then ranked.
    """
    rows = materialize(V.whole_vectors(df, key, vector, scale), "vectors")
    asked = materialize(V.whole_vectors(df.where(queries), key, vector, scale), "queries")
    n_rows, n_queries = rows.count(), asked.count()
    slices, n_cells = V.cells(rows, n_rows)

    def pack_slice(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"cell": pa.array([key[0].as_py() % n_cells], pa.int32()), "lists": pa.array([sort_lists(V.column(t, "id"), V.lists(t, "v"))], pa.binary())})

    stored = materialize(rows.withColumn("slice", V.place(slices)).groupBy("slice").applyInArrow(pack_slice, "cell int, lists binary"), "lists")

    def run(q: pa.Table, r: pa.Table) -> pa.Table:
        ids, m = V.column(q, "id"), V.lists(q, "v")
        n = len(ids)
        found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        floor = np.full(n, -np.inf)
        for data in r.column("lists"):
            lists = Lists(data.as_py(), m.shape[1])
            wide = V.widened(m, lists.width)
            V.check_exact(wide, lists.values)
            new = [found]
            for a in range(0, n, V.BLOCK):
                at, vec, score = search(lists, ids[a : a + V.BLOCK], wide[a : a + V.BLOCK].astype(np.float64), k, floor[a : a + V.BLOCK])
                new.append((at + a, vec, score))
            at, vec, score = (np.concatenate(x) for x in zip(*new))
            keep = best(at, vec, score, k)
            found = at, vec, score = at[keep], vec[keep], score[keep]
            ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) if len(at) else np.zeros(0, np.int64)
            full = np.bincount(at, minlength=n)[at[ends]] == k
            floor[at[ends][full]] = score[ends][full]
        at, vec, score = found
        return pa.table({"query_id": ids[at], "vec_id": vec, "score": score.astype(np.int64)})

    out = V.meet(asked.select("id", "v"), n_queries, stored, n_cells, run, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
