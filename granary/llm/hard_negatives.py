"""Hard negatives by a secondary sort: pair scores packed into keys, sorted by Spark, read as a stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm import vectors as V
from granary.llm.common import materialize, partitions

#: A packed pair: anchor, descending score, 0 for a row of the anchor's label and 1 for another, id; sorts as bytes.
PAIR = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("other", "u1"), ("id", ">u8")])
SIGN = np.uint64(1 << 63)
FOUND = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def pack_pairs(anchor: np.ndarray, score: np.ndarray, other: np.ndarray, ids: np.ndarray) -> list[bytes]:
    up = lambda x: x.astype(np.int64).view(np.uint64) ^ SIGN
    out = np.empty(len(anchor), PAIR)
    out["anchor"], out["down"], out["other"], out["id"] = up(anchor), ~up(score), other, up(ids)
    raw, n = out.tobytes(), PAIR.itemsize
    return [raw[k : k + n] for k in range(0, len(raw), n)]


def unpack_pair(key: bytes) -> tuple[int, int, int, int]:
    number = lambda b: int.from_bytes(b, "big")
    return number(key[:8]) - (1 << 63), (1 << 63) - 1 - number(key[8:16]), key[16], number(key[17:]) - (1 << 63)


def task_of(key: bytes) -> int:
    """The anchor's part of the key, mixed; the partitioner takes it modulo the number of tasks."""
    return int.from_bytes(key[:8], "big") * 0x9E3779B97F4A7C15 % (1 << 64) >> 20


class Windows:
    """The windows of one anchor's positives while its pairs go by in descending score."""

    def __init__(self, n_positive: int, n_negative: int, low: int, high: int):
        self.n_positive, self.n_negative, self.low, self.high = n_positive, n_negative, low, high
        self.anchor, self.positives, self.open = None, 0, []

    def take(self, pairs: Iterable[bytes]) -> Iterator[tuple]:
        """Rows of FOUND from sorted pairs; what is held is one anchor's open windows, never its pairs."""
        for anchor, score, other, row in map(unpack_pair, pairs):
            if anchor != self.anchor:
                self.anchor, self.positives, self.open = anchor, 0, []
            if not other:
                if self.positives < self.n_positive:
                    self.positives += 1
                    self.open.append([row, score, 0])
                continue
            closed = False
            for w in self.open:
                if 100 * score < self.low * w[1]:
                    closed = w[2] = self.n_negative
                elif 100 * score <= self.high * w[1]:
                    w[2] += 1
                    yield anchor, w[0], w[2], row, w[1], score
                    closed = closed or w[2] == self.n_negative
            if closed:
                self.open = [w for w in self.open if w[2] < self.n_negative]


def _slices(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    t = t.sort_by("id")
    for k in range(0, t.num_rows, V.SLICE):
        part = t.slice(k, V.SLICE)
        yield V.column(part, "id"), V.column(part, "label"), V.lists(part, "v")


def _scores(q: pa.Table, r: pa.Table) -> Iterator[tuple]:
    """For each block of anchors and slice of rows: first anchor, rows' ids, whether labels are equal, the row is the anchor itself, keys.

    A key holds a score and, for ties, the row's place from the end, so that keys are distinct and higher ones come first.
    """
    anchors, labels, m = V.column(q, "id"), V.column(q, "label"), V.lists(q, "v")
    for ids, own, x in _slices(r):
        width = max(m.shape[1], x.shape[1])
        wide, x = V.widened(m, width), V.widened(x, width)
        V.check_exact(wide, x)
        right, back = x.T.astype(np.float64), np.arange(len(ids))[::-1]
        for a in range(0, len(anchors), V.BLOCK):
            b = slice(a, a + V.BLOCK)
            score = (wide[b].astype(np.float64) @ right).astype(np.int64)
            yield a, ids, labels[b, None] == own, anchors[b, None] == ids, score * V.SLICE + back


NONE = np.iinfo(np.int64).min


def _highest(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """at, place, score of the k highest keys of each row of the matrix, without those that are NONE."""
    n = keys.shape[1]
    top = np.argpartition(keys, max(0, n - k), axis=1)[:, max(0, n - k) :]
    at = np.repeat(np.arange(len(keys)), top.shape[1])
    key = keys[at, top.ravel()]
    at, key = at[key != NONE], key[key != NONE]
    score = key >> (V.SLICE.bit_length() - 1)
    return at, n - 1 - (key - score * V.SLICE), score


def mine_hard_negatives(df: DataFrame, anchors: Column, n_positive: int = 5, n_negative: int = 3, low: int = 50, high: int = 95, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of `df` that meet `anchors`.

    A row's score is its inner product with the anchor, components being floor(scale * x); higher ones come
    first, ties by smaller id. An anchor's positives are its first n_positive other rows of its label. For
    each, the first n_negative rows of another label are given with low * positive_score <= 100 *
    negative_score <= high * positive_score. Rows that take part are those of `whole_vectors`: a null label or
    id, or nulls or non-finite components leave a row out, a repeated id counts once, a shorter vector has
    zeros behind. An anchor without positives, or whose windows are empty, gives no rows, as does an empty
    table. Scores that could pass 2^50 raise ValueError.

    Anchors in blocks meet all rows twice. The first time each slice of rows offers its best rows of the
    anchor's label, of which the positives are made; the second time it offers the first rows in each
    positive's window. Only these pairs are packed, shuffled by anchor and sorted by Spark: what a slice
    leaves out has enough rows of the same slice before it. The stream then opens the windows.
    """
    rows = materialize(V.whole_vectors(df, key, vector, scale, label), "vectors")
    asked = materialize(V.whole_vectors(df.where(anchors), key, vector, scale, label), "anchors")
    n_rows, n_anchors = rows.count(), asked.count()
    _, n_cells = V.cells(rows, n_rows)
    right = rows.withColumn("cell", V.place(n_cells))

    def same(q: pa.Table, r: pa.Table) -> pa.Table:
        out = [[], [], []]
        anchor = V.column(q, "id")
        for a, ids, equal, itself, keys in _scores(q, r):
            at, place, score = _highest(np.where(equal & ~itself, keys, NONE), n_positive)
            for o, x in zip(out, (anchor[a + at], ids[place], score)):
                o.append(x)
        return pa.table(dict(zip(("anchor", "id", "score"), map(np.concatenate, out))))

    found = V.meet(asked, n_anchors, right, n_cells, same, "anchor long, id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    positives = materialize(found.withColumn("rank", rank).where(F.col("rank") <= n_positive).drop("rank"), "positives")
    own = positives.groupBy("anchor").agg(F.collect_list("score").alias("positive"))
    asked = asked.join(own, F.col("id") == F.col("anchor")).drop("anchor")

    def others(q: pa.Table, r: pa.Table) -> pa.Table:
        anchor, bound = V.column(q, "id"), V.lists(q, "positive", fill=NONE)
        out = []
        for a, ids, equal, _, keys in _scores(q, r):
            keys = np.where(equal, NONE, keys)
            score = keys >> (V.SLICE.bit_length() - 1)
            flat = []
            for p in bound[a : a + V.BLOCK].T:
                p = np.where(p == NONE, 0, p)[:, None], (p != NONE)[:, None]
                inside = ~equal & p[1] & (100 * score >= low * p[0]) & (100 * score <= high * p[0])
                at, place, _ = _highest(np.where(inside, keys, NONE), n_negative)
                flat.append(at * len(ids) + place)
            flat = np.unique(np.concatenate(flat))
            at, place = flat // len(ids), flat % len(ids)
            out += pack_pairs(anchor[a + at], score[at, place], np.ones(len(at), np.uint8), ids[place])
        return pa.table({"key": pa.array(out, pa.binary())})

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            anchor, ids, score = (b.column(c).to_numpy() for c in ("anchor", "id", "score"))
            yield pa.RecordBatch.from_arrays([pa.array(pack_pairs(anchor, score, np.zeros(len(ids), np.uint8), ids), pa.binary())], names=["key"])

    pairs = V.meet(asked, n_anchors, right, n_cells, others, "key binary").union(positives.mapInArrow(packed, "key binary"))
    n = partitions(df)
    stream = pairs.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(n, task_of)
    mined = stream.mapPartitions(lambda it: Windows(n_positive, n_negative, low, high).take(k for k, _ in it))
    return df.sparkSession.createDataFrame(mined, FOUND, verifySchema=False)
