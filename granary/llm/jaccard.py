"""N-gram Jaccard join by signature trees, exact, with components of its links.

Equal sets stand as one class. A class can only link if nearly all of its shingles are in other classes,
so document frequencies (from all documents, see chunks) leave few. These are routed by their rarest
shingles: two linked sets share one of them. Among the classes of one such shingle a signature tree finds
pairs: its nodes hold OR-combined bitmaps of shingles and ranges of sizes, and pairs of nodes are dropped
as soon as their largest possible overlap is too small. Whole sets then decide.

The first rounds try each class
with one partner of another component in its leaf and chain the leaves. The last traverses all trees for
pairs of classes that no chain of links joins yet, so a large group of near copies does not come out as
all its pairs, while no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import hashes
from granary.llm.chunks import ASKED, ChunkStore, answer_totals, answers, ask, batches
from granary.llm.common import discard, materialize
from granary.llm.graph import joined_components

BITS, LEAF, FAN = 1024, 32, 8
#: Rounds that chain, and how many of the most frequent routing shingles of a class they use (0: all).
ROUNDS, CHAINED = 3, 0
#: Shingles that more classes share are dealt in blocks of so many classes, each pair of blocks on its own.
BLOCK = 4096


def need(a: np.ndarray | int, b: np.ndarray | int, percent: int):
    """The smallest overlap at which sets of sizes a and b link: 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """Signature tree over the rows of one shingle, sorted by size; level 0 holds leaves of LEAF rows."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, lost: np.ndarray, comp: np.ndarray):
        self.size, self.sig, self.lost, self.comp = size, sig, lost, comp
        starts = np.arange(0, len(size), LEAF)
        same = np.minimum.reduceat(comp, starts) == np.maximum.reduceat(comp, starts)
        self.levels = [(np.minimum.reduceat(size, starts), np.maximum.reduceat(size, starts), np.bitwise_or.reduceat(sig, starts, 0), np.maximum.reduceat(lost, starts), np.where(same, comp[starts], -1))]
        while len(self.levels[-1][0]) > 1:
            lo, hi, bits, most, one = self.levels[-1]
            starts = np.arange(0, len(lo), FAN)
            same = (np.minimum.reduceat(one, starts) == np.maximum.reduceat(one, starts)) & (one[starts] >= 0)
            self.levels.append((np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts), np.bitwise_or.reduceat(bits, starts, 0), np.maximum.reduceat(most, starts), np.where(same, one[starts], -1)))

    def may(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs of nodes can hold a link between different components."""
        lo, hi, bits, most, one = self.levels[level]
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(most[a], most[b])
        fits = (100 * hi[a] >= percent * lo[b]) & (100 * hi[b] >= percent * lo[a])
        return fits & (overlap >= need(lo[a], lo[b], percent)) & ((one[a] < 0) | (one[a] != one[b]))

    def rows(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        overlap = np.bitwise_count(self.sig[a] & self.sig[b]).sum(1, dtype=np.int64) + np.minimum(self.lost[a], self.lost[b])
        return (overlap >= need(self.size[a], self.size[b], percent)) & (self.comp[a] != self.comp[b])

    def traverse(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows that the bounds leave, by going down pairs of nodes together."""
        stack = [(len(self.levels) - 1, np.array([0]), np.array([0]))]
        while stack:
            level, a, b = stack.pop()
            keep = self.may(level, a, b, percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            step, n = (LEAF, len(self.size)) if level == 0 else (FAN, len(self.levels[level - 1][0]))
            for at in range(0, len(a), 64):
                x = a[at : at + 64, None, None] * step + np.arange(step)[:, None]
                y = b[at : at + 64, None, None] * step + np.arange(step)
                x, y = (z.ravel() for z in np.broadcast_arrays(x, y))
                inside = (x < n) & (y < n) & (x <= y if level else x < y)
                x, y = x[inside], y[inside]
                if level:
                    stack.append((level - 1, x, y))
                else:
                    good = self.rows(x, y, percent)
                    yield x[good], y[good]

    def chain(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each row of a leaf the earlier row of most common bits, and each leaf's first row with the first of the leaf before."""
        for at in range(0, len(self.size), LEAF):
            n = min(LEAF, len(self.size) - at)
            x, y = np.tril_indices(n, -1)
            if n > 1:
                common = np.bitwise_count(self.sig[at + x] & self.sig[at + y]).sum(1, dtype=np.int64)
                good = self.rows(at + x, at + y, percent)
                best = np.lexsort((-common, ~good, x))
                first = best[np.searchsorted(x[best], np.arange(1, n))]
                first = first[good[first]]
                yield at + y[first], at + x[first]
            if at and self.rows(np.array([at - LEAF]), np.array([at]), percent)[0]:
                yield np.array([at - LEAF]), np.array([at])


class Sets:
    """The distinct hashed shingles of a chunk's documents; with `reps`, of the first document of each class that is listed there."""

    def __init__(self, t: pa.Table, n: int, reps: pa.Table | None = None):
        if reps is not None and t.num_rows:
            t = t.filter(pc.is_in(t.column("doc_id"), reps.column("doc_id").combine_chunks(), skip_nulls=True))
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for rows, data, offsets in batches(t):
            d, x = hashes.shingles(*hashes.words(data, offsets), n)
            docs.append(rows[d])
            keys.append(x)
        self.doc, self.key = np.concatenate(docs), np.concatenate(keys)
        self.n = np.bincount(self.doc, minlength=t.num_rows)
        at = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.sum = np.zeros(t.num_rows, np.uint64)
        if len(at):
            self.sum[self.doc[at]] = np.add.reduceat(hashes.mix(self.key ^ np.uint64(hashes.ROOT)), at) ^ (np.add.reduceat(self.key, at) << np.uint64(1))
        if reps is not None:
            full = np.flatnonzero((self.n > 0) & np.isin(self.sum.astype(np.int64), reps.column("cls").to_numpy()))
            own = np.isin(self.doc, full[np.unique(self.sum[full], return_index=True)[1]])
            self.doc, self.key = self.doc[own], self.key[own]


def _frequencies(store: ChunkStore, reps: DataFrame, n: int) -> DataFrame:
    buckets = store.buckets

    def question(chunk: int, t: pa.Table, r: pa.Table) -> pa.Table:
        keys, counts = np.unique(Sets(t, n, r).key, return_counts=True)
        return ask(chunk, keys, counts, buckets)

    return answer_totals(store.meet(reps, question, ASKED))


SURVIVOR = "cls long, n int, tokens binary, prefix binary, often binary"


def _survivors(store: ChunkStore, told: DataFrame, n: int, percent: int) -> DataFrame:
    """Classes whose shared shingles can make a link, with these (sorted) and the rarest that route them."""

    def keep(chunk: int, t: pa.Table, r: pa.Table) -> pa.Table:
        rows = []
        s = Sets(t, n, r.filter(r.column("doc_id").is_valid()))
        doc, key = s.doc, s.key
        if len(doc):
            keys, place = np.unique(key, return_inverse=True)
            df = answers(r.filter(r.column("bucket").is_valid()))[place]
            cut = np.flatnonzero(np.diff(doc, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(doc))):
                shared = df[a:b] > 1
                size = int(b - a)
                if 100 * int(shared.sum()) < percent * size:
                    continue
                tokens, often = key[a:b][shared], df[a:b][shared]
                order = np.lexsort((tokens, often))
                first = size - -(-percent * size // 100) + 1 - (size - len(tokens))
                pre = order[: max(0, first)]
                rows.append((int(s.sum[doc[a]].astype(np.int64)), size, tokens.tobytes(), tokens[pre].tobytes(), often[pre].astype(np.uint32).tobytes()))
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["cls", "n", "tokens", "prefix", "often"])

    return store.meet(told, keep, SURVIVOR)


ROUTED = "token long, i int, j int, cls long, n int, lost int, sig binary"


def _routes(survivors: DataFrame, block: int, diagonal: bool, last: int = 0) -> DataFrame:
    """A row for each class and routing shingle; for a frequent shingle one for each pair of blocks that the class's block is in. last: only so many of the most frequent."""

    def route(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            out: list[tuple] = []
            for row in p.to_pylist():
                tokens = np.frombuffer(row["tokens"], np.uint64)
                bits = np.unique(hashes.mix(tokens) % np.uint64(BITS)).astype(np.int64)
                sig = np.zeros(BITS // 8, np.uint8)
                np.bitwise_or.at(sig, bits // 8, (1 << (bits % 8)).astype(np.uint8))
                lost = len(tokens) - len(bits)
                for token, often in zip(np.frombuffer(row["prefix"], np.int64)[-last:].tolist(), np.frombuffer(row["often"], np.uint32)[-last:].tolist()):
                    blocks = -(-often // block)
                    own = row["cls"] % blocks
                    others = [own] if diagonal else range(blocks)
                    out += [(token, min(own, o), max(own, o), row["cls"], row["n"], lost, sig.tobytes()) for o in others]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["token", "i", "j", "cls", "n", "lost", "sig"])

    return survivors.mapInArrow(route, ROUTED)


def _candidates(routed: DataFrame, percent: int, chain: bool) -> DataFrame:
    """Distinct pairs (a, b) of classes that the trees of the routed shingles leave."""
    size = F.count("*").alias("size")
    keys = routed.groupBy("token", "i", "j").agg(size, F.min("comp").alias("low"), F.max("comp").alias("high"))
    open_keys = keys.where("size > 1 and low <> high").select("token", "i", "j")
    rows = routed.join(open_keys, ["token", "i", "j"])
    sort = ["token", "i", "j", "n", "sig", "cls"]
    rows = rows.repartition("token", "i", "j").sortWithinPartitions(*sort)

    def pairs_of(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        col = {c: t.column(c).to_numpy() for c in ("token", "i", "j", "cls", "n", "lost", "comp")}
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, BITS // 64)
        new = np.ones(t.num_rows, bool)
        for c in ("token", "i", "j"):
            new[1:] &= col[c][1:] == col[c][:-1]
        new[1:] = ~new[1:]
        cut = np.flatnonzero(new)
        for a, b in zip(cut, np.append(cut[1:], t.num_rows)):
            tree = Tree(col["n"][a:b].astype(np.int64), sig[a:b], col["lost"][a:b].astype(np.int64), col["comp"][a:b])
            for x, y in tree.chain(percent) if chain else tree.traverse(percent):
                yield col["cls"][a:b][x], col["cls"][a:b][y]

    def find(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            found = list(pairs_of(t))
            if found:
                x, y = (np.concatenate(z) for z in zip(*found))
                pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        for p in parts:
            held.append(p)
            if sum(h.num_rows for h in held) < 20_000:
                continue
            t = pa.Table.from_batches(held)
            last = [t.column(c)[-1].as_py() for c in ("token", "i", "j")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == v for c, v in zip(("token", "i", "j"), last)])
            at = int(np.argmax(same))
            if at:
                yield from done(t.slice(0, at))
                held = t.slice(at).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held))

    return rows.mapInArrow(find, "a long, b long").distinct()


def _verify(pairs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    own = survivors.select("cls", "n", "tokens")
    left = own.select(F.col("cls").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at"))
    right = own.select(F.col("cls").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt"))

    def check(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            good = []
            for an, bn, at, bt in zip(*(p.column(c).to_pylist() for c in ("an", "bn", "at", "bt"))):
                both = np.intersect1d(np.frombuffer(at, np.uint64), np.frombuffer(bt, np.uint64), assume_unique=True)
                good.append(100 * len(both) >= percent * (an + bn - len(both)))
            yield pa.RecordBatch.from_arrays([p.column("a"), p.column("b"), pa.array(good)], names=["a", "b", "good"])

    checked = pairs.join(left, "a").join(right, "b").select("a", "b", "an", "bn", "at", "bt")
    return checked.mapInArrow(check, "a long, b long, good boolean").where("good").select("a", "b")


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach, itself included) of each row.

    Sets are the distinct runs of n words `[^\\x20\\x09-\\x0D]+` of the A-Z-lower-cased text; all words as
    one where there are fewer than n; without words, as for a null text, the set is empty and links with
    nothing. Sets link when 100 * intersection >= percent * union. Rows of equal sets are one component.
    A null doc_id has no component and links with nothing. Rows that repeat a doc_id each have a row, with
    the component of their own text. An empty table gives an empty result. Other columns are ignored.
    """
    store = ChunkStore(docs)

    def describe(chunk: int, t: pa.Table) -> pa.Table:
        s = Sets(t, n)
        return pa.table({"doc_id": t.column("doc_id"), "chunk": pa.array(np.full(t.num_rows, chunk, np.int32)), "n_shingles": pa.array(s.n.astype(np.int64)), "cls": pa.array(s.sum.astype(np.int64))})

    rows = materialize(store.map(describe, "doc_id long, chunk int, n_shingles long, cls long"), "sets")
    linked = rows.where("n_shingles > 0 and doc_id is not null")
    classes = linked.groupBy("cls").agg(F.min(F.struct("doc_id", "chunk")).alias("first"))
    classes = materialize(classes.select("cls", "first.doc_id", "first.chunk"), "classes")
    reps = classes.select("chunk", "doc_id", "cls")
    totals = materialize(_frequencies(store, reps, n), "frequencies")
    told = totals.unionByName(reps, allowMissingColumns=True)
    survivors = materialize(_survivors(store, told, n, percent), "survivors")
    store.drop()

    def routed(comps: DataFrame | None, diagonal: bool, last: int) -> DataFrame:
        rows = _routes(survivors, block, diagonal, last)
        if comps is None:
            return rows.withColumn("comp", F.col("cls"))
        return rows.join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls")).drop("node")

    comps = None
    for _ in range(ROUNDS):
        dealt = materialize(routed(comps, True, CHAINED), "routed")
        found = materialize(_verify(_candidates(dealt, percent, True), survivors, percent), "links")
        comps = joined_components(comps, found)
        discard(dealt)
        if found.isEmpty():
            break
    dealt = materialize(routed(comps, False, 0), "routed")
    more = materialize(_verify(_candidates(dealt, percent, False), survivors, percent), "links")
    comps = joined_components(comps, more)
    discard(dealt, totals)

    of_class = classes.join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = of_class.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = of_class.join(least, "comp").select("cls", "component_id")
    joined = rows.join(by_class.withColumnRenamed("cls", "_cls"), (F.col("cls") == F.col("_cls")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, whose id is their component's smallest; rows with a null id stay.

    Rows that repeat an id stand or fall together: they go where any of their texts has a smaller id in its component.
    """
    found = jaccard_components(docs, n, percent)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
