"""Fuzzy line deduplication: SimHash blocks, edit similarity, connected groups, and a search that misses nothing.

Lines are normalised (lower case, ASCII punctuation and white space as single spaces); equal ones are one
node. Two lines are linked if the edit similarity of their word sequences, 1 - edits / words of the longer,
is at least `similarity`.

An edit of words leaves most runs of three words as they are, so a line can only have a link if enough of
its runs also occur elsewhere. Counts of all runs, asked in packed form, leave few lines. These are hashed
(SimHash over words); pairs of equal 16-bit blocks find what is within two bits, and the two smallest
shared runs find most of the rest: lines that meet are compared with one of them, in rounds, and linked
lines become components. SimHash cannot guarantee 0.8, so a last search does: of a line's shared runs,
rarest first, the first ones are such that two linked lines have one of these in common. Runs whose lines
are all in one component are done. For the others, the pairs that bags of words and lengths leave are first
thinned to a forest over the components, most alike first, so that a large group joins with few edit
distances (its bags are still compared pair by pair); then all pairs that are still apart are compared.

Lines of up to six words meet on runs of two words, since one edit may touch all runs of three.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import hashes
from granary.llm.chunks import ASKED, ChunkStore, answer_totals, answers, ask
from granary.llm.common import discard, free_shuffles, materialize, remove
from granary.llm.graph import joined_components, with_components

SIMILARITY = 0.8
#: Rounds that compare each line with one of those it meets, and pairs of a forest, before the last search.
ROUNDS = 1
#: Runs that more lines share are dealt in blocks of so many lines, each pair of blocks on its own.
BLOCK = 2048
#: Pairs that are compared at once.
PAIRS = 1 << 18
#: Open runs, pairs and components up to this number are sent to all executors; more are joined by shuffle.
BROADCAST = 1_000_000
#: Bits of a line's bag of words, in the search of a forest and in the last one.
BITS, WIDE_BITS = 512, 2048
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32


class Lines:
    """The lines of a chunk's documents: row, line number, key and number of words, and the hashes of the words."""

    def __init__(self, t: pa.Table):
        texts = t.column("bytes").to_pylist()
        count = np.array([b.count(b"\n") + 1 for b in texts], np.int64)
        self.row = np.repeat(np.arange(len(count)), count)
        self.line = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count, count)
        self.key, self.words = np.zeros(len(self.row), np.uint64), np.zeros(len(self.row), np.int64)
        found, at, stop, line = [np.zeros(0, np.uint64)], 0, 0, 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) < 1 << 20):
                size += len(texts[stop])
                stop += 1
            found.append(self._batch(line, texts[at:stop]))
            line += int(count[at:stop].sum())
            at = stop
        self.h = np.concatenate(found)
        self.start = np.cumsum(self.words) - self.words

    def _batch(self, at: int, texts: list[bytes]) -> np.ndarray:
        data = np.frombuffer(b"\n".join([b.lower() if b.isascii() else b.decode().lower().encode() for b in texts]), np.uint8)
        offsets = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
        h, line = hashes.words(_PLAIN[data], offsets)
        if len(h):
            cut = np.flatnonzero(np.diff(line, prepend=-1))
            size = np.diff(np.append(cut, len(h)))
            place = np.arange(len(h)) - np.repeat(cut, size)
            up, _ = hashes.powers(int(size.max()) + 1)
            self.key[line[cut] + at] = hashes.mix(np.add.reduceat(h * up[place], cut) + size.astype(np.uint64))
            self.words[line[cut] + at] = size
        return h


def most_edits(size: np.ndarray, similarity: float) -> np.ndarray:
    """Edits that a pair may have whose longer line is of so many words."""
    return np.floor((1 - similarity) * size + 1e-9).astype(np.int64)


def most_lost(q: int, size: np.ndarray, similarity: float) -> np.ndarray:
    """Runs of q words that a line of so many words may have and a similar one may lack.

    An edit touches q runs, but an insertion one less; to a line of k words more belong k insertions. From
    a partner's length on that is one period longer the number falls, so the lengths below are all.
    """
    longer = np.arange(math.ceil(1 / max(1 - similarity, 1e-9)) + 1 if similarity < 1 else 1)
    partner = size[:, None] + longer
    edits = most_edits(partner, similarity)
    return np.where(longer <= edits, q * edits - longer, 0).max(1, initial=0)


def families(similarity: float) -> list[tuple[int, int, int]]:
    """(q, least, most) words of the lines that meet on runs of q words: pairs with a line below the least of q = 3 meet on q = 2."""
    size = np.arange(1, 200)
    bad = size[size - 2 - most_lost(3, size, similarity) < 1]
    first = int(bad.max()) + 1
    reach = int(size[size - most_edits(size, similarity) < first].max())
    short = np.arange(2, reach + 1)
    if first > 100 or (short - 1 - most_lost(2, short, similarity) < 1).any():
        raise ValueError("a similarity of 0.75 to 1 is needed")
    return [(2, 2, reach), (3, first, 1 << 62)]


class Runs:
    """Word runs of some lines: hash, line (its place in `own`), place in the line, and distinct hashes with each run's slot among them."""

    def __init__(self, x: Lines, own: np.ndarray, similarity: float, mask: np.uint64):
        self.size = size = x.words[own]
        begin = np.cumsum(size) - size
        word = np.arange(size.sum()) - np.repeat(begin, size)
        self.word_line = np.repeat(np.arange(len(own)), size)
        self.h = x.h[np.repeat(x.start[own] - begin, size) + np.arange(size.sum())]
        parts, self.family = [], []
        for q, least, most in families(similarity):
            n = max(0, len(self.h) - q + 1)
            of = size[self.word_line[:n]]
            use = np.flatnonzero((word[:n] + q <= of) & (of >= least) & (of <= most))
            up, _ = hashes.powers(q + 1)
            joined = self.h[use] + np.uint64(q)
            for k in range(1, q):
                joined += self.h[use + k] * up[k]
            parts.append((hashes.mix(joined) & mask, self.word_line[use], word[use]))
            self.family.append(slice(sum(len(p[0]) for p in parts[:-1]), sum(len(p[0]) for p in parts)))
        self.hash, self.line, self.place = (np.concatenate(c) for c in zip(*parts))
        self.keys, self.slot = hashes.distinct(self.hash)


LINE = "chunk int, doc_id long, line int, key long, first boolean, bucket int, asked binary"
SURVIVOR = "key long, size int, code string, seen binary, wide binary, simhash long, run array<long>, often array<int>, at array<int>"
_KINDS = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.int64()]


def _survivors(x: Lines, own: np.ndarray, runs: Runs, counts: np.ndarray, copies: np.ndarray, similarity: float) -> pa.Table:
    """Lines with enough shared runs to have a link, with their words as letters, bag of words, SimHash, and the runs that they can be met on.

    `copies` has the chunks that hold a line, which its runs are counted in; 0 leaves the line out.
    """
    often = counts[runs.slot] if len(runs.slot) else np.zeros(0, np.int64)
    others = often > copies[runs.line]
    parts = []
    for (q, least, most), s in zip(families(similarity), runs.family):
        line, df, run, at = runs.line[s], often[s], runs.hash[s], runs.place[s]
        shared = np.bincount(line, others[s], len(own)).astype(np.int64)
        need = runs.size - q + 1 - most_lost(q, runs.size, similarity)
        able = (runs.size >= least) & (runs.size <= most) & (shared >= need) & (copies > 0)
        use = np.flatnonzero(others[s] & able[line])
        use = use[np.lexsort((run[use], df[use], line[use]))]
        line, df, run, at = line[use], df[use], run[use], at[use]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        rank = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        keep = rank < (shared - need + 1)[line]
        again = (run[1:] == run[:-1]) & (line[1:] == line[:-1])
        at[1:][again] = at[:-1][again] = -1
        keep[1:] &= ~again
        parts.append((line[keep], df[keep], run[keep], at[keep]))
    line, df, run, at = (np.concatenate(c) for c in zip(*parts))
    order = np.argsort(line, kind="stable")
    line, df, run, at = line[order], df[order], run[order], at[order]
    found, n = np.unique(line, return_counts=True)
    place = np.full(len(own), -1)
    place[found] = np.arange(len(found))
    use = np.flatnonzero(place[runs.word_line] >= 0)
    h, of = runs.h[use], place[runs.word_line[use]]
    cut = np.flatnonzero(np.diff(of, prepend=-1))
    # Words as 2^20 letters beyond the basic plane.
    letters = (h % np.uint64(1 << 20) + np.uint64(1 << 16)).astype("<u4").tobytes().decode("utf-32-le")
    code = [letters[a:b] for a, b in zip(cut.tolist(), np.append(cut[1:], len(h)).tolist())]
    # A word's second, third and further occurrences have bits of their own.
    order = hashes.order_within(of, h)
    again = np.zeros(len(h), np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])) if len(h) else np.zeros(0, np.int64)
    again[order] = np.arange(len(h)) - np.repeat(fresh, np.diff(np.append(fresh, len(h))))
    bags = []
    for bits in (BITS, WIDE_BITS):
        bit = hashes.mix(h + again.astype(np.uint64)) % np.uint64(bits)
        bag = np.zeros(len(found) * bits // 8, np.uint8)
        np.bitwise_or.at(bag, of * (bits // 8) + (bit >> np.uint64(3)).astype(np.int64), (1 << (bit & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        bags.append([x.tobytes() for x in bag.reshape(-1, bits // 8)])
    simhash = np.zeros(len(found), np.uint64)
    size = runs.size[found]
    for b in range(64 if len(found) else 0):
        ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int64), cut)
        simhash |= (2 * ones > size).astype(np.uint64) << np.uint64(b)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    columns = [x.key[own][found].astype(np.int64), size, code, *bags, simhash.astype(np.int64)]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (run.astype(np.int64), np.minimum(df, (1 << 31) - 1).astype(np.int32), at.astype(np.int32))]
    return pa.table([pa.array(c, k) for c, k in zip(columns, _KINDS)] + lists, names=["key", "size", "code", "seen", "wide", "simhash", "run", "often", "at"])


def _small(df: DataFrame) -> DataFrame | None:
    """A written table to be sent to all executors, or None if it has too many rows."""
    return F.broadcast(df) if df.count() <= BROADCAST else None


def _similar(pairs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """The (written) pairs (a, b) of keys whose word sequences are similar."""
    if (few := _small(pairs)) is not None:  # the other lines stay out of the shuffles
        lines = lines.join(F.broadcast(few.select(F.explode(F.array("a", "b")).alias("key")).distinct()), "key", "left_semi")
    a = lines.select(F.col("key").alias("a"), F.col("code").alias("a_code"), F.col("size").alias("a_size"))
    b = lines.select(F.col("key").alias("b"), F.col("code").alias("b_code"), F.col("size").alias("b_size"))
    edits = F.floor(F.greatest("a_size", "b_size") * (1 - similarity) + 1e-9).cast("int")
    within = F.call_function("levenshtein", F.col("a_code"), F.col("b_code"), edits) >= 0
    return pairs.join(b, "b").join(a, "a").where(F.abs(F.col("a_size") - F.col("b_size")) <= edits).where(within).select("a", "b")


def _meetings(lines: DataFrame) -> DataFrame:
    """token, key, size: pairs of the SimHash's four blocks, and each line's two smallest runs."""
    block = [F.shiftrightunsigned("simhash", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [F.xxhash64(F.lit(4 * i + j), block[i], block[j]) for i in range(4) for j in range(i)]
    return lines.select("key", "size", F.explode(F.concat(F.array(*pairs), F.slice(F.array_sort("run"), 1, 2))).alias("token"))


def _one_each(lines: DataFrame, comps: DataFrame | None, similarity: float) -> DataFrame:
    """Pairs (a, b): of each token's components one line each, with the smallest key that it meets."""
    each = _meetings(lines)
    if comps is not None:
        each = with_components(each, comps, "key").groupBy("token", "comp").agg(F.min(F.struct("key", "size")).alias("m")).select("token", "m.key", "m.size")
    hub = each.groupBy("token").agg(F.min(F.struct("key", "size")).alias("m"), F.max("key").alias("last")).where("m.key < last")
    hub = hub.select("token", F.col("m.key").alias("a"), F.col("m.size").alias("a_size"))
    near = F.abs(F.col("size") - F.col("a_size")) <= F.floor(F.greatest("size", "a_size") * (1 - similarity) + 1e-9)
    return each.join(hub, "token").where("a <> key").where(near).groupBy(F.col("key").alias("b")).agg(F.min("a").alias("a"))


def _candidates(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one run and of different components that lengths, places of the run and sets of words leave: the rows, how many words one lacks, edits.

    Rows are in order of run, blocks and size. The words before a run and those behind it need as many edits as
    their numbers differ; this holds where neither line has the run twice (`at` is -1 there).
    """
    c = {k: t.column(k).to_numpy() for k in ("run", "i", "j", "mine", "comp", "size", "at")}
    sets = np.frombuffer(b"".join(t.column("seen").to_pylist()), np.uint64).reshape(t.num_rows, -1)
    held = np.bitwise_count(sets).sum(1, dtype=np.int64)
    size, at, comp = c["size"].astype(np.int64), c["at"].astype(np.int64), c["comp"]
    new = np.zeros(t.num_rows, np.int64)
    new[1:] = np.logical_or.reduce([c[k][1:] != c[k][:-1] for k in ("run", "i", "j")])
    edits = most_edits(size, similarity)
    # In order of size: a line's shorter partners begin where sizes reach its own less its edits.
    ordered = np.cumsum(new) * (int(size.max()) + 1) + size
    first = np.searchsorted(ordered, ordered - edits)
    n = np.arange(t.num_rows) - first
    total = np.cumsum(n)
    lo = 0
    while lo < t.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + PAIRS, "right")))
        m = n[lo:hi]
        y = np.repeat(np.arange(lo, hi), m)
        x = np.arange(len(y)) + np.repeat(first[lo:hi] - np.cumsum(m) + m, m)
        before = at[x] - at[y]
        use = (comp[x] != comp[y]) & ((at[x] < 0) | (at[y] < 0) | (np.abs(before) + np.abs(size[y] - size[x] + before) <= edits[y]))
        use &= (c["i"][y] == c["j"][y]) | (c["mine"][x] != c["mine"][y])
        x, y = x[use], y[use]
        lacks = np.maximum(held[x], held[y]) - np.bitwise_count(sets[x] & sets[y]).sum(1, dtype=np.int64)
        good = lacks <= edits[y]
        if good.any():
            yield x[good], y[good], lacks[good], edits[y[good]]
        lo = hi


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges a, b of a least spanning forest."""
    if not len(a):
        return np.zeros(0, np.int64)
    _, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    edge = np.argsort(weight, kind="stable")
    a, b = ends[: len(a)][edge], ends[len(a) :][edge]
    trees, found = np.arange(int(ends.max()) + 1), []
    while len(edge):
        # Each tree takes its least edge; of two that take the same one the smaller is the root.
        least = np.full((2, len(trees)), len(edge))
        for own, side in zip(least, (a, b)):
            own[side[::-1]] = np.arange(len(edge))[::-1]
        best = least.min(0)
        tree = np.flatnonzero(best < len(edge))
        take = best[tree]
        found.append(edge[np.unique(take)])
        to = trees.copy()
        to[tree] = a[take] + b[take] - tree
        root = (to[to] == trees) & (trees < to)
        to[root] = trees[root]
        while (to[to] != to).any():
            to = to[to]
        a, b = to[a], to[b]
        apart = a != b
        a, b, edge = a[apart], b[apart], edge[apart]
    return np.concatenate(found)


def _pairs_of(t: pa.Table, similarity: float, forest: bool) -> np.ndarray:
    """Pairs of keys: all candidates, or those of a forest over the components that prefers pairs with the smallest share of their edits used."""
    key, comp = t.column("key").to_numpy(), t.column("comp").to_numpy()
    _, node = np.unique(key, return_inverse=True)
    held, n = [np.zeros((0, 3), np.int64)], 0

    def fewer() -> np.ndarray:
        p = np.concatenate(held)
        if forest:
            return p[_forest(comp[p[:, 0]], comp[p[:, 1]], p[:, 2])]
        low, high = np.minimum(node[p[:, 0]], node[p[:, 1]]), np.maximum(node[p[:, 0]], node[p[:, 1]])
        return p[np.unique(low * len(node) + high, return_index=True)[1]]

    for x, y, lacks, edits in _candidates(t, similarity):
        held.append(np.stack([x, y, (lacks << 20) // np.maximum(edits, 1)], 1))
        n += len(x)
        if n >= 4 * PAIRS:
            held = [fewer()]
            n = 0
    kept = fewer()
    a, b = key[kept[:, 0]], key[kept[:, 1]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def _all_left(lines: DataFrame, comps: DataFrame, similarity: float, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that share one of the runs that they can be met on; with `forest` no more than join what meets in a task."""
    few = _small(comps)
    own = with_components(lines.select("key", "size", F.col("seen" if forest else "wide").alias("seen"), "run", "often", "at"), comps if few is None else few, "key")
    if few is None:
        own = materialize(own, "grouped")
    runs = own.select("comp", F.explode(F.arrays_zip("run", "often")).alias("r")).select("comp", "r.run", "r.often")
    met = runs.groupBy("run").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("often").alias("often"))
    left = materialize(met.where("low <> high").select("run", F.ceil(F.col("often") / BLOCK).cast("int").alias("blocks")), "open-runs")
    own_runs = F.explode(F.arrays_zip("run", "at")).alias("r")
    if (open_ := _small(left)) is not None:
        rows = own.select("key", "comp", "size", "seen", own_runs).select("key", "comp", "size", "seen", "r.run", "r.at").join(open_, "run")
    else:  # bags of words are not sent along before it is known which runs of a line are open
        met = own.select("key", own_runs).select("key", "r.run", "r.at").join(left, "run").groupBy("key").agg(F.collect_list(F.struct("run", "at", "blocks")).alias("r"))
        rows = own.select("key", "comp", "size", "seen").join(met, "key").select("key", "comp", "size", "seen", F.inline("r"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("run", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "comp", "size", "at", "seen")
    rows = rows.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "size", "key")

    def find(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            pair = _pairs_of(t, similarity, forest)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, k]) for k in range(2)], names=["a", "b"])

        for p in parts:
            held.append(p)
            if sum(h.num_rows for h in held) >= 100_000:
                t = pa.Table.from_batches(held)
                same = np.logical_and.reduce([t.column(k).to_numpy() == t.column(k)[-1].as_py() for k in ("run", "i", "j")])
                if at := int(np.argmax(same)):
                    yield done(t.slice(0, at))
                    held = t.slice(at).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    pairs = materialize(rows.mapInArrow(find, "a long, b long").distinct(), "pairs")
    discard(left, *([own] if few is None else []))
    free_shuffles(lines.sparkSession)
    return pairs


def _here(x: Lines, t: pa.Table) -> np.ndarray:
    """A chunk's distinct lines with words, each where it occurs first there; rows without a doc_id have none."""
    own = _lines_of(x, t)
    return np.sort(own[np.unique(x.key[own], return_index=True)[1]])


def _lines_of(x: Lines, t: pa.Table) -> np.ndarray:
    return np.flatnonzero((x.words > 0) & t.column("doc_id").is_valid().to_numpy().astype(bool)[x.row])


def _groups(lines: DataFrame, store: ChunkStore, similarity: float) -> DataFrame:
    """key, kept (the group's first occurrence) of lines that are equal or similar to others."""
    mask = store.mask
    nodes = lines.where("not asks").groupBy("key").agg(F.min(F.struct("doc_id", "line", "chunk")).alias("first"), F.count("*").alias("n"), F.count_if("first").cast("int").alias("copies"))
    nodes = materialize(nodes.select("key", "first", F.expr("n > 1").alias("twice"), "copies"), "lines")
    counted = materialize(answer_totals(lines.where("asks").select("chunk", "bucket", "asked")), "counts")
    remove(store.spark, f"{lines.granary_path}/asks=true")

    def survive(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        is_line = told.column("key").is_valid().to_numpy().astype(bool)
        x = Lines(t)
        own = _here(x, t)
        runs = Runs(x, own, similarity, mask)
        theirs = told.filter(pa.array(is_line)).sort_by("key")
        key, copies = theirs.column("key").to_numpy(), np.zeros(len(own), np.int64)
        if len(key):
            mine = x.key[own].astype(np.int64)
            at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            copies = np.where(key[at] == mine, theirs.column("copies").to_numpy()[at], 0)
        return _survivors(x, own, runs, answers(told.filter(pa.array(~is_line))).astype(np.int64), copies, similarity)

    told = nodes.select("first.chunk", "key", "copies").unionByName(counted, allowMissingColumns=True)
    left = materialize(store.meet(told, survive, SURVIVOR), "able-lines")
    discard(counted)
    free_shuffles(store.spark)
    comps = None
    for _ in range(ROUNDS):
        met = materialize(_one_each(left, comps, similarity), "met")
        comps = joined_components(comps, _similar(met, left, similarity))
        pairs = _all_left(left, comps, similarity, forest=True)
        comps = joined_components(comps, _similar(pairs, left, similarity))
        discard(met, pairs)
    pairs = _all_left(left, comps, similarity)
    comps = joined_components(comps, _similar(pairs, left, similarity))
    own = nodes.join(comps, F.col("key") == F.col("node"), "left").where("twice or comp is not null")
    own = own.select("key", F.coalesce("comp", "key").alias("comp"), F.struct("first.doc_id", "first.line").alias("first"))
    groups = materialize(own.join(own.groupBy("comp").agg(F.min("first").alias("kept")), "comp").select("key", "kept"), "groups")
    discard(left, pairs, nodes)
    return groups


KEPT = "doc_id long, n_lines long, n_removed long, kept string"


def drop_similar_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines, n_removed, kept (the text without its removed lines) of each row.

    Of each connected group of similar lines the first occurrence, by doc_id and line number, stays. Lines
    without letters or digits always stay. A null text counts as empty: one empty line. Rows with a null
    doc_id stay whole and take no part; rows that repeat a doc_id count as one document, whose lines of
    one number are one occurrence. An empty table gives an empty result. Other columns are ignored.
    `similarity` is from 0.75 to 1. In the comparison words are told apart by 20 bits of their hash: two
    different ones count as equal once in a million.
    """
    store = ChunkStore(docs)

    buckets, mask = store.buckets, store.mask

    def describe(chunk: int, t: pa.Table) -> pa.Table:
        """The chunk's lines, and what it asks: in how many lines each run of its distinct lines occurs."""
        x = Lines(t)
        own, here = _lines_of(x, t), _here(x, t)
        runs = Runs(x, here, similarity, mask)
        asked = ask(chunk, runs.keys, np.bincount(runs.slot, minlength=len(runs.keys)), buckets)
        doc = np.array([0 if i is None else i for i in t.column("doc_id").to_pylist()], np.int64)[x.row[own]]
        told = pa.table({"chunk": pa.array(np.full(len(own), chunk, np.int32)), "doc_id": doc, "line": pa.array(x.line[own].astype(np.int32)), "key": x.key[own].astype(np.int64), "first": np.isin(own, here)})
        both = pa.concat_tables([told, asked], promote_options="default")
        return both.select(["chunk", "doc_id", "line", "key", "first", "bucket", "asked"])

    lines = materialize(store.map(describe, LINE).withColumn("asks", F.expr("bucket is not null")), "all-lines", "asks")
    groups = _groups(lines, store, similarity)
    gone = lines.where("not asks").select("chunk", "doc_id", "line", "key").join(groups, "key").where("doc_id <> kept.doc_id or line <> kept.line").select("chunk", "doc_id", "line", "key")

    def cut(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        drop: dict[int, set] = {}
        for d, n, k in zip(told.column("doc_id").to_pylist(), told.column("line").to_pylist(), told.column("key").to_pylist()):
            drop.setdefault(d, set()).add((n, k))
        ids = t.column("doc_id").to_pylist()
        hit = [i for i, d in enumerate(ids) if d in drop]
        # Of a document with one row here the line numbers are enough; of repeated rows the lines are compared.
        twice = [i for i in hit if ids.count(ids[i]) > 1] if len({ids[i] for i in hit}) < len(hit) else []
        keys: dict[int, list[int]] = {}
        if twice:
            x = Lines(t.take(pa.array(twice)))
            keys = {i: own.tolist() for i, own in zip(twice, np.split(x.key.astype(np.int64), np.flatnonzero(np.diff(x.row)) + 1))}
        out = []
        for i, (d, text) in enumerate(zip(ids, t.column("bytes").to_pylist())):
            own, kept = text.count(b"\n") + 1, text.decode()
            lost = 0
            if d in drop:
                gone = {n for n, k in drop[d] if i not in keys or (n < own and keys[i][n] == k)}
                lost, kept = len(gone), "\n".join([s for n, s in enumerate(kept.split("\n")) if n not in gone])
            out.append((d, own, lost, kept))
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=["doc_id", "n_lines", "n_removed", "kept"])

    result = materialize(store.meet(gone, cut, KEPT), "kept")
    store.drop()
    discard(lines, groups)
    return result
