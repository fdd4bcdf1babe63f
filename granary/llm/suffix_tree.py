"""Probabilistic suffix tree over words: contexts of up to `depth` words, kept by a divergence test.

Level 0 is the smoothed distribution of single tokens. A context s of n words is a candidate when it occurs
LEAST times or more in training. With c(s, x) its occurrences before x and c(s) all of them,

    p(x | s) = (1 - w) c(s, x) / c(s) + w p(x | parent)

where the parent is the longest kept shorter suffix of s. The weight w is one for all contexts of n words
and of equal floor(log2 c(s)): the share of their training occurrences whose next token comes once only in
its context, that is how often something new follows. A context is kept if it raises the log-likelihood of
its own training occurrences, each scored with itself left out, by more than GAIN nats: c(s) times an
estimate of the divergence from the parent. A token is scored in the longest kept context before it.

All statistics are sums over positions. Chunks ask for counts of runs of n words, n = 1, 2, ..., and tell
the gains of their contexts; a frequent context is one entry a chunk, whatever follows it. Gains are added
up as whole numbers, so that results do not depend on chunks. Runs are told apart by 64-bit hashes
whatever the size of the corpus, as words are: among 10^12 different ones about one in 2 * 10^7 shares its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm import hashes
from granary.llm.chunks import ChunkStore, answers, batches, bucket_of
from granary.llm.common import materialize, narrow, pack, pack_sorted, unpack, unpack_sorted

LEAST, DEPTH, GAIN = 2, 4, 8.0
#: Gains are rounded to so many parts of a nat; counts of contexts fall into bins by their logarithm.
PARTS, BINS = 64, 64
END = np.uint64(0x5851F42D4C957F2D)
HELD_OUT = 1
#: Odd numbers, one for each place before a run's last token.
STEPS = hashes.mix(np.arange(256, dtype=np.uint64)) | np.uint64(1)
COUNTS, GAINS = 0, 1


CODED = "chunk int, tokens binary"


def coded(chunk: int, t: pa.Table) -> pa.Table:
    """A chunk's documents as one row: their ids, which of them are there, their numbers of tokens, the different tokens' hashes, and each token's number among these."""
    hs, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for rows, data, offsets in batches(t):
        h, d = hashes.words(data, offsets)
        hs.append(h)
        docs.append(rows[d])
    doc = np.concatenate(docs)
    size = np.bincount(doc, minlength=t.num_rows) + 1
    token = np.full(int(size.sum()), END)
    token[np.arange(len(doc)) + doc] = np.concatenate(hs)
    keys, slot = hashes.distinct(token)
    ids = t.column("doc_id")
    row = pack(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy().astype(np.uint8), narrow(size), pack_sorted(keys), narrow(slot))
    return pa.table({"chunk": pa.array([chunk], pa.int32()), "tokens": pa.array([row], pa.binary())})


class Tokens:
    """The tokens of a chunk's documents in order, each document's words and its end, from their row.

    keys: the hashes of different tokens, sorted; slot: by position, the token's number among them.
    """

    def __init__(self, t: pa.Table):
        ids, there, size, keys, slot = unpack(t.column("tokens")[0].as_py())
        self.ids = pa.array(ids, mask=there == 0)
        self.fold = np.array([-1 if i is None else zlib.crc32(str(i).encode()) % 5 for i in self.ids.to_pylist()], np.int64)
        self.keys, self.slot = unpack_sorted(keys), slot.astype(np.int64)
        self.token = self.keys[self.slot]
        size = size.astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), size)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(size) - size, size)
        self.train = ((self.fold >= 0) & (self.fold != HELD_OUT))[self.doc]


class Runs:
    """Runs of n tokens at the positions `at` where they end: which are asked for, and their training counts.

    count: by position, once answered; slot: by position, the number of its run among `keys`.
    """

    def __init__(self, x: Tokens, n: int, at: np.ndarray, run: np.ndarray, sure: np.ndarray | None, seen: np.ndarray):
        self.x, self.n, self.at, self.run = x, n, at, run
        self.sure = np.zeros(len(at), bool) if sure is None else sure
        self.seen = seen
        self.asked = at[~self.sure]
        if n == 1:
            self.keys, self.slot = x.keys, x.slot
            return
        self.keys, inverse = hashes.distinct(run[self.asked])
        self.slot = np.full(len(x.token), -1, np.int64)
        self.slot[self.asked] = inverse

    def answered(self, told: pa.Table, sure_counts: np.ndarray) -> None:
        self.count = np.zeros(len(self.x.token), np.int64)
        self.count[self.at] = sure_counts
        if len(self.asked):
            self.count[self.asked] = answers(told).astype(np.int64)[self.slot[self.asked]]

    def question(self) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Keys, their training counts and, for those that may come once in all, bins of their contexts; and by bin of the context all training occurrences, and those that are sure to be single."""
        slot, train = self.slot[self.asked], self.x.train[self.asked]
        counts = np.bincount(slot, train, len(self.keys))
        bins = np.zeros(len(self.keys), np.uint8)
        bins[slot] = bin_of(self.seen[~self.sure])
        bins[counts != 1] = 0
        every = bin_of(self.seen[self.x.train[self.at]])
        once = bin_of(self.seen[self.sure & self.x.train[self.at]])
        return self.keys, [narrow(counts.astype(np.uint64)), bins], np.concatenate([np.bincount(b, minlength=BINS) for b in (every, once)]).astype(np.uint64)


def bin_of(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(n.astype(float))[1] - 1, 0)


def single_tokens(x: Tokens) -> Runs:
    return Runs(x, 1, np.arange(len(x.token)), x.token, None, np.zeros(len(x.token), np.int64))


def longer(x: Tokens, runs: Runs) -> tuple[Runs, np.ndarray]:
    """Runs of one token more, where the tokens before the last are a candidate context; and the counts that are sure.

    A run has no more occurrences than its end: none where that has none, one where that is this very one.
    """
    n = runs.n
    at = np.flatnonzero((x.place[1:] >= n) & (runs.count[:-1] >= LEAST)) + 1
    run = np.zeros(len(x.token), np.uint64)
    run[at] = hashes.mix(runs.run[at] * np.uint64(3) + x.token[at - n] * STEPS[n])
    last = runs.count[at]
    sure = (last == 0) | ((last == 1) & x.train[at])
    return Runs(x, n + 1, at, run, sure, runs.count[at - 1]), np.minimum(last, 1)


class Walk:
    """What the answers so far say of a chunk's positions: runs of each length up to `longest`, and the probabilities."""

    def __init__(self, t: pa.Table, told: pa.Table, found: dict[int, dict], longest: int):
        self.x = x = Tokens(t)
        self.found, self.told = found, told
        runs = single_tokens(x)
        self.runs, self.next = [], runs
        sure = np.zeros(len(x.token), np.int64)
        while self.next.n in found:
            self.next.answered(self._of(self.next.n, COUNTS), sure)
            self.runs.append(self.next)
            if self.next.n == longest:
                break
            self.next, sure = longer(x, self.next)
        if self.runs:
            n, v = found[1]["n"], found[1]["v"]
            self.p0 = (self.runs[0].count + 0.5) / (n + 0.5 * (v + 1))
            self.p = self.p0.copy()

    def _of(self, level: int, kind: int) -> pa.Table:
        t = self.told
        return t.filter(pa.array((t.column("level").to_numpy() == level) & (t.column("kind").to_numpy() == kind))) if t.num_rows else t

    def contexts(self, level: int) -> tuple[np.ndarray, ...]:
        """Positions behind contexts of `level` words, their numbers among the keys of those runs, c(s, x), c(s) and w."""
        short, long = self.runs[level - 1], self.runs[level]
        at = long.at
        return at, short.slot[at - 1], long.count[at].astype(float), long.seen.astype(float), self.found[level + 1]["weight"][bin_of(long.seen)]

    def gains(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        at, slot, c, n, w = self.contexts(level)
        train = self.x.train[at]
        ratio = (1 - w) * np.maximum(c - 1, 0) / (np.maximum(n - 1, 1) * self.p[at]) + w
        gain = np.where(train, np.rint(PARTS * np.log(ratio)), 0.0)
        keys = self.runs[level - 1].keys
        used = np.bincount(slot, minlength=len(keys)) > 0
        return used, np.bincount(slot, gain, len(keys))[used].astype(np.int64)

    def learn(self, level: int) -> None:
        """Goes on with the kept contexts of `level` words."""
        at, slot, c, n, w = self.contexts(level)
        if len(at):
            keys = self.runs[level - 1].keys
            kept = np.zeros(len(keys), bool)
            kept[np.bincount(slot, minlength=len(keys)) > 0] = answers(self._of(level, GAINS)) > 0
            self.p[at] = np.where(kept[slot], (1 - w) * c / n + w * self.p[at], self.p[at])


ASKED = "chunk int, bucket int, kind int, asked binary"
ANSWERED = "chunk int, bucket int, kind int, answer binary, sums array<long>"


def _ask(chunk: int, buckets: int, kind: int, keys: np.ndarray, values: list[np.ndarray], once: np.ndarray | None = None) -> pa.Table:
    """A row for each bucket that the sorted keys fall into; the first also carries `once`."""
    cut = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    if not len(full) and once is not None and once.any():
        full = np.array([0])
    none = np.zeros(0, np.uint64)
    rows = [pack(pack_sorted(keys[cut[b] : cut[b + 1]]), *(v[cut[b] : cut[b + 1]] for v in values), *([] if once is None else [once if b == full[0] else none])) for b in full]
    return pa.table({"chunk": pa.array([chunk] * len(full), pa.int32()), "bucket": pa.array(full, pa.int32()), "kind": pa.array([kind] * len(full), pa.int32()), "asked": pa.array(rows, pa.binary())})


def _signs(gains: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones: small ones stay small."""
    return ((gains << 1) ^ (gains >> 63)).astype(np.uint64)


def _answer(asked: DataFrame) -> DataFrame:
    """To each chunk the counts of its runs, and whether its contexts are kept; in one row a bucket, with chunk -1, sums for the weights."""

    def total(t: pa.Table) -> pa.Table:
        parts = []
        for kind in (COUNTS, GAINS):
            own = t.filter(pa.array(t.column("kind").to_numpy() == kind))
            if not own.num_rows:
                continue
            told = [unpack(x) for x in own.column("asked").to_pylist()]
            keys = [unpack_sorted(x[0]) for x in told]
            every, place = hashes.distinct(np.concatenate(keys))
            value = np.concatenate([x[1].astype(np.int64) for x in told])
            if kind == GAINS:
                value = (value >> 1) ^ -(value & 1)
            sums = np.bincount(place, value, len(every))
            cut = np.cumsum([0, *map(len, keys)])
            if kind == COUNTS:
                result, single = sums.astype(np.uint64), sums == 1
                # Where the sum is 1, one chunk alone has given a bin.
                bins = np.bincount(place, np.concatenate([x[2] for x in told]), len(every))[single].astype(np.int64)
                tally = sum((x[3].astype(np.int64) for x in told if len(x[3])), np.zeros(2 * BINS, np.int64))
                tally[BINS:] += np.bincount(bins, minlength=BINS)
                tally = np.append(tally, (sums > 0).sum())
            else:
                result, tally = (sums > GAIN * PARTS).astype(np.uint8), None
            out = [pack(narrow(result[place[a:b]])) for a, b in zip(cut[:-1], cut[1:])]
            n = own.num_rows
            parts.append(pa.table({"chunk": own.column("chunk"), "bucket": own.column("bucket"), "kind": own.column("kind"), "answer": pa.array(out, pa.binary()), "sums": pa.array([None] * n, pa.list_(pa.int64()))}))
            if tally is not None:
                parts.append(pa.table({"chunk": pa.array([-1], pa.int32()), "bucket": pa.array([0], pa.int32()), "kind": pa.array([kind], pa.int32()), "answer": pa.array([None], pa.binary()), "sums": pa.array([tally], pa.list_(pa.int64()))}))
        return pa.concat_tables(parts)

    return asked.groupBy("bucket").applyInArrow(total, ANSWERED)


def _tally(told: DataFrame, level: int) -> dict:
    """Number of positions, of different runs with training occurrences, and by bin of the context's count the weight."""
    rows = told.where((F.col("chunk") == -1) & (F.col("level") == level)).select(F.posexplode("sums").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros(2 * BINS + 1)
    for r in rows:
        sums[r.k] = r.v
    seen, single = sums[:BINS], sums[BINS : 2 * BINS]
    return {"n": int(seen.sum()), "v": int(sums[-1]), "weight": (single + 0.5) / (seen + 1)}


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Training takes the rows whose crc32(doc_id as text) mod 5 is not 1; rows with a null doc_id are
    neither held out nor learnt from. A null text counts as empty: its end is its one token. With no
    training rows all probabilities are 1. Rows that repeat a doc_id each count and have a row. An empty
    table gives an empty result. Other columns are ignored. `depth` is the number of words of the longest
    contexts; each one more is a further pass over the coded tokens. Texts are read and hashed once.
    """
    store = ChunkStore(docs)
    store.recode(coded, CODED)
    buckets = store.buckets

    def answered(told: DataFrame) -> DataFrame:
        return told.where("chunk >= 0").select("chunk", "bucket", "kind", "answer", "level")

    def first(chunk: int, t: pa.Table) -> pa.Table:
        keys, values, once = single_tokens(Tokens(t)).question()
        return _ask(chunk, buckets, COUNTS, keys, values, once)

    told = store.tell(_answer(store.map(first, ASKED)).withColumn("level", F.lit(1)))
    found = {1: _tally(told, 1)}
    for n in range(1, depth + 2):  # counts of runs of n tokens are known, and gains of contexts of n - 2 words

        def ask(chunk: int, t: pa.Table, told: pa.Table, n: int = n, found: dict = dict(found)) -> pa.Table:
            w = Walk(t, told, found, depth + 1)
            parts = []
            if n <= depth:
                keys, values, once = w.next.question()
                parts.append(_ask(chunk, buckets, COUNTS, keys, values, once))
            if n >= 2:
                for level in range(1, n - 1):
                    w.learn(level)
                used, gains = w.gains(n - 1)
                parts.append(_ask(chunk, buckets, GAINS, w.runs[n - 2].keys[used], [narrow(_signs(gains))]))
            return pa.concat_tables(parts)

        level = F.when(F.col("kind") == COUNTS, n + 1).otherwise(n - 1)
        told = store.tell(_answer(store.meet(answered(told), ask, ASKED)).withColumn("level", level))
        if n <= depth:
            found[n + 1] = _tally(told, n + 1)

    def score(chunk: int, t: pa.Table, told: pa.Table) -> pa.Table:
        w = Walk(t, told, found, depth + 1)
        for level in range(1, depth + 1):
            w.learn(level)
        x, rows = w.x, len(w.x.ids)
        ints = lambda y: pa.array(np.bincount(x.doc, y, rows).astype(np.int64))
        return pa.table({"doc_id": x.ids, "held_out": pa.array(x.fold == HELD_OUT), "n_tokens": ints(np.ones(len(x.doc))), "n_known": ints(w.runs[0].count > 0), "train_tokens": pa.array(np.full(rows, found[1]["n"])), "base_score": pa.array(np.bincount(x.doc, np.log10(w.p0), rows)), "score": pa.array(np.bincount(x.doc, np.log10(w.p), rows))})

    result = materialize(store.meet(answered(told), score, SCORES), "scores")
    store.drop()
    return result
