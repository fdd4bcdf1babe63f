"""Toxicity scores from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams and of itself, hashed into a fixed
number of buckets; a passage's vector is the mean over its words; a linear softmax gives the class. Both
layers are trained together. Training starts on whole texts and goes on with each text's most toxic
passage of SPAN words, since a few words decide: a text's score is that of its most toxic passage. Every
run of SPAN words is a passage.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import fold, free, pack, unpack, whole_text

WORD = re.compile(r"[^\W_]+")
BUCKETS, DIM, SPAN = 1 << 18, 16, 12
SHORTEST, LONGEST = 4, 6
#: Longer runs of letters, as in texts without spaces, are read in windows of so many letters.
WINDOW = 40
#: Buckets that fewer training texts have keep a zero vector, so that no text is learnt by its own rare words.
FEWEST = 5
#: Step lengths of embeddings, output layer and bias.
RATES = (4.0, 0.1, 0.1)
#: Words whose worth is kept, and tokens that a step of training holds at once (a longer text comes alone).
MEMO, BLOCK = 500_000, 1 << 18


def text_words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits; a run of more than WINDOW as windows that overlap, so that each n-gram is whole in one."""
    found = WORD.findall(text.lower())
    if max(map(len, found), default=0) <= WINDOW:
        return found
    step = WINDOW - LONGEST + 1
    return [w[i : i + WINDOW] for w in found for i in range(0, max(1, len(w) - LONGEST + 1), step)]


def subwords(word: str) -> list[int]:
    """Buckets of the marked word and of its n-grams."""
    marked = f"<{word}>"
    text = marked.encode() if marked.isascii() else marked
    grams = [text[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(text) - n + 1)]
    own = dict.fromkeys([text, *grams])
    return [zlib.crc32(g) % BUCKETS for g in (own if marked.isascii() else map(str.encode, own))]


class Trainer:
    """Full-batch steps on both layers, each of a set length, so that what many texts agree on grows and what single texts have does not. The gradient of a word's vector is a multiple of one direction, so counts by bucket suffice."""

    def __init__(self, texts: list[str], labels: np.ndarray, seed: int = 7):
        words: dict[str, int] = {}
        docs = [np.array([words.setdefault(w, len(words)) for w in text_words(t)], np.int32) for t in texts]
        self.sizes = np.array([len(d) for d in docs])
        self.tokens = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        subs = [np.array(subwords(w), np.int32) for w in words]
        self.per = np.array([len(s) for s in subs] or [0])
        self.sub = np.concatenate(subs) if subs else np.zeros(0, np.int32)
        self.sub_at = np.concatenate([[0], np.cumsum(self.per)[:-1]])
        self.word_of_sub = np.repeat(np.arange(len(subs), dtype=np.int32), self.per[: len(subs)])
        del subs
        self.y = labels.astype(float)
        seen = np.zeros(BUCKETS, np.int64)
        for d in docs:
            own = np.unique(d)
            seen[np.unique(np.concatenate([self.sub[self.sub_at[w] : self.sub_at[w] + self.per[w]] for w in own] or [self.sub[:0]]))] += 1
        self.learnt = seen >= FEWEST
        self.n_words = len(words)
        rng = np.random.default_rng(seed)
        self.emb = rng.normal(0, 0.01, (BUCKETS, DIM)) * self.learnt[:, None]
        self.out = rng.normal(0, 0.3, (2, DIM))
        self.bias = np.zeros(2)

    def fit(self, whole: int = 30, picked: int = 100) -> None:
        if not self.n_words or len(set(self.y)) < 2:
            return
        full = np.flatnonzero(self.sizes)
        size = self.sizes[full]
        base = np.cumsum(size) - size
        # Blocks of whole texts; sums run on from block to block in the order of tokens.
        cuts = [0]
        while cuts[-1] < len(full):
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(base + size, base[cuts[-1]] + BLOCK, "right"))))
        blocks = list(zip(cuts[:-1], cuts[1:]))
        weight = np.where(self.y > 0, np.sqrt(max(1.0, (self.y == 0).sum() / max(1, (self.y > 0).sum()))), 1.0)[full]
        weight /= weight.sum()
        params = [self.emb, self.out, self.bias]
        m, scale = [np.zeros_like(p) for p in params], [0.0] * 3
        grad, spare = np.empty_like(self.emb), np.empty_like(self.emb)
        for step in range(1, whole + picked + 1):
            way = self.out[1] - self.out[0]
            worth = np.add.reduceat((self.emb @ way)[self.sub], self.sub_at) / self.per
            per_word, pulled, carried = np.zeros(self.n_words), np.empty(len(full)), 0.0
            for lo, hi in blocks:
                own, at = size[lo:hi], base[lo:hi]
                if step > whole:  # the mean over each text's most toxic passage, else over all its words
                    sums = np.cumsum(np.concatenate([[carried], worth[self.tokens[at[0] : at[-1] + own[-1]]]]))
                    carried = sums[-1]
                    top = best_passages(sums, at - at[0], own)
                    own, at = np.minimum(own, SPAN), at + top
                rows = np.repeat(np.arange(hi - lo), own)
                share = (1.0 / own)[rows]
                tokens = self.tokens[np.arange(len(rows)) + (at - np.cumsum(own) + own)[rows]]
                logit = np.bincount(rows, worth[tokens] * share, hi - lo) + self.bias[1] - self.bias[0]
                pulled[lo:hi] = pull = weight[lo:hi] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - self.y[full[lo:hi]])
                np.add.at(per_word, tokens, pull[rows] * share)
            bucket = np.bincount(self.sub, (per_word / self.per)[self.word_of_sub], BUCKETS) * self.learnt
            toward = bucket @ self.emb
            np.multiply(bucket[:, None], way, out=grad)
            grads = [grad, np.stack([-toward, toward]) + 1e-5 * self.out, np.array([-pulled.sum(), pulled.sum()])]
            pace = min(1.0, 2 * (1 - step / (whole + picked + 1)))
            for k, (p, g, a) in enumerate(zip(params, grads, m)):
                held = spare if k == 0 else np.empty_like(p)
                scale[k] += 0.02 * (np.sum(np.multiply(g, g, out=held)) - scale[k])
                np.subtract(g, a, out=held)
                held *= 0.1
                a += held
                np.divide(a, 1 - 0.9**step, out=held)
                held *= pace * RATES[k]
                held /= np.sqrt(scale[k] / (1 - 0.98**step)) + 1e-12
                p -= held

    def model(self, slope: float = 1.0, offset: float | None = None) -> bytes:
        """By bucket, what it adds to the logit of class 1; with the offset last."""
        offset = self.bias[1] - self.bias[0] if offset is None else offset
        return pack(np.append(slope * (self.emb @ (self.out[1] - self.out[0])), offset))


def best_passages(sums: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where in each text the first passage of SPAN words (all, if fewer) of largest mean begins. sums: the running sum of the words' worth, from before the first; at, size: where texts begin, and their words."""
    n = np.maximum(size - SPAN + 1, 1)
    first = np.cumsum(n) - n
    begin = np.arange(n.sum()) + np.repeat(at - first, n)
    length = np.repeat(np.minimum(size, SPAN), n)
    mean = (sums[begin + length] - sums[begin]) / length
    best = np.flatnonzero(mean == np.repeat(np.maximum.reduceat(mean, first), n))
    text = np.repeat(np.arange(len(n)), n)[best]
    return (best - first[text])[np.diff(text, prepend=-1) != 0]


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over raw scores, by Newton's method with a slight pull to 0."""
    scale = raw.std() or 1.0
    x = np.stack([raw / scale, np.ones_like(raw)], 1)
    beta = np.array([1.0, np.log((weight @ y + 1) / (weight @ (1 - y) + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-2 * beta
        beta -= np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + 1e-2 * np.eye(2), gradient)
    return max(beta[0], 0.0) / scale, beta[1]


def prior(share: dict[int, float]) -> bytes:
    """The model that gives every text the share of class 1."""
    return pack(np.append(np.zeros(BUCKETS), np.log(share[1] / share[0])))


def is_fitted(model: bytes) -> bool:
    """Whether the model tells texts apart at all."""
    return bool(unpack(model)[0][:-1].any())


def fit_model(texts: list[str], labels: np.ndarray, share: dict[int, float]) -> bytes:
    """Trains on four fifths of the sample; the last fifth sets slope and offset. share: each class's share of all labelled rows, none of them 0.

    Where either part lacks a class, all of the sample trains and the offset moves from the odds that
    training saw to those of `share`. A sample of one class gives the prior alone.
    """
    aside = np.array([zlib.crc32(t.encode()) % 5 == 0 for t in texts], bool)
    y = labels.astype(float)
    if len(set(y)) < 2:
        return prior(share)
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        t = Trainer(texts, labels)
        t.fit()
        trained = np.sqrt(max(1.0, (y == 0).sum() / y.sum())) * y.sum() / (y == 0).sum()
        return t.model(1.0, t.bias[1] - t.bias[0] + np.log(share[1] / share[0]) - np.log(trained))
    t = Trainer([x for x, a in zip(texts, aside) if not a], labels[~aside])
    t.fit()
    scorer = Scorer(t.model(1.0, 0.0))
    raw = scorer.raw([x for x, a in zip(texts, aside) if a])
    own = y[aside]
    weight = np.where(own > 0, share[1] / own.sum(), share[0] / (1 - own).sum()) * len(own)
    return t.model(*calibrate(raw, own, weight))


def train(docs: DataFrame, labels: DataFrame, most: int = 4000) -> bytes:
    """Fits on at most `most` labelled rows of each class, of ids whose fold is not 0.

    The sample is the rows of smallest hashed id, the same for any partitioning; it bounds what one task
    reads to fit, and it is the only bound: scoring covers all rows. A doc_id with several labels takes
    the largest, and one with several texts the first in order; null labels, ids without a text and rows of
    fold 0 are left out. With no labels of one
    class every score is the share of toxic labels, each class counted once more: one half with no labels.
    """
    own = labels.where(F.col("toxic").isNotNull() & (fold() != 0)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    counted = {int(r.toxic): float(r["count"]) for r in own.groupBy("toxic").count().collect()}
    rest = 0.0 if len(counted) == 2 else 1.0
    share = {c: (counted.get(c, 0.0) + rest) / (sum(counted.values()) + 2 * rest) for c in (0, 1)}
    order = F.xxhash64("doc_id")
    picked = own.where("toxic = 1").orderBy(order, "doc_id").limit(most).unionByName(own.where("toxic = 0").orderBy(order, "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sample = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic")

    def fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [b for b in batches if len(b)]
        if rows:
            all_rows = pd.concat(rows).sort_values(["doc_id", "text"]).drop_duplicates("doc_id")
            yield pd.DataFrame({"model": [fit_model(all_rows.text.tolist(), all_rows.toxic.to_numpy(), share)]})

    found = sample.repartition(1).mapInPandas(fit, "model binary").collect()
    return bytes(found[0].model) if found else prior(share)


class Scorer:
    def __init__(self, model: bytes):
        (m,) = unpack(model)
        self.bucket, self.bias = m[:-1], m[-1]
        self.memo: dict[str, float] = {}

    def raw(self, texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            words = text_words(t)
            memo = self.memo
            if new := list(set(words).difference(memo)):
                subs = [subwords(w) for w in new]
                size = np.fromiter(map(len, subs), np.int64, len(subs))
                means = np.add.reduceat(self.bucket[np.fromiter(chain.from_iterable(subs), np.int64, size.sum())], np.cumsum(size) - size) / size
                memo.update(zip(new, means.tolist()))
            if words:
                worth = np.fromiter(map(memo.__getitem__, words), float, len(words))
                size = min(len(words), SPAN)
                sums = np.concatenate([[0.0], np.cumsum(worth)])
                out[k] = (sums[size:] - sums[:-size]).max() / size
            else:
                out[k] = 0.0
            if len(memo) > MEMO:
                self.memo = {}
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts) + self.bias, -500, 500)))


def score_toxicity(docs: DataFrame, model: bytes, text: str = "text", name: str = "score") -> DataFrame:
    """All rows with a column `name`: the model's probability of class 1.

    A null or empty text, or one without letters, has the score of the bias alone. Equal texts have equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Scorer] = {}

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        state.setdefault("scorer", Scorer(shared.value))
        for b in batches:
            yield pd.Series(state["scorer"].scores(b.tolist()))

    return docs.withColumn(name, score(whole_text(text)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 where the score is one half or more) for each row of `docs`.

    A model that tells no texts apart gives all the same score: the share of class 1 among the labels, one half without any.
    """
    model = train(docs, labels)
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose text scores below one half; all rows where the model tells no texts apart.

    Null texts score as empty ones; rows that repeat an id or have none each count by their own text. A
    column of `docs` named score stays as it is. An empty table gives an empty result.
    """
    model = train(docs, labels)
    if not is_fitted(model):
        return docs
    (name,) = free(docs.columns, "score")
    return score_toxicity(docs, model, name=name).where(F.col(name) < 0.5).drop(name)
