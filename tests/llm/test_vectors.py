"""Top-k search and hard negatives against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import hard_negatives, nra

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, score string, cell string, slice int, anchor int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1, "y", "z", 3, 4) for i, e, label in rows], SCHEMA)


def taking_part(rows, labelled):
    """id -> (vector, label), by the stated rules."""
    found = {}
    for i, e, label in rows:
        if i is None or e is None or any(x is None or not math.isfinite(x) for x in e) or (labelled and label is None):
            continue
        own = ([math.floor(256 * float(np.float32(x))) for x in e], label if labelled else 0)
        found[i] = min(found.get(i, own), own)
    return found


def score(a, b):
    return sum(x * y for x, y in zip(a, b))


def top(rows, asks, k):
    live, out = taking_part(rows, False), set()
    for q in [i for i in live if asks(i)]:
        order = sorted((-score(live[q][0], live[i][0]), i) for i in live if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(order[:k])}
    return out


def mined(rows, asks, n_positive=5, n_negative=3):
    live, out = taking_part(rows, True), set()
    for q in [i for i in live if asks(i)]:
        order = sorted((-score(live[q][0], live[i][0]), i) for i in live if i != q)
        for s, p in [x for x in order if live[x[1]][1] == live[q][1]][:n_positive]:
            fits = [x for x in order if live[x[1]][1] != live[q][1] and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out |= {(q, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fits[:n_negative])}
    return out


def mixed_rows(seed, n=300, d=6):
    """Random vectors with copies, coarse values (ties), repeated ids, nulls, NaN, infinities, empty and short vectors."""
    rng = random.Random(seed)
    common = [0.25] * d
    rows = [(i, [rng.randrange(-4, 5) / 8 for _ in range(d)] if rng.random() < 0.7 else common, rng.randrange(4)) for i in range(n)]
    rows += [(10, [0.5] * d, 1), (10, common, 2), (20, [0.125] * d, 0), (None, common, 1), (400, None, 1), (410, [0.1, None], 1), (420, [math.nan] * d, 1), (430, [math.inf] * d, 2)]
    rows += [(440, [], 1), (450, [1.0], 0), (460, [0.3] * d, None), (-470, [-0.4] * d, 3), *[(480, common, 1)] * 50]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_matches_brute_force(spark, seed):
    rows = mixed_rows(seed)
    got = nra.top_k(frame(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(top(rows, lambda i: i % 10 == 0, 5))


@pytest.mark.parametrize("seed", [3, 4])
def test_hard_negatives_match_brute_force(spark, seed):
    rows = mixed_rows(seed)
    got = hard_negatives.mine_hard_negatives(frame(spark, rows).repartition(5), F.col("vec_id") % 10 == 0)
    want = mined(rows, lambda i: i % 10 == 0)
    assert got.count() > 50 and sorted(map(tuple, got.collect())) == sorted(want)


def test_vectors_in_many_slices_and_cells(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1 / 4, (9_000, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, [float(y) for y in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    whole = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    got = {}
    for r in nra.top_k(rows, F.col("vec_id") % 1000 == 0, k=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 9_000, 1000):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(9_000), -s)) if i != q][:7]
        assert sorted(got[q]) == [(k + 1, i, s[i]) for k, i in enumerate(order)]
    mine = {}
    for r in hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 3000 == 0).collect():
        mine.setdefault((r.anchor_id, r.positive_id), []).append((r.rank, r.negative_id))
    for q in range(0, 9_000, 3000):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(9_000), -s)) if i != q]
        for p in [i for i in order if i % 3 == q % 3][:5]:
            fits = [i for i in order if i % 3 != q % 3 and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:3]
            assert sorted(mine.get((q, p), [])) == [(k + 1, i) for k, i in enumerate(fits)]


def test_empty_tables_no_queries_and_few_rows(spark):
    rows = frame(spark, mixed_rows(6, n=8)[:8])
    for f in (nra.top_k, hard_negatives.mine_hard_negatives):
        assert f(rows.limit(0), F.col("vec_id") % 10 == 0).count() == 0
        assert f(rows, F.col("vec_id") == 99).count() == 0
        assert f(rows.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0
    few = nra.top_k(rows.where("vec_id < 3"), F.col("vec_id") == 0)
    assert sorted(r["rank"] for r in few.collect()) == [1, 2]


def test_too_large_components_are_refused(spark):
    rows = frame(spark, [(0, [1e7, 1.0], 1), (1, [1e7, 2.0], 1)])
    with pytest.raises(Exception, match="too large"):
        nra.top_k(rows, F.col("vec_id") == 0).collect()


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 32, (2000, 64)).astype(np.int64)
    ids = rng.permutation(2000)
    lists = nra.Lists(nra.sort_lists(ids, x), 64)
    q = rng.normal(0, 32, (20, 64)).astype(np.int64)
    at, vec, score = nra.search(lists, np.full(20, -1), q.astype(float), 5, np.full(20, -np.inf))
    assert len(lists.states) < lists.steps and lists.known.mean() < 1
    keep = nra.best(at, vec, score, 5)
    for k in range(20):
        s = x @ q[k]
        order = np.lexsort((ids, -s))[:5]
        own = keep[at[keep] == k]
        assert vec[own].tolist() == ids[order].tolist() and score[own].tolist() == s[order].tolist()


def test_bounds_hold_at_every_step():
    rng = np.random.default_rng(8)
    x = rng.integers(-9, 10, (137, 5))
    lists = nra.Lists(nra.sort_lists(np.arange(137), x), 6)
    q = np.pad(rng.integers(-9, 10, (11, 5)), ((0, 0), (0, 1))).astype(float)
    exact = q[:, :5] @ x.T
    for step in range(1, lists.steps + 1):
        middle, half = lists.bounds(step)
        mid, rad = q @ middle.T, np.abs(q) @ half.T
        assert (mid - rad <= exact).all() and (exact <= mid + rad).all()
    assert not half.any()


def test_packed_pairs_sort_as_numbers():
    rng = random.Random(9)
    pairs = [(rng.randrange(-3, 4) << 40, rng.randrange(-5, 6) << 35, rng.randrange(2), rng.randrange(-4, 5)) for _ in range(500)]
    a, s, o, i = (np.array(x) for x in zip(*pairs))
    keys = hard_negatives.pack_pairs(a, s, o.astype(np.uint8), i)
    assert [hard_negatives.unpack_pair(k) for k in keys] == pairs
    assert [hard_negatives.unpack_pair(k) for k in sorted(keys)] == sorted(pairs, key=lambda p: (p[0], -p[1], p[2], p[3]))


def test_the_stream_holds_open_windows_only():
    n = 50_000
    keys = hard_negatives.pack_pairs(np.zeros(n + 2), np.r_[1000, 900, np.arange(n) % 1000].astype(np.int64), np.r_[0, 0, np.ones(n)].astype(np.uint8), np.arange(n + 2))
    windows = hard_negatives.Windows(5, 3, 50, 95)
    out = list(windows.take(sorted(keys)))
    assert len(out) == 6 and not windows.open and {r[4] for r in out} == {1000, 900}
