"""Alias tables hold exactly the weights; rows meet one segment."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import alias as A

D = datetime.date


@pytest.mark.parametrize("seed", range(4))
def test_slots_hold_the_weights(spark, seed):
    rng = random.Random(seed)
    kinds = [lambda: 1, lambda: rng.choice([0, 1, 2]), lambda: rng.random() ** 8 * 100, lambda: rng.choice([1, 1000])]
    rows = [(g, i, float(kinds[(g + seed) % 4]())) for g in range(5) for i in range(1, rng.randrange(2, 40))] + [(9, 1, 5.0), (8, 1, 0.0)]
    table = A.alias_table(spark.createDataFrame(rows, "g int, i int, w double"), ["g"], "w", "i").collect()
    for g in {r[0] for r in rows}:
        own = {i: w for h, i, w in rows if h == g and w > 0}
        slots = [r for r in table if r.g == g]
        assert sorted(r._slot for r in slots) == list(range(len(own))) and all(r._n == len(own) and -1e-12 <= r._prob <= 1 for r in slots)
        held = Counter()
        for r in slots:
            held[r._item] += r._prob / r._n
            held[r._other] += (1 - r._prob) / r._n
        assert all(held[i] == pytest.approx(w / sum(own.values()), abs=5e-8) for i, w in own.items()) and set(held) == set(own)


def test_picks_follow_the_weights(spark):
    pool = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 0), ("b", 7, 5)], "g string, item int, w int")
    left = spark.range(8000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 10 == 1, F.lit(None)).when(F.col("id") % 10 == 2, "none").otherwise("a").alias("g"))
    got = Counter((r.g, r.item) for r in A.weighted_pick(left, pool, "g", "w", "item", "k", 1).collect())
    assert got["b", 7] == 800 and got[None, None] == 800 and got["none", None] == 800 and ("a", 3) not in got
    assert abs(got["a", 2] / (got["a", 1] + got["a", 2]) - 0.75) < 0.02


def test_a_row_meets_one_segment_and_only_items_of_its_day(spark):
    rng = random.Random(5)
    day = lambda n: D(2024, 1, 1) + datetime.timedelta(days=n)
    spans = [(s, e, day(a), day(a + rng.randrange(0, 60)), float(rng.randrange(0, 4))) for s in range(3) for e in range(12) for a in [rng.randrange(0, 100)]]
    spans += [(0, 99, None, day(5), 1.0), (1, 98, day(90), None, 0.0), (2, 97, day(50), day(40), 9.0), (1, 1, day(10), day(12), 7.0)]
    pool = spark.createDataFrame(spans, "store int, who int, a date, b date, w double")
    rows = [(k, rng.randrange(4), day(rng.randrange(0, 120))) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, store int, day date")
    out = A.pick_by_day(df, "day", pool, "store", "a", "b", "who", "w", ["k"], 3, "got")
    assert out.columns == ["k", "store", "day", "got"] and out.count() == len(rows)
    for r in out.collect():
        here = {e: w for s, e, a, b, w in spans if s == r.store and (a or D.min) <= r.day <= (b or D.max)}
        best = {e: max(w for s, x, a, b, w in spans if (s, x) == (r.store, e) and (a or D.min) <= r.day <= (b or D.max)) for e in here}
        here = [e for e, w in best.items() if w] or list(best)
        assert r.got in here if here else r.got is None


def test_no_range_condition_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, D(2024, 1, 1))], "k int, store int, day date")
    pool = spark.createDataFrame([(1, 5, D(2024, 1, 1), D(2024, 2, 1), 1.0)], "store int, who int, a date, b date, w double")
    plan = A.pick_by_day(df, "day", pool, "store", "a", "b", "who", "w", ["k"], 3, "got")._jdf.queryExecution().optimizedPlan().toString()
    assert not any(("<=" in line or ">=" in line) for line in plan.splitlines() if "Join" in line)
