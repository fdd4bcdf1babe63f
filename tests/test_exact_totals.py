"""Totals that are met exactly, within bounds, without a window over all rows."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from granary.operators import allocation as A
from granary.plans import registry

SF = "/root/testdata/sf0.001"


def by_remainder(weights, total):
    """key -> whole number, from key -> weight."""
    whole = sum(weights.values())
    exact = {k: Fraction(total * w, whole) for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def test_allocation_by_remainders(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, rng.choice([0, 1, 1, 5, rng.randrange(10**6)])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, g int, w long").repartition(5)
    got = {r.k: r.n for r in A.allocate_by_remainder(df, F.col("w"), F.lit(10_007), ["g"], "k", "n").collect()}
    for g in range(3):
        assert {k: got[k] for k, h, _ in rows if h == g} == by_remainder({k: w for k, h, w in rows if h == g}, 10_007)
    same = A.allocate_by_remainder(df.withColumn("one", F.lit(1)), F.col("one"), F.lit(650), [], "k", "n")
    assert {r.k: r.n for r in same.collect()} == {k: 2 if k < 250 else 1 for k in range(400)}


@pytest.mark.parametrize("total", [50, 120, 121, 333, 449, 450])
def test_lines_fit_a_total_within_bounds(spark, total):
    rng = random.Random(2)
    lines = {k: rng.randrange(1, 10) for k in range(50)}
    df = spark.createDataFrame(list(lines.items()), "k long, n int")
    got = {r.k: r.Lines for r in A.fit_total(df, "n", total, 9, "k").collect()}
    assert sum(got.values()) == total and all(1 <= n <= 9 for n in got.values())
    lack = total - sum(lines.values())
    if lack:
        room = {k: 9 - n if lack > 0 else n - 1 for k, n in lines.items()}
        moved = by_remainder(room, abs(lack))
        assert got == {k: n + moved[k] * (1 if lack > 0 else -1) for k, n in lines.items()}


def test_totals_without_headroom_are_errors(spark):
    df = spark.createDataFrame([(1, 2), (2, 3)], "k long, n int")
    for total in (1, 19):
        with pytest.raises(ValueError, match="do not fit"):
            A.fit_total(df, "n", total, 9, "k")
    with pytest.raises(ValueError, match="cannot hold"):
        A.allocate_capped(df.withColumn("cap", F.lit(4)), "n", "cap", 9, [], "k")


@pytest.mark.parametrize("seed", [3, 4])
def test_capped_allocation_is_whole_and_exact(spark, seed):
    rng = random.Random(seed)
    rows = [(k, k % 2, rng.randrange(0, 9), rng.randrange(0, 12)) for k in range(120)] + [(500 + k, 2, 1, 1) for k in range(10)]
    df = spark.createDataFrame(rows, "k long, g int, w long, cap long").where("g < 2")
    got = {r.k: r.Share for r in A.allocate_capped(df, "w", "cap", 150, ["g"], "k").collect()}
    for g in range(2):
        own = [(k, w, cap) for k, h, w, cap in rows if h == g]
        assert sum(got[k] for k, _, _ in own) == 150 and all(0 <= got[k] <= cap for k, _, cap in own)
        level = max((got[k] - 1) / w for k, w, _ in own if w and got[k])  # nobody that has room is left more than one behind
        assert all(got[k] == cap or not w or got[k] + 1 > level * w - 1e-6 for k, w, cap in own)


def test_first_rows_of_a_group_with_ties(spark):
    rng = random.Random(5)
    rows = [(k, "ab"[k % 2], rng.choice([0.0, 1.0, 2.0, None]), 20 if k % 2 else 7) for k in range(100)] + [(200 + k, "c", 1.0, 9) for k in range(4)]
    df = spark.createDataFrame(rows, "k long, g string, v double, n int")
    got = {r.k for r in A.first_n(df, ["g"], F.col("v"), "k", "n").collect()}
    want = set()
    for g in "abc":
        own = sorted((v, k) for k, h, v, _ in rows if h == g and v is not None)
        want |= {k for _, k in own[: next(n for _, h, _, n in rows if h == g)]}
    assert got == want


@pytest.mark.parametrize("name", ["split_total_orders", "allocate_total_by_customer", "quantile_tiers"])
def test_no_window_or_shuffle_to_one_task(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition, REPARTITION" not in plan
    for line in plan.splitlines():
        if "Exchange SinglePartition" in line:  # only partial sums of one row a task
            below = plan.splitlines()[plan.splitlines().index(line) + 1 :]
            assert "partial_" in below[0], below[0]
