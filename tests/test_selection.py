"""Exact selection against sorting, with passes forced by small limits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import selection


def values(seed):
    rng = random.Random(seed)
    out = [("a", rng.gauss(0, 1)) for _ in range(900)] + [("b", 10.0 ** rng.uniform(-4, 4)) for _ in range(500)] + [("c", 7.0)] * 400 + [("d", float(rng.randrange(3))) for _ in range(500)]
    return out + [("e", 1.5), (None, 2.0), (None, 4.0), ("f", None), ("a", None)]


@pytest.mark.parametrize(("limit", "bins"), [(100_000, 1024), (60, 64)])
def test_quantiles_by_group(spark, limit, bins):
    rows, ps = values(1), [0.0, 0.1, 0.5, 0.77, 1.0]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {(r.g, r.Probability): r.Quantile for r in selection.quantiles(df, ["g"], F.col("x"), ps, limit, bins).collect()}
    want = {}
    for g in {g for g, x in rows if x is not None}:
        for i, q in enumerate(np.quantile([x for h, x in rows if h == g and x is not None], ps)):
            want[g, i] = q
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_quantiles_of_a_whole_table(spark):
    rng = random.Random(2)
    x = [rng.lognormvariate(0, 2) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r.Quantile for r in selection.quantiles(df, [], F.col("x"), [0.25, 0.5, 0.9], 200, 64).orderBy("Probability").collect()]
    assert got == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.9])), rel=1e-12)
    assert selection.quantiles(df.limit(0), [], F.col("x"), [0.5]).count() == 0


@pytest.mark.parametrize("limit", [40, 100_000])
def test_the_level_of_a_capped_share(spark, limit):
    rng = random.Random(3)
    rows = [(k % 3, rng.randrange(1, 50), rng.randrange(1, 9)) for k in range(600)]
    df = spark.createDataFrame(rows, "g int, cap int, w int")
    got = selection.first_crossing(df, ["g"], F.col("cap") / F.col("w"), F.array(F.lit(2000.0)), F.col("cap"), F.col("w"), limit, 16)
    for r in got.collect():
        level = (2000 - r.BelowA) / (r.SumB - r.BelowB)
        assert level <= r.Value + 1e-9
        assert sum(min(c, level * w) for g, c, w in rows if g == r.g) == pytest.approx(2000)
    assert got.count() == 3


def test_targets_out_of_reach_have_no_row(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    got = selection.first_crossing(df, [], F.col("x"), F.array(F.lit(0.0), F.lit(2.0), F.lit(3.0))).collect()
    assert sorted((r.Target, r.Value) for r in got) == [(0, 1.0), (1, 2.0)]
