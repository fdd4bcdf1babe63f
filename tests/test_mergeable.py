"""Distinct counts that merge, answers from footers, and versions of keys that have many."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import bitmaps as B
from granary.operators import intervals as I
from granary.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_distinct_counts_of_all_grouping_sets(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.choice([-70_000, -1, 0, 1, 32_768, 32_769, 10**12, None, rng.randrange(200_000)]), rng.randrange(9)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "a string, b int, id long, q int").repartition(5)
    got = B.grouping_sets(df, ["a", "b"], B.cube_sets(["a", "b"]), "id", "n", q=F.sum("q"))
    want = df.cube("a", "b").agg(F.grouping_id().cast("long").alias("Level"), F.sum("q").alias("q"), F.countDistinct("id").alias("n"))
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert B.grouping_sets(df.limit(0), ["a"], B.rollup_sets(["a"]), "id", "n").count() == 0


def test_loads_merge_to_the_count_of_the_whole(spark):
    rows = [(k % 3, k % 70, 1) for k in range(1000)]
    df = spark.createDataFrame(rows, "g int, id int, q int")
    parts = [B.cells(df.where(F.col("id") % 4 == n), ["g"], "id", q=F.sum("q")) for n in range(4)] + [B.cells(df.where("id < 5"), ["g"], "id", q=F.sum(F.lit(0)))]
    merged = B.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4]), ["g"], ["q"])
    got = {r.g: (r.n, r.q) for r in B.counted(merged, ["g"], ["q"], "n").collect()}
    assert got == {g: (len({i for h, i, _ in rows if h == g}), sum(q for h, _, q in rows if h == g)) for g in range(3)}


def test_counts_and_bounds_come_from_footers(spark, tmp_path):
    plan = T.from_footers(spark, f"{SF}/orders.parquet", F.count("*"), F.min("o_orderkey"), F.max("o_custkey"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(o_orderkey), MAX(o_custkey)]" in plan
    spark.createDataFrame([(5, None), (None, None), (2, "x")], "a int, b string").write.parquet(f"{tmp_path}/t.parquet")
    assert {r.table: r.rows for r in T.row_counts(spark, str(tmp_path), ["t", "absent"]).collect()} == {"t": 3, "absent": None}
    assert [tuple(r) for r in T.footer_bounds(spark, str(tmp_path), [("t", "a")]).collect()] == [("t", "a", 2, 5, 2)]


@pytest.mark.parametrize("many", [0, 64, 100_000])
def test_a_key_of_many_versions(spark, many):
    day = lambda n: datetime.date(1995, 1, 1) + datetime.timedelta(days=n)
    rng = random.Random(2)
    dim = [(1, day(n), n) for n in range(10_000)] + [(k, day(rng.randrange(9000)), i) for k in range(2, 40) for i in range(4)]
    dim = list({(k, d): (k, d, v) for k, d, v in dim}.values())
    facts = [(i, rng.choice([1, 1, 1, rng.randrange(2, 45)]), day(rng.randrange(-50, 10_500))) for i in range(4000)] + [(9000, 1, None), (9001, None, day(3))]
    df, versions = spark.createDataFrame(facts, "id int, k int, d date"), spark.createDataFrame(dim, "k int, s date, v int")
    got = {r.id: r.v for r in I.scd2_as_of(df, "d", versions, "k", ["v"], "s", many).collect()}
    own = {}
    for k, s, v in sorted(dim):
        own.setdefault(k, []).append((s, v))
    for i, k, d in facts:
        before = [v for s, v in own.get(k, []) if d and s <= d]
        assert got[i] == (before[-1] if before else own[k][0][1] if d and k in own else None)
    assert len(got) == len(facts)
