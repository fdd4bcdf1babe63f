"""The stock matrix against a loop over one key at a time, and what each rule does."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import stock as X

D = datetime.date
PROFILE = "ProductKey long, SafetyStock int, ReorderPoint int, LeadMonths int, CasePack int, IsFragile boolean, Season string, Class string"


def plain(demand, profile, rules):
    """Rows by one key's own loop."""
    sums = {}
    for p, w, y, m, q in demand:
        sums[p, w, y * 12 + m - 1] = sums.get((p, w, y * 12 + m - 1), 0) + q
    last, out = max(y * 12 + m - 1 for _, _, y, m, _ in demand), []
    attributes = {p[0]: p[1:] for p in profile}
    for p, w in {(p, w) for p, w, _, _, _ in demand}:
        own = {m: q for (a, b, m), q in sums.items() if (a, b) == (p, w) and q > 0}
        safety, point, lead, pack, fragile, season, cls = attributes.get(p, (20, 10, 1, 1, False, None, None))
        if len(own) < rules.least_months or (rules.keep is not None and cls is not None and cls not in rules.keep):
            continue
        mean, scale = max(sum(own.values()) / len(own), 1.0), rules.by_class.get(cls, 1.0)
        lot = max(math.floor((safety + mean * lead) * scale * rules.overstock), math.floor(mean * lead * scale))
        lot = math.ceil(lot / pack) * pack
        stock, due = math.floor(mean * rules.opening_months * scale * rules.overstock), {}
        for m in range(min(own), last + 1):
            received = due.get(m, 0)
            stock += received
            sold = own.get(m, 0)
            stock -= sold + math.floor(stock * (rules.shrinkage / 12.0 * (rules.fragile if fragile else 1.0)))
            days = min(30, math.floor(-stock / max(1.0, sold * (1.0 / 30.0)))) if stock < 0 else 0
            short, stock = stock < 0, max(stock, 0)
            reorder = stock <= math.floor(point * (1.0 + X.SEASONS.get(season, {}).get(m % 12 + 1, 0.0)))
            if reorder:
                due[m + lead] = due.get(m + lead, 0) + lot
            out.append((p, w, D(m // 12, m % 12 + 1, 1), stock, lot if reorder else 0, sold, received, reorder, short, days))
    return sorted(out)


def some(seed, keys=60):
    rng = random.Random(seed)
    demand = [(p, w, 2020 + m // 12, m % 12 + 1, rng.randrange(0, 60)) for p in range(keys) for w in range(2) for m in sorted(rng.sample(range(30), rng.randrange(1, 25)))]
    demand += [demand[0], (10**6, 1, 2021, 1, 5), (10**6, 1, 2021, 2, 5), (10**6, 1, 2021, 5, 9)]
    profile = [(p, rng.randrange(30), rng.randrange(25), rng.randrange(1, 5), rng.randrange(1, 7), rng.random() < 0.3, rng.choice([*X.SEASONS, "None", None]), rng.choice("ABC")) for p in range(keys)]
    return demand, profile


@pytest.mark.parametrize("rules", [X.StockRules(), X.StockRules(opening_months=0.5, shrinkage=0.3, overstock=1.3, least_months=6, keep=("A", "C"))])
def test_matrix_matches_a_loop_over_keys(spark, rules):
    demand, profile = some(1)
    df = spark.createDataFrame(demand, "ProductKey long, WarehouseKey int, Year int, Month int, QuantitySold int").repartition(5)
    got = X.inventory_snapshots(df, spark.createDataFrame(profile, PROFILE), rules)
    want = plain(demand, profile, rules)
    assert len(want) > 300 and sorted(map(tuple, got.collect())) == want
    assert any(r[8] for r in want) and any(r[7] and not r[8] for r in want)


def test_no_demand_gives_no_rows(spark):
    demand, profile = some(2, 3)
    df = spark.createDataFrame(demand, "ProductKey long, WarehouseKey int, Year int, Month int, QuantitySold int")
    assert X.inventory_snapshots(df.limit(0), spark.createDataFrame(profile, PROFILE)).count() == 0
    assert X.inventory_snapshots(df, spark.createDataFrame(profile, PROFILE), X.StockRules(least_months=99)).count() == 0


def test_quarters_sum_and_cap(spark):
    rows = [(1, 1, D(2024, m, 1), 10 * m, m, m, m, m == 2, m == 3, 40) for m in range(1, 5)]
    got = {r.SnapshotDate: r for r in X.by_quarter(spark.createDataFrame(rows, X.SNAPSHOT)).collect()}
    q = got[D(2024, 1, 1)]
    assert (q.QuantityOnHand, q.QuantityOnOrder, q.QuantitySold, q.ReorderFlag, q.StockoutFlag, q.DaysOutOfStock) == (30, 6, 6, True, True, 90)
    assert got[D(2024, 4, 1)].DaysOutOfStock == 40


def test_seasons_raise_the_reorder_point(spark):
    demand = spark.createDataFrame([(p, 1, 2023, m, 1) for p in (1, 2) for m in range(1, 13)], "ProductKey long, WarehouseKey int, Year int, Month int, QuantitySold int")
    profile = spark.createDataFrame([(1, 0, 10, 1, 1, False, "Holiday", "B"), (2, 0, 10, 1, 1, False, "None", "B")], PROFILE)
    out = X.inventory_snapshots(demand, profile, X.StockRules(opening_months=23.0, shrinkage=0.0))
    first = {r.ProductKey: r.m for r in out.where("ReorderFlag").groupBy("ProductKey").agg(F.min(F.month("SnapshotDate")).alias("m")).collect()}
    assert first == {1: 10}  # 13 left in October, at or below 10 raised by 0.3; the other product has 11 left in December
