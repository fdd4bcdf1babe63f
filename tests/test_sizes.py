"""Queries whose work or memory grew faster than their tables."""

import datetime
import math
import random

from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.operators import facts, picks
from granary.plans import more, registry, suites

SF = "/root/testdata/sf0.001"


def test_assortment_in_blocks(spark):
    stores = spark.range(40).select(F.col("id").alias("StoreKey"))
    products = spark.range(101).select(F.when(F.col("id") == 100, None).when(F.col("id") < 70, "A").otherwise("B").alias("Category"), F.col("id").alias("ProductKey"))
    want = stores.crossJoin(products).where("Category is not null").where(hash_u01(F.col("StoreKey"), F.col("Category"), seed=15) < 0.5).select("StoreKey", "ProductKey")
    got = more.assortment(stores, products, 15, block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()
    assert more.assortment(stores, products.where("false"), 15).count() == 0
    joined = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("_b#" in line for line in joined)  # a row meets a block, not all products of its category


def test_wishes_by_place(spark):
    """Small categories, customers who have all of one, nobody's purchases and unknown products, against a plain loop."""
    rng = random.Random(4)
    goods = [(p, None if p == 59 else "ABCD"[min(p // 4, 3) if p < 14 else 3]) for p in range(60)]
    bought = sorted({(c, rng.randrange(62)) for c in range(30) for _ in range(rng.randrange(1, 25))} | {(99, p) for p in range(8)}) + [(None, 1), (None, 20)]
    products, purchases = spark.createDataFrame(goods, "ProductKey long, Category string"), spark.createDataFrame(bought, "CustomerKey long, ProductKey long")
    u = {r.ProductKey: r.u for r in products.select("ProductKey", hash_u01(F.col("ProductKey"), seed=7).alias("u")).collect()}
    both = purchases.select("CustomerKey").distinct().crossJoin(products.select("ProductKey"))
    v = {(r[0], r[1]): r[2] for r in both.select("CustomerKey", "ProductKey", hash_u01(F.col("CustomerKey"), F.col("ProductKey"), seed=7)).collect()}
    category, want = dict(goods), set()
    for c in {c for c, _ in bought}:
        own = [p for x, p in bought if x == c]
        free = []
        for k in {category.get(p) for p in own} - {None}:
            n = sum(category.get(p) == k for p in own)
            free += [(-n, v[c, p], p) for p in sorted((p for p, x in goods if x == k and (c is None or p not in own)), key=lambda p: (u[p], p))[:12]]
        want |= {(c, p, r) for r, (_, _, p) in enumerate(sorted(free)[:3], 1)}
    got = picks.wishlist(purchases, products, 3, 7)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and not any("<=" in line for line in joins)  # places are looked up, not compared with all of a category


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey")


def test_shares_of_a_table_are_one_scan(spark):
    assert scans(registry.queries()["correlation_scorecard"](spark, SF)) == 1


def test_suites_share_scans(spark):
    """All suites' conditions on a table and each key are looked at once, whatever the number of suites, and no plan holds two of them."""
    frames = suites.together(suites.SUITES, spark, SF)
    tables = {t for s in suites.SUITES for t, *_ in s.rules}
    assert len(frames) == len(tables) + len({k for s in suites.SUITES for k, _ in s.keys}) < sum(len(s.rows) for s in suites.SUITES)
    assert max(map(scans, frames)) <= 2 and scans(registry.queries()["all_suites"](spark, SF)) == 0


def test_ledger_folds_keys_together(spark):
    """Keys that begin in different months, without a product, and in negative demand, against one key's own loop; quarters and the profile from its rows."""
    rng = random.Random(9)
    rows = [(None if p == 7 else p, w, m // 12, m % 12 + 1, rng.randrange(-1, 30)) for p in range(12) for w in range(2) for m in sorted(rng.sample(range(24020, 24050), rng.randrange(1, 20)))]
    demand = spark.createDataFrame(rows, "ProductKey long, WarehouseKey int, Year int, Month int, QuantitySold long")
    last, want, want_quarters, want_profile = max(y * 12 + m - 1 for _, _, y, m, _ in rows), set(), {}, {}
    for p, w in {r[:2] for r in rows}:
        own = {y * 12 + m - 1: q for a, b, y, m, q in rows if (a, b) == (p, w)}
        if len(own) < 3:
            continue
        mean = math.ceil(sum(own.values()) / len(own))
        stock, due = 2 * mean, [0, 0, 0]
        for m in range(min(own), last + 1):
            q, received = own.get(m, 0), due.pop(0)
            sold = min(stock + received, q)
            stock += received - sold
            due.append(2 * mean if stock < mean else 0)
            day = datetime.date(m // 12 + (m % 12 == 11), (m + 1) % 12 + 1, 1) - datetime.timedelta(1)
            want.add((p, w, day, q, received, sold, stock, due[-1], stock < mean, sold < q))
            old = want_quarters.get((p, w, m // 3), (0, 0, 0, False, False))
            want_quarters[p, w, m // 3] = (stock, old[1] + sold, old[2] + received, old[3] or stock < mean, old[4] or sold < q)
            want_profile.setdefault(day, set()).add((p, w))
    assert set(map(tuple, facts.inventory_ledger(demand, lead=3).collect())) == want
    quarters = {(r[0], r[1], (r[2].year * 12 + r[2].month - 1) // 3): tuple(r[3:]) for r in facts.inventory_ledger(demand, lead=3, quarters=True).collect()}
    assert quarters == want_quarters
    profile = {r[0]: tuple(r[1:]) for r in facts.ledger_profile(demand).collect()}
    assert profile == {d: (len(k), len({p for p, _ in k} - {None}), len({w for _, w in k})) for d, k in want_profile.items()}
    assert facts.inventory_ledger(demand.where("false")).count() == facts.ledger_profile(demand.where("false")).count() == 0


def test_salesperson_reads_sales_once(spark):
    """Orders, assignments, segments and their table are made once each; the last join reads them."""
    assert scans(registry.queries()["assign_salesperson"](spark, SF)) == 0
