"""Month pools and orders: the cases that the given tables hold seldom."""

import datetime as dt
from collections import Counter

from granary.operators.customers import assign_customers, month_pool, place_within

M = [dt.date(2020, m, 1) for m in range(1, 5)]


def people(spark, rows):
    return spark.createDataFrame(rows, "CustomerKey long, Start date, End date, Debut date, Weight int")


def targets(spark, rows):
    return spark.createDataFrame(rows, "MonthStart date, Target long")


def test_debuts_come_first_and_those_that_end_first_stay(spark):
    own = people(spark, [(k, M[0], M[3 - k % 3], M[0], 1) for k in range(9)] + [(100, M[0], M[3], M[1], 5)])
    got = month_pool(own, targets(spark, [(M[0], 3), (M[1], 4)]), 7).collect()
    first = {r.CustomerKey for r in got if r.MonthStart == M[0]}
    assert first == {2, 5, 8}
    second = {r.CustomerKey: r.Place for r in got if r.MonthStart == M[1]}
    assert second[100] == 0 and len(second) == 4


def test_a_month_of_strangers_draws_from_all_and_others_have_no_pool(spark):
    own = people(spark, [(k, M[0], M[1], M[1], 1 + k) for k in range(5)])
    got = month_pool(own, targets(spark, [(M[0], 2), (M[2], 2)]), 7).collect()
    assert Counter(r.MonthStart for r in got) == {M[0]: 2}
    assert sorted(r.Place for r in got) == [0, 1]


def test_orders_use_each_customer_then_repeat_by_weight(spark):
    pool = spark.createDataFrame([(M[0], 1, 1, 0), (M[0], 2, 9, 1)], "MonthStart date, CustomerKey long, Weight int, Place long")
    orders = spark.createDataFrame([(n, M[0]) for n in range(1000)] + [(5000, M[3])], "OrderNumber long, MonthStart date")
    got = {r.OrderNumber: r.CustomerKey for r in assign_customers(orders, pool, 3).collect()}
    assert len(got) == 1001 and got[0] == 1 and got[1] == 2 and got[5000] is None
    repeats = Counter(got[n] for n in range(2, 1000))
    assert set(repeats) == {1, 2} and 0.06 < repeats[1] / 998 < 0.14


def test_empty_tables(spark):
    none = people(spark, [])
    pool = month_pool(none, targets(spark, []), 1)
    assert pool.collect() == []
    assert assign_customers(spark.createDataFrame([], "OrderNumber long, MonthStart date"), pool, 1).collect() == []


def test_places_restart_in_each_group(spark):
    rows = spark.createDataFrame([(g, k) for g in (1, 2, 3) for k in range(g)], "g int, k int")
    assert {(r.g, r.k, r.Place) for r in place_within(rows, "g", ["k"]).collect()} == {(g, k, k) for g in (1, 2, 3) for k in range(g)}
