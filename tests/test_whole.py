"""Queries over all keys cover what the samples of one key leave out."""

from granary.plans import registry

SF = "/root/testdata/sf0.001"


def test_all_keys_and_months_are_covered(spark):
    q = registry.queries()
    gaps = q["gap_months_by_customer"](spark, SF)
    assert gaps.select("CustomerKey").distinct().count() > 1
    one = {r.MonthStart for r in gaps.where("CustomerKey = 1").collect()}
    assert one == {r.MonthStart for r in q["gap_months"](spark, SF).collect()}
    grid = q["calendar_left_join_by_store"](spark, SF)
    n_lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert grid.agg({"Rows": "sum"}).first()[0] == n_lines
    assert q["sequence_expand_all"](spark, SF).select("OrderNumber", "OrderLineNumber").distinct().count() == n_lines
    days = q["fx_daily_all"](spark, SF).selectExpr("year(Date) as y").distinct().count()
    assert days > 1
