import datetime

import pytest
from pyspark.sql import functions as F

from granary.operators import allocation, intervals, ordered
from granary.operators.budget import clip
from granary.sources import tables as T
from granary.streaming import folds

SF = "/root/testdata/sf0.001"


def test_layout_jobs_keep_the_rows(spark, tmp_path):
    path = f"file://{tmp_path}/fact"
    orders = T.scan_table(spark, SF, "Orders").withColumnRenamed("o_orderdate", "OrderDate")
    orders.repartition(9).write.parquet(path)
    want = orders.count()
    assert T.compact(spark, path, 128, 2) == 1 and spark.read.parquet(path).count() == want
    T.relayout(spark, path, "year_month")
    assert {"Year", "Month"} <= set(spark.read.parquet(path).columns) and spark.read.parquet(path).count() == want
    narrow = T.optimize_layout(orders, sort_columns=["o_orderstatus"])
    assert dict(narrow.dtypes)["o_custkey"] == "smallint" and narrow.count() == want


def test_csv_refuses_structural_characters(spark, tmp_path):
    T.write_csv_bulk(spark.createDataFrame([(1, True, "plain")], "a int, b boolean, c string"), f"{tmp_path}/ok")
    assert spark.read.option("header", True).csv(f"{tmp_path}/ok").first().b == "1"
    with pytest.raises(Exception, match="structural"):
        T.write_csv_bulk(spark.createDataFrame([("a,b",)], "c string"), f"{tmp_path}/bad")


def test_schemas(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    with pytest.raises(ValueError, match="missing"):
        T.conform(df, spark.createDataFrame([], "a int, c int").schema)
    with pytest.raises(ValueError, match="absent"):
        T.require_columns(df, ["absent"], "x")
    assert T.scan_table(spark, SF, "no_such_table") is None
    assert T.snake("EmployeeStoreAssignments") == "employee_store_assignments"


def test_null_growth_stays_null(spark):
    got = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double").select(clip(F.col("x"), -0.2, 0.3).alias("y")).collect()
    assert [r.y for r in got] == [None, 0.3, -0.2]


def test_adjacent_intervals_join_and_interior_holes_show(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2020, 1, 1), d(2020, 1, 5)), (1, d(2020, 1, 6), d(2020, 1, 7)), (1, d(2020, 1, 20), d(2020, 1, 31))], "k int, s date, e date")
    assert intervals.interval_union(df, ["k"], "s", "e").count() == 2
    assert [(r.GapStart, r.GapEnd) for r in intervals.coverage_gaps(df, "k", "s", "e", "2020-01-01", "2020-01-31").collect()] == [(d(2020, 1, 8), d(2020, 1, 19))]


def test_odd_cents_sum_to_the_whole(spark):
    df = spark.createDataFrame([(1, i, 0.05, 1) for i in range(3)], "g int, i int, total double, w int")
    got = sorted(r.part for r in allocation.apportion_cents(df, "total", "w", ["g"], "i", "part").collect())
    assert got == [0.01, 0.02, 0.02]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "k int, s date, e date")
    assert intervals.interval_union(df, ["k"], "s", "e").count() == 0
    assert ordered.dense_surrogate_key(df, ["k"], "n").count() == 0
    assert intervals.scd2_build(df, ["k"], "s", ["e"]).count() == 0


def test_stream_equals_its_batch_twin(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    got = folds.replay(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out", f"{tmp_path}/ck", lambda s: folds.stream_demand(s, "60 days"))
    last = events.agg(F.max("ts")).first()[0] - datetime.timedelta(days=61)
    want = folds.demand_by_day(events).where(F.col("Day") < F.lit(last))
    assert got.where(F.col("Day") < F.lit(last)).count() == want.count()
    pairs = folds.replay(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/out2", f"{tmp_path}/ck2", lambda s: folds.stream_distinct(s, ["user_id", "event_type"], "60 days"))
    assert pairs.count() == events.select("user_id", "event_type").distinct().count()


def test_stream_upsert_keeps_the_newest(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    q = folds.stream_upsert(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), ["user_id"], f"{tmp_path}/t", f"{tmp_path}/ck")
    q.processAllAvailable()
    q.stop()
    got = {r.user_id: r.value for r in spark.read.parquet(f"{tmp_path}/t/v0").collect()}
    assert got == {r.user_id: r.v for r in events.groupBy("user_id").agg(F.max_by("value", "ts").alias("v")).collect()}
