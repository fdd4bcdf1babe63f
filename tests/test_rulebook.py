"""Suites by table: every rule sees its fault, a suite that fails is a row, a table is scanned once."""

import datetime

import pytest
from pyspark.sql import functions as F

from granary.operators import rulebook as R
from granary.plans import rulebook as B

SF = "/root/testdata/sf0.001"
D = datetime.date
NO = 10**9
#: For each rule on rows: a row copied from its table with these values breaks it.
FAULTS = {
    "quantity": {"Quantity": 0}, "unit_price": {"UnitPrice": 0}, "cost_above_price": {"UnitCost": 10**6}, "discount_range": {"DiscountAmount": -1}, "early_due": {"DueDate": D(1990, 1, 1)},
    "early_delivery": {"DeliveryDate": D(1990, 1, 1)}, "delay_flag": {"IsOrderDelayed": True, "DeliveryDate": D(1995, 1, 1), "DueDate": D(2001, 1, 1)}, "time_key": {"TimeKey": 1440},
    "customer_name": {"FullName": " "}, "balance": {"Balance": 10_001.0}, "list_price": {"ListPrice": 0}, "no_channel": {"EligibleStore": False, "EligibleOnline": False}, "store_type": {"StoreType": "Kiosk"},
    "empty_region": {"Region": None}, "starts_before_ends": {"EffectiveEndDate": D(1980, 1, 1)}, "follows": {"PreviousEnd": D(1980, 1, 1)}, "first_is_1": {"PreviousEnd": None, "VersionNumber": 2},
    "numbers": {"VersionNumber": 99, "Of": 98}, "one_current": {"NowCurrent": 2}, "current_is_open": {"IsCurrent": True, "EffectiveEndDate": D(2001, 1, 1)}, "changes": {"ChannelKey": 3, "Before": 3},
    "assignment_order": {"EndDate": D(1980, 1, 1)}, "overlap_rows": {"PreviousEnd": D(2050, 1, 1)}, "long_assignment": {"EndDate": D(2050, 1, 1)}, "null_employee": {"EmployeeKey": None}, "other_store": {"EmployeeKey": 39_999_990},
}


def tables(spark):
    return {t: f(spark, SF) for t, f in B.TABLES.items()}


def changed(df, values):
    """One row of the table with other values."""
    for name, v in values.items():
        df = df.withColumn(name, F.lit(v).cast(df.schema[name].dataType))
    return df


def run(spark, frames, suites):
    return {(r.suite, r.check): r for r in R.run_suites(spark, {t: (lambda d=d: d) for t, d in frames.items()}, suites).collect()}


def test_every_rule_sees_its_fault(spark):
    clean, suites = tables(spark), B.suites()
    clean = {t: spark.createDataFrame(d.collect(), d.schema) for t, d in clean.items()}
    faulty = dict(clean)
    for suite in suites.values():
        for r in suite:
            one = clean[r.table].limit(1)
            if isinstance(r, R.Keys):
                values = {k: None for k in r.keys} if r.kind == "null" else {r.keys[0]: NO} if r.kind == "orphan" else {}
                faulty[r.table] = faulty[r.table].unionByName(changed(one, values))
            elif r.low is not None and r.check in FAULTS:
                faulty[r.table] = faulty[r.table].unionByName(changed(one, FAULTS[r.check]))
    before, after = run(spark, clean, suites), run(spark, faulty, suites)
    for name, checks in suites.items():
        for r in checks:
            if isinstance(r, R.Keys) or (r.low == r.high == 0):
                assert after[name, r.check].actual_value > before[name, r.check].actual_value, r.check
                assert after[name, r.check].result == "FAIL" and (before[name, r.check].result == "PASS") == (before[name, r.check].actual_value == 0)
                assert isinstance(r, R.Keys) or r.check in FAULTS
    assert after["summary", "verdict"].result == "FAIL" and after["summary", "verdict"].description == f"{sum(map(len, suites.values()))} checks"


def test_shares_and_what_is_only_told(spark):
    frames = {"t": spark.createDataFrame([(i,) for i in range(10)], "x int"), "none": spark.createDataFrame([], "x int")}
    low = lambda: F.col("x") < 3
    got = run(spark, frames, {"s": [R.share("in", "t", "", low, 0.2, 0.4), R.share("out", "t", "", low, 0.4, 0.5), R.share("empty", "none", "", low, 0, 1), R.info("n", "t", "", lambda: F.count("*"))]})
    assert [(got["s", c].result, got["s", c].actual_value) for c in ("in", "out", "empty", "n")] == [("PASS", 0.3), ("FAIL", 0.3), ("FAIL", None), ("INFO", 10.0)]


def test_a_suite_that_fails_is_a_row_and_the_others_go_on(spark):
    frames = {"t": spark.createDataFrame([(1, "7"), (2, "x"), (2, None)], "x int, y string")}
    fine = [R.bad("fine", "t", "", lambda: F.col("x") > 1), R.Keys("twice", "t", ("x",), "repeated"), R.Keys("gone", "t", ("y",), "null")]
    makers = {"t": lambda: frames["t"], "broken": lambda: spark.read.parquet("/no/such/folder")}
    suites = {
        "good": fine,
        "no_column": [R.bad("a", "t", "", lambda: F.col("z") > 1), *fine],
        "no_table": [R.bad("b", "broken", "", lambda: F.col("x") > 1)],
        "unknown_table": [R.Keys("c", "t", ("x",), "orphan", "absent", ("x",))],
        "at_run_time": [R.bad("d", "t", "", lambda: F.raise_error(F.lit("no such luck")).cast("int") > 1)],
    }
    rows = R.run_suites(spark, makers, suites).collect()
    got = {(r.suite, r.check): r for r in rows}
    assert {(s, c): got[s, c].actual_value for s, c in got if s == "good"} == {("good", "fine"): 2.0, ("good", "twice"): 1.0, ("good", "gone"): 1.0}
    for s in list(suites)[1:]:
        (row,) = [r for r in rows if r.suite == s]
        assert (row.category, row.check, row.result, row.actual_value) == ("error", "EXECUTION ERROR", "FAIL", None) and row.description
    assert "no such luck" in got["at_run_time", "EXECUTION ERROR"].description
    assert [r.result for r in rows[:-1]] == sorted((r.result for r in rows[:-1]), key="FAIL PASS INFO".split().index)
    assert rows[-1].check == "verdict" and rows[-1].actual_value == 7.0


def test_a_table_is_scanned_once(spark, tmp_path):
    spark.createDataFrame([(i, i % 7) for i in range(100)], "k int, v int").coalesce(1).write.parquet(f"{tmp_path}/t")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.read.parquet(f"{tmp_path}/t").mapInArrow(count, "k int, v int")
    checks = {f"s{n}": [R.bad("a", "t", "", lambda: F.col("v") > 5), R.info("b", "t", "", lambda: F.max("k")), R.Keys("c", "t", ("k",), "repeated"), R.Keys("d", "t", ("v",), "orphan", "t", ("k",))] for n in range(3)}
    assert {r.result for r in R.run_suites(spark, {"t": lambda: df}, checks, summary=False).collect()} == {"FAIL", "PASS", "INFO"}
    assert seen.value == 100


@pytest.mark.parametrize("kind", ["null", "repeated"])
def test_keys_of_several_columns(spark, kind):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (12, "3"), (1, "23")], "x int, y string")
    got = run(spark, {"t": df}, {"s": [R.Keys("k", "t", ("x", "y"), kind)]})
    assert got["s", "k"].actual_value == {"null": 2.0, "repeated": 1.0}[kind]
