"""Stateful ledger and bucketed upserts: several batches, late rows, stops and restarts."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import intervals
from granary.streaming import buckets, ledger

SCHEMA = "event long, ts timestamp, k long, q long"
T0 = datetime.datetime(2024, 1, 1)


def rows(seed, n=240, keys=4, days=40):
    rng = random.Random(seed)
    out = [(i, T0 + datetime.timedelta(seconds=rng.randrange(days * 86400), microseconds=rng.randrange(1_000_000)), rng.randrange(keys), rng.randrange(0, 7)) for i in range(n)]
    return out + [(n + i, out[0][1], out[0][2], 1) for i in range(3)]  # ties of time


def plain(events, rules):
    """A loop over each key's events and receipts in order of time."""
    out, last = [], max(e[1] for e in events if e[3] > 0)
    for k in {e[2] for e in events}:
        stock, due = rules.opening, None
        for ts, event, q in sorted((e[1], e[0], e[3]) for e in events if e[2] == k and e[3] > 0) + [(last, None, 0)]:
            while due is not None and due <= ts:
                at, due, stock = due, None, stock + rules.order
                if stock <= rules.reorder_at:
                    due = at + datetime.timedelta(hours=rules.lead_hours)
                out.append((k, at, "receipt", None, rules.order, rules.order, stock, rules.order if due else 0))
            if event is not None:
                moved = min(q, stock)
                stock -= moved
                ordered = stock <= rules.reorder_at and due is None
                due = ts + datetime.timedelta(hours=rules.lead_hours) if ordered else due
                out.append((k, ts, "sale", event, q, moved, stock, rules.order if ordered else 0))
    return sorted(out, key=str)


def entries(df):
    return sorted(((r.Key, r.At, r.Kind, r.EventId, r.Asked, r.Moved, r.Stock, r.Ordered) for r in df.collect()), key=str)


RULES = [ledger.StockRules(), ledger.StockRules(opening=0, reorder_at=5, order=2, lead_hours=7)]


@pytest.mark.parametrize("rules", RULES)
def test_batch_ledger_matches_a_plain_loop(spark, rules):
    events = rows(1)
    df = spark.createDataFrame(events + [(None, T0, 1, 1), (9000, None, 1, 1), (9001, T0, None, 1)], SCHEMA)
    assert entries(ledger.batch_ledger(df.repartition(7), rules, "k", "ts", "event", "q")) == plain(events, rules)
    assert ledger.batch_ledger(df.limit(0), rules, "k", "ts", "event", "q").count() == 0


def run(spark, folder, rules, files):
    """Runs the stream over what lies in the folder, from its checkpoint, and stops."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    out = ledger.stream_ledger(stream, rules, "k", "ts", "event", "q", "2 days")
    with ledger.rocksdb(spark):
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("rules", RULES)
def test_the_stream_equals_its_twin_over_batches_and_a_restart(spark, tmp_path, rules):
    events = sorted(rows(2), key=lambda e: e[1])
    rng = random.Random(3)
    parts = [events[i : i + 50] for i in range(0, len(events), 50)]
    for n, p in enumerate(parts):  # rows out of order within a batch and, by less than the watermark, between batches
        rng.shuffle(p)
        if n:
            early = [e for e in p if e[1] < min(x[1] for x in p) + datetime.timedelta(hours=20)][:5]
            parts[n - 1] += early
            parts[n] = [e for e in p if e not in early]
    folder = str(tmp_path)
    for half in (parts[:2], parts[2:]):
        for p in half:
            spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark, folder, rules, 1)
    settled = max(e[1] for e in events) - datetime.timedelta(days=2, seconds=1)
    got = [r for r in entries(spark.read.parquet(f"{folder}/out")) if r[1] <= settled]
    want = [r for r in plain(events, rules) if r[1] <= settled]
    assert len(want) > 100 and got == want


def test_late_rows_are_dropped(spark, tmp_path):
    day = lambda n: T0 + datetime.timedelta(days=n)
    for batch in ([(1, day(0), 1, 2), (2, day(10), 1, 2)], [(3, day(1), 1, 5), (4, day(11), 1, 1)], [(5, day(30), 1, 1)], [(6, day(31), 1, 1)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(spark, str(tmp_path), ledger.StockRules(), 1)
    sold = {r.EventId: r.Stock for r in spark.read.parquet(f"{tmp_path}/out").where("Kind = 'sale'").collect()}
    assert sold == {1: 8, 2: 6, 4: 5}


def test_rules_are_checked():
    with pytest.raises(ValueError):
        ledger.StockRules(order=0)


def table_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_only_touched_buckets_change(spark, tmp_path):
    table = buckets.BucketTable(spark, f"{tmp_path}/t", ["k"], 8)
    assert table.read() is None
    keep = buckets.newest(["k"], "ts")
    frame = lambda r: spark.createDataFrame(r, "k long, ts int, v string")
    assert table.apply(frame([(k, 1, "a") for k in range(40)]), 0, keep)
    before = table.manifest()["holds"]
    assert table.apply(frame([(3, 2, "b"), (3, 1, "c"), (99, 5, "d"), (4, 0, "old")]), 1, keep)
    after = table.manifest()["holds"]
    assert {b for b in after if after[b] != before.get(b)} == {b for b in after if after[b] == 1} and 1 <= list(after.values()).count(1) <= 3
    want = {k: (k, 1, "a") for k in range(40)} | {3: (3, 2, "b"), 99: (99, 5, "d")}
    assert table_of(table.read()) == sorted(want.values())


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    table = buckets.BucketTable(spark, f"{tmp_path}/t", ["k"], 4)
    keep = buckets.newest(["k"], "ts")
    frame = lambda r: spark.createDataFrame(r, "k long, ts int, v string")
    for n in range(3):
        assert table.apply(frame([(k, n, "x") for k in range(n, 10)]), n, keep)
    state, rows_now = table.manifest(), table_of(table.read())
    assert not table.apply(frame([(1, 99, "again")]), 2, keep) and not table.apply(frame([(1, 99, "again")]), 1, keep)
    assert table.manifest() == state and table_of(table.read()) == rows_now
    # data without a manifest is what a writer that died has left: it does not count and is written over
    frame([(7, 50, "half")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{tmp_path}/t/data/3")
    assert table_of(table.read()) == rows_now
    assert table.apply(frame([(0, 3, "y")]), 3, keep)
    assert table_of(table.read()) == [(0, 3, "y")] + [r for r in rows_now if r[0] != 0]
    assert len(table.versions()) == 2 and set(table._entries(f"{tmp_path}/t/data")) <= {"0", "1", "2", "3"}
    assert table.apply(frame([]), 4, keep) and table_of(table.read()) == [(0, 3, "y")] + [r for r in rows_now if r[0] != 0]


def test_old_versions_go_and_another_layout_is_refused(spark, tmp_path):
    table = buckets.BucketTable(spark, f"{tmp_path}/t", ["k"], 2)
    keep = buckets.newest(["k"], "ts")
    for n in range(4):
        table.apply(spark.createDataFrame([(k, n) for k in range(20)], "k long, ts int"), n, keep)
    assert sorted(table._entries(f"{tmp_path}/t/data")) == ["2", "3"] and table.versions() == [2, 3]
    assert table.read(2).agg(F.max("ts")).first()[0] == 2
    with pytest.raises(ValueError, match="buckets"):
        buckets.BucketTable(spark, f"{tmp_path}/t", ["k"], 3).read()


def test_upserts_from_a_stream_that_stops_and_starts(spark, tmp_path):
    events = rows(5)
    table = buckets.BucketTable(spark, f"{tmp_path}/t", ["k"], 4)
    for half in (events[:100], events[100:]):
        for p in (half[::2], half[1::2]):
            spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        buckets.stream_upsert_buckets(stream, table, "ts", f"{tmp_path}/ck").awaitTermination()
    want = {}
    for e in events:
        want[e[2]] = max(want.get(e[2], e), e, key=lambda x: (x[1], x[0]))
    assert table_of(table.read()) == sorted(want.values())


def test_versions_in_a_bucketed_table(spark, tmp_path):
    rng = random.Random(6)
    changes = [(rng.randrange(30), datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(300)), rng.randrange(3)) for _ in range(300)]
    df = spark.createDataFrame(changes, "k int, d date, a int")
    table = buckets.BucketTable(spark, f"{tmp_path}/t", ["k"], 8)
    build = lambda old, new: intervals.scd2_build(new, ["k"], "d", ["a"]) if old is None else intervals.scd2_merge(old, new, ["k"], "d", ["a"])
    for n, part in enumerate((df.where("d < '2024-05-01'"), df.where("d >= '2024-05-01' and k < 5"), df.where("d >= '2024-05-01' and k >= 5"))):
        table.apply(part, n, build)
    want = intervals.scd2_build(df, ["k"], "d", ["a"])
    assert table_of(table.read().select(want.columns)) == table_of(want)
