"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from granary.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return str(v) if v.time() != datetime.time(0) else str(v.date())
    return v if v is None or isinstance(v, (int, str)) else str(v)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = df.collect()
    if sql := registry.oracle_sql().get(name):
        want = duck.sql(sql)
        assert sorted(want.columns) == sorted(df.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), want.columns)
    else:
        assert got


@pytest.mark.parametrize("name", ["budget_yearly", "dense_surrogate_key", "abc_classify", "weighted_pick", "returns_events", "inventory_ledger"])
def test_partitioning_does_not_matter(spark, name):
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        df = registry.queries()[name](spark, SF)
        found.append(rows(df.collect(), df.columns))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
