"""Queries: sales lines written in a layout to the shared folder, and what reading them back gives."""

import uuid

from pyspark.sql import functions as F

from granary.plans import star as S
from granary.plans.registry import register
from granary.plans.star import STAR
from granary.sources import tables as T

BY_MONTH = STAR + 'SELECT year(OrderDate)::INTEGER AS "Year", month(OrderDate)::INTEGER AS "Month", count(*) AS "Rows", sum(Quantity)::BIGINT AS Quantity FROM sales GROUP BY 1, 2'


def lines(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "StoreKey", "OrderDate", "Quantity")


def place(spark) -> str:
    return f"{T.shared_folder(spark)}/granary-layout/{uuid.uuid4().hex}"


def by_month(df):
    year, month = (F.col("Year"), F.col("Month")) if "Year" in df.columns else (F.year("OrderDate"), F.month("OrderDate"))
    return df.groupBy(year.cast("int").alias("Year"), month.cast("int").alias("Month")).agg(F.count("*").alias("Rows"), F.sum("Quantity").cast("long").alias("Quantity"))


@register("write_partitioned", BY_MONTH)
def write_partitioned(spark, sf):
    path = place(spark)
    T.write_fact(T.add_year_month(lines(spark, sf)), path, ["Year", "Month"])
    return by_month(spark.read.parquet(path))


@register("compact_files", BY_MONTH)
def compact_files(spark, sf):
    """A partitioned table of many files, compacted in its folders."""
    path = place(spark)
    T.add_year_month(lines(spark, sf)).write.partitionBy("Year", "Month").parquet(path)
    T.compact(spark, path)
    return by_month(spark.read.parquet(path))


@register("repartition_table", BY_MONTH)
def repartition_table(spark, sf):
    path = place(spark)
    T.write_fact(lines(spark, sf), path)
    T.relayout(spark, path, "year_month")
    return by_month(spark.read.parquet(path))


@register("optimize_layout", BY_MONTH)
def optimize_layout(spark, sf):
    path = place(spark)
    T.write_fact(T.optimize_layout(lines(spark, sf), sort_columns=["StoreKey", "OrderDate"]), path)
    return by_month(spark.read.parquet(path))


@register("cluster_sort", STAR + "SELECT StoreKey, min(OrderDate) AS FirstOrder, max(OrderDate) AS LastOrder, count(*) AS \"Rows\" FROM sales GROUP BY 1")
def cluster_sort(spark, sf):
    """Rows clustered by store in the files, so that a store's rows are read from few row groups."""
    path = place(spark)
    T.write_fact(T.optimize_layout(lines(spark, sf).repartitionByRange("StoreKey"), sort_columns=["StoreKey", "OrderDate"]), path)
    return spark.read.parquet(path).groupBy(F.col("StoreKey").cast("long").alias("StoreKey")).agg(F.min("OrderDate").alias("FirstOrder"), F.max("OrderDate").alias("LastOrder"), F.count("*").alias("Rows"))


def _csv(spark, sf, max_rows):
    path, own = place(spark), lines(spark, sf)
    T.write_csv_bulk(own, path, max_rows)
    return by_month(spark.read.schema(own.schema).option("header", True).csv(path))


@register("write_csv_bulk", BY_MONTH)
def write_csv_bulk(spark, sf):
    return _csv(spark, sf, 0)


@register("rechunk_csv", BY_MONTH)
def rechunk_csv(spark, sf):
    """In files of 5,000 rows at most, each with its header."""
    return _csv(spark, sf, 5000)
