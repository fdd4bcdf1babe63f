"""The retail star over the given tables: sales lines, stores, customers, products, returns, channels.

Each builder has a twin in STAR, the head of the SQL that the queries are checked against.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.money import from_cents
from granary.sources.tables import scan_table


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    found = scan_table(spark, sf_dir, name, columns)
    if found is None:
        raise ValueError(f"no table {name} in {sf_dir}")
    return found


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat sales lines; line numbers are remade, since the given ones repeat within an order."""
    lines = read(spark, sf_dir, "lineitem")
    orders = read(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"])
    every = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + F.lit(0.5))
    off = F.floor(cents * F.col("l_discount") + F.lit(0.5))
    flat = lines.withColumn("n", F.row_number().over(every)).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    channel = F.substring("o_orderpriority", 1, 1).cast("int")
    ordered = F.col("o_orderdate").cast("date")
    due = F.date_add(ordered, channel * 2)
    delivered = F.date_add(ordered, (F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")) % 14).cast("int"))
    return flat.select(
        F.col("l_orderkey").alias("OrderNumber"), F.col("n").alias("OrderLineNumber"), F.col("o_custkey").alias("CustomerKey"),
        F.col("l_partkey").alias("ProductKey"), F.col("l_suppkey").alias("StoreKey"),
        (F.lit(30_000_000) + F.col("l_suppkey") * 10 + F.col("l_orderkey") % 3).alias("EmployeeKey"),
        (F.lit(1) + F.floor(F.col("l_discount") * 100 + F.lit(0.5))).cast("int").alias("PromotionKey"),
        (F.col("l_suppkey") % 5 + 1).cast("int").alias("CurrencyKey"), channel.alias("ChannelKey"),
        (F.col("l_orderkey") % 1440).cast("int").alias("TimeKey"),
        ordered.alias("OrderDate"), due.alias("DueDate"), delivered.alias("DeliveryDate"),
        F.col("l_quantity").cast("int").alias("Quantity"), from_cents(cents).alias("UnitPrice"), from_cents(cents - off).alias("NetPrice"),
        from_cents(F.floor(cents * F.lit(0.6))).alias("UnitCost"), from_cents(off).alias("DiscountAmount"),
        F.col("l_linestatus").alias("DeliveryStatus"), (delivered > due).alias("IsOrderDelayed"), F.col("l_returnflag").alias("ReturnFlag"),
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    return supplier.join(geography(spark, sf_dir), F.col("s_nationkey") == F.col("GeographyKey")).select(F.col("s_suppkey").alias("StoreKey"), "GeographyKey", "Country", "Region", F.when(F.col("s_suppkey") % 4 == 0, "Online").when(F.col("s_suppkey") % 4 == 1, "Convenience").otherwise("Supermarket").alias("StoreType"), (F.col("s_suppkey") % 7).cast("int").alias("WarehouseKey"), F.col("s_acctbal").alias("Balance"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("GeographyKey"), F.col("n_name").alias("Country"), F.col("r_name").alias("Region"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "customer")
    return own.join(geography(spark, sf_dir), F.col("c_nationkey") == F.col("GeographyKey")).select(F.col("c_custkey").alias("CustomerKey"), F.col("c_name").alias("FullName"), "GeographyKey", "Country", "Region", F.col("c_acctbal").alias("Balance"), F.col("c_mktsegment").alias("Segment"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return own.select(key.alias("ProductKey"), F.col("p_name").alias("ProductName"), F.col("p_brand").alias("Brand"), F.col("p_type").alias("Category"), F.col("p_size").alias("Size"), F.col("p_retailprice").cast("decimal(12,2)").alias("ListPrice"), (key % 3 != 0).alias("EligibleStore"), (key % 5 != 0).alias("EligibleOnline"))


def returns(lines: DataFrame) -> DataFrame:
    """Lines flagged as returned, with derived dates, reasons and quantities."""
    lag = (F.col("ProductKey") % 60).cast("int")
    return lines.where("ReturnFlag = 'R'").select("OrderNumber", "OrderLineNumber", F.date_add("DeliveryDate", lag).alias("ReturnDate"), (F.col("ProductKey") % 8 + 1).cast("int").alias("ReturnReasonKey"), F.greatest(F.lit(1), F.col("Quantity") - (F.col("ProductKey") % 3).cast("int")).alias("ReturnQuantity"), F.col("NetPrice").alias("ReturnNetPrice"))


STAR = """
WITH raw AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)::INTEGER AS n,
    floor(l_extendedprice / l_quantity * 100 + 0.5)::BIGINT AS cents, substr(o_orderpriority, 1, 1)::INTEGER AS ch, o_orderdate::DATE AS od
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
raw2 AS (SELECT *, floor(cents * l_discount + 0.5)::BIGINT AS off, od + ch * 2 AS due, od + (date_diff('day', DATE '1990-01-01', l_shipdate::DATE) % 14)::INTEGER AS delivered FROM raw),
sales AS (
  SELECT l_orderkey AS OrderNumber, n AS OrderLineNumber, o_custkey AS CustomerKey, l_partkey AS ProductKey, l_suppkey AS StoreKey,
    30000000 + l_suppkey * 10 + l_orderkey % 3 AS EmployeeKey, (1 + floor(l_discount * 100 + 0.5))::INTEGER AS PromotionKey, (l_suppkey % 5 + 1)::INTEGER AS CurrencyKey, ch AS ChannelKey,
    (l_orderkey % 1440)::INTEGER AS TimeKey, od AS OrderDate, due::DATE AS DueDate, delivered::DATE AS DeliveryDate, l_quantity::INTEGER AS Quantity,
    (cents / 100.0)::DECIMAL(12,2) AS UnitPrice, ((cents - off) / 100.0)::DECIMAL(12,2) AS NetPrice, (floor(cents * 0.6::DOUBLE)::BIGINT / 100.0)::DECIMAL(12,2) AS UnitCost, (off / 100.0)::DECIMAL(12,2) AS DiscountAmount,
    l_linestatus AS DeliveryStatus, delivered > due AS IsOrderDelayed, l_returnflag AS ReturnFlag FROM raw2),
geography AS (SELECT n_nationkey AS GeographyKey, n_name AS Country, r_name AS Region FROM nation JOIN region ON n_regionkey = r_regionkey),
stores AS (SELECT s_suppkey AS StoreKey, GeographyKey, Country, Region, CASE s_suppkey % 4 WHEN 0 THEN 'Online' WHEN 1 THEN 'Convenience' ELSE 'Supermarket' END AS StoreType, (s_suppkey % 7)::INTEGER AS WarehouseKey, s_acctbal AS Balance FROM supplier JOIN geography ON s_nationkey = GeographyKey),
customers AS (SELECT c_custkey AS CustomerKey, c_name AS FullName, GeographyKey, Country, Region, c_acctbal AS Balance, c_mktsegment AS Segment FROM customer JOIN geography ON c_nationkey = GeographyKey),
products AS (SELECT p_partkey AS ProductKey, p_name AS ProductName, p_brand AS Brand, p_type AS Category, p_size AS Size, p_retailprice::DECIMAL(12,2) AS ListPrice, p_partkey % 3 <> 0 AS EligibleStore, p_partkey % 5 <> 0 AS EligibleOnline FROM part),
returns AS (SELECT OrderNumber, OrderLineNumber, DeliveryDate + (ProductKey % 60)::INTEGER AS ReturnDate, (ProductKey % 8 + 1)::INTEGER AS ReturnReasonKey, greatest(1, Quantity - (ProductKey % 3)::INTEGER) AS ReturnQuantity, NetPrice AS ReturnNetPrice FROM sales WHERE ReturnFlag = 'R')
"""
