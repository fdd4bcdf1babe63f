"""Queries: weights, scores, pools and reassignments."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01, u01_sql
from granary.operators import weights as V
from granary.operators.alias import weighted_pick
from granary.plans import star as S
from granary.plans.domain import alias_sql, picked, slot_is
from granary.plans.history import ASSIGN, MONTHS, assignments, months
from granary.plans.registry import register
from granary.plans.star import STAR


def q(name: str, sql: str):
    return register(name, STAR + sql)


TYPE = "CASE StoreType WHEN 'Online' THEN 1.5::DOUBLE WHEN 'Convenience' THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END"


@q("store_weight", f"SELECT StoreKey, round({TYPE} * CASE WHEN Balance > 5000 THEN 1.2::DOUBLE WHEN Balance < 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 9) AS Weight FROM stores")
def store_weight(spark, sf):
    revenue = F.when(F.col("Balance") > 5000, 1.2).when(F.col("Balance") < 0, 0.8).otherwise(1.0)
    return S.stores(spark, sf).select("StoreKey", F.round(V.mapped(F.col("StoreType"), {"Online": 1.5, "Convenience": 0.7}) * revenue, 9).alias("Weight"))


WORDS = [("ring", 1.5), ("widget", 0.8), ("a", 1.1)]


@q("keyword_weight", "SELECT ProductKey, round(1.0::DOUBLE" + "".join(f" * CASE WHEN contains(lower(ProductName), '{w}') THEN {x}::DOUBLE ELSE 1.0::DOUBLE END" for w, x in WORDS) + ", 9) AS Weight FROM products")
def keyword_weight(spark, sf):
    return S.products(spark, sf).select("ProductKey", F.round(V.keyword_weight(F.col("ProductName"), WORDS), 9).alias("Weight"))


@q("product_month_weight", "SELECT ProductKey, m::INTEGER AS \"Month\", round(greatest(Size / 10.0::DOUBLE, 1.0::DOUBLE) * CASE WHEN m // 4 = Size % 4 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END, 9) AS Weight FROM products CROSS JOIN range(1, 13) t(m)")
def product_month_weight(spark, sf):
    rows = S.products(spark, sf).withColumn("Month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    boost = F.when(F.floor(F.col("Month") / 4) == F.col("Size") % 4, 1.4).otherwise(1.0)
    return rows.select("ProductKey", "Month", F.round(F.greatest(F.col("Size") / 10.0, F.lit(1.0)) * boost, 9).alias("Weight"))


@q("employee_weight", ASSIGN + f", e AS (SELECT StoreKey, EmployeeKey, row_number() OVER (PARTITION BY EmployeeKey ORDER BY max(EndDate) DESC, StoreKey) = 1 AS prim FROM assign GROUP BY 1, 2) SELECT StoreKey, EmployeeKey, round(least(greatest((EmployeeKey % 6) / 2.0::DOUBLE, 0.0::DOUBLE), 2.0::DOUBLE) * CASE WHEN prim THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END * exp(0.25::DOUBLE * sqrt(-2 * ln(1 - {u01_sql('EmployeeKey', seed=41, salt=1)})) * cos(2 * pi() * {u01_sql('EmployeeKey', seed=41, salt=2)})), 6) AS Weight FROM e")
def employee_weight(spark, sf):
    own = assignments(spark, sf).groupBy("StoreKey", "EmployeeKey").agg(F.max("EndDate").alias("last"))
    primary = F.row_number().over(W.partitionBy("EmployeeKey").orderBy(F.desc("last"), "StoreKey")) == 1
    hours = F.least(F.greatest((F.col("EmployeeKey") % 6) / 2.0, F.lit(0.0)), F.lit(2.0))
    weight = hours * F.when(F.col("primary"), 1.5).otherwise(1.0) * V.lognormal(F.col("EmployeeKey"), spread=0.25, seed=41)
    return own.withColumn("primary", primary).select("StoreKey", "EmployeeKey", F.round(weight, 6).alias("Weight"))


MIX = [("Online", 1, 8.0), ("Online", 2, 2.0), ("Convenience", 3, 1.0), ("Supermarket", 3, 3.0), ("Supermarket", 4, 2.0), ("Supermarket", 5, 1.0)]
MIX_SQL = ", mix(t, ChannelKey, w) AS (VALUES " + ", ".join(f"('{t}', {c}, {w}::DOUBLE)" for t, c, w in MIX) + ") "


def _mix(spark):
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(c).alias("Channel"), F.lit(w).alias("w")) for t, c, w in MIX]))
    return spark.range(1).select(rows.alias("r")).select("r.*")


@q("store_channel_map", MIX_SQL + "SELECT StoreKey, ChannelKey, round(w / sum(w) OVER (PARTITION BY StoreKey), 9) AS Probability FROM stores JOIN mix ON t = StoreType")
def store_channel_map(spark, sf):
    rows = S.stores(spark, sf).join(F.broadcast(_mix(spark)), F.col("t") == F.col("StoreType"))
    return rows.select("StoreKey", F.col("Channel").alias("ChannelKey"), F.round(F.col("w") / F.sum("w").over(W.partitionBy("StoreKey")), 9).alias("Probability"))


@q("channel_by_store", MIX_SQL + f", {alias_sql('c', 'mix', 't', 'w', 'ChannelKey')}, o AS (SELECT OrderNumber, min(StoreKey) AS StoreKey, {u01_sql('OrderNumber', seed=43)} AS u FROM sales GROUP BY OrderNumber) SELECT OrderNumber, {picked('ChannelKey')} AS Channel FROM o JOIN stores USING (StoreKey) LEFT JOIN c ON t = StoreType AND {slot_is()}")
def channel_by_store(spark, sf):
    own = S.sales(spark, sf).groupBy("OrderNumber").agg(F.min("StoreKey").alias("StoreKey"))
    own = own.join(S.stores(spark, sf).select("StoreKey", F.col("StoreType").alias("t")), "StoreKey")
    return weighted_pick(own, _mix(spark), "t", "w", "Channel", "OrderNumber", 43).select("OrderNumber", "Channel")


@q("country_pools", "SELECT StoreKey, Country, row_number() OVER (PARTITION BY Country ORDER BY StoreKey)::INTEGER AS Place, count(*) OVER (PARTITION BY Country) AS PoolSize FROM stores")
def country_pools(spark, sf):
    return V.pool_places(S.stores(spark, sf).select("StoreKey", "Country"), "Country", "StoreKey")


@q("clamp_year_window", "SELECT OrderNumber, OrderLineNumber, CASE WHEN year(OrderDate) BETWEEN 1995 AND 1998 THEN least(greatest(OrderDate, make_date(year(OrderDate), 3, 1)), make_date(year(OrderDate), 10, 31)) ELSE least(greatest(OrderDate, DATE '1996-01-01'), DATE '2000-12-31') END AS Clamped FROM sales")
def clamp_year_window(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", V.clamp_year(F.col("OrderDate"), "03-01", "10-31", (1995, 1998), ("1996-01-01", "2000-12-31")).alias("Clamped"))


@q("distinct_target", MONTHS + "SELECT MonthStart, least(floor(n * 0.2::DOUBLE * (1 + 0.3::DOUBLE * sin(2 * pi() * month(MonthStart) / 12.0::DOUBLE)) * CASE month(MonthStart) WHEN 12 THEN 1.5::DOUBLE WHEN 11 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END + 0.5::DOUBLE), n)::BIGINT AS Target FROM months, (SELECT count(*) AS n FROM customers)")
def distinct_target(spark, sf):
    people = S.customers(spark, sf).agg(F.count("*").alias("n"))
    return V.distinct_targets(months(spark, sf).crossJoin(F.broadcast(people)), F.col("n"), 0.2, 0.3, {12: 1.5, 11: 1.2}).select("MonthStart", "Target")


@q("product_scores", f"SELECT ProductKey, round(1 + 4 * {u01_sql('ProductKey', seed=44, salt=1)}, 1) AS Rating, floor(pow({u01_sql('ProductKey', seed=44, salt=2)}, 3) * 1000)::BIGINT AS Reviews, CASE WHEN ListPrice > 1200 THEN 36 WHEN ListPrice > 1000 THEN 24 ELSE 12 END AS WarrantyMonths, round(0.02::DOUBLE + 0.1::DOUBLE * {u01_sql('ProductKey', seed=44, salt=3)}, 6) AS ReturnRate FROM products")
def product_scores(spark, sf):
    u = lambda salt: hash_u01(F.col("ProductKey"), seed=44, salt=salt)
    months_of = F.when(F.col("ListPrice") > 1200, 36).when(F.col("ListPrice") > 1000, 24).otherwise(12)
    return S.products(spark, sf).select("ProductKey", F.round(1 + 4 * u(1), 1).alias("Rating"), F.floor(F.pow(u(2), 3) * 1000).cast("long").alias("Reviews"), months_of.alias("WarrantyMonths"), F.round(0.02 + 0.1 * u(3), 6).alias("ReturnRate"))


@q("eligible_product_swap", f", pool AS (SELECT Category AS g, ProductKey, 1 AS w FROM products WHERE EligibleOnline), {alias_sql('c', 'pool', 'g', 'w', 'ProductKey')}, l AS (SELECT OrderNumber, OrderLineNumber, s.ProductKey, Category, StoreType = 'Online' AND NOT EligibleOnline AS bad, {u01_sql('OrderNumber * 100 + OrderLineNumber', seed=45).replace('OrderNumber * 100 + OrderLineNumber::VARCHAR', '(OrderNumber * 100 + OrderLineNumber)::VARCHAR')} AS u FROM sales s JOIN stores USING (StoreKey) JOIN products p ON p.ProductKey = s.ProductKey) SELECT OrderNumber, OrderLineNumber, l.ProductKey AS Old, coalesce({picked('ProductKey')}, l.ProductKey) AS ProductKey FROM l LEFT JOIN c ON bad AND g = Category AND {slot_is()}")
def eligible_product_swap(spark, sf):
    goods = S.products(spark, sf).select("ProductKey", "Category", "EligibleOnline")
    rows = S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "ProductKey", "StoreKey", (F.col("OrderNumber") * 100 + F.col("OrderLineNumber")).alias("Line"))
    rows = rows.join(S.stores(spark, sf).select("StoreKey", "StoreType"), "StoreKey").join(goods, "ProductKey")
    return V.repick(rows, F.expr("StoreType = 'Online' AND NOT EligibleOnline"), goods.where("EligibleOnline"), "Category", "ProductKey", "Line", 45).select("OrderNumber", "OrderLineNumber", "Old", "ProductKey")


CLOSED = "StoreKey % 3 = 1 AND OrderDate >= DATE '1998-02-10' AND OrderDate < DATE '1998-03-20'"


@q("store_reassign_closed", f", pool AS (SELECT Country AS g, StoreKey, 1 AS w FROM stores WHERE StoreKey % 3 <> 1), {alias_sql('c', 'pool', 'g', 'w', 'StoreKey')}, l AS (SELECT OrderNumber, OrderLineNumber, StoreKey, Country, {CLOSED} AS bad, {u01_sql('OrderNumber', seed=46)} AS u FROM sales JOIN stores USING (StoreKey)) SELECT OrderNumber, OrderLineNumber, l.StoreKey AS Old, coalesce({picked('StoreKey')}, l.StoreKey) AS StoreKey FROM l LEFT JOIN c ON bad AND g = Country AND {slot_is()}")
def store_reassign_closed(spark, sf):
    """All lines of an order whose stores are closed and of one country move to the same store."""
    shops = S.stores(spark, sf).select("StoreKey", "Country")
    rows = S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "OrderDate", "StoreKey").join(shops, "StoreKey")
    return V.repick(rows, F.expr(CLOSED), shops.where("StoreKey % 3 <> 1"), "Country", "StoreKey", "OrderNumber", 46).select("OrderNumber", "OrderLineNumber", "Old", "StoreKey")


RACE = f"-ln(1 - {u01_sql('CustomerKey', seed=47)}) / (1 + CustomerKey % 5)::DOUBLE"


@q("sample_with_coverage", f", r AS (SELECT CustomerKey, Country, {RACE} AS race FROM customers), f AS (SELECT *, row_number() OVER (PARTITION BY Country ORDER BY race, CustomerKey) AS k FROM r), g AS (SELECT CustomerKey, Country, row_number() OVER (ORDER BY race, CustomerKey) AS k FROM f WHERE k > 1) SELECT CustomerKey, Country, true AS Covers FROM f WHERE k = 1 UNION ALL SELECT CustomerKey, Country, false FROM g WHERE k <= 100 - (SELECT count(DISTINCT Country) FROM r)")
def sample_with_coverage(spark, sf):
    own = S.customers(spark, sf).select("CustomerKey", "Country")
    return V.sample_covering(own, "Country", (1 + F.col("CustomerKey") % 5).cast("double"), "CustomerKey", 100, 47)


@q("brand_rotation", MONTHS + f", b AS (SELECT Brand, count(*) AS Size FROM products GROUP BY 1), t AS (SELECT Brand, row_number() OVER (ORDER BY {u01_sql('Brand', seed=48)}, Brand) - 1 AS turn, count(*) OVER () AS n, pow(Size::DOUBLE, 0.8::DOUBLE) / sum(pow(Size::DOUBLE, 0.8::DOUBLE)) OVER () AS base FROM b), w AS (SELECT MonthStart, Brand, greatest(base * CASE WHEN (year(MonthStart) * 12 + month(MonthStart)) % n = turn THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 0.01::DOUBLE) AS w FROM months CROSS JOIN t) SELECT MonthStart, Brand, round(w / sum(w) OVER (PARTITION BY MonthStart), 9) AS Share FROM w")
def brand_rotation(spark, sf):
    brands = S.products(spark, sf).groupBy("Brand").agg(F.count("*").alias("Size"))
    return V.brand_month_share(brands, months(spark, sf), 0.8, 1.5, 0.01, 48).withColumn("Share", F.round("Share", 9))
