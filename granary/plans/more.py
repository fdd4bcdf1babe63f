"""Queries: profiles, demand curves, versions of prices, staff grids."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01, u01_sql
from granary.operators.allocation import allocate_by_remainder, expand, fit_total
from granary.operators.intervals import in_interval
from granary.plans import star as S
from granary.plans.history import ASSIGN, MONTHS, assignments, months
from granary.plans.registry import register
from granary.plans.star import STAR
from granary.sources.tables import written


def q(name: str, sql: str):
    return register(name, STAR + sql)


#: Stores of this kind are renovated in these days.
RENOVATED, FROM, TO = "StoreKey % 3 = 1", "1998-02-10", "1998-03-20"


@q("staff_coverage_matrix", ASSIGN + MONTHS + f"SELECT StoreKey, MonthStart, count(DISTINCT EmployeeKey) AS Staff FROM (SELECT StoreKey, MonthStart FROM stores CROSS JOIN months WHERE NOT ({RENOVATED} AND MonthStart <= DATE '{TO}' AND last_day(MonthStart) >= DATE '{FROM}')) g LEFT JOIN assign a USING (StoreKey) GROUP BY 1, 2".replace("count(DISTINCT EmployeeKey)", "count(DISTINCT CASE WHEN StartDate <= MonthStart AND EndDate >= last_day(MonthStart) THEN EmployeeKey END)"))
def staff_coverage_matrix(spark, sf):
    """Staff of each open store in each month: those whose assignment holds the whole month, 0 where nobody's does; months of renovation are left out.

    Intervals are dealt to their months, not compared with all.
    """
    own = in_interval(months(spark, sf), "MonthStart", assignments(spark, sf), "StartDate", "EndDate")
    staff = own.where(F.col("EndDate") >= F.last_day("MonthStart")).groupBy("StoreKey", "MonthStart").agg(F.countDistinct("EmployeeKey").alias("Staff"))
    closed = F.expr(RENOVATED) & (F.col("MonthStart") <= F.lit(TO).cast("date")) & (F.last_day("MonthStart") >= F.lit(FROM).cast("date"))
    grid = S.stores(spark, sf).select("StoreKey").crossJoin(F.broadcast(months(spark, sf))).where(~closed)  # months are a bounded calendar
    return grid.join(staff, ["StoreKey", "MonthStart"], "left").select("StoreKey", "MonthStart", F.coalesce("Staff", F.lit(0)).alias("Staff"))


@q("product_assortment", f"SELECT StoreKey, ProductKey FROM stores s JOIN (SELECT DISTINCT Category FROM products) c ON {u01_sql('StoreKey', 'Category', seed=15)} < 0.5 JOIN products p USING (Category)")
def product_assortment(spark, sf):
    """Each store's products of the categories it keeps: as many rows as pairs, so a row of the join stands for a block of products, not for a category."""
    return assortment(S.stores(spark, sf).select("StoreKey"), S.products(spark, sf).select("Category", "ProductKey"), 15)


#: Products a block: what a task holds of the rows to come. Four runs of Parquet's bit packing, so blocks of one store after the other compress well.
BLOCK = 2016


def assortment(stores, products, seed: int, block: int = BLOCK):
    """StoreKey, ProductKey of the keyed half of all pairs of store and category.

    A joined row becomes all rows of its matches before one is handed on, so matches are one block each, on both
    sides numbered by category. Sides are dealt to a fixed number of partitions, as their size tells nothing of the result's.
    """
    n = int(stores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.floor((F.row_number().over(W.partitionBy("Category").orderBy("ProductKey")) - 1) / block).cast("int")
    blocks = products.where(F.col("Category").isNotNull()).withColumn("_b", at).groupBy("Category", "_b").agg(F.collect_list("ProductKey").alias("_keys"))
    counts = blocks.groupBy("Category").agg(F.count("*").cast("int").alias("_n"))
    kept = stores.crossJoin(counts).where(hash_u01(F.col("StoreKey"), F.col("Category"), seed=seed) < 0.5)
    kept = kept.repartition(n, "StoreKey", "Category").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    pairs = kept.repartition(n, "Category", "_b").join(blocks.repartition(n, "Category", "_b").hint("merge"), ["Category", "_b"])
    return pairs.select("StoreKey", F.explode("_keys").alias("ProductKey"))


@q("replicate_variants", "SELECT ProductKey AS BaseProduct, i::INTEGER AS Variant, lpad(ProductKey::VARCHAR, 6, '0') || '-' || i AS Code FROM products CROSS JOIN range(1, 4) t(i)")
def replicate_variants(spark, sf):
    rows = expand(S.products(spark, sf).select("ProductKey", F.lit(3).alias("n")), "n", "Variant")
    return rows.select(F.col("ProductKey").alias("BaseProduct"), "Variant", F.concat(F.lpad(F.col("ProductKey").cast("string"), 6, "0"), F.lit("-"), F.col("Variant").cast("string")).alias("Code"))


@q("inventory_params", ", d AS (SELECT ProductKey, year(OrderDate) AS y, month(OrderDate) AS m, sum(Quantity) AS qn FROM sales GROUP BY 1, 2, 3) SELECT ProductKey, ceil(sum(qn)::DOUBLE / count(*))::BIGINT AS MeanDemand, (ceil(sum(qn)::DOUBLE / count(*)) * 2)::BIGINT AS Opening FROM d GROUP BY 1")
def inventory_params(spark, sf):
    monthly = S.sales(spark, sf).groupBy("ProductKey", F.year("OrderDate").alias("y"), F.month("OrderDate").alias("m")).agg(F.sum("Quantity").alias("qn"))
    mean = F.ceil(F.sum("qn").cast("double") / F.count("*"))
    return monthly.groupBy("ProductKey").agg(mean.cast("bigint").alias("MeanDemand"), (mean * 2).cast("bigint").alias("Opening"))


@q("replenishment_params", "SELECT ProductKey, least(greatest(ceil(Size * (3 + ProductKey % 12) * 0.5::DOUBLE), 5), 200)::BIGINT AS ReorderPoint, greatest(ceil(Size * 0.25::DOUBLE), 1)::BIGINT AS SafetyStock FROM products")
def replenishment_params(spark, sf):
    point = F.least(F.greatest(F.ceil(F.col("Size") * (3 + F.col("ProductKey") % 12) * 0.5), F.lit(5)), F.lit(200))
    return S.products(spark, sf).select("ProductKey", point.cast("bigint").alias("ReorderPoint"), F.greatest(F.ceil(F.col("Size") * 0.25), F.lit(1)).cast("bigint").alias("SafetyStock"))


@q("customer_value_score", "SELECT CustomerKey, round(0.6::DOUBLE * greatest(Balance, 0) / 10000 + 0.4::DOUBLE * least(coalesce(n, 0), 40) / 40.0::DOUBLE, 6) AS Score FROM customers LEFT JOIN (SELECT CustomerKey, count(DISTINCT OrderNumber) AS n FROM sales GROUP BY 1) USING (CustomerKey)")
def customer_value_score(spark, sf):
    n = S.sales(spark, sf).groupBy("CustomerKey").agg(F.countDistinct("OrderNumber").alias("n"))
    score = 0.6 * F.greatest(F.col("Balance"), F.lit(0.0)) / 10000 + 0.4 * F.least(F.coalesce("n", F.lit(0)), F.lit(40)) / 40.0
    return S.customers(spark, sf).join(n, "CustomerKey", "left").select("CustomerKey", F.round(score, 6).alias("Score"))


def _numbered(rows):
    """Months by their number from the first, as i."""
    first = rows.agg(F.min("MonthStart").alias("f"))
    return rows.crossJoin(F.broadcast(first)).withColumn("i", (F.year("MonthStart") - F.year("f")) * 12 + F.month("MonthStart") - F.month("f")).drop("f")


@q("month_demand_weight", MONTHS + ", w AS (SELECT MonthStart, (1 + 0.01::DOUBLE * date_diff('month', (SELECT min(MonthStart) FROM months), MonthStart)) * (1 + 0.2::DOUBLE * sin(2 * pi() * month(MonthStart) / 12.0::DOUBLE)) AS w FROM months) SELECT MonthStart, round(w / sum(w) OVER (), 9) AS Weight FROM w")
def month_demand_weight(spark, sf):
    rows = _numbered(months(spark, sf))
    trend = 1 + 0.01 * F.col("i")
    rows = rows.withColumn("w", trend * (1 + 0.2 * F.sin(2 * F.pi() * F.month("MonthStart") / 12.0)))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("w").alias("t")))).select("MonthStart", F.round(F.col("w") / F.col("t"), 9).alias("Weight"))


@q("acquisition_weight", MONTHS + ", l AS (SELECT MonthStart, 1 / (1 + exp(-0.1::DOUBLE * (date_diff('month', (SELECT min(MonthStart) FROM months), MonthStart) - 40))) AS s FROM months) SELECT MonthStart, round(s - coalesce(lag(s) OVER (ORDER BY MonthStart), 0), 9) AS Weight FROM l")
def acquisition_weight(spark, sf):
    index = F.col("i")
    curve = lambda i: 1 / (1 + F.exp(-0.1 * (i - 40)))
    before = F.when(index == 0, 0.0).otherwise(curve(index - 1))
    return _numbered(months(spark, sf)).select("MonthStart", F.round(curve(index) - before, 9).alias("Weight"))


@q("price_revisions", f", v AS (SELECT ProductKey, ListPrice, unnest(range(1, 1 + 1 + (ProductKey % 4)::INTEGER))::INTEGER AS VersionNumber FROM products), d AS (SELECT *, CASE WHEN VersionNumber = 1 THEN 1.0::DOUBLE ELSE 0.95::DOUBLE + 0.15::DOUBLE * {u01_sql('ProductKey', 'VersionNumber', seed=16)} END AS f FROM v) SELECT ProductKey, VersionNumber, round(ListPrice::DOUBLE * exp(sum(ln(f)) OVER (PARTITION BY ProductKey ORDER BY VersionNumber ROWS UNBOUNDED PRECEDING)), 4) AS Price FROM d")
def price_revisions(spark, sf):
    rows = expand(S.products(spark, sf).select("ProductKey", "ListPrice", (1 + F.col("ProductKey") % 4).alias("n")), "n", "VersionNumber")
    drift = F.when(F.col("VersionNumber") == 1, 1.0).otherwise(0.95 + 0.15 * hash_u01(F.col("ProductKey"), F.col("VersionNumber"), seed=16))
    w = W.partitionBy("ProductKey").orderBy("VersionNumber").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("f", drift).select("ProductKey", "VersionNumber", F.round(F.col("ListPrice").cast("double") * F.exp(F.sum(F.ln("f")).over(w)), 4).alias("Price"))


@q("reason_weights_ontime", ", r AS (SELECT ReturnReasonKey, count(*)::DOUBLE AS w FROM returns GROUP BY 1), z AS (SELECT ReturnReasonKey, CASE WHEN ReturnReasonKey IN (2, 5) THEN 0 ELSE w END AS w FROM r) SELECT ReturnReasonKey, w / (SELECT sum(w) FROM z) AS Weight FROM z")
def reason_weights_ontime(spark, sf):
    rows = S.returns(S.sales(spark, sf)).groupBy("ReturnReasonKey").agg(F.count("*").cast("double").alias("n"))
    rows = rows.withColumn("w", F.when(F.col("ReturnReasonKey").isin(2, 5), 0.0).otherwise(F.col("n")))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("w").alias("t")))).select("ReturnReasonKey", (F.col("w") / F.col("t")).alias("Weight"))


@q("normalize_products", "SELECT p_partkey AS ProductKey, coalesce(try_cast(p_retailprice AS DOUBLE), 0) AS ListPrice, least(p_retailprice * 0.7::DOUBLE, coalesce(p_retailprice, 0)) AS UnitCost FROM part")
def normalize_products(spark, sf):
    """Legacy names, texts as numbers, nulls as 0, costs at most prices."""
    raw = S.read(spark, sf, "part", ["p_partkey", "p_retailprice"]).withColumn("p_retailprice", F.col("p_retailprice").cast("string"))
    price = F.coalesce(F.col("p_retailprice").try_cast("double"), F.lit(0.0))
    return raw.select(F.col("p_partkey").alias("ProductKey"), price.alias("ListPrice"), F.least(price * 0.7, price).alias("UnitCost"))


@q("remap_to_current", "SELECT CustomerKey, CustomerKey - CustomerKey % 5 + 4 AS CurrentKey FROM customers WHERE CustomerKey - CustomerKey % 5 + 4 IN (SELECT CustomerKey FROM customers)")
def remap_to_current(spark, sf):
    own = S.customers(spark, sf).select("CustomerKey", (F.col("CustomerKey") - F.col("CustomerKey") % 5).alias("id"))
    current = own.where("CustomerKey % 5 = 4").select("id", F.col("CustomerKey").alias("CurrentKey"))
    return own.join(current, "id").select("CustomerKey", "CurrentKey")


@q("warehouse_allocation", ", c AS (SELECT Country, count(*) AS n FROM stores GROUP BY 1) SELECT Country, n AS Stores, CASE WHEN n >= 6 THEN 'large' WHEN n >= 3 THEN 'medium' ELSE 'small' END AS Kind, CASE WHEN n >= 6 THEN ceil(n / 4.0::DOUBLE)::BIGINT ELSE 1 END AS Warehouses FROM c")
def warehouse_allocation(spark, sf):
    rows = S.stores(spark, sf).groupBy("Country").agg(F.count("*").alias("Stores"))
    n = F.col("Stores")
    return rows.select("Country", "Stores", F.when(n >= 6, "large").when(n >= 3, "medium").otherwise("small").alias("Kind"), F.when(n >= 6, F.ceil(n / 4.0)).otherwise(F.lit(1)).cast("bigint").alias("Warehouses"))


@q("allocate_total_by_customer", ", o AS (SELECT CustomerKey, count(DISTINCT OrderNumber)::BIGINT AS w FROM sales GROUP BY 1), a AS (SELECT *, 5000 * w / (sum(w) OVER ())::DOUBLE AS e FROM o), b AS (SELECT *, floor(round(e, 9))::BIGINT AS f, round(e - floor(round(e, 9)), 9) AS r FROM a) SELECT CustomerKey, f + CASE WHEN row_number() OVER (ORDER BY r DESC, CustomerKey) <= 5000 - sum(f) OVER () THEN 1 ELSE 0 END AS Lines FROM b")
def allocate_total_by_customer(spark, sf):
    """5000 lines over all customers by their orders: one group, spread by selection and not by a window."""
    own = S.sales(spark, sf).groupBy("CustomerKey").agg(F.countDistinct("OrderNumber").alias("w"))
    return allocate_by_remainder(own, F.col("w"), F.lit(5000), [], "CustomerKey", "Lines").select("CustomerKey", "Lines")


def _fitted_sql(per_order: int, name: str) -> str:
    """Lines moved to `per_order` times the orders, each in [1, 9]."""
    return f"""{name} AS (SELECT *, room * abs(lack) // nullif(all_room, 0) AS f, room * abs(lack) % nullif(all_room, 0) AS r FROM (
      SELECT *, sum(room) OVER ()::BIGINT AS all_room FROM (SELECT *, CASE WHEN lack > 0 THEN 9 - n ELSE n - 1 END AS room FROM (SELECT *, {per_order} * count(*) OVER () - (sum(n) OVER ())::BIGINT AS lack FROM o)))),
    {name}2 AS (SELECT OrderNumber, (n + sign(lack) * (coalesce(f, 0) + CASE WHEN r > 0 AND row_number() OVER (ORDER BY r DESC, OrderNumber) <= abs(lack) - sum(f) OVER () THEN 1 ELSE 0 END))::BIGINT AS {name} FROM {name})"""


@q("split_total_orders", f", o AS (SELECT OrderNumber, least(count(*), 9) AS n FROM sales GROUP BY 1), {_fitted_sql(6, 'More')}, {_fitted_sql(2, 'Fewer')} SELECT OrderNumber, n AS Lines, More, Fewer FROM o JOIN More2 USING (OrderNumber) JOIN Fewer2 USING (OrderNumber)")
def split_total_orders(spark, sf):
    """Lines per order moved to exactly six and exactly two lines an order in the mean, each in [1, 9]."""
    own = written(S.sales(spark, sf).groupBy("OrderNumber").agg(F.least(F.count("*"), F.lit(9)).alias("n")))
    orders = own.count()
    more = fit_total(own, "n", 6 * orders, 9, "OrderNumber", "More")
    return fit_total(more, "n", 2 * orders, 9, "OrderNumber", "Fewer").select("OrderNumber", F.col("n").alias("Lines"), "More", "Fewer")


@q("new_customer_promo", ", f AS (SELECT CustomerKey, min(OrderDate) AS f FROM sales GROUP BY 1) SELECT OrderNumber, OrderLineNumber, CASE WHEN OrderDate <= f + 30 THEN 99 WHEN PromotionKey = 11 THEN 1 ELSE PromotionKey END AS PromotionKey FROM sales JOIN f USING (CustomerKey)")
def new_customer_promo(spark, sf):
    lines = S.sales(spark, sf)
    first = lines.groupBy("CustomerKey").agg(F.min("OrderDate").alias("f"))
    key = F.when(F.col("OrderDate") <= F.date_add("f", 30), 99).when(F.col("PromotionKey") == 11, 1).otherwise(F.col("PromotionKey"))
    return lines.join(first, "CustomerKey").select("OrderNumber", "OrderLineNumber", key.alias("PromotionKey"))


@q("home_assignment", "SELECT EmployeeKey, (EmployeeKey - 30000000) // 10 AS StoreKey, greatest(min(OrderDate), DATE '1996-01-01') AS StartDate, least(max(OrderDate), DATE '2000-12-31') AS EndDate FROM sales GROUP BY 1, 2")
def home_assignment(spark, sf):
    own = S.sales(spark, sf).groupBy("EmployeeKey").agg(F.min("OrderDate").alias("a"), F.max("OrderDate").alias("b"))
    return own.select("EmployeeKey", F.floor((F.col("EmployeeKey") - 30_000_000) / 10).alias("StoreKey"), F.greatest("a", F.lit("1996-01-01").cast("date")).alias("StartDate"), F.least("b", F.lit("2000-12-31").cast("date")).alias("EndDate"))
