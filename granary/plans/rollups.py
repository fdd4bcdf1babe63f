"""Queries: views, aggregates, mixes, shares, top lists and measures."""

from pyspark.sql import functions as F

from granary.operators import rollups as R
from granary.operators.bitmaps import cells, counted, cube_sets, grouping_sets, merged
from granary.plans import star as S
from granary.plans.registry import register
from granary.plans.star import STAR

REV = "(Quantity * NetPrice)"


def q(name: str, sql: str):
    return register(name, STAR + sql)


@register("scan_table", "SELECT o_orderkey, o_custkey FROM orders")
def scan_table(spark, sf):
    return S.read(spark, sf, "orders", ["o_orderkey", "o_custkey", "not_there"])


@register("table_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in ("orders", "lineitem", "part", "customer", "supplier")))
def table_row_counts(spark, sf):
    from granary.sources.tables import row_counts

    return row_counts(spark, sf, ["orders", "lineitem", "part", "customer", "supplier"])


RETAIL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@register("resolve_table_path", "SELECT 'Orders' AS name, 'parquet' AS format, count(*) AS rows FROM orders UNION ALL SELECT 'lineitem', 'parquet', count(*) FROM lineitem UNION ALL SELECT 'absent', NULL, NULL")
def resolve_table_path(spark, sf):
    """The rows of what each name leads to; null for a name that leads nowhere."""
    from granary.sources.tables import resolve_table, row_counts

    names = ["Orders", "lineitem", "absent"]
    kinds = [(n, (resolve_table(spark, sf, n) or (None, None))[0]) for n in names]
    found = spark.createDataFrame(kinds, "name string, format string")
    return found.join(row_counts(spark, sf, names), F.col("name") == F.col("table")).select("name", "format", "rows")


@register("discover_tables", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", 'parquet' AS format, count(*) AS rows FROM {t}" for t in RETAIL))
def discover_tables(spark, sf):
    """The rows of each retail table that a listing of the folder finds."""
    from granary.sources.tables import discover_tables, row_counts

    found = discover_tables(spark, sf).where(F.col("table").isin(*RETAIL)).select("table", "format")
    return found.join(row_counts(spark, sf, list(RETAIL)), "table")


@register("preview_page", "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total_rows FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 50")
def preview_page(spark, sf):
    from granary.sources.tables import preview_page

    return preview_page(S.read(spark, sf, "orders", ["o_orderkey", "o_custkey"]), ["o_orderkey"], 50, 25)


@q("add_year_month", "SELECT OrderNumber, OrderLineNumber, year(OrderDate)::SMALLINT AS \"Year\", month(OrderDate)::SMALLINT AS \"Month\" FROM sales")
def add_year_month(spark, sf):
    from granary.sources.tables import add_year_month

    return add_year_month(S.sales(spark, sf)).select("OrderNumber", "OrderLineNumber", "Year", "Month")


@register("conform_schema", "SELECT p_partkey::INTEGER AS p_partkey, p_retailprice::DECIMAL(12,1)::DOUBLE AS price FROM (SELECT p_partkey, round_even(p_retailprice, 1) AS p_retailprice FROM part)")
def conform_schema(spark, sf):
    from pyspark.sql import types as T

    from granary.sources.tables import conform

    schema = T.StructType([T.StructField("p_partkey", T.IntegerType()), T.StructField("price", T.DecimalType(12, 1))])
    own = S.read(spark, sf, "part").select(F.col("p_retailprice").alias("price"), "p_partkey")
    return conform(own, schema).withColumn("price", F.col("price").cast("double"))


@register("project_schema", "SELECT n_nationkey, n_name, NULL::DOUBLE AS area FROM nation")
def project_schema(spark, sf):
    from pyspark.sql import types as T

    from granary.sources.tables import project

    return project(S.read(spark, sf, "nation"), T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("area", T.DoubleType())]))


@register("union_schema_merge", "SELECT c_custkey AS k, c_name AS name, NULL::BIGINT AS s FROM customer UNION ALL SELECT s_suppkey, NULL, s_suppkey FROM supplier")
def union_schema_merge(spark, sf):
    from granary.sources.tables import merge_by_name

    a = S.read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return merge_by_name([a, S.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_suppkey").alias("s"))])


@register("coerce_all_null", "SELECT r_regionkey, NULL::DATE AS opened FROM region")
def coerce_all_null(spark, sf):
    from pyspark.sql import types as T

    from granary.sources.tables import coerce_nulls

    return coerce_nulls(S.read(spark, sf, "region").select("r_regionkey", F.lit(None).alias("opened")), T.StructType([T.StructField("opened", T.DateType())]))


@register("normalize_dates", "SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders")
def normalize_dates(spark, sf):
    from granary.sources.tables import normalize_dates

    return normalize_dates(S.read(spark, sf, "orders", ["o_orderkey", "o_orderdate"]), ["o_orderdate"])


HEADER = "header AS (SELECT OrderNumber, min(CustomerKey) AS CustomerKey, min(PromotionKey) AS PromotionKey, min(CurrencyKey) AS CurrencyKey, min(ChannelKey) AS ChannelKey, min(OrderDate) AS OrderDate, min(TimeKey) AS TimeKey, bool_or(IsOrderDelayed) AS IsOrderDelayed FROM sales GROUP BY OrderNumber)"
DETAIL = ("OrderNumber", "OrderLineNumber", "ProductKey", "DueDate", "DeliveryDate", "Quantity", "UnitPrice", "NetPrice", "UnitCost", "DiscountAmount", "DeliveryStatus")


@q("header_from_detail", f", {HEADER} SELECT * FROM header")
def header_from_detail(spark, sf):
    return R.header_from_detail(S.sales(spark, sf))


@q("view_sales_flat", f", {HEADER} SELECT s.OrderNumber, s.OrderLineNumber, h.CustomerKey, h.OrderDate, s.ProductKey, s.Quantity, s.NetPrice::DOUBLE AS NetPrice, h.IsOrderDelayed FROM sales s JOIN header h USING (OrderNumber)")
def view_sales_flat(spark, sf):
    lines = S.sales(spark, sf)
    header = R.header_from_detail(lines)
    return lines.select(*DETAIL).join(header, "OrderNumber").select("OrderNumber", "OrderLineNumber", "CustomerKey", "OrderDate", "ProductKey", "Quantity", F.col("NetPrice").cast("double").alias("NetPrice"), "IsOrderDelayed")


@q("view_sales_direct", "SELECT OrderNumber, OrderLineNumber, CustomerKey, ProductKey, StoreKey, OrderDate, Quantity, UnitPrice::DOUBLE AS UnitPrice, NetPrice::DOUBLE AS NetPrice FROM sales")
def view_sales_direct(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "CustomerKey", "ProductKey", "StoreKey", "OrderDate", "Quantity", F.col("UnitPrice").cast("double").alias("UnitPrice"), F.col("NetPrice").cast("double").alias("NetPrice"))


@q("view_header", f", {HEADER} SELECT OrderNumber, CustomerKey, OrderDate FROM header")
def view_header(spark, sf):
    return R.header_from_detail(S.sales(spark, sf)).select("OrderNumber", "CustomerKey", "OrderDate")


@q("view_detail", "SELECT OrderNumber, OrderLineNumber, ProductKey, Quantity, UnitCost::DOUBLE AS UnitCost FROM sales")
def view_detail(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "ProductKey", "Quantity", F.col("UnitCost").cast("double").alias("UnitCost"))


@q("view_returns", "SELECT OrderNumber, OrderLineNumber, ReturnDate, ReturnReasonKey, ReturnQuantity, ReturnNetPrice::DOUBLE AS ReturnNetPrice FROM returns")
def view_returns(spark, sf):
    return S.returns(S.sales(spark, sf)).withColumn("ReturnNetPrice", F.col("ReturnNetPrice").cast("double"))


@register("view_passthrough", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def view_passthrough(spark, sf):
    names = [n for n in ("nation", "region", "absent") if (df := S.scan_table(spark, sf, n)) is not None and df.createOrReplaceTempView(f"v_{n}") is None]
    return spark.sql(f"SELECT n_name, r_name FROM v_{names[0]} JOIN v_{names[1]} ON n_regionkey = r_regionkey")


@q("drop_order_cols", "SELECT CustomerKey, ProductKey, OrderDate, Quantity FROM sales")
def drop_order_cols(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "CustomerKey", "ProductKey", "OrderDate", "Quantity").drop("OrderNumber", "OrderLineNumber")


@q("split_sales_header_detail", f", {HEADER} SELECT 'header' AS part, count(*) AS rows, count(DISTINCT OrderNumber) AS orders FROM header UNION ALL SELECT 'detail', count(*), count(DISTINCT OrderNumber) FROM sales")
def split_sales_header_detail(spark, sf):
    lines = S.sales(spark, sf)
    count = lambda df, n: df.agg(F.count("*").alias("rows"), F.countDistinct("OrderNumber").alias("orders")).select(F.lit(n).alias("part"), "rows", "orders")
    return count(R.header_from_detail(lines), "header").union(count(lines.select(*DETAIL), "detail"))


@q("split_core_profile", "SELECT ProductKey, ProductName, Brand, Category, Size FROM products")
def split_core_profile(spark, sf):
    from granary.sources.tables import split_columns

    core, rest = split_columns(S.products(spark, sf), ["ProductKey", "ProductName", "Brand"], ["ProductKey"])
    return core.join(rest.select("ProductKey", "Category", "Size"), "ProductKey")


@q("check_order_invariants", "SELECT OrderNumber, concat_ws(',', CASE WHEN min(CustomerKey) <> max(CustomerKey) THEN 'CustomerKey' END, CASE WHEN min(StoreKey) <> max(StoreKey) THEN 'StoreKey' END) AS \"Columns\" FROM sales GROUP BY OrderNumber HAVING min(CustomerKey) <> max(CustomerKey) OR min(StoreKey) <> max(StoreKey)")
def check_order_invariants(spark, sf):
    return R.invariant_violations(S.sales(spark, sf), ["CustomerKey", "StoreKey"])


@q("monthly_sales", f"SELECT year(OrderDate) AS \"Year\", month(OrderDate) AS \"Month\", count(*) AS Lines, count(DISTINCT OrderNumber) AS Orders, sum{REV}::DOUBLE AS Revenue, sum{REV}::DOUBLE / count(*) AS MeanLine FROM sales GROUP BY 1, 2")
def monthly_sales(spark, sf):
    return R.monthly_sales(S.sales(spark, sf))


@q("yearly_sales", f"SELECT year(OrderDate) AS \"Year\", count(*) AS Lines, count(DISTINCT OrderNumber) AS Orders, sum{REV}::DOUBLE AS Revenue FROM sales GROUP BY 1")
def yearly_sales(spark, sf):
    return R.yearly_sales(S.sales(spark, sf))


@q("lines_per_order", "SELECT n AS LinesInOrder, count(*) AS Keys FROM (SELECT count(*) AS n FROM sales GROUP BY OrderNumber) GROUP BY n")
def lines_per_order(spark, sf):
    return R.histogram_of_counts(S.sales(spark, sf), "OrderNumber", "LinesInOrder")


def mixes(name: str, expr: str, sql_expr: str | None = None):
    @q(name, f"SELECT {sql_expr or expr} AS Value, count(*) AS \"Rows\", count(*)::DOUBLE / (SELECT count(*) FROM sales) AS Share FROM sales GROUP BY 1")
    def run(spark, sf):
        return R.mix(S.sales(spark, sf), F.expr(expr), "Value")

    return run


mixes("price_bands", "CASE WHEN UnitPrice <= 500 THEN 'to 500' WHEN UnitPrice <= 1000 THEN 'to 1000' WHEN UnitPrice <= 2000 THEN 'to 2000' ELSE 'above' END")
mixes("quantity_bands", "CASE WHEN Quantity <= 1 THEN '1' WHEN Quantity <= 5 THEN '2-5' WHEN Quantity <= 20 THEN '6-20' ELSE 'above 20' END")
mixes("delivery_status_mix", "DeliveryStatus")
mixes("category_mix", "ReturnFlag")
mixes("margin_category", "CASE WHEN (NetPrice - UnitCost) < NetPrice * 0.2 THEN 'low' WHEN (NetPrice - UnitCost) < NetPrice * 0.3 THEN 'medium' WHEN (NetPrice - UnitCost) < NetPrice * 0.4 THEN 'high' ELSE 'very high' END")
mixes("channel_type", "CASE WHEN ChannelKey = 1 THEN 'Physical' WHEN ChannelKey IN (2, 3) THEN 'Digital' WHEN ChannelKey = 4 THEN 'B2B' ELSE 'Other' END")
mixes("promo_channel_group", "CASE WHEN PromotionKey IN (1, 2, 3) THEN 'any' WHEN PromotionKey IN (4, 5, 6) THEN 'physical' ELSE 'digital' END")


@q("return_lag_bands", "SELECT CASE WHEN ReturnDate - OrderDate <= 7 THEN '0-7' WHEN ReturnDate - OrderDate <= 30 THEN '8-30' WHEN ReturnDate - OrderDate <= 60 THEN '31-60' ELSE 'above' END AS Band, count(*) AS \"Rows\", count(*)::DOUBLE / (SELECT count(*) FROM returns) AS Share FROM returns JOIN sales USING (OrderNumber, OrderLineNumber) GROUP BY 1")
def return_lag_bands(spark, sf):
    lines = S.sales(spark, sf)
    lag = S.returns(lines).join(lines.select("OrderNumber", "OrderLineNumber", "OrderDate"), ["OrderNumber", "OrderLineNumber"])
    return R.mix(lag, R.band(F.datediff("ReturnDate", "OrderDate"), [(7, "0-7"), (30, "8-30"), (60, "31-60")], "above"), "Band")


@q("discount_usage", "SELECT DiscountAmount > 0 AS Discounted, count(*) AS Lines, (sum(DiscountAmount)::DOUBLE / nullif(count(CASE WHEN DiscountAmount > 0 THEN 1 END), 0)) AS MeanDiscount FROM sales GROUP BY 1")
def discount_usage(spark, sf):
    used = F.count(F.when(F.col("DiscountAmount") > 0, 1))
    return S.sales(spark, sf).groupBy((F.col("DiscountAmount") > 0).alias("Discounted")).agg(F.count("*").alias("Lines"), R.ratio(F.sum("DiscountAmount"), used).alias("MeanDiscount"))


@q("delayed_rate", f", {HEADER} SELECT count(*) AS \"Rows\", count(CASE WHEN IsOrderDelayed THEN 1 END) AS Met, count(CASE WHEN IsOrderDelayed THEN 1 END)::DOUBLE / count(*) AS Rate FROM header")
def delayed_rate(spark, sf):
    return R.share_of(R.header_from_detail(S.sales(spark, sf)), F.col("IsOrderDelayed"))


@q("return_rate", "SELECT (SELECT count(DISTINCT OrderNumber) FROM returns) AS Returned, (SELECT count(DISTINCT OrderNumber) FROM sales) AS Orders, (SELECT count(DISTINCT OrderNumber) FROM returns)::DOUBLE / (SELECT count(DISTINCT OrderNumber) FROM sales) AS Rate")
def return_rate(spark, sf):
    lines = S.sales(spark, sf)
    one = S.returns(lines).agg(F.countDistinct("OrderNumber").alias("Returned"))
    return one.crossJoin(lines.agg(F.countDistinct("OrderNumber").alias("Orders"))).withColumn("Rate", R.ratio(F.col("Returned"), F.col("Orders")))


@q("return_reasons_mix", "SELECT ReturnReasonKey AS Value, count(*) AS \"Rows\", count(*)::DOUBLE / (SELECT count(*) FROM returns) AS Share FROM returns GROUP BY 1")
def return_reasons_mix(spark, sf):
    return R.mix(S.returns(S.sales(spark, sf)), "ReturnReasonKey", "Value")


@q("monthly_cov", "SELECT round(stddev_samp(n) / avg(n), 9) AS Cov FROM (SELECT count(*) AS n FROM sales GROUP BY date_trunc('month', OrderDate))")
def monthly_cov(spark, sf):
    return R.monthly_cov(S.sales(spark, sf))


@q("share_of_total", f"SELECT StoreKey, sum{REV}::DOUBLE AS Amount, sum{REV}::DOUBLE / (SELECT sum{REV}::DOUBLE FROM sales) AS Share FROM sales GROUP BY StoreKey")
def share_of_total(spark, sf):
    return R.share_of_total(S.sales(spark, sf), "StoreKey", R.revenue())


@q("channel_store_mix", "SELECT StoreType, ChannelKey, count(*) AS \"Rows\", count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY StoreType) AS Share FROM sales JOIN stores USING (StoreKey) GROUP BY 1, 2")
def channel_store_mix(spark, sf):
    return R.mix(R.star(S.sales(spark, sf), {"StoreKey": S.stores(spark, sf)}), "ChannelKey", "ChannelKey", ["StoreType"])


@q("share_within", "SELECT Category, Brand, count(*) AS \"Rows\", count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY Category) AS Share FROM sales JOIN products USING (ProductKey) GROUP BY 1, 2")
def share_within(spark, sf):
    return R.mix(R.star(S.sales(spark, sf), {"ProductKey": S.products(spark, sf)}), "Brand", "Brand", ["Category"])


@q("marketplace_at_convenience", "SELECT count(CASE WHEN StoreType = 'Convenience' AND ChannelKey = 3 THEN 1 END) AS Met, count(*) AS \"Rows\" FROM sales JOIN stores USING (StoreKey)")
def marketplace_at_convenience(spark, sf):
    rows = R.star(S.sales(spark, sf), {"StoreKey": S.stores(spark, sf)})
    return R.share_of(rows, F.expr("StoreType = 'Convenience' AND ChannelKey = 3")).select("Met", "Rows")


@q("physical_share", "SELECT StoreType, count(*) AS \"Rows\", count(CASE WHEN ChannelKey = 1 THEN 1 END) AS Met, count(CASE WHEN ChannelKey = 1 THEN 1 END)::DOUBLE / count(*) AS Rate FROM sales JOIN stores USING (StoreKey) GROUP BY 1")
def physical_share(spark, sf):
    return R.share_of(R.star(S.sales(spark, sf), {"StoreKey": S.stores(spark, sf)}), F.col("ChannelKey") == 1, ["StoreType"])


def _two_countries(spark, sf):
    lines = R.star(S.sales(spark, sf), {"StoreKey": S.stores(spark, sf).select("StoreKey", F.col("Country").alias("StoreCountry"))})
    return R.star(lines, {"CustomerKey": S.customers(spark, sf).select("CustomerKey", F.col("Country").alias("CustomerCountry"))})


TWO = ", two AS (SELECT s.*, st.Country AS StoreCountry, c.Country AS CustomerCountry FROM sales s JOIN stores st USING (StoreKey) JOIN customers c USING (CustomerKey)) "


@q("local_purchase_rate", TWO + "SELECT CustomerCountry, count(*) AS \"Rows\", count(CASE WHEN StoreCountry = CustomerCountry THEN 1 END) AS Met, count(CASE WHEN StoreCountry = CustomerCountry THEN 1 END)::DOUBLE / count(*) AS Rate FROM two GROUP BY 1")
def local_purchase_rate(spark, sf):
    return R.share_of(_two_countries(spark, sf), F.col("StoreCountry") == F.col("CustomerCountry"), ["CustomerCountry"])


@q("join_role_playing", TWO + "SELECT StoreCountry, CustomerCountry, count(*) AS Lines FROM two GROUP BY 1, 2")
def join_role_playing(spark, sf):
    return _two_countries(spark, sf).groupBy("StoreCountry", "CustomerCountry").agg(F.count("*").alias("Lines"))


@q("top_country_pairs", TWO + "SELECT StoreCountry, CustomerCountry, CASE WHEN StoreCountry = CustomerCountry THEN 'MATCH' ELSE 'CROSS' END AS Kind, count(*) AS Lines FROM two GROUP BY 1, 2, 3 ORDER BY Lines DESC, 1, 2 LIMIT 20")
def top_country_pairs(spark, sf):
    kind = F.when(F.col("StoreCountry") == F.col("CustomerCountry"), "MATCH").otherwise("CROSS")
    return _two_countries(spark, sf).groupBy("StoreCountry", "CustomerCountry", kind.alias("Kind")).agg(F.count("*").alias("Lines")).orderBy(F.desc("Lines"), "StoreCountry", "CustomerCountry").limit(20)


@q("join_star", f"SELECT Region, Category, Segment, sum{REV}::DOUBLE AS Revenue FROM sales JOIN (SELECT StoreKey, Region FROM stores) USING (StoreKey) JOIN (SELECT ProductKey, Category FROM products) USING (ProductKey) JOIN (SELECT CustomerKey, Segment FROM customers) USING (CustomerKey) GROUP BY 1, 2, 3")
def join_star(spark, sf):
    dims = {"StoreKey": S.stores(spark, sf).select("StoreKey", "Region"), "ProductKey": S.products(spark, sf).select("ProductKey", "Category"), "CustomerKey": S.customers(spark, sf).select("CustomerKey", "Segment")}
    return R.star(S.sales(spark, sf), dims).groupBy("Region", "Category", "Segment").agg(R.total(R.revenue()).alias("Revenue"))


@q("join_currency_fallback", "SELECT GeographyKey, Country, coalesce(CASE WHEN GeographyKey < 20 THEN GeographyKey + 100 END, 1)::INTEGER AS CurrencyKey FROM geography")
def join_currency_fallback(spark, sf):
    geo = S.geography(spark, sf)
    codes = geo.where("GeographyKey < 20").select("GeographyKey", (F.col("GeographyKey") + 100).alias("CurrencyKey"))
    return R.with_default_key(geo, codes, "GeographyKey", "CurrencyKey", 1).select("GeographyKey", "Country", "CurrencyKey")


@q("due_days_by_channel", "SELECT ChannelKey, avg(DueDate - OrderDate) AS MeanDays, min(DueDate - OrderDate)::INTEGER AS MinDays, max(DueDate - OrderDate)::INTEGER AS MaxDays FROM sales GROUP BY 1")
def due_days_by_channel(spark, sf):
    days = F.datediff("DueDate", "OrderDate")
    return S.sales(spark, sf).groupBy("ChannelKey").agg(F.avg(days).alias("MeanDays"), F.min(days).alias("MinDays"), F.max(days).alias("MaxDays"))


@q("due_days_histogram", "SELECT ChannelKey, (DeliveryDate - OrderDate)::INTEGER AS Days, count(*) AS Lines FROM sales GROUP BY 1, 2")
def due_days_histogram(spark, sf):
    return S.sales(spark, sf).groupBy("ChannelKey", F.datediff("DeliveryDate", "OrderDate").alias("Days")).agg(F.count("*").alias("Lines"))


@q("same_day_by_channel", "SELECT ChannelKey, count(*) AS Lines FROM sales WHERE DeliveryDate = OrderDate GROUP BY 1")
def same_day_by_channel(spark, sf):
    return S.sales(spark, sf).where("DeliveryDate = OrderDate").groupBy("ChannelKey").agg(F.count("*").alias("Lines"))


@q("eligibility_rate", "SELECT ChannelKey, count(*) AS \"Rows\", count(CASE WHEN CASE WHEN ChannelKey = 1 THEN EligibleStore ELSE EligibleOnline END THEN 1 END) AS Met, count(CASE WHEN CASE WHEN ChannelKey = 1 THEN EligibleStore ELSE EligibleOnline END THEN 1 END)::DOUBLE / count(*) AS Rate FROM sales JOIN products USING (ProductKey) GROUP BY 1")
def eligibility_rate(spark, sf):
    rows = R.star(S.sales(spark, sf), {"ProductKey": S.products(spark, sf)})
    return R.share_of(rows, F.when(F.col("ChannelKey") == 1, F.col("EligibleStore")).otherwise(F.col("EligibleOnline")), ["ChannelKey"])


@q("promo_channel_alignment", "SELECT CASE WHEN PromotionKey <= 3 THEN 'any' WHEN PromotionKey <= 6 THEN 'physical' ELSE 'digital' END AS PromoGroup, CASE WHEN ChannelKey = 1 THEN 'Physical' ELSE 'Digital' END AS ChannelGroup, count(*) AS Lines FROM sales GROUP BY 1, 2")
def promo_channel_alignment(spark, sf):
    group = R.band(F.col("PromotionKey"), [(3, "any"), (6, "physical")], "digital")
    return S.sales(spark, sf).groupBy(group.alias("PromoGroup"), F.when(F.col("ChannelKey") == 1, "Physical").otherwise("Digital").alias("ChannelGroup")).agg(F.count("*").alias("Lines"))


@q("participation_rate", "SELECT (SELECT count(DISTINCT CustomerKey) FROM sales) AS Participants, (SELECT count(*) FROM customers) AS Everyone, (SELECT count(DISTINCT CustomerKey) FROM sales)::DOUBLE / (SELECT count(*) FROM customers) AS Rate")
def participation_rate(spark, sf):
    return R.participation(S.sales(spark, sf), S.customers(spark, sf), "CustomerKey")


@q("items_per_customer", "SELECT sum(n)::DOUBLE / count(*) AS MeanItems, min(n) AS MinItems, max(n) AS MaxItems FROM (SELECT count(DISTINCT ProductKey) AS n FROM sales GROUP BY CustomerKey)")
def items_per_customer(spark, sf):
    return R.per_key_stats(S.sales(spark, sf), "CustomerKey", "ProductKey")


@q("repeat_rate", "SELECT count(*) AS Keys, count(CASE WHEN n > 1 THEN 1 END) AS Repeated, count(CASE WHEN n > 1 THEN 1 END)::DOUBLE / count(*) AS Rate FROM (SELECT count(*) AS n FROM returns GROUP BY OrderNumber)")
def repeat_rate(spark, sf):
    return R.repeat_rate(S.returns(S.sales(spark, sf)), "OrderNumber")


@q("resolution_rate", "SELECT count(*) AS \"Rows\", count(CASE WHEN ReturnReasonKey <= 5 THEN 1 END) AS Met, count(CASE WHEN ReturnReasonKey <= 5 THEN 1 END)::DOUBLE / count(*) AS Rate FROM returns")
def resolution_rate(spark, sf):
    complaints = S.returns(S.sales(spark, sf)).withColumn("ResolutionDate", F.when(F.col("ReturnReasonKey") <= 5, F.col("ReturnDate")))
    return R.share_of(complaints, F.col("ResolutionDate").isNotNull())


@q("distribution_summary", "SELECT 'Quantity' AS \"Column\", min(Quantity)::DOUBLE AS \"Min\", max(Quantity)::DOUBLE AS \"Max\", round(avg(Quantity::DOUBLE), 6) AS Mean, quantile_cont(Quantity::DOUBLE, 0.5) AS Median, round(stddev_samp(Quantity::DOUBLE), 6) AS Std FROM sales UNION ALL SELECT 'NetPrice', min(NetPrice)::DOUBLE, max(NetPrice)::DOUBLE, round(avg(NetPrice::DOUBLE), 6), quantile_cont(NetPrice::DOUBLE, 0.5), round(stddev_samp(NetPrice::DOUBLE), 6) FROM sales")
def distribution_summary(spark, sf):
    return R.summary(S.sales(spark, sf), ["Quantity", "NetPrice"]).withColumns({"Mean": F.round("Mean", 6), "Std": F.round("Std", 6)})


@q("group_size_summary", "SELECT min(n) AS MinRows, max(n) AS MaxRows, sum(n)::DOUBLE / count(*) AS MeanRows FROM (SELECT count(*) AS n FROM sales GROUP BY CustomerKey)")
def group_size_summary(spark, sf):
    return R.group_sizes(S.sales(spark, sf), "CustomerKey")


@q("monthly_distinct_customers", "SELECT year(OrderDate) AS \"Year\", month(OrderDate) AS \"Month\", count(DISTINCT CustomerKey) AS Customers FROM sales GROUP BY 1, 2")
def monthly_distinct_customers(spark, sf):
    return S.sales(spark, sf).groupBy(F.year("OrderDate").alias("Year"), F.month("OrderDate").alias("Month")).agg(F.countDistinct("CustomerKey").alias("Customers"))


@register("table_digest", "SELECT count(*) AS \"Rows\", sum(('0x' || substr(md5(n_name || '|' || n_nationkey || '|' || n_regionkey), 1, 8))::BIGINT)::BIGINT AS Digest FROM nation")
def table_digest(spark, sf):
    return R.digest(S.read(spark, sf, "nation"))


@q("distinct_purchases", "SELECT DISTINCT CustomerKey, ProductKey FROM sales")
def distinct_purchases(spark, sf):
    return S.sales(spark, sf).select("CustomerKey", "ProductKey").distinct()


@q("distinct_order_lines", "SELECT DISTINCT CustomerKey, OrderNumber, OrderLineNumber FROM sales")
def distinct_order_lines(spark, sf):
    return S.sales(spark, sf).select("CustomerKey", "OrderNumber", "OrderLineNumber").distinct()


@q("merge_partials", "SELECT ProductKey, sum(Quantity)::BIGINT AS Quantity FROM sales GROUP BY 1")
def merge_partials(spark, sf):
    lines = S.sales(spark, sf)
    parts = lines.groupBy("ProductKey", "ChannelKey").agg(F.sum("Quantity").alias("Quantity"))
    return R.merge_partials(parts, ["ProductKey"], ["Quantity"])


@q("distinct_values", "SELECT DISTINCT CurrencyKey FROM sales")
def distinct_values(spark, sf):
    return S.sales(spark, sf).select("CurrencyKey").distinct()


def tops(name: str, key: str, measure: str):
    @q(name, f"SELECT {key}, sum({measure})::DOUBLE AS Amount FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
    def run(spark, sf):
        return R.top_k(S.sales(spark, sf), key, F.expr(measure), 10)

    return run


tops("top_customers", "CustomerKey", "Quantity * NetPrice")
tops("top_products", "ProductKey", "Quantity")
tops("top_stores", "StoreKey", "Quantity * NetPrice")

_MEASURES = {
    "m_sales_amount": ("SalesAmount", f"sum{REV}::DOUBLE"),
    "m_cost_amount": ("CostAmount", "sum(Quantity * UnitCost)::DOUBLE"),
    "m_profit_amount": ("ProfitAmount", f"(sum{REV} - sum(Quantity * UnitCost))::DOUBLE"),
    "m_transactions": ("Transactions", "count(*)"),
    "m_customers": ("Customers", "count(DISTINCT CustomerKey)"),
    "m_order_vs_delivery": ("OrderVsDelivery", "sum(DeliveryDate - OrderDate)::BIGINT"),
    "m_due_vs_delivery": ("DueVsDelivery", "sum(DeliveryDate - DueDate)::BIGINT"),
    "m_avg_delivery_lag": ("AvgDeliveryLag", "sum(DeliveryDate - OrderDate)::DOUBLE / count(*)"),
}


def _measure(name: str, column: str, sql: str):
    @q(name, f'SELECT year(OrderDate) AS "Year", ChannelKey, {sql} AS {column} FROM sales GROUP BY 1, 2')
    def run(spark, sf):
        return R.measures(S.sales(spark, sf), ["Year", "ChannelKey"]).select("Year", "ChannelKey", column)


for _name, (_column, _sql) in _MEASURES.items():
    _measure(_name, _column, _sql)


@q("m_role_playing_date", f'SELECT year(DeliveryDate) AS "Year", month(DeliveryDate) AS "Month", sum{REV}::DOUBLE AS SalesAmount FROM sales GROUP BY 1, 2')
def m_role_playing_date(spark, sf):
    return R.measures(S.sales(spark, sf), ["Year", "Month"], "DeliveryDate").select("Year", "Month", "SalesAmount")


def _list_price(name: str, f, column: str, sql: str):
    @q(name, f"SELECT Category, {sql}(ListPrice)::DOUBLE AS {column} FROM products GROUP BY 1")
    def run(spark, sf):
        return S.products(spark, sf).groupBy("Category").agg(f("ListPrice").cast("double").alias(column))


_list_price("m_min_list_price", F.min, "MinListPrice", "min")
_list_price("m_max_list_price", F.max, "MaxListPrice", "max")


@q("m_new_customers", 'SELECT year(d) AS "Year", month(d) AS "Month", count(*) AS NewCustomers FROM (SELECT CustomerKey, min(OrderDate) AS d FROM sales GROUP BY 1) GROUP BY 1, 2')
def m_new_customers(spark, sf):
    lines = S.sales(spark, sf).withColumns({"Year": F.year("OrderDate"), "Month": F.month("OrderDate")})
    return R.new_customers(lines, ["Year", "Month"])


MATRIX = f"sum{REV}::DOUBLE AS SalesAmount, sum(Quantity * UnitCost)::DOUBLE AS CostAmount, (sum{REV} - sum(Quantity * UnitCost))::DOUBLE AS ProfitAmount, count(*) AS Transactions, count(DISTINCT CustomerKey) AS Customers"


@q("m_matrix_category_brand", f"SELECT Category, Brand, grouping(Category, Brand)::BIGINT AS Level, {MATRIX} FROM sales JOIN products USING (ProductKey) GROUP BY ROLLUP (Category, Brand)")
def m_matrix_category_brand(spark, sf):
    return R.matrix(R.star(S.sales(spark, sf), {"ProductKey": S.products(spark, sf)}), ["Category", "Brand"])


@q("m_matrix_year_month", f'SELECT y AS "Year", m AS "Month", grouping(y, m)::BIGINT AS Level, {MATRIX} FROM (SELECT *, year(OrderDate) AS y, month(OrderDate) AS m FROM sales) GROUP BY ROLLUP (y, m)')
def m_matrix_year_month(spark, sf):
    return R.matrix(S.sales(spark, sf).withColumns({"Year": F.year("OrderDate"), "Month": F.month("OrderDate")}), ["Year", "Month"])


@q("m_cube_customers", 'SELECT y AS "Year", ChannelKey, CurrencyKey, grouping(y, ChannelKey, CurrencyKey)::BIGINT AS Level, sum(Quantity)::BIGINT AS Quantity, count(DISTINCT CustomerKey) AS Customers FROM (SELECT *, year(OrderDate) AS y FROM sales) GROUP BY CUBE (y, ChannelKey, CurrencyKey)')
def m_cube_customers(spark, sf):
    """Distinct customers of every combination of three levels, merged from the finest."""
    levels = ["Year", "ChannelKey", "CurrencyKey"]
    return grouping_sets(S.sales(spark, sf).withColumn("Year", F.year("OrderDate")), levels, cube_sets(levels), "CustomerKey", "Customers", Quantity=F.sum("Quantity"))


@q("merge_distinct_partials", 'SELECT ProductKey, sum(Quantity)::BIGINT AS Quantity, count(DISTINCT CustomerKey) AS Customers FROM sales GROUP BY 1')
def merge_distinct_partials(spark, sf):
    """Each year's cells are made alone, and merged as later loads come: customers of several years count once."""
    lines = S.sales(spark, sf)
    years = [lines.where(F.year("OrderDate") % 2 == n) for n in (0, 1)]
    first, second = (cells(part, ["ProductKey"], "CustomerKey", Quantity=F.sum("Quantity")) for part in years)
    return counted(merged(first.unionByName(second), ["ProductKey"], ["Quantity"]), ["ProductKey"], ["Quantity"], "Customers")


BOUNDS = [("orders", "o_orderkey"), ("orders", "o_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_partkey"), ("part", "p_partkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey")]


@register("key_bounds", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", min({c})::BIGINT AS lowest, max({c})::BIGINT AS highest, count({c}) AS filled FROM {t}" for t, c in BOUNDS))
def key_bounds(spark, sf):
    """Least and greatest keys, from the tables' footers: no row is read."""
    from granary.sources.tables import footer_bounds

    return footer_bounds(spark, sf, BOUNDS)
