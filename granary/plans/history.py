"""Queries: keys and ranks, versions and intervals, calendars' neighbours, sets."""

from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01, u01_sql
from granary.operators import intervals as I
from granary.operators import ordered as O
from granary.operators import rollups as R
from granary.plans import star as S
from granary.plans.registry import register
from granary.plans.star import STAR


def q(name: str, sql: str):
    return register(name, STAR + sql)


ORDERS = ", orders1 AS (SELECT OrderNumber, min(OrderDate) AS OrderDate, min(CustomerKey) AS CustomerKey FROM sales GROUP BY 1)"


def orders(spark, sf):
    return S.sales(spark, sf).groupBy("OrderNumber").agg(F.min("OrderDate").alias("OrderDate"), F.min("CustomerKey").alias("CustomerKey"))


@q("dense_surrogate_key", "SELECT CustomerKey, Country, row_number() OVER (ORDER BY Country, CustomerKey) AS Key FROM customers")
def dense_surrogate_key(spark, sf):
    return O.dense_surrogate_key(S.customers(spark, sf).select("CustomerKey", "Country"), ["Country", "CustomerKey"], "Key")


@q("sequence_within", "SELECT OrderNumber, ProductKey, OrderLineNumber, row_number() OVER (PARTITION BY ProductKey ORDER BY OrderNumber, OrderLineNumber)::INTEGER AS Seq FROM sales")
def sequence_within(spark, sf):
    return O.sequence_within(S.sales(spark, sf).select("OrderNumber", "ProductKey", "OrderLineNumber"), ["ProductKey"], ["OrderNumber", "OrderLineNumber"], "Seq")


@q("within_day_rank", ORDERS + " SELECT *, (row_number() OVER (PARTITION BY OrderDate ORDER BY OrderNumber) - 1)::INTEGER AS DayRank FROM orders1")
def within_day_rank(spark, sf):
    return O.sequence_within(orders(spark, sf), ["OrderDate"], ["OrderNumber"], "DayRank", 0)


@q("day_banded_order_id", ORDERS + " SELECT *, date_diff('day', DATE '1990-01-01', OrderDate) * 100000 + row_number() OVER (PARTITION BY OrderDate ORDER BY OrderNumber) - 1 AS OrderId FROM orders1")
def day_banded_order_id(spark, sf):
    return O.day_banded_order_id(orders(spark, sf), 100_000)


@q("latest_is_primary", ORDERS + " SELECT *, row_number() OVER (PARTITION BY CustomerKey ORDER BY OrderDate DESC, OrderNumber DESC) = 1 AS IsPrimary FROM orders1")
def latest_is_primary(spark, sf):
    return O.mark_latest(orders(spark, sf), ["CustomerKey"], [F.desc("OrderDate"), F.desc("OrderNumber")])


@q("order_any_delayed", "SELECT OrderNumber, OrderLineNumber, bool_or(IsOrderDelayed) OVER (PARTITION BY OrderNumber) AS AnyDelayed FROM sales")
def order_any_delayed(spark, sf):
    from pyspark.sql import Window as W

    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", F.bool_or("IsOrderDelayed").over(W.partitionBy("OrderNumber")).alias("AnyDelayed"))


DEMAND = ', demand AS (SELECT ProductKey, WarehouseKey, year(OrderDate) AS "Year", month(OrderDate) AS "Month", sum(Quantity)::BIGINT AS QuantitySold FROM sales JOIN stores USING (StoreKey) GROUP BY 1, 2, 3, 4)'


def demand(spark, sf):
    rows = R.star(S.sales(spark, sf), {"StoreKey": S.stores(spark, sf).select("StoreKey", "WarehouseKey")})
    return rows.groupBy("ProductKey", "WarehouseKey", F.year("OrderDate").alias("Year"), F.month("OrderDate").alias("Month")).agg(F.sum("Quantity").alias("QuantitySold"))


@q("agg_demand", DEMAND + " SELECT * FROM demand")
def agg_demand(spark, sf):
    return demand(spark, sf)


@q("abc_classify", DEMAND + ", s AS (SELECT ProductKey, sum(QuantitySold)::BIGINT AS Sold FROM demand GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY Sold DESC, ProductKey) AS k, count(*) OVER () AS n FROM s) SELECT p.ProductKey, coalesce(Sold, 0) AS Sold, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'A' WHEN k <= floor(n * 0.5::DOUBLE) THEN 'B' ELSE 'C' END AS Class FROM products p LEFT JOIN r USING (ProductKey)")
def abc_classify(spark, sf):
    return O.abc_classify(demand(spark, sf), S.products(spark, sf))


@q("abc_mix", DEMAND + ", s AS (SELECT ProductKey, sum(QuantitySold) AS Sold FROM demand GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY Sold DESC, ProductKey) AS k, count(*) OVER () AS n FROM s) SELECT CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'A' WHEN k <= floor(n * 0.5::DOUBLE) THEN 'B' ELSE 'C' END AS Class, count(*) AS Products FROM products p LEFT JOIN r USING (ProductKey) GROUP BY 1")
def abc_mix(spark, sf):
    return O.abc_classify(demand(spark, sf), S.products(spark, sf)).groupBy("Class").agg(F.count("*").alias("Products"))


@q("rank_thirds", "SELECT ProductKey, Category, CASE WHEN k <= floor(n * (1 / 3.0::DOUBLE)) THEN 'Value' WHEN k <= floor(n * (2 / 3.0::DOUBLE)) THEN 'Mainstream' ELSE 'Premium' END AS Tier FROM (SELECT *, row_number() OVER (PARTITION BY Category ORDER BY ListPrice, ProductKey) AS k, count(*) OVER (PARTITION BY Category) AS n FROM products)")
def rank_thirds(spark, sf):
    own = S.products(spark, sf).select("ProductKey", "Category", "ListPrice")
    return O.ranked_classes(own, [F.asc("ListPrice"), F.asc("ProductKey")], [(1 / 3, "Value"), (2 / 3, "Mainstream")], "Premium", "Tier", ["Category"]).drop("ListPrice")


@q("rank_top_share", "SELECT CustomerKey, CASE WHEN row_number() OVER (ORDER BY Balance DESC, CustomerKey) <= floor(count(*) OVER () * 0.15::DOUBLE) THEN 'top' ELSE 'rest' END AS Part FROM customers")
def rank_top_share(spark, sf):
    own = S.customers(spark, sf).select("CustomerKey", "Balance")
    return O.ranked_classes(own, [F.desc("Balance"), F.asc("CustomerKey")], [(0.15, "top")], "rest", "Part").drop("Balance")


@q("quantile_tiers", "SELECT CustomerKey, CASE WHEN Balance <= (SELECT quantile_cont(Balance, 0.5) FROM customers) THEN 'low' WHEN Balance <= (SELECT quantile_cont(Balance, 0.9) FROM customers) THEN 'middle' ELSE 'high' END AS Tier FROM customers")
def quantile_tiers(spark, sf):
    return O.quantile_tiers(S.customers(spark, sf).select("CustomerKey", "Balance"), "Balance", [0.5, 0.9], ["low", "middle", "high"], "Tier").drop("Balance")


@q("min_max_rescale", "SELECT ProductKey, round(1 + (ListPrice::DOUBLE - lo) / (hi - lo) * 99, 6) AS Scaled FROM products, (SELECT min(ListPrice)::DOUBLE AS lo, max(ListPrice)::DOUBLE AS hi FROM products)")
def min_max_rescale(spark, sf):
    return O.rescale(S.products(spark, sf).select("ProductKey", "ListPrice"), "ListPrice", 1, 100, "Scaled").select("ProductKey", F.round("Scaled", 6).alias("Scaled"))


@q("group_median_normalize", ", l AS (SELECT *, ln(ListPrice::DOUBLE) AS lp FROM products), g AS (SELECT Brand, quantile_cont(lp, 0.5) AS gm, count(*) AS n FROM l GROUP BY 1) SELECT ProductKey, Brand, round(CASE WHEN n >= 5 THEN least(greatest(exp(0.5::DOUBLE * ((SELECT quantile_cont(lp, 0.5) FROM l) - gm)), 0.8::DOUBLE), 1.25::DOUBLE) ELSE 1.0 END, 6) AS Factor FROM l JOIN g USING (Brand)")
def group_median_normalize(spark, sf):
    own = S.products(spark, sf).select("ProductKey", "Brand", "ListPrice")
    return O.normalize_by_group(own, "Brand", "ListPrice", 0.5, 0.8, 1.25, 5, "Factor").select("ProductKey", "Brand", F.round("Factor", 6).alias("Factor"))


@q("cumulative_product", "SELECT OrderNumber, OrderLineNumber, round(exp(sum(ln(1 + PromotionKey / 100.0::DOUBLE)) OVER (PARTITION BY OrderNumber ORDER BY OrderLineNumber ROWS UNBOUNDED PRECEDING)), 6) AS Drift FROM sales")
def cumulative_product(spark, sf):
    own = S.sales(spark, sf).withColumn("x", 1 + F.col("PromotionKey") / 100.0)
    return O.cumulative_product(own, ["OrderNumber"], "OrderLineNumber", "x", "Drift").select("OrderNumber", "OrderLineNumber", F.round("Drift", 6).alias("Drift"))


@q("urgency_pick", f"SELECT StoreKey, OrderNumber, OrderLineNumber, Rank FROM (SELECT *, row_number() OVER (PARTITION BY StoreKey ORDER BY DueDate ASC NULLS LAST, {u01_sql('Line', seed=5)}, Line)::INTEGER AS Rank FROM (SELECT *, OrderNumber * 100 + OrderLineNumber AS Line FROM sales)) WHERE Rank <= 3")
def urgency_pick(spark, sf):
    own = S.sales(spark, sf).withColumn("Line", F.col("OrderNumber") * 100 + F.col("OrderLineNumber"))
    return O.urgency_top_k(own, ["StoreKey"], "DueDate", "Line", 3, seed=5).select("StoreKey", "OrderNumber", "OrderLineNumber", "Rank")


@q("dedupe_keep_last", "SELECT GeographyKey, CASE WHEN GeographyKey % 2 = 0 THEN 'new' ELSE 'old' END AS Source FROM geography")
def dedupe_keep_last(spark, sf):
    own = S.geography(spark, sf).select("GeographyKey")
    return O.dedupe_keep_last(own.withColumn("Source", F.lit("old")), own.where("GeographyKey % 2 = 0").withColumn("Source", F.lit("new")), ["GeographyKey"])


@q("hash_uniform", f"SELECT CustomerKey, {u01_sql('CustomerKey', seed=7, salt=2)} AS U FROM customers")
def hash_uniform(spark, sf):
    return S.customers(spark, sf).select("CustomerKey", hash_u01(F.col("CustomerKey"), seed=7, salt=2).alias("U"))


CHANGES = ", ch AS (SELECT CustomerKey, OrderDate AS d, ChannelKey FROM sales), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY CustomerKey, d ORDER BY ChannelKey DESC) AS r FROM ch) WHERE r = 1), kept AS (SELECT CustomerKey, d, ChannelKey FROM (SELECT *, lag(ChannelKey) OVER (PARTITION BY CustomerKey ORDER BY d) AS b, row_number() OVER (PARTITION BY CustomerKey ORDER BY d) AS k FROM one) WHERE k = 1 OR ChannelKey IS DISTINCT FROM b), dim AS (SELECT CustomerKey, d AS EffectiveStartDate, ChannelKey, row_number() OVER w::INTEGER AS VersionNumber, coalesce((lead(d) OVER w - 1)::DATE, DATE '2099-12-31') AS EffectiveEndDate, lead(d) OVER w IS NULL AS IsCurrent FROM kept WINDOW w AS (PARTITION BY CustomerKey ORDER BY d)) "


def changes(spark, sf):
    return S.sales(spark, sf).select("CustomerKey", F.col("OrderDate").alias("d"), "ChannelKey")


def versions(spark, sf):
    return I.scd2_build(changes(spark, sf), ["CustomerKey"], "d", ["ChannelKey"])


@q("scd2_from_changes", CHANGES + "SELECT * FROM dim")
def scd2_from_changes(spark, sf):
    return versions(spark, sf)


@q("scd2_close_intervals", ORDERS + ", o AS (SELECT DISTINCT CustomerKey, OrderDate AS EffectiveStartDate FROM orders1) SELECT *, row_number() OVER w::INTEGER AS VersionNumber, coalesce((lead(EffectiveStartDate) OVER w - 1)::DATE, DATE '2099-12-31') AS EffectiveEndDate, lead(EffectiveStartDate) OVER w IS NULL AS IsCurrent FROM o WINDOW w AS (PARTITION BY CustomerKey ORDER BY EffectiveStartDate)")
def scd2_close_intervals(spark, sf):
    return I.close_intervals(orders(spark, sf).select("CustomerKey", F.col("OrderDate").alias("EffectiveStartDate")).distinct(), ["CustomerKey"])


@q("scd2_merge", CHANGES + "SELECT * FROM dim")
def scd2_merge(spark, sf):
    every = changes(spark, sf)
    dim = I.scd2_build(every.where("d < '2000-01-01'"), ["CustomerKey"], "d", ["ChannelKey"])
    return I.scd2_merge(dim, every.where("d >= '2000-01-01'"), ["CustomerKey"], "d", ["ChannelKey"])


@q("current_versions", CHANGES + "SELECT CustomerKey, ChannelKey FROM dim WHERE IsCurrent")
def current_versions(spark, sf):
    return versions(spark, sf).where("IsCurrent").select("CustomerKey", "ChannelKey")


@q("scd2_as_of", CHANGES + ", r AS (SELECT OrderNumber, OrderLineNumber, CustomerKey, DeliveryDate - 30 AS AsDate FROM sales), v AS (SELECT *, CASE WHEN VersionNumber = 1 THEN DATE '0001-01-01' ELSE EffectiveStartDate END AS f FROM dim) SELECT OrderNumber, OrderLineNumber, VersionNumber FROM r JOIN v ON r.CustomerKey = v.CustomerKey AND AsDate BETWEEN f AND EffectiveEndDate")
def scd2_as_of(spark, sf):
    fact = S.sales(spark, sf).withColumn("AsOf", F.date_sub("DeliveryDate", 30))
    return I.scd2_as_of(fact, "AsOf", versions(spark, sf), "CustomerKey", ["VersionNumber"]).select("OrderNumber", "OrderLineNumber", "VersionNumber")


@q("version_pair_join", CHANGES + "SELECT a.CustomerKey, a.VersionNumber, b.EffectiveStartDate AS NextEffectiveStartDate FROM dim a JOIN dim b ON a.CustomerKey = b.CustomerKey AND b.VersionNumber = a.VersionNumber + 1")
def version_pair_join(spark, sf):
    return I.version_pairs(versions(spark, sf), "CustomerKey", ["EffectiveStartDate"]).select("CustomerKey", "VersionNumber", "NextEffectiveStartDate")


@q("version_gap_check", CHANGES + "SELECT CustomerKey, VersionNumber, VersionNumber - 2 AS Before FROM (SELECT * FROM dim WHERE VersionNumber % 3 <> 2) WHERE VersionNumber % 3 = 0")
def version_gap_check(spark, sf):
    return I.version_gaps(versions(spark, sf).where("VersionNumber % 3 <> 2"), "CustomerKey")


@q("version_distribution", CHANGES + "SELECT n AS Versions, count(*) AS Keys FROM (SELECT count(*) AS n FROM dim GROUP BY CustomerKey) GROUP BY 1")
def version_distribution(spark, sf):
    return R.histogram_of_counts(versions(spark, sf), "CustomerKey", "Versions")


@q("classify_version_change", CHANGES + "SELECT CASE WHEN b IS NULL THEN 'first' WHEN ChannelKey > b THEN 'up' ELSE 'down' END AS Change, count(*) AS \"Rows\" FROM (SELECT *, lag(ChannelKey) OVER (PARTITION BY CustomerKey ORDER BY VersionNumber) AS b FROM dim) GROUP BY 1")
def classify_version_change(spark, sf):
    from pyspark.sql import Window as W

    before = F.lag("ChannelKey").over(W.partitionBy("CustomerKey").orderBy("VersionNumber"))
    label = F.when(F.col("b").isNull(), "first").when(F.col("ChannelKey") > F.col("b"), "up").otherwise("down")
    return versions(spark, sf).withColumn("b", before).groupBy(label.alias("Change")).agg(F.count("*").alias("Rows"))


ASSIGN = """, assign AS (SELECT StoreKey, ProductKey % 50 AS EmployeeKey, date_trunc('quarter', OrderDate)::DATE AS Q, min(OrderDate) AS StartDate, max(DeliveryDate) AS EndDate FROM sales GROUP BY 1, 2, 3) """


def assignments(spark, sf):
    lines = S.sales(spark, sf)
    return lines.groupBy("StoreKey", (F.col("ProductKey") % 50).alias("EmployeeKey"), F.trunc("OrderDate", "quarter").alias("Q")).agg(F.min("OrderDate").alias("StartDate"), F.max("DeliveryDate").alias("EndDate"))


UNION = ASSIGN + ", marked AS (SELECT *, CASE WHEN StartDate > max(EndDate) OVER w + 1 OR max(EndDate) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM assign WINDOW w AS (PARTITION BY StoreKey ORDER BY StartDate, EndDate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), numbered AS (SELECT *, sum(nw) OVER (PARTITION BY StoreKey ORDER BY StartDate, EndDate ROWS UNBOUNDED PRECEDING) AS i FROM marked), spans AS (SELECT StoreKey, min(StartDate) AS StartDate, max(EndDate) AS EndDate FROM numbered GROUP BY StoreKey, i) "


@q("interval_union", UNION + "SELECT * FROM spans")
def interval_union(spark, sf):
    return I.interval_union(assignments(spark, sf), ["StoreKey"], "StartDate", "EndDate")


@q("interval_overlap_join", ASSIGN + "SELECT count(*) AS Overlaps FROM (SELECT *, max(EndDate) OVER (PARTITION BY StoreKey, EmployeeKey ORDER BY StartDate, EndDate ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM assign) WHERE StartDate <= e")
def interval_overlap_join(spark, sf):
    return I.overlaps(assignments(spark, sf), ["StoreKey", "EmployeeKey"], "StartDate", "EndDate").agg(F.count("*").alias("Overlaps"))


@q("contiguity_violations", ASSIGN + "SELECT StoreKey, EmployeeKey, StartDate, PreviousEnd FROM (SELECT *, lag(EndDate) OVER (PARTITION BY StoreKey, EmployeeKey ORDER BY StartDate, EndDate) AS PreviousEnd FROM assign) WHERE StartDate <> PreviousEnd + 1")
def contiguity_violations(spark, sf):
    return I.contiguity(assignments(spark, sf), ["StoreKey", "EmployeeKey"], "StartDate", "EndDate").select("StoreKey", "EmployeeKey", "StartDate", "PreviousEnd")


@q("coverage_gaps", UNION + ", inside AS (SELECT * FROM spans WHERE EndDate >= DATE '1995-01-01' AND StartDate <= DATE '2001-12-31') SELECT * FROM (SELECT StoreKey, coalesce((lag(EndDate) OVER (PARTITION BY StoreKey ORDER BY StartDate) + 1)::DATE, DATE '1995-01-01') AS GapStart, (StartDate - 1)::DATE AS GapEnd FROM inside UNION ALL SELECT StoreKey, (max(EndDate) + 1)::DATE, DATE '2001-12-31' FROM inside GROUP BY 1) WHERE GapStart <= GapEnd")
def coverage_gaps(spark, sf):
    return I.coverage_gaps(assignments(spark, sf), "StoreKey", "StartDate", "EndDate", "1995-01-01", "2001-12-31")


@q("coverage_report", UNION + ", inside AS (SELECT * FROM spans WHERE EndDate >= DATE '1995-01-01' AND StartDate <= DATE '2001-12-31') SELECT StoreKey, count(*) AS Gaps, min(GapStart) AS FirstGap, sum(GapEnd - GapStart + 1)::BIGINT AS Days FROM (SELECT StoreKey, coalesce((lag(EndDate) OVER (PARTITION BY StoreKey ORDER BY StartDate) + 1)::DATE, DATE '1995-01-01') AS GapStart, (StartDate - 1)::DATE AS GapEnd FROM inside UNION ALL SELECT StoreKey, (max(EndDate) + 1)::DATE, DATE '2001-12-31' FROM inside GROUP BY 1) WHERE GapStart <= GapEnd GROUP BY 1")
def coverage_report(spark, sf):
    gaps = I.coverage_gaps(assignments(spark, sf), "StoreKey", "StartDate", "EndDate", "1995-01-01", "2001-12-31")
    return gaps.groupBy("StoreKey").agg(F.count("*").alias("Gaps"), F.min("GapStart").alias("FirstGap"), F.sum(F.datediff("GapEnd", "GapStart") + 1).alias("Days"))


PROMOS = ", promos AS (SELECT k AS PromotionKey, DATE '1995-01-01' + (k * 97)::INTEGER AS StartDate, DATE '1995-01-01' + (k * 97 + 120)::INTEGER AS EndDate FROM (SELECT DISTINCT PromotionKey AS k FROM sales)) "


@q("interval_point_join", PROMOS + "SELECT p.PromotionKey, count(*) AS Lines FROM sales s JOIN promos p ON OrderDate BETWEEN StartDate AND EndDate GROUP BY 1")
def interval_point_join(spark, sf):
    lines = S.sales(spark, sf)
    k = F.col("PromotionKey")
    day0 = F.lit("1995-01-01").cast("date")
    promos = lines.select("PromotionKey").distinct().select("PromotionKey", F.date_add(day0, k * 97).alias("StartDate"), F.date_add(day0, k * 97 + 120).alias("EndDate"))
    return I.in_interval(lines.select("OrderDate"), "OrderDate", promos, "StartDate", "EndDate").groupBy("PromotionKey").agg(F.count("*").alias("Lines"))


@q("last_end_by_pair", ASSIGN + "SELECT StoreKey, EmployeeKey, max(EndDate) AS LastEnd FROM assign GROUP BY 1, 2")
def last_end_by_pair(spark, sf):
    return assignments(spark, sf).groupBy("StoreKey", "EmployeeKey").agg(F.max("EndDate").alias("LastEnd"))


@q("m_employee_sales_by_assignment", ASSIGN + ", s AS (SELECT *, ProductKey % 50 AS E FROM sales), w AS (SELECT StoreKey, EmployeeKey, min(StartDate) AS f, max(EndDate) AS t FROM assign WHERE Q >= DATE '1997-01-01' GROUP BY 1, 2) SELECT w.EmployeeKey, sum(Quantity * NetPrice)::DOUBLE AS SalesAmount, count(*) AS Lines FROM s JOIN w ON s.StoreKey = w.StoreKey AND s.E = w.EmployeeKey AND OrderDate BETWEEN f AND t GROUP BY 1")
def m_employee_sales_by_assignment(spark, sf):
    lines = S.sales(spark, sf).withColumn("EmployeeKey", F.col("ProductKey") % 50)
    return R.assigned_sales(lines, assignments(spark, sf).where("Q >= '1997-01-01'"), ["EmployeeKey"])


@q("m_assignment_table", ASSIGN + ", s AS (SELECT *, ProductKey % 50 AS E FROM sales) SELECT a.StoreKey, a.EmployeeKey, a.StartDate, a.EndDate, sum(Quantity * NetPrice)::DOUBLE AS SalesAmount, count(*) AS Lines FROM assign a JOIN s ON s.StoreKey = a.StoreKey AND s.E = a.EmployeeKey AND OrderDate BETWEEN a.StartDate AND a.EndDate GROUP BY 1, 2, 3, 4")
def m_assignment_table(spark, sf):
    lines = S.sales(spark, sf).withColumn("EmployeeKey", F.col("ProductKey") % 50)
    rows = I.in_interval(lines, "OrderDate", assignments(spark, sf), "StartDate", "EndDate", ["StoreKey", "EmployeeKey"])
    return rows.groupBy("StoreKey", "EmployeeKey", "StartDate", "EndDate").agg(R.total(R.revenue()).alias("SalesAmount"), F.count("*").alias("Lines"))


MONTHS = ", months AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM orders)::DATE, (SELECT max(o_orderdate) FROM orders)::DATE, INTERVAL 1 MONTH))::DATE AS MonthStart) "


def months(spark, sf):
    """Every month from the table's first order to its last."""
    bounds = S.read(spark, sf, "orders", ["o_orderdate"]).agg(F.trunc(F.min("o_orderdate"), "month").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return bounds.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("MonthStart"))


@q("calendar_left_join", MONTHS + "SELECT MonthStart, coalesce(n, 0) AS \"Rows\" FROM months LEFT JOIN (SELECT date_trunc('month', OrderDate)::DATE AS MonthStart, count(*) AS n FROM sales WHERE StoreKey = 1 GROUP BY 1) USING (MonthStart)")
def calendar_left_join(spark, sf):
    return I.fill_calendar(months(spark, sf), S.sales(spark, sf).where("StoreKey = 1"), "OrderDate")


@q("gap_months", MONTHS + ", b AS (SELECT date_trunc('month', min(OrderDate))::DATE AS f, max(OrderDate) AS t FROM sales WHERE CustomerKey = 1) SELECT MonthStart FROM months, b WHERE MonthStart BETWEEN f AND t AND MonthStart NOT IN (SELECT date_trunc('month', OrderDate)::DATE FROM sales WHERE CustomerKey = 1)")
def gap_months(spark, sf):
    own = S.sales(spark, sf).where("CustomerKey = 1")
    bounds = own.agg(F.trunc(F.min("OrderDate"), "month").alias("f"), F.max("OrderDate").alias("t"))
    inside = months(spark, sf).crossJoin(F.broadcast(bounds)).where("MonthStart between f and t").select("MonthStart")
    return inside.join(own.select(F.trunc("OrderDate", "month").alias("MonthStart")).distinct(), "MonthStart", "left_anti")


@q("calendar_left_join_by_store", ", months AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(OrderDate)) FROM sales), (SELECT max(OrderDate) FROM sales), INTERVAL 1 MONTH))::DATE AS MonthStart) SELECT StoreKey, MonthStart, coalesce(n, 0) AS \"Rows\" FROM stores CROSS JOIN months LEFT JOIN (SELECT StoreKey, date_trunc('month', OrderDate)::DATE AS MonthStart, count(*) AS n FROM sales GROUP BY 1, 2) USING (StoreKey, MonthStart)")
def calendar_left_join_by_store(spark, sf):
    """Every store in every month of the sales' own range."""
    own = S.sales(spark, sf).select("StoreKey", F.trunc("OrderDate", "month").alias("MonthStart"))
    counted = own.groupBy("StoreKey", "MonthStart").agg(F.count("*").alias("n"))
    bounds = counted.agg(F.min("MonthStart").alias("f"), F.max("MonthStart").alias("t"))
    every = bounds.select(F.explode(F.expr("sequence(f, t, interval 1 month)")).alias("MonthStart"))
    grid = S.stores(spark, sf).select("StoreKey").crossJoin(F.broadcast(every))
    return grid.join(counted, ["StoreKey", "MonthStart"], "left").select("StoreKey", "MonthStart", F.coalesce("n", F.lit(0)).alias("Rows"))


@q("gap_months_by_customer", ", own AS (SELECT DISTINCT CustomerKey, date_trunc('month', OrderDate)::DATE AS MonthStart FROM sales), every AS (SELECT CustomerKey, unnest(generate_series(min(MonthStart), max(MonthStart), INTERVAL 1 MONTH))::DATE AS MonthStart FROM own GROUP BY 1) SELECT CustomerKey, MonthStart FROM every ANTI JOIN own USING (CustomerKey, MonthStart)")
def gap_months_by_customer(spark, sf):
    """Months without orders between each customer's first and last."""
    own = S.sales(spark, sf).select("CustomerKey", F.trunc("OrderDate", "month").alias("MonthStart")).distinct()
    bounds = own.groupBy("CustomerKey").agg(F.min("MonthStart").alias("f"), F.max("MonthStart").alias("t"))
    every = bounds.select("CustomerKey", F.explode(F.expr("sequence(f, t, interval 1 month)")).alias("MonthStart"))
    return every.join(own, ["CustomerKey", "MonthStart"], "left_anti")


@q("eligible_counts", MONTHS + ", c AS (SELECT CustomerKey, min(OrderDate) AS s, max(OrderDate) AS e FROM sales GROUP BY 1) SELECT MonthStart, count(c.CustomerKey) AS Active FROM months LEFT JOIN c ON date_trunc('month', s) <= MonthStart AND MonthStart <= date_trunc('month', e) GROUP BY 1")
def eligible_counts(spark, sf):
    own = S.sales(spark, sf).groupBy("CustomerKey").agg(F.min("OrderDate").alias("s"), F.max("OrderDate").alias("e"))
    return I.active_per_month(own, "s", "e", months(spark, sf))


@q("cross_expand", MONTHS + "SELECT StoreKey, MonthStart FROM stores CROSS JOIN months")
def cross_expand(spark, sf):
    return S.stores(spark, sf).select("StoreKey").crossJoin(F.broadcast(months(spark, sf)))


@q("anti_orphans", "SELECT DISTINCT ProductKey AS Orphan FROM sales WHERE ProductKey NOT IN (SELECT ProductKey FROM products WHERE Size > 2)")
def anti_orphans(spark, sf):
    return I.orphans(S.sales(spark, sf), "ProductKey", S.products(spark, sf).where("Size > 2"), "ProductKey")


@q("sample_orphans", "SELECT DISTINCT ProductKey AS Orphan FROM sales WHERE ProductKey NOT IN (SELECT ProductKey FROM products WHERE Size > 2) ORDER BY 1 LIMIT 10")
def sample_orphans(spark, sf):
    return I.orphans(S.sales(spark, sf), "ProductKey", S.products(spark, sf).where("Size > 2"), "ProductKey").orderBy("Orphan").limit(10)


@q("semi_not_exists", ASSIGN + "SELECT OrderNumber, OrderLineNumber FROM (SELECT *, ProductKey % 50 AS E FROM sales) s WHERE NOT EXISTS (SELECT 1 FROM assign a WHERE a.StoreKey = s.StoreKey AND a.EmployeeKey = s.E AND Q >= DATE '1997-01-01' AND s.OrderDate BETWEEN a.StartDate AND a.EndDate)")
def semi_not_exists(spark, sf):
    lines = S.sales(spark, sf).withColumn("E", F.col("ProductKey") % 50).alias("s")
    own = assignments(spark, sf).where("Q >= '1997-01-01'").alias("a")
    cond = F.expr("a.StoreKey = s.StoreKey AND a.EmployeeKey = s.E AND s.OrderDate BETWEEN a.StartDate AND a.EndDate")
    return lines.join(own, cond, "left_anti").select("OrderNumber", "OrderLineNumber")


@q("clamp_order_date", CHANGES + ", f AS (SELECT CustomerKey, min(EffectiveStartDate) + 400 AS f FROM dim GROUP BY 1) SELECT OrderNumber, OrderLineNumber, greatest(OrderDate, f)::DATE AS OrderDate FROM sales JOIN f USING (CustomerKey)")
def clamp_order_date(spark, sf):
    first = versions(spark, sf).groupBy("CustomerKey").agg(F.date_add(F.min("EffectiveStartDate"), 400).alias("f"))
    return S.sales(spark, sf).join(first, "CustomerKey").select("OrderNumber", "OrderLineNumber", F.greatest("OrderDate", "f").alias("OrderDate"))


CLOSED = ASSIGN + ", closed AS (SELECT *, CASE WHEN StoreKey % 3 <> 0 THEN DATE '1998-02-10' END AS ClosedFrom, DATE '1998-03-20' AS ClosedTo, StoreKey % 3 = 1 AS Permanent FROM assign) "


def closed(spark, sf):
    return assignments(spark, sf).withColumns({"ClosedFrom": F.when(F.col("StoreKey") % 3 != 0, F.lit("1998-02-10").cast("date")), "ClosedTo": F.lit("1998-03-20").cast("date"), "Permanent": F.col("StoreKey") % 3 == 1})


@q("renovation_split", CLOSED + ", c AS (SELECT * FROM closed WHERE ClosedFrom IS NOT NULL), p AS (SELECT EmployeeKey, StoreKey, 'before' AS Part, StartDate AS PartStart, least(EndDate, ClosedFrom - 1)::DATE AS PartEnd, Permanent FROM c UNION ALL SELECT EmployeeKey, StoreKey, 'away', greatest(StartDate, ClosedFrom), least(EndDate, ClosedTo - 1)::DATE, Permanent FROM c UNION ALL SELECT EmployeeKey, StoreKey, 'return', greatest(StartDate, ClosedTo), EndDate, Permanent FROM c) SELECT EmployeeKey, StoreKey, Part, PartStart, PartEnd FROM p WHERE PartStart <= PartEnd AND NOT (Permanent AND Part <> 'before')")
def renovation_split(spark, sf):
    return I.split_by_closure(closed(spark, sf).where("ClosedFrom is not null"))


@q("clip_assignment", CLOSED + "SELECT StoreKey, EmployeeKey, StartDate, CASE WHEN ClosedFrom IS NOT NULL THEN least(EndDate, ClosedFrom - 1)::DATE ELSE EndDate END AS EndDate FROM closed WHERE ClosedFrom IS NULL OR StartDate < ClosedFrom")
def clip_assignment(spark, sf):
    return I.clip_to_closure(closed(spark, sf)).select("StoreKey", "EmployeeKey", "StartDate", "EndDate")
