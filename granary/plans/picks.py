"""Queries: weights, prices and keyed choices."""

from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01, u01_sql
from granary.operators import allocation as A
from granary.operators import picks as P
from granary.plans import star as S
from granary.plans.domain import alias_sql, picked, slot_is
from granary.plans.history import ASSIGN, ORDERS, assignments, orders
from granary.plans.registry import register
from granary.plans.star import STAR
from granary.sources.tables import written


def q(name: str, sql: str | None = None):
    return register(name, STAR + sql if sql else None)


@q("band_step", "SELECT ProductKey, CASE WHEN ListPrice <= 500 THEN 5.0::DOUBLE WHEN ListPrice <= 1000 THEN 10.0::DOUBLE ELSE 50.0::DOUBLE END AS Step FROM products")
def band_step(spark, sf):
    return S.products(spark, sf).select("ProductKey", P.band_step(F.col("ListPrice").cast("double"), [(500, 5.0), (1000, 10.0)], 50.0).alias("Step"))


@q("snap_discount", "SELECT OrderNumber, OrderLineNumber, least(floor(d / s + 0.5::DOUBLE) * s, UnitPrice::DOUBLE) AS Discount FROM (SELECT *, DiscountAmount::DOUBLE AS d, CASE WHEN DiscountAmount <= 50 THEN 1.0::DOUBLE ELSE 5.0::DOUBLE END AS s FROM sales)")
def snap_discount(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", P.snap_discount(F.col("DiscountAmount").cast("double"), F.col("UnitPrice").cast("double"), [(50, 1.0)], 5.0).alias("Discount"))


INFL = "least(greatest(pow(1.03::DOUBLE, ((year(OrderDate) * 12 + month(OrderDate)) - (1995 * 12 + 1)) / 12.0::DOUBLE), 0.5::DOUBLE), 2.0::DOUBLE)"


@q("inflation_factor", f"SELECT OrderNumber, OrderLineNumber, round({INFL}, 9) AS Factor FROM sales")
def inflation_factor(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", F.round(P.inflation(F.col("OrderDate"), "1995-01-01", 0.03, 0.5, 2.0), 9).alias("Factor"))


REPRICE = f""", a AS (SELECT *, UnitPrice::DOUBLE * {INFL} AS u FROM sales), b AS (SELECT *, CASE WHEN u <= 500 THEN 5.0::DOUBLE WHEN u <= 1000 THEN 10.0::DOUBLE ELSE 50.0::DOUBLE END AS st FROM a),
c AS (SELECT *, greatest(floor(u / st + 0.5::DOUBLE) * st, st) AS p FROM b), d AS (SELECT *, greatest(least(floor(p * (PromotionKey - 1)) / 100.0::DOUBLE, p - least(UnitCost::DOUBLE, p - 0.01::DOUBLE) - 0.01::DOUBLE), 0.0::DOUBLE) AS off FROM c)
SELECT OrderNumber, OrderLineNumber, floor(p * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS NewPrice, floor(off * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS NewDiscount, floor((p - off) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE AS NewNet FROM d"""


@q("reprice_lines", REPRICE)
def reprice_lines(spark, sf):
    return P.reprice(S.sales(spark, sf)).select("OrderNumber", "OrderLineNumber", "NewPrice", "NewDiscount", "NewNet")


@q("quantity_elasticity", "SELECT OrderNumber, OrderLineNumber, least(greatest(round_even(Quantity * pow(NetPrice::DOUBLE / UnitPrice::DOUBLE, -1.5::DOUBLE), 0), 1), 60)::INTEGER AS Elastic FROM sales")
def quantity_elasticity(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", P.elastic_quantity(F.col("Quantity"), F.col("NetPrice").cast("double"), F.col("UnitPrice").cast("double"), 1.5, 1, 60).alias("Elastic"))


@q("promo_salience", ", p AS (SELECT DISTINCT PromotionKey, exp(20.0::DOUBLE * (PromotionKey - 1) / 100.0::DOUBLE) AS w FROM sales) SELECT PromotionKey, round(greatest(w, (SELECT max(w) FROM p) / 4.0::DOUBLE), 9) AS Weight FROM p")
def promo_salience(spark, sf):
    promos = S.sales(spark, sf).select("PromotionKey").distinct().withColumn("d", (F.col("PromotionKey") - 1) / 100.0)
    return P.salience(promos, "d", 20.0, 4.0).select("PromotionKey", F.round("Weight", 9).alias("Weight"))


@q("weekday_weight", f", d AS (SELECT DISTINCT OrderDate AS Date FROM sales), r AS (SELECT Date, CASE WHEN {u01_sql('Date', seed=2)} < 0.02 THEN 0.0::DOUBLE ELSE [0.8, 1.0, 1.0, 1.1, 1.2, 1.5, 1.4][dayofweek(Date) + 1]::DOUBLE END AS w FROM d) SELECT Date, round(w / sum(w) OVER (PARTITION BY date_trunc('month', Date)), 9) AS Weight FROM r")
def weekday_weight(spark, sf):
    days = S.sales(spark, sf).select(F.col("OrderDate").alias("Date")).distinct()
    return P.day_weights(days, [0.8, 1.0, 1.0, 1.1, 1.2, 1.5, 1.4], 0.02, 2).select("Date", F.round("Weight", 9).alias("Weight"))


HOURS = ", ch AS (SELECT DISTINCT ChannelKey FROM sales), h AS (SELECT ChannelKey, hr AS Hour, CASE WHEN hr BETWEEN 6 + ChannelKey AND 19 + ChannelKey - 1 THEN 1.0::DOUBLE + hr % 5 ELSE 0.0::DOUBLE END AS w FROM ch CROSS JOIN range(0, 24) t(hr)), hw AS (SELECT ChannelKey, Hour::INTEGER AS Hour, w / sum(w) OVER (PARTITION BY ChannelKey) AS Weight FROM h)"


def _hours(spark, sf):
    return P.hour_weights(S.sales(spark, sf).select("ChannelKey").distinct().withColumns({"Opens": F.col("ChannelKey") + 6, "Closes": F.col("ChannelKey") + 19}))


@q("hour_weight", HOURS + " SELECT ChannelKey, Hour, round(Weight, 9) AS Weight FROM hw")
def hour_weight(spark, sf):
    return _hours(spark, sf).select("ChannelKey", "Hour", F.round("Weight", 9).alias("Weight"))


@q("pick_order_minute", HOURS + f", {alias_sql('c', 'hw', 'ChannelKey', 'Weight', 'Hour')}, o AS (SELECT OrderNumber, min(ChannelKey) AS ChannelKey, {u01_sql('OrderNumber', seed=13)} AS u, {u01_sql('OrderNumber', seed=13, salt=1)} AS m FROM sales GROUP BY OrderNumber) SELECT OrderNumber, (({picked('Hour')}) * 60 + floor(m * 60))::INTEGER AS TimeKey FROM o LEFT JOIN c ON o.ChannelKey = c.ChannelKey AND {slot_is()}")
def pick_order_minute(spark, sf):
    own = S.sales(spark, sf).groupBy("OrderNumber").agg(F.min("ChannelKey").alias("ChannelKey"))
    return P.pick_minute(own, _hours(spark, sf), 13).select("OrderNumber", "TimeKey")


PROMOS = """, promos AS (SELECT PromotionKey AS k, DATE '1995-01-01' + (PromotionKey * 97)::INTEGER AS f, DATE '1995-01-01' + (PromotionKey * 97 + 400)::INTEGER AS t, CASE PromotionKey % 3 WHEN 0 THEN 'digital' WHEN 1 THEN 'physical' END AS own FROM (SELECT DISTINCT PromotionKey FROM sales)),
lines AS (SELECT OrderNumber, OrderLineNumber, OrderDate, CASE WHEN ChannelKey <= 2 THEN 'digital' ELSE 'physical' END AS g FROM sales),
pool AS (SELECT DISTINCT g, OrderDate, k, k * 1.0::DOUBLE AS w FROM (SELECT DISTINCT g, OrderDate FROM lines) JOIN promos ON OrderDate BETWEEN f AND t AND coalesce(own, g) = g)"""


@q("promo_assign", PROMOS + f", {alias_sql('c', 'pool', 'g, OrderDate', 'w', 'k')} SELECT OrderNumber, OrderLineNumber, coalesce({picked('k')}, 1)::INTEGER AS PromotionKey FROM (SELECT *, {u01_sql('OrderNumber', 'OrderLineNumber', seed=5)} AS u FROM lines) l LEFT JOIN c ON l.g = c.g AND l.OrderDate = c.OrderDate AND {slot_is()}")
def promo_assign(spark, sf):
    """Promotions of a channel group serve its lines alone, those without one all lines."""
    lines = S.sales(spark, sf).withColumn("ChannelGroup", F.when(F.col("ChannelKey") <= 2, "digital").otherwise("physical"))
    day0 = F.lit("1995-01-01").cast("date")
    k = F.col("PromotionKey")
    group = F.when(k % 3 == 0, "digital").when(k % 3 == 1, "physical")
    promos = lines.select("PromotionKey").distinct().select("PromotionKey", group.alias("ChannelGroup"), F.date_add(day0, k * 97).alias("StartDate"), F.date_add(day0, k * 97 + 400).alias("EndDate"), (k * 1.0).alias("Weight"))
    return P.assign_promo(lines, promos, 5).select("OrderNumber", "OrderLineNumber", "PromotionKey")


STAFF = """, o AS (SELECT OrderNumber, min(OrderDate) AS OrderDate, min(StoreKey) AS StoreKey FROM sales GROUP BY 1),
pool AS (SELECT StoreKey, OrderDate, EmployeeKey AS k, max(1 + EmployeeKey % 4)::DOUBLE AS w FROM (SELECT DISTINCT StoreKey, OrderDate FROM o) JOIN assign USING (StoreKey) WHERE OrderDate BETWEEN StartDate AND EndDate AND EmployeeKey % 10 <> 0 GROUP BY 1, 2, 3)"""


@q("assign_salesperson", ASSIGN + STAFF + f", {alias_sql('c', 'pool', 'StoreKey, OrderDate', 'w', 'k')} SELECT OrderNumber, coalesce({picked('k')}, -1)::BIGINT AS Seller FROM (SELECT *, {u01_sql('OrderNumber', seed=6)} AS u FROM o) l LEFT JOIN c ON l.StoreKey = c.StoreKey AND l.OrderDate = c.OrderDate AND {slot_is()}")
def assign_salesperson(spark, sf):
    """By weight among those present who are no managers: in this star, employees whose key ends in 0 are the managers."""
    own = written(S.sales(spark, sf).groupBy("OrderNumber").agg(F.min("OrderDate").alias("OrderDate"), F.min("StoreKey").alias("StoreKey")))
    staff = written(assignments(spark, sf)).withColumn("Weight", 1 + F.col("EmployeeKey") % 4)
    return P.assign_employee(own, staff, F.col("EmployeeKey") % 10 == 0, 6).select("OrderNumber", "Seller")


@q("geo_biased_store", ORDERS + f", pool AS (SELECT Country AS g, StoreKey, 1 AS w FROM stores UNION ALL SELECT '*', StoreKey, 1 FROM stores), {alias_sql('c', 'pool', 'g', 'w', 'StoreKey')}, o AS (SELECT OrderNumber, CASE WHEN {u01_sql('OrderNumber', seed=9, salt=1)} < 0.7::DOUBLE AND Country IN (SELECT Country FROM stores) THEN Country ELSE '*' END AS g, {u01_sql('OrderNumber', seed=9)} AS u FROM orders1 JOIN customers USING (CustomerKey)) SELECT OrderNumber, {picked('StoreKey')} AS StoreKey FROM o LEFT JOIN c ON o.g = c.g AND {slot_is()}")
def geo_biased_store(spark, sf):
    own = orders(spark, sf).join(S.customers(spark, sf).select("CustomerKey", "Country"), "CustomerKey")
    return P.pick_store(own, S.stores(spark, sf), 0.7, 9).select("OrderNumber", "StoreKey")


@q("wishlist_pairs", f""", bought AS (SELECT DISTINCT CustomerKey, ProductKey FROM sales), likes AS (SELECT CustomerKey, Category, count(*) AS n FROM bought JOIN products USING (ProductKey) GROUP BY 1, 2),
c AS (SELECT l.CustomerKey, l.n, l.Category, p.ProductKey, row_number() OVER (PARTITION BY l.CustomerKey, l.Category ORDER BY {u01_sql('p.ProductKey', seed=4)}, p.ProductKey) AS r FROM likes l JOIN products p USING (Category) WHERE NOT EXISTS (SELECT 1 FROM bought b WHERE b.CustomerKey = l.CustomerKey AND b.ProductKey = p.ProductKey)),
k AS (SELECT CustomerKey, ProductKey, row_number() OVER (PARTITION BY CustomerKey ORDER BY n DESC, {u01_sql('CustomerKey', 'ProductKey', seed=4)}, ProductKey)::INTEGER AS Rank FROM c WHERE r <= 12) SELECT * FROM k WHERE Rank <= 3""")
def wishlist_pairs(spark, sf):
    bought = S.sales(spark, sf).select("CustomerKey", "ProductKey").distinct()
    return P.wishlist(bought, S.products(spark, sf), 3, 4)


@q("complaint_rows", f", p AS (SELECT *, {u01_sql('OrderNumber', 'OrderLineNumber', seed=12, salt=2)} AS u2, {u01_sql('OrderNumber', 'OrderLineNumber', seed=12, salt=3)} AS u3, {u01_sql('OrderNumber', 'OrderLineNumber', seed=12, salt=4)} AS u4 FROM sales WHERE {u01_sql('OrderNumber', 'OrderLineNumber', seed=12, salt=1)} < 0.05) SELECT CustomerKey, OrderNumber, OrderLineNumber, (DeliveryDate + floor(u2 * 20)::INTEGER)::DATE AS ComplaintDate, CASE WHEN u4 < 0.8 THEN (DeliveryDate + floor(u2 * 20)::INTEGER + floor(u3 * 15)::INTEGER + 1)::DATE END AS ResolutionDate, CASE WHEN u4 < 0.8 THEN floor(u3 * 15)::INTEGER + 1 END AS ResponseDays FROM p")
def complaint_rows(spark, sf):
    return P.complaints(S.sales(spark, sf), 0.05, 12)


CAPPED = """, a AS (SELECT StoreKey, StoreKey % 5 AS g, sum(Quantity)::DOUBLE AS w, (20 + StoreKey % 50)::DOUBLE AS cap FROM sales GROUP BY StoreKey),
b AS (SELECT *, (40 - coalesce(sum(cap) OVER (PARTITION BY g ORDER BY cap / w, StoreKey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(w) OVER (PARTITION BY g) - coalesce(sum(w) OVER (PARTITION BY g ORDER BY cap / w, StoreKey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM a)
"""


def _capped(spark, sf):
    return S.sales(spark, sf).groupBy("StoreKey").agg(F.sum("Quantity").cast("double").alias("w")).withColumns({"g": F.col("StoreKey") % 5, "cap": (20 + F.col("StoreKey") % 50).cast("double")})


@q("capped_shares", CAPPED + """SELECT StoreKey, g, round(CASE WHEN cap / w <= level THEN cap ELSE w * first_value(level) OVER (PARTITION BY g ORDER BY CASE WHEN cap / w <= level THEN 1 ELSE 0 END, cap / w, StoreKey) END, 6) AS Share FROM b""")
def capped_shares(spark, sf):
    return P.capped_shares(_capped(spark, sf), "w", "cap", 40, ["g"], "StoreKey").select("StoreKey", "g", F.round("Share", 6).alias("Share"))


@q("allocate_capped", CAPPED + """, x AS (SELECT StoreKey, g, cap, round(CASE WHEN cap / w <= level THEN cap ELSE w * first_value(level) OVER (PARTITION BY g ORDER BY CASE WHEN cap / w <= level THEN 1 ELSE 0 END, cap / w, StoreKey) END, 9) AS x FROM b),
f AS (SELECT *, floor(x)::BIGINT AS f, round(x - floor(x), 9) AS r FROM x)
SELECT StoreKey, g, f + CASE WHEN r > 0 AND row_number() OVER (PARTITION BY g ORDER BY CASE WHEN r > 0 THEN 0 ELSE 1 END, r DESC, StoreKey) <= 40 - sum(f) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS Share FROM f""")
def allocate_capped(spark, sf):
    """Whole numbers that sum to 40 in each group, none above its cap."""
    return A.allocate_capped(_capped(spark, sf), "w", "cap", 40, ["g"], "StoreKey").select("StoreKey", "g", "Share")


@q("store_hierarchy", "SELECT StoreKey, Country, District, ((District - 1) // 2 + 1)::INTEGER AS StoreRegion FROM (SELECT StoreKey, Country, ((row_number() OVER (PARTITION BY Country ORDER BY StoreKey) - 1) // 3 + 1)::INTEGER AS District FROM stores)")
def store_hierarchy(spark, sf):
    return P.hierarchy(S.stores(spark, sf), 3, 2).select("StoreKey", "Country", "District", "StoreRegion")


@q("short_number", "SELECT StoreKey, CASE WHEN b >= 1000000 THEN floor(b / 1000000)::BIGINT || 'M' WHEN b >= 1000 THEN floor(b / 1000)::BIGINT || 'K' ELSE (floor(b)::BIGINT)::VARCHAR END AS Label FROM (SELECT StoreKey, abs(Balance) AS b FROM stores)")
def short_number(spark, sf):
    return S.stores(spark, sf).select("StoreKey", P.short_number(F.abs("Balance")).alias("Label"))


@q("name_slug", "SELECT CustomerKey, trim(regexp_replace(lower(FullName), '[^a-z0-9]+', '-', 'g'), '-') AS Slug FROM customers")
def name_slug(spark, sf):
    return S.customers(spark, sf).select("CustomerKey", P.slug(F.col("FullName")).alias("Slug"))


@q("snake_name", "SELECT s AS StoreType, lower(s) AS Snake FROM (SELECT DISTINCT StoreType AS s FROM stores)")
def snake_name(spark, sf):
    snake = F.lower(F.regexp_replace("StoreType", "(?<=[a-z0-9])(?=[A-Z])", "_"))
    return S.stores(spark, sf).select("StoreType").distinct().withColumn("Snake", snake)


@q("discovery_month", f"SELECT CustomerKey, least(floor(-ln(1 - {u01_sql('CustomerKey', seed=3, salt=8)}) * 6.0::DOUBLE), 36)::INTEGER AS Lag FROM customers")
def discovery_month(spark, sf):
    lag = -F.ln(1 - hash_u01(F.col("CustomerKey"), seed=3, salt=8)) * 6.0
    return S.customers(spark, sf).select("CustomerKey", F.least(F.floor(lag), F.lit(36)).cast("int").alias("Lag"))


@q("basket_theme", f"SELECT OrderNumber, floor({u01_sql('OrderNumber', seed=14)} * 6)::INTEGER AS Theme, count(*) AS Lines FROM sales GROUP BY 1, 2")
def basket_theme(spark, sf):
    return S.sales(spark, sf).groupBy("OrderNumber", F.floor(hash_u01(F.col("OrderNumber"), seed=14) * 6).cast("int").alias("Theme")).agg(F.count("*").alias("Lines"))


@q("trial_price", "SELECT ProductKey, floor(ListPrice::DOUBLE * (1 - 14 / (365.25::DOUBLE / 12)) * 100 + 0.5::DOUBLE) / 100 AS Trial FROM products")
def trial_price(spark, sf):
    price = F.col("ListPrice").cast("double") * (1 - 14 / F.lit(365.25 / 12))
    return S.products(spark, sf).select("ProductKey", (F.floor(price * 100 + 0.5) / 100).alias("Trial"))
