"""Queries: hubs of stores, split returns, rotating winners, profile scores, families of versions, codes without cover."""

from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01, u01_sql
from granary.operators import allocation as A
from granary.operators import facts as X
from granary.operators import ordered as O
from granary.operators import weights as V
from granary.plans import star as S
from granary.plans.history import MONTHS, months
from granary.plans.registry import register
from granary.plans.star import STAR


def q(name: str, sql: str):
    return register(name, STAR + sql)


#: Countries with more stores are split, those with fewer than OWN share hubs with others of their zone.
SPLIT, OWN = 5, 3


@register(
    "warehouse_hubs",
    STAR.replace("WITH raw", "WITH RECURSIVE raw", 1)
    + f""", k AS (SELECT Country, CASE WHEN count(*) > {SPLIT} THEN 'large' WHEN count(*) >= {OWN} THEN 'medium' ELSE 'small' END AS Kind FROM stores GROUP BY 1),
t AS (SELECT StoreKey, Kind, CASE Kind WHEN 'small' THEN Region ELSE Country END AS Scope, CASE Kind WHEN 'large' THEN StoreType ELSE Country END AS Name FROM stores JOIN k USING (Country)),
o AS (SELECT *, row_number() OVER (PARTITION BY Kind, Scope ORDER BY n DESC, Name) AS i FROM (SELECT Kind, Scope, Name, count(*) AS n, CASE Kind WHEN 'large' THEN {SPLIT} ELSE {OWN} END AS least FROM t GROUP BY 1, 2, 3)),
g AS (SELECT Kind, Scope, Name, i, 1::BIGINT AS Hub, CASE WHEN n >= least THEN 0 ELSE n END AS held FROM o WHERE i = 1
  UNION ALL SELECT o.Kind, o.Scope, o.Name, o.i, g.Hub + CASE WHEN g.held = 0 THEN 1 ELSE 0 END, CASE WHEN g.held + o.n >= o.least THEN 0 ELSE g.held + o.n END FROM g JOIN o ON o.Kind = g.Kind AND o.Scope = g.Scope AND o.i = g.i + 1)
SELECT StoreKey, t.Kind, t.Scope, Hub FROM t JOIN g ON g.Kind = t.Kind AND g.Scope = t.Scope AND g.Name = t.Name""",
)
def warehouse_hubs(spark, sf):
    """Each store's hub: large countries by kind of store, medium ones whole, small ones joined within their zone."""
    shops = S.stores(spark, sf).select("StoreKey", "Country", "Region", "StoreType")
    n = F.count("*")
    kinds = shops.groupBy("Country").agg(F.when(n > SPLIT, "large").when(n >= OWN, "medium").otherwise("small").alias("Kind"))
    shops = shops.join(kinds, "Country")
    medium = shops.where("Kind = 'medium'").select("StoreKey", "Kind", F.col("Country").alias("Scope"), F.lit(1).cast("long").alias("Hub"))

    def hubs(kind: str, scope: str, name: str, least: int):
        own = shops.where(F.col("Kind") == kind)
        found = A.greedy_hubs(own.groupBy(scope, name).agg(F.count("*").alias("n")), scope, name, "n", least)
        return own.join(found, [scope, name]).select("StoreKey", "Kind", F.col(scope).alias("Scope"), "Hub")

    return medium.unionByName(hubs("large", "Country", "StoreType", SPLIT)).unionByName(hubs("small", "Region", "Country", OWN))


#: Reasons and their weights; those of logistics go with late lines alone.
REASONS, LOGISTICS = {1: 4.0, 2: 3.0, 3: 2.0, 4: 2.0, 5: 1.0}, {2, 5}


def _reason_sql(u: str, weights: dict[int, float]) -> str:
    stretch = " UNION ALL ".join(f"SELECT {k} AS r, {sum(w for j, w in weights.items() if j <= k)}::DOUBLE / {sum(weights.values())}::DOUBLE AS hi" for k in weights)
    return f"(SELECT min(r) FROM ({stretch}) WHERE {u} < hi)"


def _u(salt: int, *more: str) -> str:
    return u01_sql("OrderNumber", "OrderLineNumber", *more, seed=61, salt=salt)


@q(
    "returns_split",
    f""", a AS (SELECT *, greatest(1, ceil(Quantity * {_u(2)})::INTEGER) AS ret FROM sales WHERE {_u(1)} < 0.1),
b AS (SELECT *, least(ret, 1 + floor({_u(3)} * 3)::INTEGER) AS ev, 1 + floor({_u(4)} * 30)::INTEGER AS lag, (NetPrice * 100)::BIGINT AS cents FROM a),
c AS (SELECT OrderNumber, OrderLineNumber, ev, unnest(range(1, ret))::INTEGER AS c FROM b),
d AS (SELECT OrderNumber, OrderLineNumber, c FROM (SELECT *, row_number() OVER (PARTITION BY OrderNumber, OrderLineNumber ORDER BY {_u(5, "c")}, c) AS k FROM c) WHERE k < ev UNION ALL SELECT OrderNumber, OrderLineNumber, 0 FROM b),
e AS (SELECT b.*, c AS low, coalesce(lead(c) OVER w, ret) AS high, (row_number() OVER w)::INTEGER AS ReturnSequence FROM d JOIN b USING (OrderNumber, OrderLineNumber) WINDOW w AS (PARTITION BY OrderNumber, OrderLineNumber ORDER BY c)),
f AS (SELECT *, sum(CASE WHEN ReturnSequence = 1 THEN 0 ELSE 1 + floor({_u(6, "ReturnSequence")} * 5)::INTEGER END) OVER (PARTITION BY OrderNumber, OrderLineNumber ORDER BY ReturnSequence) AS more, {_u(7, "ReturnSequence")} AS u7, (2 * cents * ret + Quantity) // (2 * Quantity) AS paid FROM e)
SELECT OrderNumber, OrderLineNumber, ReturnSequence, high - low AS ReturnQuantity, (DeliveryDate + lag + more::INTEGER)::DATE AS ReturnDate,
  CASE WHEN IsOrderDelayed THEN {_reason_sql("u7", REASONS)} ELSE {_reason_sql("u7", {k: w for k, w in REASONS.items() if k not in LOGISTICS})} END AS ReturnReasonKey,
  (2 * paid * high + ret) // (2 * ret) - (2 * paid * low + ret) // (2 * ret) AS ReturnCents FROM f""",
)
def returns_split(spark, sf):
    return X.split_returns(S.sales(spark, sf), REASONS, LOGISTICS, seed=61)


Z = f"sqrt(-2 * ln(1 - {u01_sql('MonthStart', 'Brand', seed=63, salt=1)})) * cos(2 * pi() * {u01_sql('MonthStart', 'Brand', seed=63, salt=2)})"


@q(
    "brand_rotation_by_year",
    MONTHS
    + f""", b AS (SELECT Brand, count(*) OVER () AS n, pow(Size::DOUBLE, 0.25::DOUBLE) / sum(pow(Size::DOUBLE, 0.25::DOUBLE)) OVER () AS base FROM (SELECT Brand, count(*) AS Size FROM products GROUP BY 1)),
m AS (SELECT MonthStart, date_diff('month', (SELECT min(MonthStart) FROM months), MonthStart) // 12 AS y FROM months),
turns AS (SELECT Brand, y * n + row_number() OVER (PARTITION BY y ORDER BY {u01_sql("Brand", "y", seed=62)}, Brand) - 1 AS turn FROM b CROSS JOIN (SELECT DISTINCT y FROM m)),
risen AS (SELECT y, Brand, max(t) AS t FROM (SELECT DISTINCT y FROM m) CROSS JOIN (VALUES (0, 1.0::DOUBLE), (1, 0.5::DOUBLE), (2, 0.25::DOUBLE)) s(k, t) JOIN turns ON turn = least(y + k, (SELECT max(y) FROM m)) GROUP BY 1, 2),
w AS (SELECT MonthStart, Brand, greatest(base * (1 + coalesce(t, 0) * 1.5::DOUBLE) * exp(0.15::DOUBLE * ({Z})), 0.02::DOUBLE) AS w FROM m CROSS JOIN b LEFT JOIN risen USING (y, Brand))
SELECT MonthStart, Brand, round(w / sum(w) OVER (PARTITION BY MonthStart), 9) AS Share FROM w""",
)
def brand_rotation_by_year(spark, sf):
    brands = S.products(spark, sf).groupBy("Brand").agg(F.count("*").alias("Size"))
    return V.rotating_winners(brands, months(spark, sf), 0.25, 2.5, (1.0, 0.5, 0.25), 0.15, 0.02, 62).withColumn("Share", F.round("Share", 9))


@q(
    "customer_profile_scores",
    """, c AS (SELECT CustomerKey, count(DISTINCT OrderNumber) AS n, count(*) AS lines, count(*) FILTER (ReturnFlag = 'R') AS back, min(OrderDate) AS f, max(OrderDate) AS l FROM sales GROUP BY 1),
s AS (SELECT max(l) AS z, date_diff('month', min(f), max(l)) + 1 AS t, greatest(date_diff('day', min(f), max(l)), 1) AS days, sum(n)::DOUBLE / count(*) AS mean FROM c),
p AS (SELECT CustomerKey, greatest(Balance, 0) / 10000.0::DOUBLE AS income, coalesce(n, 0) / mean AS weight, CASE WHEN n IS NULL THEN 3.0::DOUBLE ELSE 5 - 4 * (back / lines::DOUBLE) END AS satisfaction,
  coalesce(date_diff('month', f, z) + 1, 1) AS tenure, t, coalesce(date_diff('day', l, z) / days::DOUBLE, 1.0::DOUBLE) AS idle FROM customers LEFT JOIN c USING (CustomerKey) CROSS JOIN s),
r AS (SELECT *, round(0.45::DOUBLE * idle + 0.3::DOUBLE * (1 - satisfaction / 5) + 0.25::DOUBLE * (1 - tenure / t::DOUBLE), 9) AS risk FROM p)
SELECT CustomerKey, round(greatest(50, least(100000, income * 2000 + weight * 500 + tenure * 20)), 2) AS LifetimeValue, risk AS ChurnScore, CASE WHEN risk < 0.33::DOUBLE THEN 'Low' WHEN risk < 0.66::DOUBLE THEN 'Medium' ELSE 'High' END AS ChurnRisk,
  greatest(0, least(10, floor(round((satisfaction - 1) * 2.5::DOUBLE, 9))))::INTEGER AS NetPromoter FROM r""",
)
def customer_profile_scores(spark, sf):
    """Lifetime value, churn risk and net promoter base of each customer, from their orders; those without orders have the shortest tenure and a middle satisfaction."""
    lines = S.sales(spark, sf).groupBy("CustomerKey", "OrderNumber").agg(F.count("*").alias("lines"), F.sum((F.col("ReturnFlag") == "R").cast("int")).alias("back"), F.first("OrderDate").alias("d"))
    own = lines.groupBy("CustomerKey").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"), F.sum("back").alias("back"), F.min("d").alias("f"), F.max("d").alias("l"))
    month = lambda a, b: F.round(F.months_between(F.trunc(b, "month"), F.trunc(a, "month"))).cast("int")
    first, last = F.min("f"), F.max("l")
    span = own.agg(last.alias("z"), (month(first, last) + 1).alias("t"), F.greatest(F.datediff(last, first), F.lit(1)).alias("days"), (F.sum("n").cast("double") / F.count("*")).alias("mean"))
    rows = S.customers(spark, sf).select("CustomerKey", "Balance").join(own, "CustomerKey", "left").join(F.broadcast(span), how="cross")  # one row
    satisfaction = F.coalesce(5 - 4 * (F.col("back") / F.col("lines")), F.lit(3.0))
    tenure = F.coalesce(month(F.col("f"), F.col("z")) + 1, F.lit(1))
    idle = F.coalesce(F.datediff("z", "l") / F.col("days"), F.lit(1.0))
    value = F.greatest("Balance", F.lit(0.0)) / 10000 * 2000 + F.coalesce("n", F.lit(0)) / F.col("mean") * 500 + tenure * 20
    risk = F.round(0.45 * idle + 0.3 * (1 - satisfaction / 5) + 0.25 * (1 - tenure / F.col("t")), 9)
    promoter = F.greatest(F.lit(0), F.least(F.lit(10), F.floor(F.round((satisfaction - 1) * 2.5, 9)).cast("int")))
    return rows.select("CustomerKey", F.round(F.greatest(F.lit(50.0), F.least(F.lit(100000.0), value)), 2).alias("LifetimeValue"), risk.alias("ChurnScore"), F.when(risk < 0.33, "Low").when(risk < 0.66, "Medium").otherwise("High").alias("ChurnRisk"), promoter.alias("NetPromoter"))


@q("active_pool_families", f", f AS (SELECT ProductKey - ProductKey % 4 AS Family, max(ProductKey) AS ProductKey FROM products GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY {u01_sql('Family', seed=64)}, Family) AS k, count(*) OVER () AS n FROM f) SELECT Family, ProductKey FROM r WHERE k <= floor(n * 0.4::DOUBLE)")
def active_pool_families(spark, sf):
    """The current version, which is the last, of each product in a keyed share of the products; all versions of a product are in or out together."""
    own = S.products(spark, sf).groupBy((F.col("ProductKey") - F.col("ProductKey") % 4).alias("Family")).agg(F.max("ProductKey").alias("ProductKey"))
    ranked = O.ranked_classes(own.withColumn("u", hash_u01(F.col("Family"), seed=64)), [F.asc("u"), F.asc("Family")], [(0.4, "in")], "out", "Pool")
    return ranked.where("Pool = 'in'").select("Family", "ProductKey")


@q("uncovered_codes", "SELECT Country, count(*) AS Customers FROM customers WHERE Country NOT IN (SELECT Country FROM stores WHERE StoreType = 'Online') GROUP BY 1")
def uncovered_codes(spark, sf):
    """Countries of customers that no online store covers, with their customers."""
    return S.customers(spark, sf).join(S.stores(spark, sf).where("StoreType = 'Online'").select("Country"), "Country", "left_anti").groupBy("Country").agg(F.count("*").alias("Customers"))
