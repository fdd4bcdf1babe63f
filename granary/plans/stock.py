"""Queries: monthly and quarterly stock by seasonal reorder points, lead times and classes."""

from pyspark.sql import functions as F

from granary.operators import ordered as O
from granary.operators import stock as X
from granary.plans import star as S
from granary.plans.history import DEMAND, demand
from granary.plans.registry import register
from granary.plans.star import STAR
from granary.sources.tables import written


def profile(spark, sf, sold):
    """Replenishment attributes of products, by their keys and sizes; classes by what was sold."""
    key, size = F.col("ProductKey"), F.col("Size")
    names = F.array(*[F.lit(x) for x in ("None", *X.SEASONS)])
    own = S.products(spark, sf).select(
        "ProductKey", (5 + size % 20).alias("SafetyStock"), (2 + size % 9).alias("ReorderPoint"), (1 + key % 3).alias("LeadMonths"), (1 + key % 6).alias("CasePack"), (key % 7 == 0).alias("IsFragile"), F.element_at(names, (key % 6 + 1).cast("int")).alias("Season")
    )
    return own.join(O.abc_classify(sold, own).select("ProductKey", "Class"), "ProductKey")


def season_sql() -> str:
    """season, month, boost of the fixed values."""
    return ", ".join(f"({k}, {m}, {b}::DOUBLE)" for k, months in enumerate(X.SEASONS.values(), 1) for m, b in months.items())


def stock_sql(keep: str) -> str:
    return DEMAND + f""", sold AS (SELECT ProductKey, sum(QuantitySold)::BIGINT AS s FROM demand GROUP BY 1),
classes AS (SELECT ProductKey, CASE WHEN k <= floor(n * 0.2::DOUBLE) THEN 'A' WHEN k <= floor(n * 0.5::DOUBLE) THEN 'B' ELSE 'C' END AS class FROM (SELECT ProductKey, row_number() OVER (ORDER BY s DESC, ProductKey) AS k, count(*) OVER () AS n FROM sold)),
boosts(season, month, boost) AS (VALUES {season_sql()}),
pairs AS (SELECT d.ProductKey, WarehouseKey, greatest(sum(QuantitySold)::DOUBLE / count(*), 1.0::DOUBLE) AS mean, min("Year" * 12 + "Month" - 1) AS f, (SELECT max("Year" * 12 + "Month" - 1) FROM demand) AS t FROM demand d GROUP BY 1, 2 HAVING count(*) >= 3),
p AS (SELECT pairs.*, CASE class WHEN 'A' THEN 1.2::DOUBLE WHEN 'B' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS sc, 5 + Size % 20 AS safety, 2 + Size % 9 AS point, 1 + ProductKey % 3 AS lead, 1 + ProductKey % 6 AS pack, CASE WHEN ProductKey % 7 = 0 THEN 0.02::DOUBLE / 12.0::DOUBLE * 2.5::DOUBLE ELSE 0.02::DOUBLE / 12.0::DOUBLE * 1.0::DOUBLE END AS rate, ProductKey % 6 AS season FROM pairs JOIN products USING (ProductKey) JOIN classes USING (ProductKey) WHERE {keep}),
k AS (SELECT *, ceil(greatest(floor((safety + mean * lead) * sc * 1.0::DOUBLE), floor(mean * lead * sc)) / pack)::BIGINT * pack AS lot FROM p),
months AS (SELECT k.*, m, m - f + 1 AS i, coalesce(QuantitySold, 0)::BIGINT AS q, floor(point * (1.0::DOUBLE + coalesce(boost, 0)))::BIGINT AS pt FROM (SELECT *, unnest(range(f, t + 1)) AS m FROM k) k
  LEFT JOIN demand d ON d.ProductKey = k.ProductKey AND d.WarehouseKey = k.WarehouseKey AND d."Year" * 12 + d."Month" - 1 = m LEFT JOIN boosts b ON b.season = k.season AND b.month = m % 12 + 1),
led AS (
  SELECT ProductKey, WarehouseKey, 0::BIGINT AS i, 0::BIGINT AS m, floor(mean * 2.0::DOUBLE * sc * 1.0::DOUBLE)::BIGINT AS onhand, 0::BIGINT AS ordered, 0::BIGINT AS q, 0::BIGINT AS received, false AS reorder, false AS stockout, 0::BIGINT AS days, list_transform(range(lead), lambda x: 0)::BIGINT[] AS due FROM k
  UNION ALL
  SELECT ProductKey, WarehouseKey, i, m, greatest(raw, 0), CASE WHEN greatest(raw, 0) <= pt THEN lot ELSE 0 END, q, received, greatest(raw, 0) <= pt, raw < 0, CASE WHEN raw < 0 THEN least(30, floor(abs(raw) / greatest(1.0::DOUBLE, q * (1.0::DOUBLE / 30.0::DOUBLE))))::BIGINT ELSE 0 END,
    list_append(due[2:], CASE WHEN greatest(raw, 0) <= pt THEN lot ELSE 0 END)
  FROM (SELECT *, there - (q + floor(there * rate)::BIGINT) AS raw FROM (SELECT n.ProductKey, n.WarehouseKey, n.i, n.m, n.q, n.pt, n.lot, n.rate, l.due, l.due[1] AS received, l.onhand + l.due[1] AS there FROM led l JOIN months n ON n.ProductKey = l.ProductKey AND n.WarehouseKey = l.WarehouseKey AND n.i = l.i + 1))
),
snap AS (SELECT ProductKey, WarehouseKey::BIGINT AS WarehouseKey, make_date((m // 12)::BIGINT, (m % 12 + 1)::BIGINT, 1) AS SnapshotDate, onhand AS QuantityOnHand, ordered AS QuantityOnOrder, q AS QuantitySold, received AS QuantityReceived, reorder AS ReorderFlag, stockout AS StockoutFlag, days::INTEGER AS DaysOutOfStock FROM led WHERE i > 0) """


RECURSIVE = STAR.replace("WITH raw", "WITH RECURSIVE raw", 1)


def snapshots(spark, sf, rules=X.StockRules()):
    sold = written(demand(spark, sf))
    return X.inventory_snapshots(sold, profile(spark, sf, sold), rules)


@register("inventory_snapshot", RECURSIVE + stock_sql("true") + "SELECT * FROM snap")
def inventory_snapshot(spark, sf):
    """All classes: seasonal reorder points, leads of one to three months, shrinkage, days out of stock."""
    return snapshots(spark, sf)


@register("inventory_snapshot_abc", RECURSIVE + stock_sql("class IN ('A', 'B')") + "SELECT * FROM snap")
def inventory_snapshot_abc(spark, sf):
    return snapshots(spark, sf, X.StockRules(keep=("A", "B")))


@register("inventory_snapshot_quarterly", RECURSIVE + stock_sql("true") + """SELECT ProductKey, WarehouseKey, date_trunc('quarter', SnapshotDate)::DATE AS SnapshotDate, arg_max(QuantityOnHand, SnapshotDate) AS QuantityOnHand, sum(QuantityOnOrder)::BIGINT AS QuantityOnOrder, sum(QuantitySold)::BIGINT AS QuantitySold, sum(QuantityReceived)::BIGINT AS QuantityReceived, bool_or(ReorderFlag) AS ReorderFlag, bool_or(StockoutFlag) AS StockoutFlag, least(sum(DaysOutOfStock), 90)::INTEGER AS DaysOutOfStock FROM snap GROUP BY 1, 2, 3""")
def inventory_snapshot_quarterly(spark, sf):
    return X.by_quarter(snapshots(spark, sf))
