"""Queries: suites of checks that run by table. Each rule has its condition as a column here, and its SQL written apart."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.operators.rulebook import Keys, bad, info, run_suites, share
from granary.plans import star as S
from granary.plans.history import ASSIGN, CHANGES, assignments, demand, versions
from granary.plans.registry import register
from granary.plans.star import STAR

c = F.col


def spans(spark, sf):
    w = W.partitionBy("StoreKey", "EmployeeKey").orderBy("StartDate", "EndDate")
    return assignments(spark, sf).withColumn("PreviousEnd", F.lag("EndDate").over(w))


def employees(spark, sf):
    """Three of each store; the first of them manages it."""
    own = S.read(spark, sf, "supplier", ["s_suppkey"]).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return own.select((30_000_000 + c("s_suppkey") * 10 + c("n")).alias("EmployeeKey"), c("s_suppkey").alias("StoreKey"), (c("n") == 0).alias("IsManager"))


def channels(spark, sf):
    return S.read(spark, sf, "orders", ["o_orderpriority"]).select(F.substring("o_orderpriority", 1, 1).cast("int").alias("ChannelKey")).distinct()


def dim(spark, sf):
    w = W.partitionBy("CustomerKey").orderBy("VersionNumber")
    both = versions(spark, sf).withColumns({"PreviousEnd": F.lag("EffectiveEndDate").over(w), "Before": F.lag("ChannelKey").over(w), "Of": F.count("*").over(W.partitionBy("CustomerKey"))})
    return both.withColumn("NowCurrent", F.sum(c("IsCurrent").cast("int")).over(W.partitionBy("CustomerKey")))


def lines(spark, sf):
    """Sales lines with the type of their store and the age of their customer's first version."""
    return S.sales(spark, sf).join(S.stores(spark, sf).select("StoreKey", "StoreType"), "StoreKey", "left")


TABLES = {
    "sales": lines, "customers": S.customers, "products": S.products, "stores": S.stores, "geography": S.geography, "returns": lambda spark, sf: S.returns(S.sales(spark, sf)), "assign": spans,
    "employees": employees, "channels": channels, "dim": dim, "demand": demand, "headers": lambda spark, sf: S.read(spark, sf, "orders", ["o_orderkey", "o_custkey"]).toDF("OrderNumber", "CustomerKey"),
}
#: The same tables for the SQL.
HEAD = STAR + ASSIGN + CHANGES.rstrip() + """, spans AS (SELECT *, lag(EndDate) OVER (PARTITION BY StoreKey, EmployeeKey ORDER BY StartDate, EndDate) AS PreviousEnd FROM assign),
staff AS (SELECT 30000000 + s_suppkey * 10 + unnest([0, 1, 2]) AS EmployeeKey, s_suppkey AS StoreKey FROM supplier),
chan AS (SELECT DISTINCT substr(o_orderpriority, 1, 1)::INTEGER AS ChannelKey FROM orders),
v AS (SELECT *, lag(EffectiveEndDate) OVER w AS pe, lag(ChannelKey) OVER w AS b FROM dim WINDOW w AS (PARTITION BY CustomerKey ORDER BY VersionNumber)),
dem AS (SELECT ProductKey, WarehouseKey, year(OrderDate) AS y, month(OrderDate) AS m, sum(Quantity) AS qty FROM sales JOIN stores USING (StoreKey) GROUP BY ALL),
sl AS (SELECT s.*, StoreType FROM sales s LEFT JOIN stores USING (StoreKey)) """

#: suite -> [(rule, SQL of its value)]
BOOK = {
    "integrity": [
        *[
            (Keys(f"{t}_{k}_{p}".lower(), t, (k,), "orphan", p, (pk,)), f"SELECT count(DISTINCT {k}) FROM {ts} x WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {ps} y WHERE y.{pks} = x.{k})")
            for t, ts, k, p, ps, pk, pks in [
                ("sales", "sales", "CustomerKey", "customers", "customers", "CustomerKey", "CustomerKey"),
                ("sales", "sales", "ProductKey", "products", "products", "ProductKey", "ProductKey"),
                ("sales", "sales", "StoreKey", "stores", "stores", "StoreKey", "StoreKey"),
                ("sales", "sales", "EmployeeKey", "employees", "staff", "EmployeeKey", "EmployeeKey"),
                ("sales", "sales", "ChannelKey", "channels", "chan", "ChannelKey", "ChannelKey"),
                ("sales", "sales", "OrderNumber", "headers", "orders", "OrderNumber", "o_orderkey"),
                ("returns", "returns", "OrderNumber", "headers", "orders", "OrderNumber", "o_orderkey"),
                ("headers", "(SELECT o_custkey AS CustomerKey FROM orders)", "CustomerKey", "customers", "customers", "CustomerKey", "CustomerKey"),
                ("customers", "customers", "GeographyKey", "geography", "geography", "GeographyKey", "GeographyKey"),
                ("stores", "stores", "GeographyKey", "geography", "geography", "GeographyKey", "GeographyKey"),
                ("demand", "dem", "ProductKey", "products", "products", "ProductKey", "ProductKey"),
                ("demand", "dem", "WarehouseKey", "stores", "stores", "WarehouseKey", "WarehouseKey"),
                ("assign", "assign", "StoreKey", "stores", "stores", "StoreKey", "StoreKey"),
                ("dim", "dim", "CustomerKey", "customers", "customers", "CustomerKey", "CustomerKey"),
                ("employees", "staff", "StoreKey", "stores", "stores", "StoreKey", "StoreKey"),
            ]
        ]
    ],
    "primary_keys": [
        (Keys(f"{t}_{kind}", t, ks, kind), (f"SELECT count(*) FROM {ts} WHERE NOT ({' AND '.join(f'{k} IS NOT NULL' for k in sk)})" if kind == "null" else f"SELECT count(*) FROM (SELECT {', '.join(sk)} FROM {ts} WHERE {' AND '.join(f'{k} IS NOT NULL' for k in sk)} GROUP BY ALL HAVING count(*) >= 2)"))
        for kind in ("null", "repeated")
        for t, ts, ks, sk in [
            ("customers", "customers", ("CustomerKey",), ["CustomerKey"]),
            ("products", "products", ("ProductKey",), ["ProductKey"]),
            ("stores", "stores", ("StoreKey",), ["StoreKey"]),
            ("geography", "geography", ("GeographyKey",), ["GeographyKey"]),
            ("employees", "staff", ("EmployeeKey",), ["EmployeeKey"]),
            ("headers", "orders", ("OrderNumber",), ["o_orderkey"]),
            ("sales", "sales", ("OrderNumber", "OrderLineNumber"), ["OrderNumber", "OrderLineNumber"]),
            ("dim", "dim", ("CustomerKey", "VersionNumber"), ["CustomerKey", "VersionNumber"]),
            ("assign", "assign", ("StoreKey", "EmployeeKey", "StartDate"), ["StoreKey", "EmployeeKey", "StartDate"]),
        ]
    ],
    "sales_values": [
        (bad("quantity", "sales", "quantities of 0 or less", lambda: c("Quantity") <= 0), "SELECT count(*) FROM sales WHERE NOT Quantity > 0"),
        (bad("unit_price", "sales", "unit prices of 0 or less", lambda: c("UnitPrice") <= 0), "SELECT count(*) FROM sales WHERE NOT UnitPrice > 0"),
        (bad("cost_above_price", "sales", "costs above the unit price", lambda: c("UnitCost") > c("UnitPrice")), "SELECT count(*) FROM sales WHERE UnitPrice - UnitCost < 0"),
        (bad("discount_range", "sales", "discounts below 0 or above the price", lambda: ~c("DiscountAmount").between(0, c("UnitPrice"))), "SELECT count(*) FROM sales WHERE DiscountAmount < 0 OR UnitPrice < DiscountAmount"),
        (bad("early_due", "sales", "due before the order", lambda: F.datediff("DueDate", "OrderDate") < 0), "SELECT count(*) FROM sales WHERE OrderDate > DueDate"),
        (bad("early_delivery", "sales", "delivered before the order", lambda: F.datediff("DeliveryDate", "OrderDate") < 0), "SELECT count(*) FROM sales WHERE OrderDate > DeliveryDate"),
        (bad("delay_flag", "sales", "delay flags that contradict the dates", lambda: c("IsOrderDelayed") != (c("DeliveryDate") > c("DueDate"))), "SELECT count(*) FROM sales WHERE CASE WHEN DueDate < DeliveryDate THEN NOT IsOrderDelayed ELSE IsOrderDelayed END"),
        (bad("time_key", "sales", "minutes that a day does not have", lambda: ~c("TimeKey").between(0, 1439)), "SELECT count(*) FROM sales WHERE TimeKey < 0 OR TimeKey > 1439"),
        (share("delayed", "sales", "share of delayed lines", lambda: c("IsOrderDelayed"), 0.05, 0.6), "SELECT round(avg(CASE WHEN DueDate < DeliveryDate THEN 1.0::DOUBLE ELSE 0 END), 6) FROM sales"),
        (info("rows", "sales", "lines", lambda: F.count("*")), "SELECT count(*) FROM sales"),
        (info("last_order", "sales", "months from 1995 to the last order", lambda: (F.year(F.max("OrderDate")) - 1995) * 12 + F.month(F.max("OrderDate"))), "SELECT date_diff('month', DATE '1994-12-01', max(OrderDate)) FROM sales"),
    ],
    "dimensions": [
        (bad("customer_name", "customers", "customers without a name", lambda: F.coalesce(F.trim("FullName"), F.lit("")) == ""), "SELECT count(*) FROM customers WHERE FullName IS NULL OR trim(FullName) = ''"),
        (bad("balance", "customers", "balances out of range", lambda: ~c("Balance").between(-1000, 10_000)), "SELECT count(*) FROM customers WHERE Balance < -1000 OR Balance > 10000"),
        (bad("list_price", "products", "list prices of 0 or less", lambda: c("ListPrice") <= 0), "SELECT count(*) FROM products WHERE ListPrice < 0.005"),
        (bad("no_channel", "products", "products of no channel", lambda: ~(c("EligibleStore") | c("EligibleOnline"))), "SELECT count(*) FROM products WHERE ProductKey % 15 = 0"),
        (bad("store_type", "stores", "unknown store types", lambda: ~c("StoreType").isin("Online", "Convenience", "Supermarket")), "SELECT count(*) FROM stores WHERE StoreType <> 'Online' AND StoreType <> 'Convenience' AND StoreType <> 'Supermarket'"),
        (share("online_stores", "stores", "share of online stores", lambda: c("StoreType") == "Online", 0.1, 0.5), "SELECT round(sum(CASE StoreType WHEN 'Online' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) FROM stores"),
        (bad("empty_region", "geography", "countries without a region", lambda: c("Region").isNull()), "SELECT count(*) - count(Region) FROM geography"),
    ],
    "versions": [
        (bad("starts_before_ends", "dim", "versions that end before they start", lambda: c("EffectiveEndDate") < c("EffectiveStartDate")), "SELECT count(*) FROM v WHERE EffectiveStartDate > EffectiveEndDate"),
        (bad("follows", "dim", "versions that do not follow on the day after", lambda: F.datediff("EffectiveStartDate", "PreviousEnd") != 1), "SELECT count(*) FROM v WHERE pe + 1 <> EffectiveStartDate"),
        (bad("first_is_1", "dim", "first versions not numbered 1", lambda: c("PreviousEnd").isNull() & (c("VersionNumber") != 1)), "SELECT count(*) FROM (SELECT min(VersionNumber) AS n FROM v GROUP BY CustomerKey) WHERE n <> 1"),
        (bad("numbers", "dim", "version numbers above the count of versions", lambda: c("VersionNumber") > c("Of")), "SELECT count(*) FROM v JOIN (SELECT CustomerKey, count(*) AS n FROM v GROUP BY 1) USING (CustomerKey) WHERE VersionNumber > n"),
        (bad("one_current", "dim", "versions of entities without exactly one current", lambda: c("NowCurrent") != 1), "SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM v GROUP BY CustomerKey HAVING count(*) FILTER (IsCurrent) <> 1)"),
        (bad("current_is_open", "dim", "current versions with an end, or ended ones without", lambda: c("IsCurrent") != (c("EffectiveEndDate") == F.lit("2099-12-31").cast("date"))), "SELECT count(*) FROM v WHERE (IsCurrent AND EffectiveEndDate < DATE '2099-12-31') OR (NOT IsCurrent AND EffectiveEndDate >= DATE '2099-12-31')"),
        (bad("changes", "dim", "versions that change nothing", lambda: c("ChannelKey") == c("Before")), "SELECT count(*) FROM v WHERE b = ChannelKey"),
        (info("mean_versions", "dim", "versions an entity", lambda: F.round(F.count("*") / F.count(F.when(c("IsCurrent"), 1)), 6)), "SELECT round(count(*)::DOUBLE / count(DISTINCT CustomerKey), 6) FROM v"),
    ],
    "staff": [
        (bad("assignment_order", "assign", "assignments that end before they start", lambda: c("EndDate") < c("StartDate")), "SELECT count(*) FROM assign WHERE StartDate > EndDate"),
        (bad("overlap_rows", "assign", "assignments that begin 100 days or more before the one before has ended", lambda: F.datediff("PreviousEnd", "StartDate") >= 100), "SELECT count(*) FROM spans WHERE PreviousEnd - StartDate >= 100"),
        (bad("long_assignment", "assign", "assignments of more than 150 days", lambda: F.datediff("EndDate", "StartDate") > 150), "SELECT count(*) FROM assign WHERE StartDate + 150 < EndDate"),
        (bad("null_employee", "sales", "lines without an employee", lambda: c("EmployeeKey").isNull() | (c("EmployeeKey") == 0)), "SELECT count(*) FROM sales WHERE coalesce(EmployeeKey, 0) = 0"),
        (bad("other_store", "sales", "lines of an employee of another store", lambda: F.floor((c("EmployeeKey") - 30_000_000) / 10) != c("StoreKey")), "SELECT count(*) FROM sales WHERE EmployeeKey - EmployeeKey % 10 <> 30000000 + StoreKey * 10"),
        (share("manager_sales", "sales", "share of lines sold by managers", lambda: c("EmployeeKey") % 10 == 0, 0.0, 0.5), "SELECT round(count(*) FILTER (EmployeeKey % 10 = 0)::DOUBLE / count(*), 6) FROM sales"),
        (share("online_channel", "sales", "share of lines of online stores by the first channel", lambda: (c("StoreType") == "Online") & (c("ChannelKey") == 1), 0.0, 0.2), "SELECT round(sum(CASE WHEN StoreType = 'Online' AND ChannelKey = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) FROM sl"),
        (info("managers", "employees", "managers", lambda: F.count(F.when(c("IsManager"), 1))), "SELECT count(*) FROM staff WHERE EmployeeKey % 10 = 0"),
        (info("assignments", "assign", "assignments", lambda: F.count("*")), "SELECT count(*) FROM assign"),
    ],
}


def suites() -> dict:
    return {name: [rule for rule, _ in rules] for name, rules in BOOK.items()}


def _row(suite, rule, sql) -> str:
    category, low, high = (rule.category, rule.low, rule.high) if not isinstance(rule, Keys) else ("keys", 0, 0)
    result = "'INFO'" if low is None else f"CASE WHEN v BETWEEN {low} AND {high} THEN 'PASS' ELSE 'FAIL' END"
    return f"SELECT '{suite}' AS suite, '{category}' AS category, '{rule.check}' AS \"check\", '{rule.description}' AS description, {result} AS result, v::DOUBLE AS actual_value FROM (SELECT ({sql}) AS v)"


EVERY = " UNION ALL ".join(_row(s, r, sql) for s, rules in BOOK.items() for r, sql in rules)


@register("run_all_checks", HEAD + f", every AS ({EVERY}) SELECT * FROM every UNION ALL SELECT 'summary', 'summary', 'verdict', count(*) || ' checks', CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL' ELSE 'PASS' END, (count(*) FILTER (result = 'FAIL'))::DOUBLE FROM every")
def run_all_checks(spark, sf):
    """All suites of the book, each table scanned once."""
    return run_suites(spark, {t: (lambda f=f: f(spark, sf)) for t, f in TABLES.items()}, suites())
