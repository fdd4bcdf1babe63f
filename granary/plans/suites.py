"""Queries: check suites over the star. A rule's condition is one text, read by Spark and by the SQL alike."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from granary.operators import checks as K
from granary.operators import intervals as I
from granary.plans import domain as D
from granary.plans import star as S
from granary.plans.checks import row, union
from granary.plans.history import ASSIGN, assignments, versions
from granary.plans.registry import oracle_sql, register
from granary.plans.star import STAR

#: Tables of the suites: builder, and the SQL that comes before them.
PRICES = """, pc AS (SELECT ProductKey, make_date(year(OrderDate), 1, 1) AS d, max(UnitPrice)::DOUBLE AS Price FROM sales GROUP BY 1, 2), pk AS (SELECT * FROM (SELECT *, lag(Price) OVER (PARTITION BY ProductKey ORDER BY d) AS b FROM pc) WHERE b IS NULL OR Price <> b),
prices AS (SELECT ProductKey, d AS EffectiveStartDate, Price, b AS Before, row_number() OVER w AS VersionNumber, coalesce((lead(d) OVER w - 1)::DATE, DATE '2099-12-31') AS EffectiveEndDate, lead(d) OVER w IS NULL AS IsCurrent, lag(lead_end) OVER w AS PreviousEnd FROM (SELECT *, (lead(d) OVER (PARTITION BY ProductKey ORDER BY d) - 1)::DATE AS lead_end FROM pk) WINDOW w AS (PARTITION BY ProductKey ORDER BY d)) """
FLAT = ", flat AS (SELECT s.*, t.StoreType, t.WarehouseKey, t.Country AS StoreCountry, c.Country AS CustomerCountry, p.EligibleOnline, p.EligibleStore FROM sales s JOIN stores t USING (StoreKey) JOIN customers c USING (CustomerKey) JOIN products p USING (ProductKey)) "
HOUSES = ", warehouses AS (SELECT WarehouseKey, count(*) AS Stores, count(DISTINCT Country) AS Countries FROM stores GROUP BY 1) "
PERIODS = ", periods AS (" + oracle_sql()["subscription_periods"] + ") "
PER = " , per AS (SELECT SubscriptionKey, count(*) AS n, max(BillingCycleNumber) AS hi, count(CASE WHEN IsFirstPeriod THEN 1 END) AS firsts, count(CASE WHEN IsChurnPeriod THEN 1 END) AS churns FROM periods GROUP BY 1) "
SPANS = ", spans AS (SELECT *, lag(EndDate) OVER (PARTITION BY StoreKey, EmployeeKey ORDER BY StartDate, EndDate) AS PreviousEnd FROM assign) "


def prices(spark, sf):
    """Versions of products by the highest unit price of a year."""
    from pyspark.sql import Window as W

    own = S.sales(spark, sf).groupBy("ProductKey", F.trunc("OrderDate", "year").alias("d")).agg(F.max("UnitPrice").cast("double").alias("Price"))
    w = W.partitionBy("ProductKey").orderBy("EffectiveStartDate")
    built = I.scd2_build(own, ["ProductKey"], "d", ["Price"])
    return built.withColumns({"Before": F.lag("Price").over(w), "PreviousEnd": F.lag("EffectiveEndDate").over(w)})


def flat(spark, sf):
    stores = S.stores(spark, sf).select("StoreKey", "StoreType", "WarehouseKey", F.col("Country").alias("StoreCountry"))
    people = S.customers(spark, sf).select("CustomerKey", F.col("Country").alias("CustomerCountry"))
    goods = S.products(spark, sf).select("ProductKey", "EligibleOnline", "EligibleStore")
    return S.sales(spark, sf).join(stores, "StoreKey").join(people, "CustomerKey").join(goods, "ProductKey")


def warehouses(spark, sf):
    return S.stores(spark, sf).groupBy("WarehouseKey").agg(F.count("*").alias("Stores"), F.countDistinct("Country").alias("Countries"))


def per_subscription(spark, sf):
    counted = D.subscription_periods(spark, sf).groupBy("SubscriptionKey")
    return counted.agg(F.count("*").alias("n"), F.max("BillingCycleNumber").alias("hi"), K.count_where("IsFirstPeriod").alias("firsts"), K.count_where("IsChurnPeriod").alias("churns"))


def spans(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("StoreKey", "EmployeeKey").orderBy("StartDate", "EndDate")
    return assignments(spark, sf).withColumn("PreviousEnd", F.lag("EndDate").over(w))


TABLES = {
    "sales": S.sales, "stores": S.stores, "customers": S.customers, "products": S.products, "geography": S.geography, "flat": flat, "prices": prices, "warehouses": warehouses,
    "dim": versions, "assign": assignments, "spans": spans, "periods": D.subscription_periods, "per": per_subscription, "returns": lambda spark, sf: S.returns(S.sales(spark, sf)),
}


def in_sql(condition: str) -> str:
    return re.sub(r"datediff\((\w+), (\w+)\)", r"(\1 - \2)", condition)


class Suite:
    """Checks of one suite, by what they need of a table, and as SQL."""

    def __init__(self, name: str, head: str = ""):
        self.name, self.head, self.rules, self.keys, self.rows = name, head, [], [], []

    def bad(self, table: str, *rules: tuple[str, str, str]) -> "Suite":
        """Rows that no rule may hold of. Days between dates are written as datediff(end, start), a difference in the SQL."""
        self.rules += [(table, n, d, lambda c=c: K.count_where(c), 0.0, 0.0) for n, d, c in rules]
        self.rows += [row(n, d, f"(SELECT count(*) FROM {table} WHERE {in_sql(c)})", self.name) for n, d, c in rules]
        return self

    def repeated(self, table: str, *keys: str) -> "Suite":
        name, told = f"{table}_{'_'.join(keys)}", f"repeated {', '.join(keys)}"
        self.keys.append((("repeated", table, keys), ("quality", name, told)))
        self.rows.append(row(name, told, f"(SELECT count(*) FROM (SELECT 1 FROM {table} GROUP BY {', '.join(keys)} HAVING count(*) > 1))", self.name))
        return self

    def orphan(self, child: str, key: str, parent: str, pk: str) -> "Suite":
        name, told = f"{child}_{key}_{parent}", f"{key} without a dimension row"
        self.keys.append((("orphan", child, key, parent, pk), ("foreign key", name, told)))
        self.rows.append(row(name, told, f"(SELECT count(DISTINCT {key}) FROM {child} WHERE {key} NOT IN (SELECT {pk} FROM {parent}))", self.name, "foreign key"))
        return self

    def share(self, table: str, name: str, condition: str, low: float, high: float) -> "Suite":
        told = f"share between {low} and {high}"
        self.rules.append((table, name, told, lambda: K.share_of(condition), low, high))
        self.rows.append(row(name, told, f"(SELECT round(count(CASE WHEN {in_sql(condition)} THEN 1 END)::DOUBLE / nullif(count(*), 0)::DOUBLE, 6) FROM {table})", self.name, good=f"v BETWEEN {low} AND {high}"))
        return self

    def frame(self, spark, sf):
        return K.scorecard(together([self], spark, sf))

    def register(self) -> "Suite":
        register(self.name, STAR + self.head + union(*self.rows))(self.frame)
        return self


def together(suites: list[Suite], spark, sf) -> list:
    """Frames of checks of suites: one scan a table for all its conditions and shares, one for each key that some suite looks at."""
    rules, keys = defaultdict(list), defaultdict(list)
    for s in suites:
        for table, n, d, value, low, high in s.rules:
            rules[table].append((s.name, "quality", n, d, value(), low, high))
        for need, (category, n, d) in s.keys:
            keys[need].append((s.name, category, n, d, F.count("*"), 0.0, 0.0))
    made = {t: TABLES[t](spark, sf) for t in {*rules, *(k[1] for k in keys), *(k[3] for k in keys if k[0] == "orphan")}}
    frames = [K.measured(made[t], r) for t, r in rules.items()]
    for (kind, table, *more), r in keys.items():
        found = K.repeated(made[table], *more) if kind == "repeated" else I.orphans(made[table], more[0], made[more[1]], more[2])
        frames.append(K.measured(found, r))
    return frames


SUITES = [
    Suite("customer_checks").bad("customers", ("name", "customers without a name", "FullName IS NULL OR FullName = ''"), ("country", "customers without a country", "Country IS NULL"), ("balance", "balances out of range", "Balance < -1000 OR Balance > 10000"), ("segment", "customers without a segment", "Segment IS NULL OR Segment = ''")).repeated("customers", "CustomerKey").orphan("customers", "GeographyKey", "geography", "GeographyKey"),
    Suite("product_checks").bad("products", ("price", "prices of 0 or less", "ListPrice <= 0"), ("brand", "products without a brand", "Brand IS NULL OR Brand = ''"), ("size", "sizes out of range", "Size < 1 OR Size > 50"), ("category", "products without a category", "Category IS NULL"), ("channels", "products of no channel", "NOT EligibleStore AND NOT EligibleOnline")).repeated("products", "ProductKey"),
    Suite("store_checks").bad("stores", ("type", "unknown store types", "StoreType NOT IN ('Online', 'Convenience', 'Supermarket')"), ("warehouse", "warehouses out of range", "WarehouseKey < 0 OR WarehouseKey > 6"), ("region", "stores without a region", "Region IS NULL")).repeated("stores", "StoreKey").orphan("stores", "GeographyKey", "geography", "GeographyKey").orphan("sales", "StoreKey", "stores", "StoreKey"),
    Suite("warehouse_checks", HOUSES).bad("warehouses", ("stores", "warehouses without stores", "Stores = 0"), ("countries", "warehouses of more countries than stores", "Countries > Stores"), ("key", "warehouse keys out of range", "WarehouseKey NOT BETWEEN 0 AND 6")).repeated("warehouses", "WarehouseKey"),
    Suite("dimension_quality_checks", PRICES).repeated("geography", "GeographyKey").repeated("geography", "Country").repeated("customers", "CustomerKey").repeated("products", "ProductKey").repeated("stores", "StoreKey").bad("geography", ("geography_null", "geography with nulls", "Country IS NULL OR Region IS NULL")).bad("products", ("price_domain", "prices out of range", "ListPrice <= 0 OR ListPrice > 100000")).bad("stores", ("type_domain", "unknown store types", "StoreType NOT IN ('Online', 'Convenience', 'Supermarket')")).bad("prices", ("date_order", "versions that end before they start", "EffectiveEndDate < EffectiveStartDate")),
    Suite("cross_dimension_checks", FLAT).orphan("stores", "GeographyKey", "geography", "GeographyKey").orphan("customers", "GeographyKey", "geography", "GeographyKey").orphan("stores", "StoreKey", "sales", "StoreKey").orphan("products", "ProductKey", "sales", "ProductKey").bad("sales", ("currency", "unknown currencies", "CurrencyKey < 1 OR CurrencyKey > 5"), ("employee", "employees of a store other than that of the line", "floor((EmployeeKey - 30000000) / 10) <> StoreKey")),
    Suite("cross_dimension_procs", FLAT).orphan("sales", "StoreKey", "stores", "StoreKey").orphan("sales", "ProductKey", "products", "ProductKey").bad("sales", ("employee_band", "employee keys out of their band", "EmployeeKey < 30000000 OR EmployeeKey >= 40000000")).share("flat", "local_customers", "StoreCountry = CustomerCountry", 0.0, 0.5),
    Suite("scd2_product_checks", PRICES).bad("prices", ("sequence", "first versions with one before", "VersionNumber = 1 AND Before IS NOT NULL"), ("unchanged", "versions that change nothing", "Price = Before"), ("gaps", "versions that do not follow on the day after", "PreviousEnd IS NOT NULL AND datediff(EffectiveStartDate, PreviousEnd) <> 1"), ("free", "prices of 0 or less", "Price <= 0")).share("prices", "raised", "Price > Before", 0.1, 0.9).share("prices", "current", "IsCurrent", 0.05, 1.0),
    Suite("sales_relationship_checks").orphan("sales", "CustomerKey", "customers", "CustomerKey").orphan("sales", "ProductKey", "products", "ProductKey").orphan("sales", "StoreKey", "stores", "StoreKey").bad("sales", ("promotion", "unknown promotions", "PromotionKey < 1 OR PromotionKey > 11"), ("discount", "discounts out of range", "DiscountAmount < 0 OR DiscountAmount > UnitPrice"), ("net", "net prices that are not unit price less discount", "NetPrice <> UnitPrice - DiscountAmount"), ("quantity", "quantities out of range", "Quantity < 1 OR Quantity > 50"), ("due", "due before the order", "DueDate < OrderDate")),
    Suite("fact_procs", FLAT).share("sales", "delayed", "IsOrderDelayed", 0.0, 0.6).share("sales", "returned", "ReturnFlag = 'R'", 0.01, 0.6).share("sales", "discounted", "DiscountAmount > 0", 0.1, 0.99).share("sales", "same_day", "DueDate = OrderDate", 0.0, 0.1).share("flat", "online", "StoreType = 'Online'", 0.1, 0.5),
    Suite("correlation_scorecard", FLAT).share("flat", "store_channel", "StoreType = 'Online' AND ChannelKey = 1", 0.0, 0.2).share("flat", "customer_store_country", "StoreCountry = CustomerCountry", 0.0, 0.5).share("flat", "channel_delivery", "ChannelKey >= 4 AND IsOrderDelayed", 0.0, 0.4).share("flat", "channel_product", "StoreType = 'Online' AND NOT EligibleOnline", 0.0, 0.2).share("flat", "channel_promotion", "StoreType = 'Online' AND PromotionKey > 6", 0.0, 0.3),
    Suite("staff_store_sales_checks", ASSIGN + SPANS).bad("assign", ("assign_null", "assignments with null keys", "StoreKey IS NULL OR EmployeeKey IS NULL"), ("assign_order", "assignments that end before they start", "EndDate < StartDate"), ("assign_long", "assignments of over 200 days", "datediff(EndDate, StartDate) > 200")).bad("spans", ("overlaps", "assignments that overlap the one before", "StartDate <= PreviousEnd"), ("gap_days", "gaps of over 900 days", "datediff(StartDate, PreviousEnd) > 900")).orphan("assign", "StoreKey", "stores", "StoreKey").orphan("stores", "StoreKey", "assign", "StoreKey").bad("sales", ("employee_null", "lines without an employee", "EmployeeKey IS NULL"), ("employee_store", "lines of an employee of another store", "floor((EmployeeKey - 30000000) / 10) <> StoreKey")).repeated("assign", "StoreKey", "EmployeeKey", "Q"),
    Suite("staff_procs", ASSIGN + SPANS).share("spans", "overlapping", "StartDate <= PreviousEnd", 0.0, 0.5).share("assign", "short", "datediff(EndDate, StartDate) < 7", 0.0, 0.5).orphan("assign", "StoreKey", "stores", "StoreKey"),
    Suite("subscription_checks", PERIODS + PER).bad("per", ("first_period", "subscriptions without exactly one first period", "firsts <> 1"), ("contiguous", "cycle numbers with gaps", "hi <> n"), ("churn", "subscriptions with more than one churn period", "churns > 1")).bad("periods", ("date_order", "periods that end before they start", "PeriodEndDate < PeriodStartDate"), ("number", "cycle numbers below 1", "BillingCycleNumber < 1")).orphan("periods", "CustomerKey", "customers", "CustomerKey"),
    Suite("secondary_facts_scorecard", PERIODS + PER).bad("returns", ("return_quantity", "returns of nothing", "ReturnQuantity < 1"), ("return_reason", "unknown reasons", "ReturnReasonKey < 1 OR ReturnReasonKey > 8")).repeated("returns", "OrderNumber", "OrderLineNumber").orphan("returns", "OrderNumber", "sales", "OrderNumber").share("per", "churned", "churns > 0", 0.2, 0.8),
]
for suite in SUITES:
    suite.register()


@register("all_suites", "SELECT suite, result, count(*) AS Checks FROM (" + " UNION ALL ".join(f"SELECT * FROM ({STAR + s.head + union(*s.rows)})" for s in SUITES) + ") GROUP BY 1, 2")
def all_suites(spark, sf):
    """Results of all suites, counted. Scans run one after the other, so that the driver holds one plan and its broadcasts; of each comes a row a check."""
    rows = [tuple(r) for f in together(SUITES, spark, sf) for r in f.select("suite", "result").collect()]
    return spark.createDataFrame(rows, "suite string, result string").groupBy("suite", "result").agg(F.count("*").alias("Checks"))


@register("subscription_churn", STAR + PERIODS + "SELECT count(DISTINCT SubscriptionKey) AS Subscriptions, count(DISTINCT CASE WHEN IsChurnPeriod THEN SubscriptionKey END) AS Churned, round(count(DISTINCT CASE WHEN IsChurnPeriod THEN SubscriptionKey END)::DOUBLE / count(DISTINCT SubscriptionKey)::DOUBLE, 6) AS ChurnRate FROM periods")
def subscription_churn(spark, sf):
    return K.churn_rate(D.subscription_periods(spark, sf))


MOVES = ", moves AS (SELECT OrderNumber, CustomerKey, OrderDate, StoreKey, CASE WHEN StoreKey % 3 = 0 THEN 'transfer' WHEN StoreKey % 3 = 1 THEN 'closing' END AS Reason FROM sales WHERE OrderLineNumber = 1) "


@register("transition_violations", STAR + MOVES + "SELECT CustomerKey, OrderNumber, StoreKey, Previous FROM (SELECT *, lag(StoreKey) OVER (PARTITION BY CustomerKey ORDER BY OrderDate, OrderNumber) AS Previous FROM moves) WHERE Previous <> StoreKey AND (Reason IS NULL OR Reason <> 'transfer')")
def transition_violations(spark, sf):
    moves = S.sales(spark, sf).where("OrderLineNumber = 1").withColumn("Reason", F.expr("CASE WHEN StoreKey % 3 = 0 THEN 'transfer' WHEN StoreKey % 3 = 1 THEN 'closing' END"))
    return K.transition_violations(moves, ["CustomerKey"], ["OrderDate", "OrderNumber"], "StoreKey", "Reason", ["transfer"]).select("CustomerKey", "OrderNumber", "StoreKey", "Previous")
