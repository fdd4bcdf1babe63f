"""Queries: integrity, distribution, version and coverage checks."""

from pyspark.sql import functions as F

from granary.operators import checks as K
from granary.operators import intervals as I
from granary.operators import rollups as R
from granary.plans import star as S
from granary.plans.history import ASSIGN, CHANGES, assignments, orders, versions
from granary.plans.registry import register
from granary.plans.star import STAR


def q(name: str, sql: str):
    return register(name, STAR + sql)


def row(name: str, description: str, value: str, suite: str = "core", category: str = "quality", good: str = "v = 0") -> str:
    return f"SELECT '{suite}' AS suite, '{category}' AS category, '{name}' AS \"check\", '{description}' AS description, CASE WHEN {good} THEN 'PASS' ELSE 'FAIL' END AS result, v::DOUBLE AS actual_value FROM (SELECT {value} AS v)"


def union(*rows: str) -> str:
    return " UNION ALL ".join(rows)


FKS = [("ProductKey", "products"), ("StoreKey", "stores"), ("CustomerKey", "customers")]


@q("fk_check", union(*[row(f"sales_{d}", f"{k} without a dimension row", f"(SELECT count(DISTINCT {k}) FROM sales WHERE {k} NOT IN (SELECT {k} FROM {d}))", "integrity", "foreign key") for k, d in FKS]))
def fk_check(spark, sf):
    lines = S.sales(spark, sf)
    return K.scorecard([K.fk_check(lines, k, getattr(S, d)(spark, sf), k, f"sales_{d}") for k, d in FKS])


@q("fk_fact_to_fact", row("returns_orders", "OrderNumber without a dimension row", "(SELECT count(DISTINCT OrderNumber) FROM returns WHERE OrderNumber NOT IN (SELECT OrderNumber FROM sales WHERE Quantity > 3))", "integrity", "foreign key"))
def fk_fact_to_fact(spark, sf):
    lines = S.sales(spark, sf)
    return K.fk_check(S.returns(lines), "OrderNumber", lines.where("Quantity > 3"), "OrderNumber", "returns_orders")


@q("date_range_check", union(row("first_order", "orders before 1995", "(SELECT count(*) FROM sales WHERE OrderDate < DATE '1995-01-01')"), row("last_order", "orders after 2001-06", "(SELECT count(*) FROM sales WHERE OrderDate > DATE '2001-06-30')")))
def date_range_check(spark, sf):
    lines = S.sales(spark, sf)
    return K.scorecard([K.check(lines, K.count_where("OrderDate < date '1995-01-01'"), "first_order", "orders before 1995"), K.check(lines, K.count_where("OrderDate > date '2001-06-30'"), "last_order", "orders after 2001-06")])


PK = union(row("lines_null", "lines: null keys", "(SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL)", "integrity", "primary key"), row("lines_duplicate", "lines: repeated keys", "(SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))", "integrity", "primary key"))


@register("pk_duplicate", PK)
def pk_duplicate(spark, sf):
    return K.pk_checks(S.read(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]), ["l_orderkey", "l_linenumber"], "lines")


@register("pk_null", row("orders_null", "orders: null keys", "(SELECT count(*) FROM orders WHERE o_orderkey IS NULL)", "integrity", "primary key"))
def pk_null(spark, sf):
    return K.check(S.read(spark, sf, "orders"), K.count_where("o_orderkey is null"), "orders_null", "orders: null keys", "integrity", "primary key")


DIST = union(row("mean_quantity", "mean quantity in 0.5 to 10", "(SELECT sum(Quantity)::DOUBLE / count(*) FROM sales)", good="v BETWEEN 0.5 AND 10"), row("negative_price", "prices below 0", "(SELECT count(*) FROM sales WHERE NetPrice < 0)"), row("net_above_unit", "net above unit price", "(SELECT count(*) FROM sales WHERE NetPrice > UnitPrice)"), row("delivered_before_order", "deliveries before orders", "(SELECT count(*) FROM sales WHERE DeliveryDate < OrderDate)"))


def _dist(spark, sf):
    lines = S.sales(spark, sf)
    mean = R.ratio(F.sum("Quantity"), F.count("*"))
    return [K.check(lines, mean, "mean_quantity", "mean quantity in 0.5 to 10", good=F.col("v").between(0.5, 10)), K.check(lines, K.count_where("NetPrice < 0"), "negative_price", "prices below 0"), K.check(lines, K.count_where("NetPrice > UnitPrice"), "net_above_unit", "net above unit price"), K.check(lines, K.count_where("DeliveryDate < OrderDate"), "delivered_before_order", "deliveries before orders")]


@q("dist_sanity", DIST)
def dist_sanity(spark, sf):
    return K.scorecard(_dist(spark, sf))


FK_SQL = union(*[row(f"sales_{d}", f"{k} without a dimension row", f"(SELECT count(DISTINCT {k}) FROM sales WHERE {k} NOT IN (SELECT {k} FROM {d}))", "integrity", "foreign key") for k, d in FKS])


@q("scorecard_union", f"SELECT * FROM ({DIST} UNION ALL {PK} UNION ALL {FK_SQL})")
def scorecard_union(spark, sf):
    """Checks of three kinds as one scorecard."""
    return K.scorecard([*_dist(spark, sf), pk_duplicate(spark, sf), fk_check(spark, sf)])


@q("quality_report_table", f", every AS ({DIST} UNION ALL {PK}) SELECT category, result, count(*) AS Checks FROM every GROUP BY 1, 2")
def quality_report_table(spark, sf):
    every = K.scorecard([*_dist(spark, sf), pk_duplicate(spark, sf)])
    return every.groupBy("category", "result").agg(F.count("*").alias("Checks"))


@q("run_distribution_checks", f", every AS ({DIST}) SELECT * FROM every UNION ALL SELECT 'summary', 'summary', 'verdict', count(*) || ' checks', CASE WHEN count(CASE WHEN result = 'FAIL' THEN 1 END) = 0 THEN 'PASS' ELSE 'FAIL' END, count(CASE WHEN result = 'FAIL' THEN 1 END)::DOUBLE FROM every")
def run_distribution_checks(spark, sf):
    return K.run_all(_dist(spark, sf))


SCD = CHANGES + union(
    row("one_current", "entities without exactly one current version", "(SELECT count(*) FROM (SELECT 1 FROM dim GROUP BY CustomerKey HAVING count(CASE WHEN IsCurrent THEN 1 END) <> 1))", "scd2"),
    row("sequential", "version numbers with gaps", "(SELECT count(*) FROM (SELECT 1 FROM dim GROUP BY CustomerKey HAVING max(VersionNumber) <> count(*) OR min(VersionNumber) <> 1))", "scd2"),
    row("start_before_end", "versions that end before they start", "(SELECT count(*) FROM dim WHERE EffectiveStartDate > EffectiveEndDate)", "scd2"),
    row("gaps", "versions that do not follow on the day after", "(SELECT count(*) FROM (SELECT EffectiveStartDate, lag(EffectiveEndDate) OVER (PARTITION BY CustomerKey ORDER BY VersionNumber) AS p FROM dim) WHERE EffectiveStartDate <> p + 1)", "scd2"),
)


@q("scd2_checks", SCD)
def scd2_checks(spark, sf):
    dim = versions(spark, sf).persist()
    per = dim.groupBy("CustomerKey").agg(K.count_where("IsCurrent").alias("c"), F.max("VersionNumber").alias("hi"), F.min("VersionNumber").alias("lo"), F.count("*").alias("n"))
    gaps = I.contiguity(dim, ["CustomerKey"], "EffectiveStartDate", "EffectiveEndDate")
    return K.scorecard([
        K.check(per, K.count_where("c <> 1"), "one_current", "entities without exactly one current version", "scd2"),
        K.check(per, K.count_where("hi <> n or lo <> 1"), "sequential", "version numbers with gaps", "scd2"),
        K.check(dim, K.count_where("EffectiveStartDate > EffectiveEndDate"), "start_before_end", "versions that end before they start", "scd2"),
        K.check(gaps, F.count("*"), "gaps", "versions that do not follow on the day after", "scd2"),
    ])


@q("sales_in_assignment", ASSIGN + row("sales_in_assignment", "sales outside assignments", "(SELECT count(*) FROM (SELECT *, ProductKey % 50 AS E FROM sales) s WHERE NOT EXISTS (SELECT 1 FROM assign a WHERE a.StoreKey = s.StoreKey AND a.EmployeeKey = s.E AND s.OrderDate BETWEEN a.StartDate AND a.EndDate))", "staff"))
def sales_in_assignment(spark, sf):
    lines = S.sales(spark, sf).withColumn("E", F.col("ProductKey") % 50).alias("s")
    out = lines.join(assignments(spark, sf).alias("a"), F.expr("a.StoreKey = s.StoreKey AND a.EmployeeKey = s.E AND s.OrderDate BETWEEN a.StartDate AND a.EndDate"), "left_anti")
    return K.check(out, F.count("*"), "sales_in_assignment", "sales outside assignments", "staff")


@q("sales_in_open_store", row("sales_in_open_store", "sales while closed", "(SELECT count(*) FROM sales WHERE StoreKey % 3 = 1 AND OrderDate >= DATE '1998-02-10' AND OrderDate < DATE '1998-03-20')", "staff"))
def sales_in_open_store(spark, sf):
    closed = S.stores(spark, sf).where("StoreKey % 3 = 1").select("StoreKey", F.lit("1998-02-10").cast("date").alias("f"), F.lit("1998-03-20").cast("date").alias("t"))
    rows = S.sales(spark, sf).join(closed, "StoreKey").where("OrderDate >= f and OrderDate < t")
    return K.check(rows, F.count("*"), "sales_in_open_store", "sales while closed", "staff")


@q("post_transfer_leakage", ASSIGN + row("post_transfer_leakage", "sales after the last assignment", "(SELECT count(*) FROM (SELECT *, ProductKey % 50 AS E FROM sales) s JOIN (SELECT StoreKey, EmployeeKey, max(EndDate) AS e FROM assign WHERE Q < DATE '2000-01-01' GROUP BY 1, 2) l ON l.StoreKey = s.StoreKey AND l.EmployeeKey = s.E WHERE s.OrderDate > l.e)", "staff"))
def post_transfer_leakage(spark, sf):
    last = assignments(spark, sf).where("Q < '2000-01-01'").groupBy("StoreKey", F.col("EmployeeKey").alias("E")).agg(F.max("EndDate").alias("LastEnd"))
    rows = S.sales(spark, sf).withColumn("E", F.col("ProductKey") % 50).join(last, ["StoreKey", "E"]).where("OrderDate > LastEnd")
    return K.check(rows, F.count("*"), "post_transfer_leakage", "sales after the last assignment", "staff")


@q("assignment_sequence", ASSIGN + row("assignment_sequence", "sequences that are not 1 to n", "(SELECT count(*) FROM (SELECT 1 FROM (SELECT *, row_number() OVER (PARTITION BY EmployeeKey ORDER BY StartDate, StoreKey, EndDate) AS k FROM assign) WHERE k <> 2 GROUP BY EmployeeKey HAVING max(k) <> count(*)))", "staff"))
def assignment_sequence(spark, sf):
    from granary.operators.ordered import sequence_within

    rows = sequence_within(assignments(spark, sf), ["EmployeeKey"], ["StartDate", "StoreKey", "EndDate"], "k").where("k <> 2")
    per = rows.groupBy("EmployeeKey").agg(F.max("k").alias("hi"), F.count("*").alias("n"))
    return K.check(per, K.count_where("hi <> n"), "assignment_sequence", "sequences that are not 1 to n", "staff")


@q("value_list_info", "SELECT string_agg(x, ', ' ORDER BY x) AS \"Values\" FROM (SELECT StoreType || ':' || count(*) AS x FROM stores GROUP BY StoreType)")
def value_list_info(spark, sf):
    return K.value_list(S.stores(spark, sf), "StoreType")


RELS = [("sales", "ProductKey", "products", "ProductKey"), ("sales", "StoreKey", "stores", "StoreKey"), ("stores", "GeographyKey", "geography", "GeographyKey"), ("customers", "GeographyKey", "geography", "GeographyKey")]


@q("model_relationships", union(*[f"SELECT '{c}.{ck} -> {p}.{pk}' AS Relationship, (SELECT count(DISTINCT {ck}) FROM {c} WHERE {ck} NOT IN (SELECT {pk} FROM {p})) AS Orphans, (SELECT count(*) FROM (SELECT 1 FROM {p} GROUP BY {pk} HAVING count(*) > 1)) AS RepeatedParents, (SELECT count(*) FROM {c} WHERE {ck} IS NULL) AS NullChildren" for c, ck, p, pk in RELS]))
def model_relationships(spark, sf):
    names = {x for r in RELS for x in (r[0], r[2])}
    return K.relationships({n: getattr(S, n)(spark, sf) for n in names}, RELS)


@q("geography_checks", union(row("country_key", "repeated countries", "(SELECT count(*) FROM (SELECT 1 FROM geography GROUP BY Country HAVING count(*) > 1))", "geography"), row("regions", "regions without a name", "(SELECT count(*) FROM geography WHERE Region IS NULL OR Region = '')", "geography")))
def geography_checks(spark, sf):
    geo = S.geography(spark, sf)
    twice = geo.groupBy("Country").agg(F.count("*").alias("n"))
    return K.scorecard([K.check(twice, K.count_where("n > 1"), "country_key", "repeated countries", "geography"), K.check(geo, K.count_where("Region is null or Region = ''"), "regions", "regions without a name", "geography")])


@q("fact_distribution_scorecard", union(row("monthly_variation", "variation of months above 0.1", "(SELECT round(stddev_samp(n) / avg(n), 6) FROM (SELECT count(*) AS n FROM sales GROUP BY date_trunc('month', OrderDate)))", "facts", good="v > 0.1"), row("largest_customer", "largest share of one customer at most 0.05", "(SELECT max(n)::DOUBLE / sum(n)::DOUBLE FROM (SELECT count(*) AS n FROM sales GROUP BY CustomerKey))", "facts", good="v <= 0.05")))
def fact_distribution_scorecard(spark, sf):
    lines = S.sales(spark, sf)
    months = lines.groupBy(F.trunc("OrderDate", "month")).agg(F.count("*").alias("n"))
    people = lines.groupBy("CustomerKey").agg(F.count("*").alias("n"))
    return K.scorecard([K.check(months, F.round(F.stddev_samp("n") / F.avg("n"), 6), "monthly_variation", "variation of months above 0.1", "facts", good=F.col("v") > 0.1), K.check(people, R.ratio(F.max("n"), F.sum("n")), "largest_customer", "largest share of one customer at most 0.05", "facts", good=F.col("v") <= 0.05)])


@q("temporal_scorecard", row("gap_months", "months without orders", "(SELECT date_diff('month', min(OrderDate), max(OrderDate)) + 1 - count(DISTINCT date_trunc('month', OrderDate)) FROM sales)", "temporal"))
def temporal_scorecard(spark, sf):
    one = orders(spark, sf)
    index = I.month_index("OrderDate")
    return K.check(one, F.max(index) - F.min(index) + 1 - F.countDistinct(index), "gap_months", "months without orders", "temporal")


@q("require_columns", "SELECT ProductKey, ListPrice::DOUBLE AS ListPrice FROM products")
def require_columns(spark, sf):
    from granary.sources.tables import require_columns

    return require_columns(S.products(spark, sf), ["ProductKey", "ListPrice"], "pricing").select("ProductKey", F.col("ListPrice").cast("double").alias("ListPrice"))


@q("pre_join_validate", "SELECT CustomerKey FROM customers")
def pre_join_validate(spark, sf):
    own = S.customers(spark, sf)
    return K.require(own, F.col("CustomerKey").isNotNull(), "a customer has no key").select("CustomerKey")
