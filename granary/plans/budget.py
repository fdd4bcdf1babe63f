"""Queries: budgets."""

from granary.functions.hashing import jitter_sql
from granary.operators import budget as B
from granary.plans import star as S
from granary.plans.registry import register
from granary.plans.star import STAR
from granary.sources.tables import checkpointed

ACTUALS = """, actuals AS (
  SELECT coalesce(Country, 'Unknown') AS Country, coalesce(Category, 'Unknown') AS Category, year(OrderDate) AS "Year", month(OrderDate) AS "Month", ChannelKey,
    sum(Quantity * NetPrice)::DOUBLE AS SalesAmount, sum(Quantity)::DOUBLE AS SalesQuantity
  FROM sales LEFT JOIN (SELECT StoreKey, Country FROM stores) USING (StoreKey) LEFT JOIN (SELECT ProductKey, Category FROM products) USING (ProductKey)
  GROUP BY 1, 2, 3, 4, 5 HAVING sum(Quantity * NetPrice) <> 0 OR sum(Quantity) <> 0)
"""
CLIP = "CASE WHEN {0} IS NOT NULL THEN least(greatest({0}, -0.2), 0.3) END"


def grow(amount: str, over: str) -> str:
    return CLIP.format(f"(({amount} - lag({amount}) OVER ({over})) / nullif(lag({amount}) OVER ({over}), 0))")


YEARLY = f""", annual AS (SELECT Country, Category, "Year", round(sum(SalesAmount) * 100)::BIGINT / 100.0::DOUBLE AS SalesAmount, round(sum(SalesAmount) * 100)::HUGEINT AS a, round(sum(SalesQuantity) * 100)::HUGEINT AS q FROM actuals GROUP BY 1, 2, 3),
loc AS (SELECT *, {grow('SalesAmount', 'PARTITION BY Country, Category ORDER BY "Year"')} AS l FROM annual),
cat1 AS (SELECT Category, "Year", round(sum(SalesAmount), 2) AS a FROM annual GROUP BY 1, 2),
cat2 AS (SELECT *, {grow('a', 'PARTITION BY Category ORDER BY "Year"')} AS g FROM cat1),
cat3 AS (SELECT Category, "Year", avg(g) OVER (PARTITION BY Category ORDER BY "Year" ROWS 2 PRECEDING) AS c FROM cat2),
all1 AS (SELECT "Year", round(sum(SalesAmount), 2) AS a FROM annual GROUP BY 1),
all2 AS (SELECT *, {grow('a', 'ORDER BY "Year"')} AS g FROM all1),
all3 AS (SELECT "Year", avg(g) OVER (ORDER BY "Year" ROWS 2 PRECEDING) AS o FROM all2),
grown AS (SELECT loc.*, CASE WHEN (l IS NULL AND c IS NULL AND o IS NULL) THEN 0.05::DOUBLE ELSE (coalesce(l * 0.6::DOUBLE, 0) + coalesce(c * 0.3::DOUBLE, 0) + coalesce(o * 0.1::DOUBLE, 0)) / (CASE WHEN l IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN c IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN o IS NULL THEN 0 ELSE 0.1::DOUBLE END) END AS base FROM loc LEFT JOIN cat3 USING (Category, "Year") LEFT JOIN all3 USING ("Year")),
span AS (SELECT min("Year") AS f, max("Year") AS t FROM annual),
parts AS (
  SELECT Country, Category, "Year" + 1 AS BudgetYear, base, a, q, 0 AS back, 'forward' AS BudgetMethod FROM grown, span WHERE "Year" + 1 <= t
  UNION ALL SELECT Country, Category, "Year", 0.0::DOUBLE, a, q, 0, 'first' FROM grown, span WHERE "Year" = f
  UNION ALL SELECT Country, Category, "Year" - 1, -0.05::DOUBLE, a, q, 50000, 'before-first' FROM grown, span WHERE "Year" = f),
growth AS (SELECT parts.*, Scenario, round((base + {jitter_sql('Country', 'Category', 'BudgetYear')} + adj) * 1000000)::BIGINT AS g FROM parts, (VALUES ('Low', -0.03::DOUBLE), ('Medium', 0.0::DOUBLE), ('High', 0.05::DOUBLE)) s(Scenario, adj)),
yearly AS (SELECT Country, Category, BudgetYear, Scenario, g / 1000000.0::DOUBLE AS BudgetGrowthPct, ((2 * a * (1000000 + g) + 1000000 + back) // (2 * (1000000 + back)))::DOUBLE / 100.0::DOUBLE AS BudgetAmount, ((2 * q * (1000000 + g) + 1000000 + back) // (2 * (1000000 + back)))::DOUBLE / 100.0::DOUBLE AS BudgetQuantity, BudgetMethod FROM growth)
"""
SEASON = """, months AS (SELECT Category, "Year", "Month", round(sum(SalesAmount), 2) AS m FROM actuals GROUP BY 1, 2, 3),
shares AS (SELECT Category, "Month", avg(s) AS s FROM (SELECT *, CASE WHEN sum(m) OVER (PARTITION BY Category, "Year") > 0 THEN m / sum(m) OVER (PARTITION BY Category, "Year") ELSE 1 / 12.0::DOUBLE END AS s FROM months) GROUP BY 1, 2),
season AS (SELECT Category, "Month", s / sum(s) OVER (PARTITION BY Category) AS MonthShare FROM shares)
"""
MONTHLY = SEASON + """, spreaded AS (SELECT y.Country, y.Category, y.BudgetYear, y.Scenario, m.i AS i, a, qn, coalesce(MonthShare, 1 / 12.0::DOUBLE) AS w FROM (SELECT Country, Category, BudgetYear, Scenario, sum(BudgetAmount) AS a, sum(BudgetQuantity) AS qn FROM yearly GROUP BY 1, 2, 3, 4) y CROSS JOIN range(1, 13) m(i) LEFT JOIN season ON season.Category = y.Category AND season."Month" = m.i),
monthly AS (SELECT Country, Category, BudgetYear, make_date(BudgetYear, i, 1) AS BudgetMonthStart, Scenario, round(round(a * (w / sum(w) OVER (PARTITION BY Country, Category, BudgetYear, Scenario)), 6), 2) AS BudgetAmount, round(round(qn * (w / sum(w) OVER (PARTITION BY Country, Category, BudgetYear, Scenario)), 6), 2) AS BudgetQuantity, 'seasonal' AS BudgetMethod FROM spreaded)
"""


def actuals(spark, sf):
    return B.budget_actuals(S.sales(spark, sf), S.stores(spark, sf), S.products(spark, sf))


def written(spark, sf):
    """The actuals, a row for each country, category, month and channel, computed once for the branches of a budget."""
    return checkpointed(actuals(spark, sf))


@register("agg_budget_actuals", STAR + ACTUALS + "SELECT * FROM actuals")
def agg_budget_actuals(spark, sf):
    return actuals(spark, sf)


@register("budget_yearly", STAR + ACTUALS + YEARLY + "SELECT * FROM yearly")
def budget_yearly(spark, sf):
    return B.budget_yearly(written(spark, sf))


@register("yoy_growth_capped", STAR + ACTUALS + YEARLY + 'SELECT Country, Category, "Year", round(l, 9) AS Growth FROM loc')
def yoy_growth_capped(spark, sf):
    from pyspark.sql import functions as F

    annual = written(spark, sf).groupBy("Country", "Category", "Year").agg(F.round(F.sum("SalesAmount"), 2).alias("SalesAmount"))
    return B.yoy(annual, ["Country", "Category"], "Year", "SalesAmount", "Growth").select("Country", "Category", "Year", F.round("Growth", 9).alias("Growth"))


@register("rolling_growth", STAR + ACTUALS + YEARLY + 'SELECT Category, "Year", round(c, 9) AS Rolling FROM cat3')
def rolling_growth(spark, sf):
    from pyspark.sql import functions as F

    by = written(spark, sf).groupBy("Category", "Year").agg(F.round(F.sum("SalesAmount"), 2).alias("a"))
    out = B.rolling_mean(B.yoy(by, ["Category"], "Year", "a", "g"), ["Category"], "Year", "g", 3, "Rolling")
    return out.select("Category", "Year", F.round("Rolling", 9).alias("Rolling"))


@register("jitter_pct", STAR + f"SELECT Country, {jitter_sql('Country', 'GeographyKey')} AS Jitter FROM geography")
def jitter(spark, sf):
    from pyspark.sql import functions as F

    from granary.functions.hashing import jitter_pct

    return S.geography(spark, sf).select("Country", jitter_pct(F.col("Country"), F.col("GeographyKey")).alias("Jitter"))


@register("seasonal_profile", STAR + ACTUALS + SEASON + 'SELECT Category, "Month", round(MonthShare, 9) AS MonthShare FROM season')
def seasonal_profile(spark, sf):
    from pyspark.sql import functions as F

    return B.seasonal_profile(written(spark, sf)).withColumn("MonthShare", F.round("MonthShare", 9))


@register("budget_monthly", STAR + ACTUALS + YEARLY + MONTHLY + "SELECT * FROM monthly")
def budget_monthly(spark, sf):
    own = written(spark, sf)
    return B.budget_monthly(B.budget_yearly(own), own)


@register("budget_reconcile", STAR + ACTUALS + YEARLY + MONTHLY + "SELECT *, abs(Yearly - Monthly) > 0.02 * abs(Yearly) AS Off FROM (SELECT Country, Category, BudgetYear, Scenario, round(sum(BudgetAmount), 2) AS Yearly FROM yearly GROUP BY 1, 2, 3, 4) JOIN (SELECT Country, Category, BudgetYear, Scenario, round(sum(BudgetAmount), 2) AS Monthly FROM monthly GROUP BY 1, 2, 3, 4) USING (Country, Category, BudgetYear, Scenario)")
def budget_reconcile(spark, sf):
    own = written(spark, sf)
    yearly = B.budget_yearly(own)
    return B.budget_reconcile(yearly, B.budget_monthly(yearly, own))


@register("budget_variance", STAR + ACTUALS + YEARLY + MONTHLY + ", real AS (SELECT Country, Category, make_date(\"Year\", \"Month\", 1) AS BudgetMonthStart, round(sum(SalesAmount), 2) AS Actual FROM actuals GROUP BY 1, 2, 3) SELECT Country, Category, BudgetMonthStart, Scenario, BudgetAmount, coalesce(Actual, 0) AS Actual, round(coalesce(Actual, 0) - BudgetAmount, 2) AS Variance, round(coalesce(Actual, 0) / nullif(BudgetAmount, 0), 6) AS Attained FROM monthly LEFT JOIN real USING (Country, Category, BudgetMonthStart)")
def budget_variance(spark, sf):
    own = written(spark, sf)
    return B.budget_variance(own, B.budget_monthly(B.budget_yearly(own), own))


@register("budget_scenario_stats", STAR + ACTUALS + YEARLY + "SELECT Scenario, round(avg(BudgetGrowthPct), 6) AS MeanGrowth, min(BudgetGrowthPct) AS MinGrowth, max(BudgetGrowthPct) AS MaxGrowth, count(CASE WHEN BudgetAmount < 0 THEN 1 END) AS Negative FROM yearly GROUP BY 1")
def budget_scenario_stats(spark, sf):
    return B.scenario_stats(B.budget_yearly(written(spark, sf)))


@register("budget_month_coverage", STAR + ACTUALS + YEARLY + MONTHLY + "SELECT BudgetYear, Scenario, count(DISTINCT BudgetMonthStart) AS Months FROM monthly GROUP BY 1, 2")
def budget_month_coverage(spark, sf):
    own = written(spark, sf)
    return B.month_coverage(B.budget_monthly(B.budget_yearly(own), own))
