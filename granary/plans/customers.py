"""Queries: customers of a month and their orders, columns of a calendar by what is asked for."""

from pyspark.sql import functions as F

from granary.functions import calendar as C
from granary.functions.hashing import hash_u01, u01_sql
from granary.operators import customers as U
from granary.operators import weights as V
from granary.plans import star as S
from granary.plans.domain import AS_OF, DAYS, days
from granary.plans.registry import register
from granary.plans.star import STAR


def q(name: str, sql: str):
    return register(name, STAR + sql)


def active_customers(spark, sf):
    """Customers from their first to their last order's month, introduced some months after the first."""
    own = S.sales(spark, sf).groupBy("CustomerKey").agg(F.trunc(F.min("OrderDate"), "month").alias("Start"), F.trunc(F.max("OrderDate"), "month").alias("End"))
    lag = F.least(F.floor(-F.ln(1 - hash_u01(F.col("CustomerKey"), seed=3, salt=8)) * 6.0), F.lit(36)).cast("int")
    return own.withColumns({"Debut": F.add_months("Start", lag), "Weight": 1 + F.col("CustomerKey") % 5})


def month_orders(spark, sf):
    return S.sales(spark, sf).groupBy("OrderNumber").agg(F.trunc(F.min("OrderDate"), "month").alias("MonthStart"))


def month_customer_targets(spark, sf):
    """Distinct customers of each month that has orders: a share of the active ones, at least one, no more than its orders."""
    active = active_customers(spark, sf).select(F.explode(F.expr("sequence(Start, End, interval 1 month)")).alias("MonthStart")).groupBy("MonthStart").agg(F.count("*").alias("Active"))
    months = active.join(month_orders(spark, sf).groupBy("MonthStart").agg(F.count("*").alias("Orders")), "MonthStart")
    wanted = V.distinct_targets(months, F.col("Active"), 0.2, 0.3, {12: 1.5, 11: 1.2})
    return wanted.select("MonthStart", F.greatest(F.least("Target", "Orders"), F.lit(1)).alias("Target"))


def pool(spark, sf):
    return U.month_pool(active_customers(spark, sf), month_customer_targets(spark, sf), 51)


POOL = f""", c0 AS (SELECT CustomerKey, date_trunc('month', min(OrderDate))::DATE AS s, date_trunc('month', max(OrderDate))::DATE AS e FROM sales GROUP BY 1),
c AS (SELECT *, (s + to_months(least(floor(-ln(1 - {u01_sql('CustomerKey', seed=3, salt=8)}) * 6.0::DOUBLE), 36)::INTEGER))::DATE AS d, 1 + CustomerKey % 5 AS w FROM c0),
active AS (SELECT CustomerKey, e, d, w, unnest(generate_series(s, e, INTERVAL 1 MONTH))::DATE AS MonthStart FROM c),
o AS (SELECT OrderNumber, date_trunc('month', min(OrderDate))::DATE AS MonthStart FROM sales GROUP BY 1),
n AS (SELECT MonthStart, count(*) AS n FROM active GROUP BY 1), orders_of AS (SELECT MonthStart, count(*) AS orders FROM o GROUP BY 1),
targets AS (SELECT MonthStart, greatest(least(floor(n * 0.2::DOUBLE * (1 + 0.3::DOUBLE * sin(2 * pi() * month(MonthStart) / 12.0::DOUBLE)) * CASE month(MonthStart) WHEN 12 THEN 1.5::DOUBLE WHEN 11 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END + 0.5::DOUBLE), n, orders), 1)::BIGINT AS Target FROM n JOIN orders_of USING (MonthStart)),
kinds AS (SELECT *, CASE WHEN d = MonthStart THEN 0 WHEN d < MonthStart THEN 1 ELSE 2 END AS kind, {u01_sql('CustomerKey', 'MonthStart', seed=51)} AS u FROM active),
able AS (SELECT *, CASE WHEN kind = 0 THEN u ELSE -ln(1 - u) / w END AS race, min(kind) OVER (PARTITION BY MonthStart) AS least FROM kinds),
placed AS (SELECT MonthStart, CustomerKey, w AS Weight, row_number() OVER (PARTITION BY MonthStart ORDER BY kind, CASE WHEN kind = 0 THEN e END, race, CustomerKey) - 1 AS Place FROM able WHERE kind < 2 OR least = 2),
pool AS (SELECT placed.* FROM placed JOIN targets USING (MonthStart) WHERE Place < Target) """


@q("month_customer_pool", POOL + "SELECT MonthStart, CustomerKey, Weight, Place FROM pool")
def month_customer_pool(spark, sf):
    return pool(spark, sf)


@q("assign_order_customer", POOL + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY MonthStart ORDER BY OrderNumber) - 1 AS j FROM o), sizes AS (SELECT MonthStart, count(*) AS size, sum(Weight) AS total FROM pool GROUP BY 1),
slots AS (SELECT MonthStart, CustomerKey, row_number() OVER (PARTITION BY MonthStart ORDER BY Place, copy) - 1 AS slot FROM (SELECT *, unnest(range(Weight)) AS copy FROM pool)),
asked AS (SELECT *, CASE WHEN j >= size THEN floor({u01_sql('MonthStart', 'j', seed=52)} * total)::BIGINT END AS draw FROM ranked LEFT JOIN sizes USING (MonthStart))
SELECT OrderNumber, a.MonthStart, coalesce(p.CustomerKey, s.CustomerKey) AS CustomerKey FROM asked a LEFT JOIN pool p ON p.MonthStart = a.MonthStart AND p.Place = a.j LEFT JOIN slots s ON s.MonthStart = a.MonthStart AND s.slot = a.draw""")
def assign_order_customer(spark, sf):
    return U.assign_customers(month_orders(spark, sf), pool(spark, sf), 52)


GROUPS = {
    "base": ["Date", "DateKey", "Quarter", "DayOfYear", "MonthEnd"],
    "calendar": ["IsWeekend", "IsMonthEnd", "DayOffset", "MonthEnd"],
    "iso": ["IsoWeek", "IsoYear"],
    "fiscal": ["FiscalYear", "FiscalMonth"],
}


@register("resolve_date_columns", f"WITH {DAYS} SELECT d AS Date, year(d) * 10000 + month(d) * 100 + day(d) AS DateKey, quarter(d) AS Quarter, dayofyear(d) AS DayOfYear, last_day(d) AS MonthEnd, dayofweek(d) IN (0, 6) AS IsWeekend, d = last_day(d) AS IsMonthEnd, date_diff('day', DATE '{AS_OF}', d) AS DayOffset, weekofyear(d) AS IsoWeek, isoyear(d) AS IsoYear FROM days")
def resolve_date_columns(spark, sf):
    """Base, calendar and ISO columns; MonthEnd is in two groups and comes once, fiscal ones are not asked for."""
    every = C.fiscal(C.iso(C.gregorian(days(spark, sf), AS_OF), AS_OF), 7, AS_OF)
    return every.select(*C.date_columns({"base": True, "calendar": True, "iso": True}, GROUPS))
