"""Queries: calendars over the orders' days, allocation and sampling, derived facts."""

from pyspark.sql import functions as F

from granary.functions import calendar as C
from granary.functions.hashing import hash_u01, u01_sql
from granary.operators import alias
from granary.operators import allocation as A
from granary.operators import facts as X
from granary.operators import ordered as O
from granary.operators import rollups as R
from granary.plans import star as S
from granary.plans.history import DEMAND, demand
from granary.plans.registry import register
from granary.plans.star import STAR

AS_OF = "1999-06-15"
DAYS = "days AS (SELECT unnest(generate_series(f, t, INTERVAL 1 DAY))::DATE AS d FROM (SELECT date_trunc('year', min(o_orderdate)) AS f, max(o_orderdate) AS t FROM orders))"


def q(name: str, sql: str):
    return register(name, STAR + sql)


def days(spark, sf):
    """Every day from the first order's year to the last order."""
    ends = S.read(spark, sf, "orders", ["o_orderdate"]).agg(F.trunc(F.min("o_orderdate"), "year").alias("f"), F.max("o_orderdate").cast("date").alias("t"))
    return ends.select(F.explode(F.sequence("f", "t")).alias("Date"))


@register("date_spine", f"WITH {DAYS} SELECT d AS Date FROM days")
def date_spine(spark, sf):
    return days(spark, sf)


GREG = f"""WITH {DAYS} SELECT d AS Date, year(d) * 10000 + month(d) * 100 + day(d) AS DateKey, date_diff('day', DATE '1899-12-30', d) AS Serial, quarter(d) AS Quarter, dayofyear(d) AS DayOfYear, dayofweek(d) AS DayOfWeek,
monthname(d) AS MonthName, dayname(d) AS DayName, last_day(d) AS MonthEnd, date_trunc('quarter', d)::DATE AS QuarterStart, (d - dayofweek(d)::INTEGER)::DATE AS WeekStart,
(dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) // 7 + 1 AS CalendarWeek, dayofweek(d) IN (0, 6) AS IsWeekend, d = last_day(d) AS IsMonthEnd, date_diff('day', DATE '{AS_OF}', d) AS DayOffset,
(year(d) * 12 + month(d)) - (1999 * 12 + 6) AS MonthOffset FROM days"""


@register("dates_calendar", GREG)
def dates_calendar(spark, sf):
    return C.gregorian(days(spark, sf), AS_OF).select("Date", "DateKey", "Serial", "Quarter", "DayOfYear", "DayOfWeek", "MonthName", "DayName", "MonthEnd", "QuarterStart", "WeekStart", "CalendarWeek", "IsWeekend", "IsMonthEnd", "DayOffset", "MonthOffset")


PREV = "CASE WHEN d = last_day(d) THEN last_day((d - INTERVAL {0} MONTH)::DATE) ELSE (d - INTERVAL {0} MONTH)::DATE END"


@register("dates_previous_period", f"WITH {DAYS} SELECT d AS Date, (d - 7)::DATE AS PreviousWeek, {PREV.format(1)} AS PreviousMonth, {PREV.format(3)} AS PreviousQuarter, {PREV.format(12)} AS PreviousYear FROM days")
def dates_previous_period(spark, sf):
    return C.gregorian(days(spark, sf), AS_OF).select("Date", "PreviousWeek", "PreviousMonth", "PreviousQuarter", "PreviousYear")


@register("dates_iso", f"WITH {DAYS} SELECT d AS Date, weekofyear(d) AS IsoWeek, isoyear(d) AS IsoYear, date_trunc('week', d)::DATE AS IsoStart, (date_trunc('week', d)::DATE + 6)::DATE AS IsoEnd, date_diff('day', date_trunc('week', DATE '{AS_OF}')::DATE, date_trunc('week', d)::DATE) // 7 AS IsoOffset FROM days")
def dates_iso(spark, sf):
    return C.iso(days(spark, sf), AS_OF)


@register("dates_fiscal", f"""WITH {DAYS}, f AS (SELECT d, year(d) - CASE WHEN month(d) >= 7 THEN 0 ELSE 1 END AS y, (month(d) - 7 + 12) % 12 + 1 AS m FROM days)
SELECT d AS Date, y + 1 AS FiscalYear, m AS FiscalMonth, (m - 1) // 3 + 1 AS FiscalQuarter, make_date(y, 7, 1) AS FiscalYearStart, make_date(y + 1, 6, 30) AS FiscalYearEnd, (make_date(y, 7, 1) + to_months((((m - 1) // 3) * 3)::INTEGER))::DATE AS FiscalQuarterStart, 'FY' || (y + 1) || ' Q' || ((m - 1) // 3 + 1) AS FiscalLabel, y * 12 + m - (1998 * 12 + 12) AS FiscalMonthOffset FROM f""")
def dates_fiscal(spark, sf):
    return C.fiscal(days(spark, sf), 7, AS_OF)


NEAR = "(make_date(y, 2, 1) - ((dayofweek(make_date(y, 2, 1)) + 7) % 7)::INTEGER + CASE WHEN (dayofweek(make_date(y, 2, 1)) + 7) % 7 > 3 THEN 7 ELSE 0 END)::DATE"


@register("dates_weekly_fiscal", f"""WITH {DAYS}, years AS (SELECT y, {NEAR} AS s FROM (SELECT unnest(range(1990, 2010)) AS y)), w AS (SELECT d, max(y) AS y, max(s) AS s FROM days JOIN years ON s <= d GROUP BY d), k AS (SELECT *, date_diff('day', s, d) // 7 + 1 AS wk FROM w), z AS (SELECT *, least((wk - 1) // 13 + 1, 4) AS qr FROM k)
SELECT d AS Date, y + 1 AS FwYear, wk AS FwWeek, qr AS FwQuarter, (qr - 1) * 3 + CASE WHEN wk - (qr - 1) * 13 <= 4 THEN 1 WHEN wk - (qr - 1) * 13 <= 8 THEN 2 ELSE 3 END AS FwPeriod, s AS FwYearStart, (s + ((wk - 1) * 7)::INTEGER)::DATE AS FwWeekStart FROM z""")
def dates_weekly_fiscal(spark, sf):
    return C.weekly_fiscal(days(spark, sf))


@register("week_range_label", f"WITH {DAYS} SELECT d AS Date, strftime(d, '%b %d') || ' - ' || strftime(d + 6, '%b %d, %Y') AS Label FROM days")
def week_range_label(spark, sf):
    return days(spark, sf).select("Date", C.week_label(F.col("Date"), F.date_add("Date", 6)).alias("Label"))


@register("next_prev_business_day", f"WITH {DAYS} SELECT d AS Date, (d + CASE dayofweek(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END)::DATE AS NextBusinessDay, (d - CASE dayofweek(d) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END)::DATE AS PreviousBusinessDay FROM days")
def next_prev_business_day(spark, sf):
    return C.next_prev_business_day(days(spark, sf))


@q("time_of_day", "SELECT lpad((TimeKey // 60)::VARCHAR, 2, '0') || ':00' AS Bin60, CASE WHEN TimeKey < 720 THEN 'AM' ELSE 'PM' END AS Half, count(*) AS Lines FROM sales GROUP BY 1, 2")
def time_of_day(spark, sf):
    return S.sales(spark, sf).join(F.broadcast(C.time_of_day(spark)), "TimeKey").groupBy("Bin60", "Half").agg(F.count("*").alias("Lines"))


@q("year_month_parts", "SELECT OrderNumber, OrderLineNumber, year(OrderDate) AS Y, month(OrderDate) AS M FROM sales")
def year_month_parts(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", F.year("OrderDate").alias("Y"), F.month("OrderDate").alias("M"))


@q("month_diff", "SELECT OrderNumber, OrderLineNumber, (year(DeliveryDate) * 12 + month(DeliveryDate)) - (year(OrderDate) * 12 + month(OrderDate)) AS Months FROM sales")
def month_diff(spark, sf):
    from granary.operators.intervals import month_index

    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", (month_index("DeliveryDate") - month_index("OrderDate")).alias("Months"))


@q("clamp_to_window", "SELECT OrderNumber, OrderLineNumber, greatest(least(OrderDate, DATE '2000-12-31'), DATE '1996-01-01') AS Clamped FROM sales")
def clamp_to_window(spark, sf):
    return S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", F.greatest(F.least("OrderDate", C.day("2000-12-31")), C.day("1996-01-01")).alias("Clamped"))


@q("date_bounds", "SELECT 'OrderDate' AS \"Column\", min(OrderDate) AS First, max(OrderDate) AS Last FROM sales UNION ALL SELECT 'DueDate', min(DueDate), max(DueDate) FROM sales UNION ALL SELECT 'DeliveryDate', min(DeliveryDate), max(DeliveryDate) FROM sales")
def date_bounds(spark, sf):
    names = ["OrderDate", "DueDate", "DeliveryDate"]
    one = S.sales(spark, sf).agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("lo", F.min), ("hi", F.max))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(f"{c}_lo").alias("First"), F.col(f"{c}_hi").alias("Last")) for c in names])).alias("s")).select("s.*")


ALLOC = "(SELECT StoreKey, sum(Quantity)::BIGINT AS w, StoreKey % 7 AS g FROM sales GROUP BY 1)"


def _stores_by_quantity(spark, sf):
    return S.sales(spark, sf).groupBy("StoreKey").agg(F.sum("Quantity").alias("w")).withColumn("g", F.col("StoreKey") % 7)


@q("allocate_total", f", a AS (SELECT *, 1000 * w / (sum(w) OVER (PARTITION BY g))::DOUBLE AS e FROM {ALLOC}), b AS (SELECT *, floor(round(e, 9))::BIGINT AS f, round(e - floor(round(e, 9)), 9) AS r FROM a) SELECT StoreKey, f + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY r DESC, StoreKey) <= 1000 - sum(f) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS Allocated FROM b")
def allocate_total(spark, sf):
    return A.allocate(_stores_by_quantity(spark, sf), "w", F.lit(1000), ["g"], "StoreKey").select("StoreKey", "Allocated")


@q("apportion_cents", ", c AS (SELECT OrderNumber, OrderLineNumber, Quantity, round(sum(NetPrice) OVER (PARTITION BY OrderNumber) * 100)::BIGINT AS cents, sum(Quantity) OVER (PARTITION BY OrderNumber) AS t FROM sales), d AS (SELECT *, (cents * Quantity) // t AS f, (cents * Quantity) % t AS m FROM c) SELECT OrderNumber, OrderLineNumber, (f + CASE WHEN row_number() OVER (PARTITION BY OrderNumber ORDER BY m DESC, OrderLineNumber) <= cents - sum(f) OVER (PARTITION BY OrderNumber) THEN 1 ELSE 0 END)::DOUBLE / 100.0::DOUBLE AS Part FROM d")
def apportion_cents(spark, sf):
    from pyspark.sql import Window as W

    own = S.sales(spark, sf).withColumn("Total", F.sum("NetPrice").over(W.partitionBy("OrderNumber")))
    return A.apportion_cents(own, "Total", "Quantity", ["OrderNumber"], "OrderLineNumber", "Part").select("OrderNumber", "OrderLineNumber", "Part")


@q("weighted_sample_wor", f"SELECT Country, CustomerKey FROM (SELECT *, row_number() OVER (PARTITION BY Country ORDER BY -ln(1 - {u01_sql('CustomerKey', seed=3)}) / (1 + CustomerKey % 5), CustomerKey) AS k FROM customers) WHERE k <= 5")
def weighted_sample_wor(spark, sf):
    own = S.customers(spark, sf).withColumn("w", (1 + F.col("CustomerKey") % 5).cast("double"))
    return A.weighted_sample_wor(own, ["Country"], "w", "CustomerKey", 5, 3).select("Country", "CustomerKey")


def alias_sql(name: str, pool: str, group: str, weight: str, item: str) -> str:
    """The alias table of a pool: `group`, item, n, slot, prob and other, by joins on which lender's stretch a slot begins in."""
    on = " AND ".join(f"l.{g} = h.{g}" for g in group.split(", "))
    of = lambda x: ", ".join(f"{x}.{g}" for g in group.split(", "))
    return f"""{name}_m AS (SELECT {group}, {item}, greatest(1, floor({weight} / (sum({weight}) OVER (PARTITION BY {group}))::DOUBLE * 1000000000 + 0.5::DOUBLE))::BIGINT AS m FROM {pool} WHERE {weight} > 0),
{name}_e AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS n, (sum(m) OVER (PARTITION BY {group}))::BIGINT AS whole, row_number() OVER (PARTITION BY {group} ORDER BY {item}) - 1 AS slot FROM {name}_m),
{name}_s AS (SELECT *, n * m - whole AS e, (sum(abs(n * m - whole)) OVER (PARTITION BY {group}, n * m < whole ORDER BY {item} ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM {name}_e),
{name}_l AS (SELECT {of('l')}, l.{item}, l.n, l.slot, (l.m * l.n)::DOUBLE / l.whole AS prob, min(h.{item}) AS other FROM {name}_s l JOIN {name}_s h ON {on} AND h.e >= 0 AND h.upto > l.upto + l.e WHERE l.e < 0 GROUP BY ALL),
{name}_h AS (SELECT {of('h')}, h.{item}, h.n, h.slot, 1.0::DOUBLE - coalesce(min(CASE WHEN l.e < 0 AND l.upto >= h.upto THEN l.upto END) - h.upto, 0)::DOUBLE / h.whole AS prob, coalesce(min(CASE WHEN l.e >= 0 AND l.{item} > h.{item} THEN l.{item} END), h.{item}) AS other
  FROM {name}_s h JOIN {name}_s l ON {on} WHERE h.e >= 0 GROUP BY {of('h')}, h.{item}, h.n, h.slot, h.upto, h.whole),
{name} AS (SELECT * FROM {name}_l UNION ALL BY NAME SELECT * FROM {name}_h)"""


def picked(item: str, name: str = "c") -> str:
    """The item that a row with a number u picks, once it is joined by its group and `slot_is`."""
    return f"CASE WHEN u * {name}.n - floor(u * {name}.n) < {name}.prob THEN {name}.{item} ELSE {name}.other END"


def slot_is(name: str = "c") -> str:
    return f"{name}.slot = floor(u * {name}.n)"


@q("weighted_pick", f", pool AS (SELECT Country, StoreKey, 1 + StoreKey % 4 AS w FROM stores), {alias_sql('c', 'pool', 'Country', 'w', 'StoreKey')}, l AS (SELECT CustomerKey, Country, {u01_sql('CustomerKey', seed=11)} AS u FROM customers) SELECT CustomerKey, {picked('StoreKey')} AS StoreKey FROM l LEFT JOIN c ON l.Country = c.Country AND {slot_is()}")
def weighted_pick(spark, sf):
    pool = S.stores(spark, sf).select("Country", "StoreKey", (1 + F.col("StoreKey") % 4).alias("w"))
    return alias.weighted_pick(S.customers(spark, sf).select("CustomerKey", "Country"), pool, "Country", "w", "StoreKey", "CustomerKey", 11).select("CustomerKey", "StoreKey")


@q("stratified_trim", f", s AS (SELECT Country, count(*) AS n FROM customers GROUP BY 1), a AS (SELECT *, 100 * n / (sum(n) OVER ())::DOUBLE AS e FROM s), b AS (SELECT *, floor(round(e, 9))::BIGINT AS f, round(e - floor(round(e, 9)), 9) AS r FROM a), qt AS (SELECT Country, f + CASE WHEN row_number() OVER (ORDER BY r DESC, Country) <= 100 - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM b) SELECT Country, CustomerKey FROM (SELECT *, row_number() OVER (PARTITION BY Country ORDER BY {u01_sql('CustomerKey', seed=4)}, CustomerKey) AS k FROM customers) JOIN qt USING (Country) WHERE k <= quota")
def stratified_trim(spark, sf):
    return A.stratified_sample(S.customers(spark, sf).select("Country", "CustomerKey"), "Country", "CustomerKey", 100, 4).select("Country", "CustomerKey")


@q("trim_dominant_value", f", own AS (SELECT CustomerKey, Segment, Country FROM customers), s AS (SELECT Country, count(*) AS n FROM own WHERE Segment = 'BUILDING' GROUP BY 1), a AS (SELECT *, least(60, (sum(n) OVER ())) * n / (sum(n) OVER ())::DOUBLE AS e FROM s), b AS (SELECT *, floor(round(e, 9))::BIGINT AS f, round(e - floor(round(e, 9)), 9) AS r FROM a), qt AS (SELECT Country, f + CASE WHEN row_number() OVER (ORDER BY r DESC, Country) <= (SELECT least(60, sum(n)) FROM s) - sum(f) OVER () THEN 1 ELSE 0 END AS quota FROM b) SELECT * FROM own WHERE Segment <> 'BUILDING' UNION ALL SELECT CustomerKey, Segment, Country FROM (SELECT *, row_number() OVER (PARTITION BY Country ORDER BY {u01_sql('CustomerKey', seed=9)}, CustomerKey) AS k FROM own WHERE Segment = 'BUILDING') JOIN qt USING (Country) WHERE k <= quota")
def trim_dominant_value(spark, sf):
    """60 rows of the commonest segment, stratified by country; all rows of the others."""
    return A.trim_value(S.customers(spark, sf).select("CustomerKey", "Segment", "Country"), "Segment", "BUILDING", 60, "CustomerKey", 9, "Country")


@q("sequence_expand", "SELECT OrderNumber, OrderLineNumber, unnest(range(1, Quantity + 1))::INTEGER AS \"Index\" FROM sales WHERE StoreKey = 1")
def sequence_expand(spark, sf):
    return A.expand(S.sales(spark, sf).where("StoreKey = 1").select("OrderNumber", "OrderLineNumber", "Quantity"), "Quantity").drop("Quantity")


@q("sequence_expand_all", "SELECT OrderNumber, OrderLineNumber, unnest(range(1, Quantity + 1))::INTEGER AS \"Index\" FROM sales")
def sequence_expand_all(spark, sf):
    """Of all stores."""
    return A.expand(S.sales(spark, sf).select("OrderNumber", "OrderLineNumber", "Quantity"), "Quantity").drop("Quantity")


@q("order_lines_explode", ", o AS (SELECT OrderNumber, count(*) AS n FROM sales GROUP BY 1) SELECT OrderNumber, unnest(range(1, n + 1))::INTEGER AS LineNumber FROM o")
def order_lines_explode(spark, sf):
    return A.expand(S.sales(spark, sf).groupBy("OrderNumber").agg(F.count("*").alias("n")), "n", "LineNumber").drop("n")


@register("threshold_packing", STAR.replace("WITH raw", "WITH RECURSIVE raw", 1) + ", r AS (SELECT Region, Country, n, row_number() OVER (PARTITION BY Region ORDER BY Country) AS i FROM (SELECT Region, Country, count(*) AS n FROM stores GROUP BY 1, 2)), pk AS (SELECT Region, Country, i, n AS s, 0 AS Pack FROM r WHERE i = 1 UNION ALL SELECT r.Region, r.Country, r.i, CASE WHEN p.s + r.n > 10 AND p.s > 0 THEN r.n ELSE p.s + r.n END, CASE WHEN p.s + r.n > 10 AND p.s > 0 THEN p.Pack + 1 ELSE p.Pack END FROM pk p JOIN r ON r.Region = p.Region AND r.i = p.i + 1) SELECT Region, Country, Pack FROM pk")
def threshold_packing(spark, sf):
    rows = S.stores(spark, sf).groupBy("Region", "Country").agg(F.count("*").alias("n"))
    return A.pack(rows, "Region", "Country", "n", 10)


@q("index_band", "SELECT CustomerKey, floor(CustomerKey * 8 / (SELECT count(*) FROM customers))::INTEGER AS Shard FROM customers")
def index_band(spark, sf):
    own = S.customers(spark, sf).select("CustomerKey")
    return A.index_band(own.crossJoin(F.broadcast(own.agg(F.count("*").alias("n")))), "CustomerKey", F.col("n"), 8).drop("n")


RATE = f"round(1 + {u01_sql('c', 'd', seed=21)} * 9, 6)"
MASTER = f", {DAYS}, cur AS (SELECT unnest(['EUR', 'GBP', 'JPY']) AS c), master AS (SELECT d AS Date, c AS ToCurrency, {RATE} AS Rate FROM days CROSS JOIN cur)"


def master(spark, sf):
    three = F.explode(F.array(*[F.lit(c) for c in ("EUR", "GBP", "JPY")]))
    rows = days(spark, sf).withColumn("ToCurrency", three)
    return rows.withColumn("Rate", F.round(1 + hash_u01(F.col("ToCurrency"), F.col("Date"), seed=21) * 9, 6))


TRI = MASTER + ", every AS (SELECT * FROM master UNION ALL SELECT d, 'USD', 1.0 FROM days), pairs AS (SELECT a.Date, a.ToCurrency AS FromCurrency, b.ToCurrency, b.Rate / a.Rate AS Rate FROM every a JOIN every b ON a.Date = b.Date AND a.ToCurrency <> b.ToCurrency)"
CODES = ["USD", "EUR", "GBP", "JPY"]


@q("fx_triangulate", TRI + " SELECT * FROM pairs")
def fx_triangulate(spark, sf):
    return X.fx_triangulate(master(spark, sf), CODES)


@q("fx_cross_join", TRI + " SELECT Date, Rate FROM pairs WHERE FromCurrency = 'EUR' AND ToCurrency = 'GBP'")
def fx_cross_join(spark, sf):
    return X.fx_triangulate(master(spark, sf), CODES).where("FromCurrency = 'EUR' and ToCurrency = 'GBP'").select("Date", "Rate")


@q("fx_daily", TRI + " SELECT Date, FromCurrency, ToCurrency, Rate FROM pairs WHERE Date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND isfinite(Rate) AND Rate > 0")
def fx_daily(spark, sf):
    ok = (F.col("Rate") > 0) & (F.col("Rate") < float("inf"))
    return X.fx_triangulate(master(spark, sf), CODES).where(F.col("Date").between("1996-01-01", "1996-12-31") & ok)


@q("fx_daily_all", TRI + " SELECT Date, FromCurrency, ToCurrency, Rate FROM pairs WHERE isfinite(Rate) AND Rate > 0")
def fx_daily_all(spark, sf):
    """All pairs on all days."""
    return X.fx_triangulate(master(spark, sf), CODES).where((F.col("Rate") > 0) & (F.col("Rate") < float("inf")))


@q("fx_monthly", TRI + " SELECT date_trunc('month', Date)::DATE AS MonthStart, FromCurrency, ToCurrency, round(avg(Rate), 6) AS MeanRate, min(Rate) AS MinRate, max(Rate) AS MaxRate, arg_max(Rate, Date) AS EndRate FROM pairs GROUP BY 1, 2, 3")
def fx_monthly(spark, sf):
    return X.fx_monthly(X.fx_triangulate(master(spark, sf), CODES)).withColumn("MeanRate", F.round("MeanRate", 6))


def fx_stats_sql(years: int, least_rows: int) -> str:
    return f""", m AS (SELECT *, ln(greatest(Rate, 1e-12)) AS y, ln(greatest(Rate, 1e-12)) - lag(ln(greatest(Rate, 1e-12))) OVER (PARTITION BY ToCurrency ORDER BY Date) AS m, Date >= max(Date) OVER (PARTITION BY ToCurrency) - INTERVAL {years} YEAR AS late, date_diff('day', DATE '1970-01-01', Date)::DOUBLE AS d FROM history),
s AS (SELECT ToCurrency, count(*) FILTER (m <> 0) AS n, stddev_pop(m) FILTER (m <> 0) AS vol, count(*) AS r, count(*) FILTER (late) AS lr, regr_slope(y, d) * 365.25 AS every, regr_slope(y, d) FILTER (late) * 365.25 AS recent FROM m GROUP BY 1)
SELECT ToCurrency, round(CASE WHEN n < 30 THEN 0.0002 ELSE least(greatest(vol, 0.0002), 0.04) END, 6) AS Volatility, round(CASE WHEN r < {least_rows} THEN 0 ELSE least(greatest((exp(CASE WHEN lr < {least_rows} THEN every ELSE recent END) - 1) * 0.6, -0.06), 0.06) END, 6) AS Drift FROM s"""


def _fx_rounded(stats):
    return stats.withColumns({"Volatility": F.round("Volatility", 6), "Drift": F.round("Drift", 6)})


@q("fx_history_stats", MASTER + ", history AS (SELECT * FROM master)" + fx_stats_sql(10, 250))
def fx_history_stats(spark, sf):
    return _fx_rounded(X.fx_stats(master(spark, sf)))


@q("fx_history_stats_short", MASTER + ", history AS (SELECT Date, ToCurrency, CASE WHEN ToCurrency = 'GBP' THEN 1 + date_diff('day', DATE '1995-01-01', Date) / 20000.0::DOUBLE ELSE Rate END AS Rate FROM master WHERE ToCurrency <> 'JPY' OR Date < DATE '1995-03-01')" + fx_stats_sql(2, 400))
def fx_history_stats_short(spark, sf):
    """A window of two years; a currency with a steady trend, and one whose history is too short, which has the fallback."""
    trend = 1 + F.datediff("Date", F.lit("1995-01-01").cast("date")) / 20_000.0
    rows = master(spark, sf).where("ToCurrency <> 'JPY' or Date < '1995-03-01'").withColumn("Rate", F.when(F.col("ToCurrency") == "GBP", trend).otherwise(F.col("Rate")))
    return _fx_rounded(X.fx_stats(rows, X.FxRules(window_years=2, least_rows=400)))


FILL = MASTER + ", few AS (SELECT * FROM master WHERE dayofweek(Date) NOT IN (0, 6) AND ToCurrency = 'EUR'), span AS (SELECT unnest(generate_series(least(min(Date), DATE '1996-01-06'), greatest(max(Date), DATE '1996-03-31'), INTERVAL 1 DAY))::DATE AS Date FROM few)"


@q("forward_fill_dates", FILL + " SELECT 'EUR' AS ToCurrency, Date, Rate FROM (SELECT s.Date, coalesce(last_value(Rate IGNORE NULLS) OVER (ORDER BY s.Date ROWS UNBOUNDED PRECEDING), first_value(Rate IGNORE NULLS) OVER (ORDER BY s.Date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS Rate FROM span s LEFT JOIN few f ON f.Date = s.Date) WHERE Date BETWEEN DATE '1996-01-06' AND DATE '1996-03-31'")
def forward_fill_dates(spark, sf):
    few = master(spark, sf).where("dayofweek(Date) not in (1, 7) and ToCurrency = 'EUR'")
    return O.fill_days(few, ["ToCurrency"], "Date", "Rate", "1996-01-06", "1996-03-31")


@q("uncovered_dates", MASTER + " SELECT DISTINCT OrderDate FROM sales WHERE OrderDate NOT IN (SELECT Date FROM master WHERE dayofweek(Date) NOT IN (0, 6))")
def uncovered_dates(spark, sf):
    few = master(spark, sf).where("dayofweek(Date) not in (1, 7)").select(F.col("Date").alias("OrderDate")).distinct()
    return S.sales(spark, sf).select("OrderDate").distinct().join(few, "OrderDate", "left_anti")


@q("convert_currency", TRI + ", s AS (SELECT *, CASE CurrencyKey WHEN 1 THEN 'USD' WHEN 2 THEN 'EUR' ELSE 'GBP' END AS cur FROM sales) SELECT OrderNumber, OrderLineNumber, round(NetPrice::DOUBLE * CASE WHEN cur = 'USD' THEN 1.0 ELSE Rate END, 4) AS Usd FROM s LEFT JOIN pairs p ON p.Date = OrderDate AND p.FromCurrency = cur AND p.ToCurrency = 'USD'")
def convert_currency(spark, sf):
    lines = S.sales(spark, sf).withColumn("cur", F.when(F.col("CurrencyKey") == 1, "USD").when(F.col("CurrencyKey") == 2, "EUR").otherwise("GBP"))
    return X.convert(lines, "NetPrice", "OrderDate", "cur", X.fx_triangulate(master(spark, sf), CODES), "USD", "Usd").select("OrderNumber", "OrderLineNumber", F.round("Usd", 4).alias("Usd"))


def ledger_sql(lead: int = 1) -> str:
    return DEMAND + f""", k AS (SELECT ProductKey, WarehouseKey, ceil(avg(QuantitySold))::BIGINT AS mean, min("Year" * 12 + "Month" - 1) AS f, (SELECT max("Year" * 12 + "Month" - 1) FROM demand) AS t FROM demand GROUP BY 1, 2 HAVING count(*) >= 3),
e AS (SELECT ProductKey, WarehouseKey, mean, f, unnest(range(f, t + 1)) AS m FROM k),
d AS (SELECT e.ProductKey, e.WarehouseKey, e.m, e.m - e.f + 1 AS i, e.mean, coalesce(QuantitySold, 0)::BIGINT AS q FROM e LEFT JOIN demand x ON x.ProductKey = e.ProductKey AND x.WarehouseKey = e.WarehouseKey AND x."Year" * 12 + x."Month" - 1 = e.m),
led AS (
  SELECT ProductKey, WarehouseKey, i, m, q, mean, 0::BIGINT AS received, least(mean * 2, q) AS sold, mean * 2 - least(mean * 2, q) AS onhand,
    CASE WHEN mean * 2 - least(mean * 2, q) < mean THEN mean * 2 ELSE 0 END AS ordered, list_append({[0] * (lead - 1)}::BIGINT[], CASE WHEN mean * 2 - least(mean * 2, q) < mean THEN mean * 2 ELSE 0 END) AS due FROM d WHERE i = 1
  UNION ALL
  SELECT d.ProductKey, d.WarehouseKey, d.i, d.m, d.q, d.mean, l.due[1], least(l.onhand + l.due[1], d.q), l.onhand + l.due[1] - least(l.onhand + l.due[1], d.q),
    CASE WHEN l.onhand + l.due[1] - least(l.onhand + l.due[1], d.q) < d.mean THEN d.mean * 2 ELSE 0 END,
    list_append(l.due[2:], CASE WHEN l.onhand + l.due[1] - least(l.onhand + l.due[1], d.q) < d.mean THEN d.mean * 2 ELSE 0 END)
  FROM led l JOIN d ON d.ProductKey = l.ProductKey AND d.WarehouseKey = l.WarehouseKey AND d.i = l.i + 1)
, ledger AS (SELECT ProductKey, WarehouseKey, last_day(make_date((m // 12)::BIGINT, (m % 12 + 1)::BIGINT, 1)) AS SnapshotDate, q AS Demand, received AS QuantityReceived, sold AS QuantitySold, onhand AS QuantityOnHand, ordered AS QuantityOnOrder, onhand < mean AS ReorderFlag, sold < q AS StockoutFlag FROM led)
"""


LEDGER = ledger_sql()
RSTAR = STAR.replace("WITH raw", "WITH RECURSIVE raw", 1)


@register("inventory_ledger_det", RSTAR + LEDGER + "SELECT * FROM ledger")
def inventory_ledger_det(spark, sf):
    return X.inventory_ledger(demand(spark, sf))


@register("inventory_ledger", RSTAR + ledger_sql(3) + "SELECT * FROM ledger")
def inventory_ledger(spark, sf):
    return X.inventory_ledger(demand(spark, sf), lead=3)


@register("inventory_quarterly", RSTAR + LEDGER + "SELECT ProductKey, WarehouseKey, date_trunc('quarter', SnapshotDate)::DATE AS QuarterStart, arg_max(QuantityOnHand, SnapshotDate) AS QuantityOnHand, sum(QuantitySold)::BIGINT AS QuantitySold, sum(QuantityReceived)::BIGINT AS QuantityReceived, bool_or(ReorderFlag) AS ReorderFlag, bool_or(StockoutFlag) AS StockoutFlag FROM ledger GROUP BY 1, 2, 3")
def inventory_quarterly(spark, sf):
    return X.inventory_ledger(demand(spark, sf), quarters=True)


@register("stock_by_reorder_flag", RSTAR + LEDGER + "SELECT ReorderFlag, sum(QuantityOnHand)::DOUBLE / count(*) AS MeanOnHand FROM ledger GROUP BY 1")
def stock_by_reorder_flag(spark, sf):
    return X.inventory_ledger(demand(spark, sf)).groupBy("ReorderFlag").agg(R.ratio(F.sum("QuantityOnHand"), F.count("*")).alias("MeanOnHand"))


@register("inventory_period_profile", RSTAR + LEDGER + "SELECT SnapshotDate, count(*) AS \"Rows\", count(DISTINCT ProductKey) AS Products, count(DISTINCT WarehouseKey) AS Warehouses FROM ledger GROUP BY 1")
def inventory_period_profile(spark, sf):
    return X.ledger_profile(demand(spark, sf))


@register("stock_consistency", RSTAR + LEDGER + "SELECT count(CASE WHEN QuantityOnHand < 0 THEN 1 END) AS Negative, count(CASE WHEN StockoutFlag AND QuantityOnHand > 0 THEN 1 END) AS Unflagged FROM ledger")
def stock_consistency(spark, sf):
    return X.inventory_ledger(demand(spark, sf)).agg(F.count(F.when(F.col("QuantityOnHand") < 0, 1)).alias("Negative"), F.count(F.when(F.col("StockoutFlag") & (F.col("QuantityOnHand") > 0), 1)).alias("Unflagged"))


U = lambda salt, seed=31: u01_sql("OrderNumber", "OrderLineNumber", seed=seed, salt=salt)
DELIV = f", a AS (SELECT *, OrderDate + ChannelKey + floor({U(1)} * 3)::INTEGER AS due2, {U(2)} AS u2, {U(3)} AS u3 FROM sales), dl AS (SELECT *, greatest(due2 + CASE WHEN u2 < 0.2 THEN -1 WHEN u2 < 0.8 THEN 0 ELSE 1 + floor(u3 * 5)::INTEGER END, OrderDate) AS del2 FROM a)"


@q("delivery_dates", DELIV + " SELECT OrderNumber, OrderLineNumber, due2::DATE AS Due, del2::DATE AS Delivered, CASE WHEN del2 < due2 THEN 'Early' WHEN del2 = due2 THEN 'On time' ELSE 'Late' END AS Status FROM dl")
def delivery_dates(spark, sf):
    return X.delivery(S.sales(spark, sf), 31).select("OrderNumber", "OrderLineNumber", "Due", "Delivered", "Status")


@q("returns_events", f", a AS (SELECT *, greatest(1, ceil(Quantity * {U(2, 8)})::INTEGER) AS ret, {U(3, 8)} AS u3 FROM sales WHERE {U(1, 8)} < 0.1), b AS (SELECT *, least(ret, 1 + floor(u3 * 3)::INTEGER) AS ev FROM a), e AS (SELECT *, unnest(range(1, ev + 1))::INTEGER AS ReturnSequence FROM b) SELECT OrderNumber, OrderLineNumber, ReturnSequence, (ret // ev + CASE WHEN ReturnSequence <= ret % ev THEN 1 ELSE 0 END)::INTEGER AS ReturnQuantity, (DeliveryDate + floor({u01_sql('OrderNumber', 'OrderLineNumber', 'ReturnSequence', seed=8, salt=4)} * 30)::INTEGER + ReturnSequence)::DATE AS ReturnDate, NetPrice::DOUBLE AS ReturnNetPrice FROM e")
def returns_events(spark, sf):
    return X.returns_events(S.sales(spark, sf), seed=8).withColumn("ReturnNetPrice", F.col("ReturnNetPrice").cast("double"))


@q("subscription_periods", ", s AS (SELECT CustomerKey AS SubscriptionKey, CustomerKey, date_trunc('month', min(OrderDate))::DATE AS StartDate, CASE WHEN CustomerKey % 2 = 0 THEN max(OrderDate) END AS ChurnDate, (1 + 2 * (CustomerKey % 2))::INTEGER AS CycleMonths, CustomerKey % 3 = 0 AS HasTrial FROM sales GROUP BY CustomerKey), n AS (SELECT *, greatest(1, ceil((date_diff('month', StartDate, least(coalesce(ChurnDate, DATE '2001-12-31'), DATE '2001-12-31')) + 1) / CycleMonths::DOUBLE)::INTEGER) AS n FROM s), e AS (SELECT *, unnest(range(1, n + 1))::INTEGER AS BillingCycleNumber FROM n) SELECT SubscriptionKey, CustomerKey, BillingCycleNumber, (StartDate + to_months((BillingCycleNumber - 1) * CycleMonths))::DATE AS PeriodStartDate, (StartDate + to_months(BillingCycleNumber * CycleMonths))::DATE - 1 AS PeriodEndDate, BillingCycleNumber = 1 AS IsFirstPeriod, BillingCycleNumber = 1 AND HasTrial AS IsTrialPeriod, ChurnDate IS NOT NULL AND BillingCycleNumber = n AS IsChurnPeriod FROM e")
def subscription_periods(spark, sf):
    own = S.sales(spark, sf).groupBy("CustomerKey").agg(F.trunc(F.min("OrderDate"), "month").alias("StartDate"), F.max("OrderDate").alias("last"))
    subs = own.select(F.col("CustomerKey").alias("SubscriptionKey"), "CustomerKey", "StartDate", F.when(F.col("CustomerKey") % 2 == 0, F.col("last")).alias("ChurnDate"), (1 + 2 * (F.col("CustomerKey") % 2)).cast("int").alias("CycleMonths"), (F.col("CustomerKey") % 3 == 0).alias("HasTrial"))
    return X.billing_periods(subs, "2001-12-31")


@q("snap_price", "SELECT ProductKey, greatest(floor(p / s + 0.5::DOUBLE) * s - 1 + 0.99::DOUBLE, 0.99::DOUBLE) AS Snapped FROM (SELECT ProductKey, ListPrice::DOUBLE AS p, CASE WHEN ListPrice <= 500 THEN 5.0::DOUBLE WHEN ListPrice <= 1000 THEN 10.0::DOUBLE ELSE 50.0::DOUBLE END AS s FROM products)")
def snap_price(spark, sf):
    return S.products(spark, sf).select("ProductKey", X.snap_price(F.col("ListPrice").cast("double"), [(500, 5.0), (1000, 10.0)], 50.0).alias("Snapped"))


@q("keyword_classify", "SELECT ProductKey, CASE WHEN contains(lower(ProductName), 'ring') THEN 'jewellery' WHEN contains(lower(ProductName), 'widget') THEN 'tools' ELSE 'other' END AS Kind FROM products")
def keyword_classify(spark, sf):
    name = F.lower("ProductName")
    kind = F.lit("other")
    for word, label in reversed([("ring", "jewellery"), ("widget", "tools")]):
        kind = F.when(name.contains(word), label).otherwise(kind)
    return S.products(spark, sf).select("ProductKey", kind.alias("Kind"))


@q("mod_assign", "SELECT ProductKey, (ProductKey % 7)::INTEGER AS ParentIndex FROM products")
def mod_assign(spark, sf):
    return S.products(spark, sf).select("ProductKey", F.pmod("ProductKey", F.lit(7)).cast("int").alias("ParentIndex"))


@q("decode_key_band", "SELECT DISTINCT EmployeeKey, (EmployeeKey - 30000000) // 10 AS HomeStore FROM sales")
def decode_key_band(spark, sf):
    key = F.col("EmployeeKey")
    home = F.when((key >= 30_000_000) & (key < 40_000_000), F.floor((key - 30_000_000) / 10))
    return S.sales(spark, sf).select("EmployeeKey").distinct().withColumn("HomeStore", home)


@q("score_bucket", "SELECT CustomerKey, CASE WHEN Balance <= 0 THEN 'none' WHEN Balance <= 2500 THEN 'low' WHEN Balance <= 7500 THEN 'middle' ELSE 'high' END AS Bucket FROM customers")
def score_bucket(spark, sf):
    return S.customers(spark, sf).select("CustomerKey", R.band(F.col("Balance"), [(0, "none"), (2500, "low"), (7500, "middle")], "high").alias("Bucket"))


@q("filter_by_coverage", "SELECT GeographyKey, Country, row_number() OVER (ORDER BY GeographyKey)::BIGINT AS Key FROM geography WHERE GeographyKey % 3 <> 0")
def filter_by_coverage(spark, sf):
    geo = S.geography(spark, sf).select("GeographyKey", "Country")
    allowed = geo.where("GeographyKey % 3 <> 0").select("GeographyKey")
    return O.dense_surrogate_key(geo.join(allowed, "GeographyKey", "left_semi"), ["GeographyKey"], "Key").withColumn("Key", F.col("Key").cast("bigint"))


@q("active_pool", f"SELECT ProductKey FROM (SELECT ProductKey, row_number() OVER (ORDER BY {u01_sql('ProductKey', seed=6)}, ProductKey) AS k, count(*) OVER () AS n FROM products) WHERE k <= floor(n * 0.4::DOUBLE)")
def active_pool(spark, sf):
    own = S.products(spark, sf).select("ProductKey").withColumn("u", hash_u01(F.col("ProductKey"), seed=6))
    return O.ranked_classes(own, [F.asc("u"), F.asc("ProductKey")], [(0.4, "in")], "out", "Pool").where("Pool = 'in'").select("ProductKey")


@q("household_members", "SELECT c.CustomerKey, h.Segment AS HeadSegment FROM customers c JOIN customers h ON h.CustomerKey = c.CustomerKey - c.CustomerKey % 4")
def household_members(spark, sf):
    own = S.customers(spark, sf)
    heads = own.select(F.col("CustomerKey").alias("Head"), F.col("Segment").alias("HeadSegment"))
    return own.withColumn("Head", F.col("CustomerKey") - F.col("CustomerKey") % 4).join(heads, "Head").select("CustomerKey", "HeadSegment")
