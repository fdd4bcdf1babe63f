"""Rollups of sales lines: aggregates, mixes, shares, bands, top lists, matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.money import ratio, total
from granary.operators.bitmaps import grouping_sets, rollup_sets
from granary.operators.selection import quantiles


def revenue() -> Column:
    return F.col("Quantity") * F.col("NetPrice")


def star(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Inner joins on each key. Spark broadcasts a dimension below its size threshold and shuffles a larger one."""
    for key, dim in dims.items():
        fact = fact.join(dim, key)
    return fact


def with_default_key(left: DataFrame, right: DataFrame, on: str, key: str, default: int) -> DataFrame:
    """Left join whose unmatched rows take a default key."""
    return left.join(right, on, "left").withColumn(key, F.coalesce(F.col(key), F.lit(default)))


def monthly_sales(sales: DataFrame) -> DataFrame:
    months = sales.groupBy(F.year("OrderDate").alias("Year"), F.month("OrderDate").alias("Month"))
    return months.agg(F.count("*").alias("Lines"), F.countDistinct("OrderNumber").alias("Orders"), total(revenue()).alias("Revenue"), ratio(F.sum(revenue()), F.count("*")).alias("MeanLine"))


def yearly_sales(sales: DataFrame) -> DataFrame:
    years = sales.groupBy(F.year("OrderDate").alias("Year"))
    return years.agg(F.count("*").alias("Lines"), F.countDistinct("OrderNumber").alias("Orders"), total(revenue()).alias("Revenue"))


def histogram_of_counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """How many keys have 1, 2, ... rows."""
    return df.groupBy(key).agg(F.count("*").alias(name)).groupBy(name).agg(F.count("*").alias("Keys"))


def mix(df: DataFrame, by: str | Column, name: str, within: list[str] = ()) -> DataFrame:
    """Rows by value with their share, of all rows or within a partition. The window runs over the aggregate, not the rows."""
    value = F.col(by) if isinstance(by, str) else by
    counted = df.groupBy(*within, value.alias(name)).agg(F.count("*").alias("Rows"))
    if within:
        return counted.withColumn("Share", ratio(F.col("Rows"), F.sum("Rows").over(W.partitionBy(*within))))
    return counted.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).select(name, "Rows", ratio(F.col("Rows"), F.col("_all")).alias("Share"))


def band(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first band whose upper edge the value does not pass; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        out = out.when(value <= edge, label)
    return out.otherwise(last)


def share_of_total(sales: DataFrame, key: str, measure: Column) -> DataFrame:
    by_key = sales.groupBy(key).agg(F.sum(measure).alias("m"))
    whole = by_key.agg(F.sum("m").alias("whole"))
    return by_key.crossJoin(F.broadcast(whole)).select(key, F.col("m").cast("double").alias("Amount"), ratio(F.col("m"), F.col("whole")).alias("Share"))


def top_k(sales: DataFrame, key: str, measure: Column, k: int) -> DataFrame:
    """The k keys of largest sums, ties by key: each task keeps k rows, no full sort."""
    return sales.groupBy(key).agg(F.sum(measure).cast("double").alias("Amount")).orderBy(F.desc("Amount"), key).limit(k)


def share_of(df: DataFrame, condition: Column, by: list[str] = (), name: str = "Rate") -> DataFrame:
    """Share of rows that meet a condition, with counts."""
    met = F.count(F.when(condition, 1))
    return df.groupBy(*by).agg(F.count("*").alias("Rows"), met.alias("Met"), ratio(met, F.count("*")).alias(name))


def monthly_cov(sales: DataFrame) -> DataFrame:
    months = sales.groupBy(F.trunc("OrderDate", "month")).agg(F.count("*").alias("n"))
    return months.agg(F.round(F.stddev_samp("n") / F.avg("n"), 9).alias("Cov"))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, max, mean, exact median and sample deviation by column: one pass over the rows, and selection for the medians of all columns."""
    stats = {"Min": F.min, "Max": F.max, "Mean": F.avg, "Std": F.stddev_samp}
    one = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}.{n}") for c in columns for n, f in stats.items()])
    packed = F.array(*[F.struct(F.lit(c).alias("Column"), *[F.col(f"`{c}.{n}`").alias(n) for n in stats]) for c in columns])
    rows = one.select(F.explode(packed).alias("s")).select("s.*")
    every = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("Column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    medians = quantiles(every, ["Column"], F.col("v"), [0.5]).select("Column", F.col("Quantile").alias("Median"))
    return rows.join(medians, "Column", "left").select("Column", "Min", "Max", "Mean", "Median", "Std")


def group_sizes(df: DataFrame, key: str | Column) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.min("n").alias("MinRows"), F.max("n").alias("MaxRows"), ratio(F.sum("n"), F.count("*")).alias("MeanRows"))


def per_key_stats(df: DataFrame, key: str, item: str | None = None) -> DataFrame:
    """Mean, least and most rows, or different items, per key."""
    n = F.countDistinct(item) if item else F.count("*")
    return df.groupBy(key).agg(n.alias("n")).agg(ratio(F.sum("n"), F.count("*")).alias("MeanItems"), F.min("n").alias("MinItems"), F.max("n").alias("MaxItems"))


def repeat_rate(df: DataFrame, key: str) -> DataFrame:
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("Keys"), F.count(F.when(F.col("n") > 1, 1)).alias("Repeated"), ratio(F.count(F.when(F.col("n") > 1, 1)), F.count("*")).alias("Rate"))


def participation(fact: DataFrame, everyone: DataFrame, key: str) -> DataFrame:
    one = fact.agg(F.countDistinct(key).alias("Participants"))
    return one.crossJoin(F.broadcast(everyone.agg(F.countDistinct(key).alias("Everyone")))).withColumn("Rate", ratio(F.col("Participants"), F.col("Everyone")))


def header_from_detail(detail: DataFrame) -> DataFrame:
    """One row an order: the smallest of columns that are constant in it, and whether any line was late."""
    same = ("CustomerKey", "PromotionKey", "CurrencyKey", "ChannelKey", "OrderDate", "TimeKey")
    return detail.groupBy("OrderNumber").agg(*[F.min(c).alias(c) for c in same], F.bool_or("IsOrderDelayed").alias("IsOrderDelayed"))


def invariant_violations(detail: DataFrame, columns: list[str]) -> DataFrame:
    """Orders in which a column that should be constant is not."""
    ends = detail.groupBy("OrderNumber").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    broken = [F.col(f"lo_{c}") != F.col(f"hi_{c}") for c in columns]
    names = F.array_compact(F.array(*[F.when(b, c) for b, c in zip(broken, columns)]))
    return ends.select("OrderNumber", F.concat_ws(",", names).alias("Columns")).where("Columns <> ''")


def merge_partials(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def measures(star_rows: DataFrame, by: list[str] = (), date_role: str = "OrderDate") -> DataFrame:
    """The semantic model's measures by any columns; Year and Month follow the chosen date."""
    rows = star_rows.withColumns({"Year": F.year(date_role), "Month": F.month(date_role)})
    cost = F.sum(F.col("Quantity") * F.col("UnitCost"))
    lag = F.datediff("DeliveryDate", "OrderDate")
    return rows.groupBy(*by).agg(
        total(revenue()).alias("SalesAmount"), cost.cast("double").alias("CostAmount"), (F.sum(revenue()) - cost).cast("double").alias("ProfitAmount"),
        F.count("*").alias("Transactions"), F.countDistinct("CustomerKey").alias("Customers"), F.sum(lag).alias("OrderVsDelivery"),
        F.sum(F.datediff("DeliveryDate", "DueDate")).alias("DueVsDelivery"), ratio(F.sum(lag), F.count("*")).alias("AvgDeliveryLag"),
    )


def matrix(star_rows: DataFrame, levels: list[str]) -> DataFrame:
    """Measures with subtotals. Distinct customers merge from the finest level by bitmaps; money stays decimal until the end."""
    sums = {"_revenue": F.sum(revenue()), "_cost": F.sum(F.col("Quantity") * F.col("UnitCost")), "Transactions": F.count("*")}
    found = grouping_sets(star_rows, levels, rollup_sets(levels), "CustomerKey", "Customers", **sums)
    profit = F.col("_revenue") - F.col("_cost")
    return found.select(*levels, "Level", F.col("_revenue").cast("double").alias("SalesAmount"), F.col("_cost").cast("double").alias("CostAmount"), profit.cast("double").alias("ProfitAmount"), "Transactions", "Customers")


def new_customers(sales: DataFrame, by: list[str]) -> DataFrame:
    """Customers by when they first bought anything."""
    first = sales.groupBy("CustomerKey").agg(F.min("OrderDate").alias("OrderDate"))
    debut = sales.join(first, ["CustomerKey", "OrderDate"], "left_semi")
    return debut.groupBy(*by).agg(F.countDistinct("CustomerKey").alias("NewCustomers"))


def assigned_sales(sales: DataFrame, assignments: DataFrame, by: list[str]) -> DataFrame:
    """Sales credited to the employee only from the first start to the last end of the assignments to that store."""
    window = assignments.groupBy("StoreKey", "EmployeeKey").agg(F.min("StartDate").alias("s"), F.max("EndDate").alias("e"))
    credited = sales.join(window, ["StoreKey", "EmployeeKey"]).where("OrderDate between s and e")
    return credited.groupBy(*by).agg(total(revenue()).alias("SalesAmount"), F.count("*").alias("Lines"))


def digest(df: DataFrame) -> DataFrame:
    """Rows and an order-insensitive sum of row hashes."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.select(number.alias("h")).agg(F.count("*").alias("Rows"), F.sum("h").alias("Digest"))
