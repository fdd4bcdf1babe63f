"""Data-quality checks: each a row of suite, category, check, description, result, actual_value; and their scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.intervals import orphans


def check(df: DataFrame, value: Column, name: str, description: str, suite: str = "core", category: str = "quality", good: Column | None = None) -> DataFrame:
    """One aggregate as a check: PASS where `good` holds of `v` (by default v = 0), INFO without a rule."""
    one = df.agg(value.alias("v"))
    rule = (F.col("v") == 0) if good is None else good
    return one.select(F.lit(suite).alias("suite"), F.lit(category).alias("category"), F.lit(name).alias("check"), F.lit(description).alias("description"), F.when(rule, "PASS").otherwise("FAIL").alias("result"), F.col("v").cast("double").alias("actual_value"))


def count_where(condition: Column | str) -> Column:
    return F.count(F.when(F.expr(condition) if isinstance(condition, str) else condition, 1))


def scorecard(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def run_all(checks: list[DataFrame]) -> DataFrame:
    """All checks, failures first, and a summary row with the verdict."""
    every = scorecard(checks)
    fails = count_where("result = 'FAIL'")
    verdict = every.agg(fails.alias("f"), F.count("*").alias("n")).select(F.lit("summary").alias("suite"), F.lit("summary").alias("category"), F.lit("verdict").alias("check"), F.concat(F.col("n").cast("string"), F.lit(" checks")).alias("description"), F.when(F.col("f") == 0, "PASS").otherwise("FAIL").alias("result"), F.col("f").cast("double").alias("actual_value"))
    rank = F.when(F.col("result") == "FAIL", 0).when(F.col("result") == "PASS", 1).otherwise(2)
    return every.unionByName(verdict).orderBy(rank, "suite", "check")


def fk_check(fact: DataFrame, fk: str, dim: DataFrame | None, pk: str, name: str) -> DataFrame:
    """Distinct orphan keys; a missing dimension fails. Null keys are ignored."""
    if dim is None:
        return check(fact.limit(1), F.lit(1), name, f"{fk}: the dimension is missing", "integrity", "foreign key", F.lit(False))
    return check(orphans(fact, fk, dim, pk), F.count("*"), name, f"{fk} without a dimension row", "integrity", "foreign key")


def pk_checks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Null and repeated primary keys, as two rows."""
    null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    repeated = df.where(~null).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return check(df, count_where(null), f"{name}_null", f"{name}: null keys", "integrity", "primary key").unionByName(check(repeated, F.count("*"), f"{name}_duplicate", f"{name}: repeated keys", "integrity", "primary key"))


def value_list(df: DataFrame, column: str) -> DataFrame:
    """`value:count` of each value, as one text."""
    counted = df.groupBy(F.col(column).cast("string").alias("x")).agg(F.count("*").alias("n"))
    return counted.agg(F.array_join(F.array_sort(F.collect_list(F.concat("x", F.lit(":"), F.col("n").cast("string")))), ", ").alias("Values"))


def relationships(tables: dict[str, DataFrame], declared: list[tuple[str, str, str, str]]) -> DataFrame:
    """For each declared (child, key, parent, key): orphans, repeated parent keys, null child keys."""
    rows = []
    for child, ck, parent, pk in declared:
        c, p = tables[child], tables[parent]
        counts = orphans(c, ck, p, pk).agg(F.count("*").alias("Orphans"))
        twice = p.groupBy(pk).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("RepeatedParents"))
        null = c.agg(count_where(F.col(ck).isNull()).alias("NullChildren"))
        rows.append(counts.crossJoin(twice).crossJoin(null).select(F.lit(f"{child}.{ck} -> {parent}.{pk}").alias("Relationship"), "*"))
    return reduce(DataFrame.unionByName, rows)


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The rows, failing the job at the first that breaks the condition."""
    return df.where(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def row_checks(df: DataFrame, rules: list[tuple[str, str, str]], suite: str, category: str = "quality") -> DataFrame:
    """Many conditions on the rows of one table, (check, description, condition that a bad row meets): one scan counts them all."""
    return measured(df, [(suite, category, n, d, count_where(c), 0.0, 0.0) for n, d, c in rules])


def measured(df: DataFrame, rules: list[tuple[str, str, str, str, Column, float, float]]) -> DataFrame:
    """Many checks on one table, (suite, category, check, description, aggregate, lowest and highest good value): one scan serves them all."""
    one = df.agg(*[v.cast("double").alias(f"c{i}") for i, (*_, v, _, _) in enumerate(rules)])
    parts = [F.struct(*[F.lit(x).alias(k) for k, x in zip(("suite", "category", "check", "description"), r)], F.when(F.col(f"c{i}").between(*r[5:]), "PASS").otherwise("FAIL").alias("result"), F.col(f"c{i}").alias("actual_value")) for i, r in enumerate(rules)]
    return one.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def repeats(df: DataFrame, keys: list[str], name: str, suite: str) -> DataFrame:
    """Keys that more than one row has."""
    return check(repeated(df, keys), F.count("*"), name, f"repeated {', '.join(keys)}", suite)


def share_of(condition: str) -> Column:
    return F.round(count_where(condition).cast("double") / F.nullif(F.count("*").cast("double"), F.lit(0.0)), 6)


def share_check(df: DataFrame, condition: str, low: float, high: float, name: str, suite: str) -> DataFrame:
    """The share of rows that meet a condition, which is to lie between two bounds."""
    return check(df, share_of(condition), name, f"share between {low} and {high}", suite, good=F.col("v").between(low, high))


def churn_rate(periods: DataFrame) -> DataFrame:
    """Distinct subscriptions, those that churned, and their share."""
    churned = F.countDistinct(F.when(F.col("IsChurnPeriod"), F.col("SubscriptionKey")))
    every = F.countDistinct("SubscriptionKey")
    return periods.agg(every.alias("Subscriptions"), churned.alias("Churned"), F.round(churned / F.nullif(every, F.lit(0)), 6).alias("ChurnRate"))


def transition_violations(df: DataFrame, keys: list[str], order: list[str], value: str, reason: str, allowed: list[str]) -> DataFrame:
    """Rows whose value differs from the row before of the key for a reason that is not allowed; a null reason is not."""
    from pyspark.sql import Window as W

    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("Previous", before).where(F.col("Previous").isNotNull() & (F.col("Previous") != F.col(value)) & ~F.coalesce(F.col(reason).isin(allowed), F.lit(False)))
