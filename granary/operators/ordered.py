"""Windows and ranks: keys, sequences, classes, rescaling, filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.operators.selection import quantiles
from granary.sources.tables import written


def dense_surrogate_key(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1..N in a stated order, in two passes: rows are range-partitioned and numbered within partitions, and each partition adds the rows before it. No window sees the whole table."""
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    numbered = parts.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def sequence_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str, start: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) + (start - 1))


def day_banded_order_id(orders: DataFrame, stride: int, first_day: str = "1990-01-01") -> DataFrame:
    """Ids that rise with the date: day number times stride plus the rank within the day."""
    rank = F.row_number().over(W.partitionBy("OrderDate").orderBy("OrderNumber")) - 1
    return orders.withColumn("OrderId", F.datediff("OrderDate", F.lit(first_day)).cast("long") * stride + rank)


def mark_latest(df: DataFrame, keys: list[str], order: list[Column], name: str = "IsPrimary") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1)


def ranked_classes(df: DataFrame, order: list[Column], cuts: list[tuple[float, str]], last: str, name: str, within: list[str] = ()) -> DataFrame:
    """A class by rank: the label of the first cut (a share of the rows) that the rank does not pass.

    The rank over all rows comes from range partitioning, without one window over the table.
    """
    if within:
        ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*within).orderBy(*order))).withColumn("_n", F.count("*").over(W.partitionBy(*within)))
    else:
        parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
        parts = written(parts)
        counts = parts.groupBy("_part").agg(F.count("*").alias("_c"))
        before = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_n"))
        ranked = parts.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part").withColumn("_r", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")
    label = F.lit(last)
    for share, text in reversed(cuts):
        label = F.when(F.col("_r") <= F.floor(F.col("_n") * share), text).otherwise(label)
    return ranked.withColumn(name, label).drop("_r", "_n")


def abc_classify(demand: DataFrame, everything: DataFrame, key: str = "ProductKey", cuts: tuple[float, float] = (0.2, 0.5)) -> DataFrame:
    """A for the best-selling fifth of sold keys, B up to half, C for the rest and for unsold keys."""
    sold = demand.groupBy(key).agg(F.sum("QuantitySold").alias("Sold"))
    classes = ranked_classes(sold, [F.desc("Sold"), F.asc(key)], [(cuts[0], "A"), (cuts[1], "B")], "C", "Class")
    return everything.select(key).distinct().join(classes, key, "left").select(key, F.coalesce("Sold", F.lit(0)).alias("Sold"), F.coalesce("Class", F.lit("C")).alias("Class"))


def quantile_tiers(df: DataFrame, score: str, probabilities: list[float], labels: list[str], name: str) -> DataFrame:
    """Tiers by exact quantile cuts of a score, found by selection; a score on a cut is in the lower tier. Without any score all rows have the last tier."""
    found = quantiles(df, [], F.col(score), probabilities).agg(F.map_from_entries(F.collect_list(F.struct("Probability", "Quantile"))).alias("_m"))
    cuts = found.select(F.transform(F.sequence(F.lit(0), F.lit(len(probabilities) - 1)), lambda i: F.col("_m")[i]).alias("_cuts"))
    tier = F.lit(labels[-1])
    for i in reversed(range(len(probabilities))):
        tier = F.when(F.col(score) <= F.col("_cuts")[i], labels[i]).otherwise(tier)
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, tier).drop("_cuts")


def rescale(df: DataFrame, column: str, lo: float, hi: float, name: str) -> DataFrame:
    """Linear to [lo, hi]; a constant column becomes the middle."""
    ends = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    c = F.col(column).cast("double")
    scaled = F.when(F.col("_hi") > F.col("_lo"), lo + (c - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (hi - lo)).otherwise((lo + hi) / 2)
    return df.crossJoin(F.broadcast(ends)).withColumn(name, scaled).drop("_lo", "_hi")


def normalize_by_group(df: DataFrame, group: str, column: str, alpha: float, lo: float, hi: float, least: int, name: str) -> DataFrame:
    """Factor exp(alpha * (median of logs of all - of the group)), clamped; 1 for small groups. Medians come from selection: no task holds a group's values."""
    logs = df.withColumn("_l", F.ln(F.col(column).cast("double")))
    medians = quantiles(logs, [group], F.col("_l"), [0.5]).select(F.col(group).alias("_own"), F.col("Quantile").alias("_g"))
    groups = logs.groupBy(group).agg(F.count("*").alias("_n")).join(medians, F.col(group).eqNullSafe(F.col("_own")), "left").drop("_own")
    whole = quantiles(logs, [], F.col("_l"), [0.5]).agg(F.max("Quantile").alias("_a"))
    factor = F.least(F.greatest(F.exp(alpha * (F.col("_a") - F.col("_g"))), F.lit(lo)), F.lit(hi))
    factors = groups.crossJoin(F.broadcast(whole)).select(group, F.when(F.col("_n") >= least, factor).otherwise(1.0).alias(name))
    return df.join(factors, group)


def cumulative_product(df: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """Running product of positive numbers."""
    return df.withColumn(name, F.exp(F.sum(F.ln(column)).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))))


def fill_days(df: DataFrame, keys: list[str], date: str, value: str, start: str, end: str) -> DataFrame:
    """A row a day in [start, end]: the last value before, else the first after, also from rows outside; keys without any value are an error when used."""
    own = df.select(*keys, F.col(date).cast("date").alias(date), value)
    ends = own.groupBy(*keys).agg(F.least(F.min(date), F.lit(start).cast("date")).alias("a"), F.greatest(F.max(date), F.lit(end).cast("date")).alias("b"))
    days = ends.select(*keys, F.explode(F.sequence("a", "b")).alias(date))
    w = W.partitionBy(*keys).orderBy(date)
    both = days.join(own, [*keys, date], "left")
    last = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    return both.withColumn(value, F.coalesce(last, first)).where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def urgency_top_k(df: DataFrame, group: list[str], expiry: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """The k rows of each group that end first; open ends last, ties by a keyed hash."""
    order = [F.col(expiry).asc_nulls_last(), hash_u01(F.col(key), seed=seed), F.col(key)]
    return sequence_within(df, group, order, "Rank").where(F.col("Rank") <= k)


def dedupe_keep_last(master: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows, the update winning on equal keys."""
    both = master.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new")))).where("_r = 1").drop("_r", "_new")
