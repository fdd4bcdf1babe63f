"""Exact selection without sorting: a histogram over a value's range, refined only in the bin where a running total passes its target.

Ranks, quantiles, largest remainders and levels of a capped share are one question: at which value does a
total that grows along the values reach a target? Every pass counts bins where the rows are (partial sums
come before the shuffle) and keeps one bin a target; the rows of that bin are ranked once they are few. No
task holds all values of a group, however large it is, and equal values count as one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.sources.tables import written

#: Bins of a pass; ranges with more rows than LIMIT are refined; so many ranges at most are sent to all executors.
BINS, LIMIT, SMALL = 1024, 100_000, 20_000
PASSES = 250


def first_crossing(df: DataFrame, group: list[str], value: Column, targets: Column | DataFrame, a: Column | None = None, b: Column | None = None, limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """Columns of `group`, Target (its place in `targets`, from 0), Value, BelowA, BelowB, SumB: where each group's total reaches a target.

    The total at a value v is the sum of `a` over rows up to v, plus v times the sum of `b` over the rows
    above; it must not fall as v rises. `targets` is an array made of _n, _a and _b, the group's rows and
    sums, or a table with one target (_need) a group, which then is the result's column _t. Value is the least of the group's values at which the total is the target or more, BelowA and
    BelowB are the sums over rows below it. Targets that the total never reaches, and null values, have no
    row. By default `a` is 1 and `b` is 0: the total is the rank.
    """
    rows = df.select(*group, value.cast("double").alias("_v"), (F.lit(1) if a is None else a).cast("double").alias("_x"), (F.lit(0) if b is None else b).cast("double").alias("_y"))
    rows = written(rows.where(F.col("_v").isNotNull()))
    whole = rows.groupBy(*group).agg(F.count("*").alias("_n"), F.sum("_x").alias("_a"), F.sum("_y").alias("_b"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if isinstance(targets, DataFrame):
        whole = whole.join(targets, group) if group else whole.crossJoin(F.broadcast(targets))
        targets = F.array("_need")
    ranges = whole.select(*group, "_n", "_lo", "_hi", F.col("_b").alias("_all"), F.lit(0.0).alias("_below"), F.lit(0.0).alias("_over"), F.posexplode(targets).alias("Target", "_t"))
    ranges = written(ranges)
    for _ in range(PASSES):
        wide = (F.col("_n") > limit) & (F.col("_lo") < F.col("_hi"))
        if ranges.where(wide).isEmpty():
            break
        inside = _within(rows, ranges.where(wide), group)
        at = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1))
        found = inside.groupBy(*group, "Target", at.alias("_bin")).agg(F.count("*").alias("_m"), F.sum("_x").alias("_p"), F.sum("_y").alias("_q"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        ranges = written(ranges.where(~wide).unionByName(_crossed(found, ranges, group, "_to", "_bin").select(*group, F.col("_m").alias("_n"), F.col("_from").alias("_lo"), F.col("_to").alias("_hi"), "_all", F.col("_base").alias("_below"), F.col("_past").alias("_over"), "Target", "_t")))
    inside = _within(rows, ranges, group).groupBy(*group, "Target", "_v").agg(F.sum("_x").alias("_p"), F.sum("_y").alias("_q"))
    return _crossed(inside, ranges, group, "_v", "_v").select(*group, "Target", F.col("_v").alias("Value"), F.col("_base").alias("BelowA"), F.col("_past").alias("BelowB"), F.col("_all").alias("SumB"), "_t")


def _within(rows: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """Each row with the ranges of its group that hold its value."""
    own = ranges.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "Target", "_lo", "_hi")
    small = own.count() <= SMALL
    on = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return rows.join(F.broadcast(own) if small or not group else own, on)


def _crossed(found: DataFrame, ranges: DataFrame, group: list[str], end: str, order: str) -> DataFrame:
    """The first of the ordered parts of each range at whose end the total reaches the target, with the sums before it."""
    own = ranges.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("Target").alias("_k"), "_t", "_all", "_below", "_over")
    on = F.col("Target") == F.col("_k")
    for i, c in enumerate(group):
        on = on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    w = W.partitionBy(*group, "Target").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = found.withColumns({"_sp": F.sum("_p").over(w), "_sq": F.sum("_q").over(w)}).join(own, on)
    base, past = F.col("_below") + F.col("_sp") - F.col("_p"), F.col("_over") + F.col("_sq") - F.col("_q")
    total = base + F.col("_p") + F.col(end) * (F.col("_all") - past - F.col("_q"))
    reached = sums.withColumns({"_base": base, "_past": past}).where(total >= F.col("_t"))
    return reached.withColumn("_r", F.row_number().over(W.partitionBy(*group, "Target").orderBy(order))).where("_r = 1")


def quantiles(df: DataFrame, group: list[str], value: Column, probabilities: list[float], limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """`group`, Probability (its place, from 0), Quantile: exact, interpolated between the two values at p * (n - 1).

    Groups without values have no row.
    """
    at = [F.lit(float(p)) * (F.col("_n") - 1) for p in probabilities]
    targets = F.array(*[x + 1 for p in at for x in (F.floor(p).cast("double"), F.ceil(p).cast("double"))])
    found = first_crossing(df, group, value, targets, limit=limit, bins=bins)
    size = df.where(value.isNotNull()).groupBy(*group).agg(F.count("*").alias("_n"))
    on = F.lit(True)
    for i, c in enumerate(group):
        size, on = size.withColumnRenamed(c, f"_g{i}"), on & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    which = F.floor(F.col("Target") / 2).cast("int")
    share = F.element_at(F.array(*[p - F.floor(p) for p in at]), which + 1)
    both = found.join(size if group else F.broadcast(size), on).select(*group, which.alias("Probability"), "Target", "Value", share.alias("_f"))
    low, high = (F.max(F.when(F.col("Target") % 2 == k, F.col("Value"))) for k in (0, 1))
    return both.groupBy(*group, "Probability").agg((low + (high - low) * F.max("_f")).alias("Quantile"))
