"""Weighted picks by alias tables: one slot and one coin a row, found by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.sources.tables import written

#: Weights count as whole parts of this.
PARTS = 1_000_000_000


def alias_table(pool: DataFrame, group: list[str], weight: str, item: str) -> DataFrame:
    """`group`, _n, _slot, _item, _prob, _other: a group of n items as n slots of equal width, each of one item or of two.

    A slot is its own item's with probability _prob and _other's else. Items above the mean weight lend to
    those below: both are laid along a line in the order of items, by what they have too much and what they
    lack, so a slot's lender is the one whose stretch its own begins in, and a lender that has given too much
    borrows from the next. All sums are whole numbers. Items without a positive weight have no slot; items
    are unique in a group. A group's pool is sorted in one task: pools are dimension tables.
    """
    w = W.partitionBy(*group)
    own = pool.where(F.col(weight) > 0)
    part = F.greatest(F.lit(1), F.floor(F.col(weight) / F.sum(weight).over(w).cast("double") * PARTS + 0.5)).cast("long")
    rows = own.select(*group, F.col(item).alias("_item"), part.alias("_m"))
    rows = rows.withColumns({"_n": F.count("*").over(w), "_whole": F.sum("_m").over(w), "_slot": F.row_number().over(w.orderBy("_item")) - 1})
    rows = rows.withColumn("_e", F.col("_n") * F.col("_m") - F.col("_whole")).withColumn("_lends", F.col("_e") >= 0)
    side = W.partitionBy(*group, "_lends").orderBy("_item")
    rows = rows.withColumns({"_upto": F.sum(F.abs("_e")).over(side.rowsBetween(W.unboundedPreceding, 0)), "_next": F.lead("_item").over(side)})
    at = F.when(F.col("_lends"), F.col("_upto")).otherwise(F.col("_upto") - F.abs("_e"))
    # read backwards: the last lender seen is the first whose stretch ends behind; the last borrower the first that ends there or behind
    lender = F.last(F.when(F.col("_lends"), F.col("_item")), ignorenulls=True).over(w.orderBy(at.desc(), F.asc("_lends"), F.desc("_item")).rowsBetween(W.unboundedPreceding, -1))
    behind = F.last(F.when(~F.col("_lends"), F.col("_upto")), ignorenulls=True).over(w.orderBy(F.desc("_upto"), F.asc("_lends"), F.desc("_item")).rowsBetween(W.unboundedPreceding, -1))
    lent = F.lit(1.0) - F.coalesce(behind - F.col("_upto"), F.lit(0)).cast("double") / F.col("_whole")
    prob = F.when(F.col("_lends"), lent).otherwise((F.col("_m") * F.col("_n")).cast("double") / F.col("_whole"))
    return rows.select(*group, "_n", "_slot", "_item", prob.alias("_prob"), F.when(F.col("_lends"), F.coalesce("_next", "_item")).otherwise(lender).alias("_other"))


def pick(rows: DataFrame, table: DataFrame, group: list[str], u: Column, name: str) -> DataFrame:
    """`rows` with an item of their group as `name`, by a uniform number; null where the group has no slots or is null.

    Two joins by equality, on the group for its number of slots, and on group and slot: rows of a large group
    spread over its slots, and Spark may send small tables to all executors.
    """
    g = [f"_g{i}" for i in range(len(group))]
    sizes = table.groupBy(*group).agg(F.max("_n").alias("_n")).toDF(*g, "_n")
    slots = table.select(*group, F.col("_slot").alias("_s"), "_item", "_prob", "_other").toDF(*g, "_s", "_item", "_prob", "_other")
    same = [F.col(a) == F.col(b) for a, b in zip(group, g)]
    asked = rows.withColumn("_u", u).join(sizes, same, "left").drop(*g).withColumn("_at", F.col("_u") * F.col("_n")).withColumn("_slot", F.floor("_at").cast("int"))
    found = asked.join(slots, [*same, F.col("_slot") == F.col("_s")], "left")
    chosen = F.when(F.col("_at") - F.floor("_at") < F.col("_prob"), F.col("_item")).otherwise(F.col("_other"))
    return found.select(*rows.columns, chosen.alias(name))


def weighted_pick(left: DataFrame, pool: DataFrame, group: str, weight: str, item: str, key: str, seed: int) -> DataFrame:
    """One item of the group's pool for each left row, by weight and a keyed number; null where the group has no item of positive weight."""
    return pick(left, alias_table(pool, [group], weight, item), [group], hash_u01(F.col(key), seed=seed), item)


def day_pools(intervals: DataFrame, group: str, start: str, end: str, item: str, weight: str, first: Column, last: Column) -> tuple[DataFrame, DataFrame]:
    """Elementary segments of dated pools: (group, _day, _seg) and the alias table of (group, _seg).

    A group's segments lie between neighbouring bounds of its intervals, so each has one set of items; an
    interval takes part in the run of segments from its own start to its end, found by the numbers of these
    bounds. Open starts and ends are `first` and `last`; days outside these are left out. Where all weights
    of a segment are zero its items are equal. An item counts once in a segment, with its greatest weight.
    Bounds and table are used several times, so they are written, not made anew from the intervals each time.
    """
    own = intervals.select(group, F.col(item).alias("_it"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_wt"), F.greatest(F.coalesce(F.col(start), first), first).alias("_a"), F.date_add(F.least(F.coalesce(F.col(end), last), last), 1).alias("_b"))
    own = own.where("_a < _b and _it is not null")
    bounds = own.select(group, F.explode(F.array("_a", "_b")).alias("_from")).distinct()
    w = W.partitionBy(group).orderBy("_from")
    bounds = written(bounds.withColumns({"_seg": F.row_number().over(w), "_to": F.lead("_from").over(w)}))
    ends = [bounds.select(F.col(group).alias(f"_{x}g"), F.col("_from").alias(f"_{x}d"), F.col("_seg").alias(f"_{x}s")) for x in "ab"]
    runs = own
    for x, e in zip("ab", ends):
        runs = runs.join(e, (F.col(group) == F.col(f"_{x}g")) & (F.col(f"_{x}") == F.col(f"_{x}d")))
    members = runs.select(group, F.explode(F.expr("sequence(_as, _bs - 1)")).alias("_seg"), "_it", "_wt").groupBy(group, "_seg", "_it").agg(F.max("_wt").alias("_wt"))
    none = F.max("_wt").over(W.partitionBy(group, "_seg")) <= 0
    table = written(alias_table(members.withColumn("_wt", F.when(none, 1.0).otherwise(F.col("_wt"))), [group, "_seg"], "_wt", "_it"))
    days = bounds.where(F.col("_to").isNotNull()).select(group, "_seg", F.explode(F.expr("sequence(_from, date_sub(_to, 1))")).alias("_day"))
    return days, table


def pick_by_day(rows: DataFrame, date: str, intervals: DataFrame, group: str, start: str, end: str, item: str, weight: str, keys: list[str], seed: int, name: str) -> DataFrame:
    """`rows` with one of the items whose interval holds the row's day in its group, by weight; null where there is none.

    A row meets the one segment of its group and day, not every interval of its group: the join is by
    equality, and its rows are those of `rows`. Rows of a null group or day have null.
    """
    ends = rows.agg(F.min(date).alias("first"), F.max(date).alias("last"))
    own = intervals.crossJoin(F.broadcast(ends))
    days, table = day_pools(own, group, start, end, item, weight, F.col("first"), F.col("last"))
    days = days.select(F.col(group).alias("_dg"), F.col("_day"), "_seg")
    dated = rows.join(days, (F.col(group) == F.col("_dg")) & (F.col(date) == F.col("_day")), "left").drop("_dg", "_day")
    return pick(dated, table, [group, "_seg"], hash_u01(*[F.col(k) for k in keys], seed=seed), name).drop("_seg")
