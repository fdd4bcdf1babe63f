"""Customers of a month: who may order, who does, and which order is whose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.operators.ordered import dense_surrogate_key


def place_within(df: DataFrame, group: str, order: list[str], name: str = "Place") -> DataFrame:
    """Each row's place in its group, from 0, in a stated order that has no ties.

    Places are numbers over all rows less the group's first: a group may hold most rows, since no window sees it.
    """
    rows = dense_surrogate_key(df, [group, *order], "_number")
    first = rows.groupBy(group).agg(F.min("_number").alias("_first"))
    return rows.join(first, group).withColumn(name, F.col("_number") - F.col("_first")).drop("_number", "_first")


def month_pool(customers: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The distinct customers of each month: MonthStart, CustomerKey, Weight and Place (0 to Target - 1 at most).

    `customers` has CustomerKey, Start, End and Debut (first days of months) and Weight; `targets` has
    MonthStart and Target. Whoever makes a debut in the month comes first, those that end first before
    others; then those introduced before, by weight without replacement. A month in which nobody has been
    introduced draws from all that are active, so that its orders are not lost. Months without a target, or
    without active customers, have no pool.
    """
    rows = customers.withColumn("MonthStart", F.explode(F.expr("sequence(Start, End, interval 1 month)")))
    u = hash_u01(F.col("CustomerKey"), F.col("MonthStart"), seed=seed)
    kind = F.when(F.col("Debut") == F.col("MonthStart"), 0).when(F.col("Debut") < F.col("MonthStart"), 1).otherwise(2)
    rows = rows.withColumn("_kind", kind).withColumn("_end", F.when(F.col("_kind") == 0, F.col("End")))
    rows = rows.withColumn("_race", F.when(F.col("_kind") == 0, u).otherwise(-F.ln(1 - u) / F.col("Weight")))
    wanted = rows.groupBy("MonthStart").agg(F.min("_kind").alias("_least")).join(targets.select("MonthStart", "Target"), "MonthStart")
    able = rows.join(wanted, "MonthStart").where("_kind < 2 or _least = 2").select("MonthStart", "CustomerKey", "Weight", "Target", "_kind", "_end", "_race")
    placed = place_within(able, "MonthStart", ["_kind", "_end", "_race", "CustomerKey"])
    return placed.where("Place < Target").select("MonthStart", "CustomerKey", "Weight", "Place")


def assign_customers(orders: DataFrame, pool: DataFrame, seed: int) -> DataFrame:
    """OrderNumber, MonthStart, CustomerKey: a month's first orders go to its customers one by one, all later ones by weight.

    A later order draws one of the pool's slots by a keyed number; a customer has as many slots as their weight,
    a whole number. Both kinds are found by one join on (month, kind, place). Orders of a month without a
    pool have a null customer.
    """
    ranked = place_within(orders.select("OrderNumber", "MonthStart"), "MonthStart", ["OrderNumber"], "_j")
    own = pool.select("MonthStart", "CustomerKey", "Place", F.col("Weight").cast("int").alias("_weight"))
    slots = own.where("_weight > 0").withColumn("_copy", F.explode(F.expr("sequence(1, _weight)")))
    slots = place_within(slots, "MonthStart", ["Place", "_copy"], "_at").select("MonthStart", F.lit(1).alias("_kind"), "_at", "CustomerKey")
    found = own.select("MonthStart", F.lit(0).alias("_kind"), F.col("Place").alias("_at"), "CustomerKey").unionByName(slots)
    sizes = own.groupBy("MonthStart").agg(F.count("*").alias("_n"), F.sum("_weight").alias("_slots"))
    u = hash_u01(F.col("MonthStart"), F.col("_j"), seed=seed)
    asked = ranked.join(sizes, "MonthStart", "left").withColumn("_kind", (F.col("_j") >= F.col("_n")).cast("int"))
    asked = asked.withColumn("_at", F.when(F.col("_kind") == 0, F.col("_j")).otherwise(F.floor(u * F.col("_slots"))))
    return asked.join(found, ["MonthStart", "_kind", "_at"], "left").select("OrderNumber", "MonthStart", "CustomerKey")
