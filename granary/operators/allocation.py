"""Allocation and keyed sampling: exact totals, weights, results that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.operators.selection import first_crossing
from granary.sources.tables import written


def allocate(df: DataFrame, weight: str, total: Column, group: list[str], key: str, name: str = "Allocated") -> DataFrame:
    """Whole numbers by weight that sum to `total` in each group: floors, and one more for the largest remainders, ties by key."""
    w = W.partitionBy(*group)
    exact = total * F.col(weight) / F.sum(weight).over(w)
    rows = df.withColumn("_e", exact).withColumn("_f", F.floor(F.round("_e", 9))).withColumn("_r", F.round(F.col("_e") - F.col("_f"), 9))
    rank = F.row_number().over(w.orderBy(F.desc("_r"), key))
    return rows.withColumn(name, (F.col("_f") + F.when(rank <= total - F.sum("_f").over(w), 1).otherwise(0)).cast("long")).drop("_e", "_f", "_r")


def apportion_cents(df: DataFrame, total: str, weight: str, group: list[str], order: str, name: str) -> DataFrame:
    """A line's cents over its events, in whole cents that sum to it: whole-number division, then one cent by rank of the rest."""
    w = W.partitionBy(*group)
    cents = F.round(F.col(total) * 100).cast("long")
    share = cents * F.col(weight)
    whole = F.sum(weight).over(w)
    rows = df.withColumn("_q", F.floor(share / whole).cast("long")).withColumn("_m", share - F.col("_q") * whole)
    rank = F.row_number().over(w.orderBy(F.desc("_m"), order))
    return rows.withColumn(name, (F.col("_q") + F.when(rank <= cents - F.sum("_q").over(w), 1).otherwise(0)) / F.lit(100.0)).drop("_q", "_m")


def weighted_sample_wor(df: DataFrame, group: list[str], weight: str, key: str, k: int, seed: int) -> DataFrame:
    """k rows of each group without replacement: the smallest of -ln(u) / weight."""
    race = -F.ln(1 - hash_u01(F.col(key), seed=seed)) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("_k", F.row_number().over(W.partitionBy(*group).orderBy(race, key))).where(F.col("_k") <= k).drop("_k")


def first_n(df: DataFrame, group: list[str], value: Column, key: str, n: str) -> DataFrame:
    """The first rows of each group by value, then by a numeric key: as many as the column `n` says, which is constant in a group.

    The value at which the count is reached is found by selection, and then the key among the rows of just
    that value, so no window sees a group. A group with fewer rows gives all; rows with a null value or key
    are none. Keys below 2^53 are told apart.
    """
    rows = written(df.withColumn("_v", value.cast("double")).where(F.col("_v").isNotNull() & F.col(key).isNotNull() & (F.col(n) > 0)))
    last = _threshold(rows, group, F.col("_v"), n)
    met = _beside(rows, last.select(*group, F.col("_at").alias("_cut"), "_left"), group)
    ties = written(met.where(F.col("_v") == F.col("_cut")).drop("_cut"))
    among = _threshold(ties, group, F.col(key), "_left").select(*group, F.col("_at").alias("_last"))
    below = met.where(F.col("_cut").isNull() | (F.col("_v") < F.col("_cut"))).drop("_cut", "_left", "_v")
    return below.unionByName(_beside(ties, among, group).where(F.col("_last").isNull() | (F.col(key) <= F.col("_last"))).drop("_last", "_left", "_v"))


def _beside(rows: DataFrame, own: DataFrame, group: list[str]) -> DataFrame:
    """All rows with what `own` has for their group, or without a group its one row or none."""
    return rows.join(own, group, "left") if group else rows.join(F.broadcast(own), F.lit(True), "left")


def _threshold(rows: DataFrame, group: list[str], value: Column, n: str) -> DataFrame:
    """group, _at (the n-th least value), _left (how many rows of that value are among the first n); no row for groups of fewer."""
    own = rows.select(*group, value.alias("_value"), F.col(n).cast("double").alias("_need"))
    wants = own.groupBy(*group).agg(F.max("_need").alias("_need"))
    found = first_crossing(own.drop("_need"), group, F.col("_value"), wants)
    return found.select(*group, F.col("Value").alias("_at"), (F.col("_t") - F.col("BelowA")).alias("_left"))


def allocate_by_remainder(df: DataFrame, weight: Column, total: Column, group: list[str], key: str, name: str = "Allocated") -> DataFrame:
    """Whole numbers by whole weights that sum to `total` in each group, however many rows a group has.

    Floors of the exact shares, and one more for the largest remainders, ties by key, all in whole numbers;
    the last remainder that gets one is found by selection (`first_n`). Keys are unique in a group; rows of a
    null group, or of one without weight, are left out.
    """
    big = "decimal(38,0)"
    rows = df.withColumns({"_w": weight.cast("long"), "_t": total.cast("long")})
    sums = rows.groupBy(*group).agg(F.sum("_w").alias("_s"))
    rows = _beside(rows, sums, group)
    scaled = F.col("_w").cast(big) * F.col("_t").cast(big)
    rows = rows.where("_s > 0").withColumn("_f", F.floor(scaled / F.col("_s")).cast("long"))
    rows = rows.withColumn("_f", F.col("_f") + F.when(F.col("_f").cast(big) * F.col("_s") > scaled, -1).when((F.col("_f") + 1).cast(big) * F.col("_s") <= scaled, 1).otherwise(0))
    rows = written(rows.withColumn("_m", (scaled - F.col("_f").cast(big) * F.col("_s")).cast("long")))
    return _with_rest(rows, group, key, -F.col("_m"), F.col("_m") > 0, name).drop("_w", "_t", "_s", "_f", "_m")


def _with_rest(rows: DataFrame, group: list[str], key: str, value: Column, fits: Column, name: str) -> DataFrame:
    """_f, and one more for the first rows by value that fit, until the group's sum is _t."""
    rest = rows.groupBy(*group).agg((F.max("_t") - F.sum("_f")).alias("_rest"))
    open_rows = rows.where(fits)
    open_rows = _beside(open_rows, rest, group)
    more = first_n(open_rows.select(*group, key, value.alias("_p"), "_rest"), group, F.col("_p"), key, "_rest").select(*group, key, F.lit(1).alias("_one"))
    return rows.join(more, [*group, key], "left").withColumn(name, F.col("_f") + F.coalesce("_one", F.lit(0))).drop("_one")


def fit_total(orders: DataFrame, lines: str, total: int, most: int, key: str, name: str = "Lines") -> DataFrame:
    """Lines per order moved to an exact total, each in [1, most].

    What is missing is spread over the orders by their headroom (most - lines), what is too much by what they
    can lose (lines - 1): floors, and one line more for the largest remainders, ties by key. ValueError where
    the headroom does not suffice. Orders with fewer than 1 or more than `most` lines start at that bound.
    """
    rows = written(orders.withColumn("_l", F.least(F.greatest(F.coalesce(F.col(lines), F.lit(1)), F.lit(1)), F.lit(most)).cast("long")))
    now = rows.agg(F.coalesce(F.sum("_l"), F.lit(0)).alias("n"), F.count("*").alias("orders")).first()
    lack = total - now.n
    if not now.orders <= total <= most * now.orders:
        raise ValueError(f"{total} lines do not fit {now.orders} orders of 1 to {most}: there is room for {now.orders} to {most * now.orders}")
    room = most - F.col("_l") if lack > 0 else F.col("_l") - 1
    if lack == 0:
        return rows.withColumn(name, F.col("_l")).drop("_l")
    moved = allocate_by_remainder(rows.withColumn("_room", room), F.col("_room"), F.lit(abs(lack)), [], key, "_move")
    return moved.withColumn(name, F.col("_l") + F.col("_move") * (1 if lack > 0 else -1)).drop("_l", "_room", "_move")


def allocate_capped(df: DataFrame, weight: str, cap: str, total: int, group: list[str], key: str, name: str = "Share") -> DataFrame:
    """Whole numbers by weight, none above its whole cap, that sum to `total` in each group; what is above a cap goes to the others by weight.

    The level up to which shares rise is where the sum of min(cap, level * weight) is the total: it is
    searched over a histogram of cap / weight, refined in one bin a group. Floors, then one more for the
    largest remainders, ties by key. ValueError where a group's caps do not hold the total. Rows without a
    positive weight get 0. Keys are unique in a group; a null group is not one.
    """
    rows = written(df.withColumns({"_w": F.col(weight).cast("double"), "_c": F.greatest(F.col(cap).cast("long"), F.lit(0)), "_t": F.lit(total).cast("long")}))
    weighed = rows.where("_w > 0")
    short = rows.groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("_w") > 0, F.col("_c"))), F.lit(0)).alias("_room")).where(F.col("_room") < total)
    if lacking := short.count():
        raise ValueError(f"{lacking} groups cannot hold {total}")
    found = first_crossing(weighed, group, F.col("_c") / F.col("_w"), F.array(F.lit(float(total))), F.col("_c"), F.col("_w"))
    level = found.select(*group, ((F.lit(float(total)) - F.col("BelowA")) / (F.col("SumB") - F.col("BelowB"))).alias("_level"))
    rows = _beside(rows, level, group)
    share = F.when(F.col("_w") > 0, F.least(F.col("_c").cast("double"), F.col("_level") * F.col("_w"))).otherwise(0.0)
    rows = written(rows.withColumn("_x", F.round(share, 9)).withColumn("_f", F.floor("_x").cast("long")))
    part = F.round(F.col("_x") - F.col("_f"), 9)
    return _with_rest(rows, group, key, -part, (part > 0) & (F.col("_f") < F.col("_c")), name).drop("_w", "_c", "_t", "_level", "_x", "_f")


def stratified_sample(df: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """About n rows, by largest remainders over the groups' sizes; rows by keyed hash, ties by a numeric key, without a window over a group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_all", F.lit(1))
    quota = allocate(sizes, "_n", F.lit(n), ["_all"], group, "_quota").select(group, "_quota")
    return first_n(df.join(quota, group), [group], hash_u01(F.col(key), seed=seed), key, "_quota").drop("_quota")


def trim_value(df: DataFrame, column: str, value: str, most: int, key: str, seed: int, stratum: str) -> DataFrame:
    """At most `most` rows of one value, spread over its strata by their sizes and taken by keyed hash; all rows of others, nulls among them."""
    own = written(df.where(F.col(column) == value))
    few = own if own.count() <= most else stratified_sample(own, stratum, key, most, seed).select(df.columns)
    return df.where(~F.col(column).eqNullSafe(value)).unionByName(few)


def expand(df: DataFrame, n: str, name: str = "Index") -> DataFrame:
    """Each row n times, numbered from 1."""
    return df.where(F.col(n) > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))


def pack(df: DataFrame, parent: str, item: str, count: str, threshold: int) -> DataFrame:
    """Greedy groups of a parent's items, in order, until a threshold; larger items alone. The parent's items are few: they fold as one array."""
    rows = df.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct(F.col(item).cast("string").alias("item"), F.col(count).cast("long").alias("n")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("group"), F.array().cast("array<struct<item:string,pack:int>>").alias("out"))

    def add(s: Column, x: Column) -> Column:
        new = (s["sum"] + x["n"] > threshold) & (s["sum"] > 0)
        group = s["group"] + new.cast("int")
        return F.struct(F.when(new, x["n"]).otherwise(s["sum"] + x["n"]).alias("sum"), group.alias("group"), F.concat(s["out"], F.array(F.struct(x["item"].alias("item"), group.alias("pack")))).alias("out"))

    return rows.select(parent, F.explode(F.aggregate("items", start, add, lambda s: s["out"])).alias("o")).select(parent, F.col("o.item").alias(item), F.col("o.pack").alias("Pack"))


def index_band(df: DataFrame, index: str, total: Column, shards: int) -> DataFrame:
    """The shard of a global index when shards are contiguous and differ by one row at most."""
    return df.withColumn("Shard", F.floor(F.col(index) * shards / total).cast("int"))


def greedy_hubs(sizes: DataFrame, scope: str, name: str, size: str, least: int) -> DataFrame:
    """Adds Hub, from 1 in each scope: names of `least` or more stand alone, the others join, largest first, until their hub has so many.

    A scope's last hub may stay smaller. A scope is a row of its names (areas of a country, countries of a zone).
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(size)).alias("n"), F.col(name).alias("name"))))
    start = F.struct(F.lit(1).cast("long").alias("hub"), F.lit(0).cast("long").alias("held"), F.array().cast(f"array<struct<name:{sizes.schema[name].dataType.simpleString()},hub:bigint>>").alias("out"))

    def put(a: Column, x: Column) -> Column:
        held = a["held"] + (-x["n"]).cast("long")
        full = held >= least
        return F.struct((a["hub"] + full.cast("long")).alias("hub"), F.when(full, F.lit(0).cast("long")).otherwise(held).alias("held"), F.concat(a["out"], F.array(F.struct(x["name"].alias("name"), a["hub"].alias("hub")))).alias("out"))

    packed = sizes.groupBy(scope).agg(ordered.alias("_names")).select(scope, F.explode(F.aggregate("_names", start, put)["out"]).alias("_p"))
    return packed.select(scope, F.col("_p.name").alias(name), F.col("_p.hub").alias("Hub"))
