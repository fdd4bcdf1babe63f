"""Weights, prices and keyed choices for sales lines: columns and joins, no row-wise code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.operators.alias import pick_by_day, weighted_pick


def band_step(value: Column, bands: list[tuple[float, float]], last: float) -> Column:
    """The step of the first band whose upper edge the value does not pass."""
    out = F.lit(last)
    for edge, step in reversed(bands):
        out = F.when(value <= edge, step).otherwise(out)
    return out


def snap_discount(discount: Column, price: Column, bands: list[tuple[float, float]], last: float) -> Column:
    """A discount to steps of its own size, never above the price."""
    step = band_step(discount, bands, last)
    return F.least(F.floor(discount / step + 0.5) * step, price)


def inflation(date: Column, anchor: str, rate: float, lo: float, hi: float) -> Column:
    """(1 + rate) to the years from a fixed month, clamped."""
    months = (F.year(date) * 12 + F.month(date)) - (int(anchor[:4]) * 12 + int(anchor[5:7]))
    return F.least(F.greatest(F.pow(F.lit(1 + rate), months / 12), F.lit(lo)), F.lit(hi))


def reprice(lines: DataFrame, rate: float = 0.03, anchor: str = "1995-01-01", bands=((500.0, 5.0), (1000.0, 10.0)), last: float = 50.0) -> DataFrame:
    """Line prices anew: inflation, step, cost at most the price, discount by promotion, a margin of a cent at least, whole cents."""
    unit = F.col("UnitPrice").cast("double") * inflation(F.col("OrderDate"), anchor, rate, 0.5, 2.0)
    step = band_step(F.col("_u"), list(bands), last)
    snapped = F.greatest(F.floor(F.col("_u") / step + 0.5) * step, step)
    rows = lines.withColumn("_u", unit).withColumn("_p", snapped).withColumn("_c", F.least(F.col("UnitCost").cast("double"), F.col("_p") - 0.01))
    rows = rows.withColumn("_d", F.least(F.floor(F.col("_p") * (F.col("PromotionKey") - 1)) / 100, F.col("_p") - F.col("_c") - 0.01))
    rows = rows.withColumn("_d", F.greatest(F.col("_d"), F.lit(0.0)))
    cents = lambda c: F.floor(c * 100 + 0.5) / 100
    return rows.withColumns({"NewPrice": cents(F.col("_p")), "NewDiscount": cents(F.col("_d")), "NewNet": cents(F.col("_p") - F.col("_d"))}).drop("_u", "_p", "_c", "_d")


def elastic_quantity(quantity: Column, price: Column, reference: Column, elasticity: float, lo: int, hi: int) -> Column:
    factor = F.pow(price / reference, F.lit(-elasticity))
    return F.least(F.greatest(F.rint(quantity * factor), F.lit(float(lo))), F.lit(float(hi))).cast("int")


def salience(promos: DataFrame, discount: str, beta: float, ratio: float) -> DataFrame:
    """exp(beta * discount), floored at the largest over `ratio`."""
    raw = promos.withColumn("_w", F.exp(F.lit(beta) * F.col(discount)))
    top = raw.agg(F.max("_w").alias("_m"))
    return raw.crossJoin(F.broadcast(top)).withColumn("Weight", F.greatest("_w", F.col("_m") / ratio)).drop("_w", "_m")


def day_weights(days: DataFrame, weights: list[float], zero_share: float, seed: int) -> DataFrame:
    """Weekday weights (from Sunday), some days zero by hash, summing to 1 in each month."""
    base = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.dayofweek("Date"))
    raw = days.withColumn("_w", F.when(hash_u01(F.col("Date"), seed=seed) < zero_share, 0.0).otherwise(base))
    month = W.partitionBy(F.trunc("Date", "month"))
    return raw.withColumn("Weight", F.col("_w") / F.sum("_w").over(month)).drop("_w")


def hour_weights(channels: DataFrame) -> DataFrame:
    """24 shares a channel, zero outside its hours."""
    hours = channels.withColumn("Hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    raw = hours.withColumn("_w", F.when(F.col("Hour").between(F.col("Opens"), F.col("Closes") - 1), 1.0 + F.col("Hour") % 5).otherwise(0.0))
    return raw.withColumn("Weight", F.col("_w") / F.sum("_w").over(W.partitionBy("ChannelKey"))).drop("_w")


def pick_minute(orders: DataFrame, hours: DataFrame, seed: int) -> DataFrame:
    """A minute of day for each order: an hour by its channel's weights and a hashed minute."""
    picked = weighted_pick(orders, hours.where("Weight > 0"), "ChannelKey", "Weight", "Hour", "OrderNumber", seed)
    return picked.withColumn("TimeKey", F.col("Hour") * 60 + F.floor(hash_u01(F.col("OrderNumber"), seed=seed, salt=1) * 60).cast("int"))


def assign_promo(lines: DataFrame, promos: DataFrame, seed: int) -> DataFrame:
    """At most one promotion that runs on the order's day and serves the line's ChannelGroup, by Weight; lines without one get key 1.

    `promos` has PromotionKey, ChannelGroup (null: all groups), StartDate, EndDate and Weight.
    """
    groups = lines.select("ChannelGroup").where(F.col("ChannelGroup").isNotNull()).distinct()
    everywhere = promos.where(F.col("ChannelGroup").isNull()).drop("ChannelGroup").crossJoin(groups)
    own = promos.where(F.col("ChannelGroup").isNotNull()).unionByName(everywhere.select(promos.columns)).withColumnRenamed("PromotionKey", "_promo")
    picked = pick_by_day(lines.drop("PromotionKey"), "OrderDate", own, "ChannelGroup", "StartDate", "EndDate", "_promo", "Weight", ["OrderNumber", "OrderLineNumber"], seed, "PromotionKey")
    return picked.withColumn("PromotionKey", F.coalesce("PromotionKey", F.lit(1)))


def assign_employee(orders: DataFrame, assignments: DataFrame, manager: Column, seed: int) -> DataFrame:
    """A salesperson whose assignment to the store holds on the day, by Weight; -1 where there is none. Managers sell nothing.

    `assignments` has StoreKey, EmployeeKey, StartDate, EndDate (null: open) and Weight; where all weights of a
    day are zero, those present are equal.
    """
    staff = assignments.where(~manager)
    picked = pick_by_day(orders, "OrderDate", staff, "StoreKey", "StartDate", "EndDate", "EmployeeKey", "Weight", ["OrderNumber"], seed, "Seller")
    return picked.withColumn("Seller", F.coalesce("Seller", F.lit(-1)))


def pick_store(orders: DataFrame, stores: DataFrame, local: float, seed: int) -> DataFrame:
    """A store of the customer's country for a share of the orders, any store for the others."""
    everywhere = F.lit("*")
    pool = stores.select(F.col("Country").alias("g"), "StoreKey", F.lit(1).alias("w")).unionByName(stores.select(everywhere.alias("g"), "StoreKey", F.lit(1).alias("w")))
    served = stores.select(F.col("Country").alias("_c")).distinct()
    rows = orders.join(served, F.col("Country") == F.col("_c"), "left")
    near = (hash_u01(F.col("OrderNumber"), seed=seed, salt=1) < local) & F.col("_c").isNotNull()
    return weighted_pick(rows.withColumn("g", F.when(near, F.col("Country")).otherwise(everywhere)).drop("_c"), pool, "g", "w", "StoreKey", "OrderNumber", seed).drop("g")


def wishlist(purchases: DataFrame, products: DataFrame, per_customer: int, seed: int) -> DataFrame:
    """Wishes of the categories a customer bought from, none of what they have, by keyed order.

    Of a category the first 4 * per_customer products that the customer does not have take part, in a
    keyed order of products: these are among as many more as the customer has of it, so they are looked up by their
    place in that order. Categories that come after enough products of others take no part.
    """
    take = 4 * per_customer
    ranked = products.select("ProductKey", "Category").where(F.col("Category").isNotNull())
    ranked = ranked.withColumns({"_r": F.row_number().over(W.partitionBy("Category").orderBy(hash_u01(F.col("ProductKey"), seed=seed), "ProductKey")), "_of": F.count("*").over(W.partitionBy("Category"))})
    bought = purchases.select("CustomerKey", "ProductKey").join(ranked, "ProductKey").repartition("CustomerKey")
    likes = bought.groupBy("CustomerKey", "Category").agg(F.count("*").alias("n"), F.collect_list("_r").alias("_had"), F.max("_of").alias("_of"))
    # a purchase without a customer is nobody's
    had = F.when(F.col("CustomerKey").isNull(), F.array().cast("array<int>")).otherwise(F.col("_had"))
    before = W.partitionBy("CustomerKey").orderBy(F.desc("n")).rangeBetween(W.unboundedPreceding, -1)
    likes = likes.withColumn("_had", had).withColumn("_free", F.col("_of") - F.size("_had"))
    likes = likes.withColumn("_before", F.sum(F.least(F.col("_free"), F.lit(take))).over(before)).where(F.coalesce("_before", F.lit(0)) < per_customer)
    first = F.sequence(F.lit(1), F.least(F.col("_of"), F.size("_had") + take).cast("int"))
    places = likes.select("CustomerKey", "Category", "n", F.explode(F.slice(F.array_except(first, "_had"), 1, take)).alias("_r"))
    order = W.partitionBy("CustomerKey").orderBy(F.desc("n"), hash_u01(F.col("CustomerKey"), F.col("ProductKey"), seed=seed), "ProductKey")
    return places.join(ranked.drop("_of"), ["Category", "_r"]).withColumn("Rank", F.row_number().over(order)).where(F.col("Rank") <= per_customer).select("CustomerKey", "ProductKey", "Rank")


def complaints(lines: DataFrame, rate: float, seed: int) -> DataFrame:
    """Complaints of a keyed share of lines, most resolved after some days."""
    key = (F.col("OrderNumber"), F.col("OrderLineNumber"))
    picked = lines.where(hash_u01(*key, seed=seed, salt=1) < rate)
    made = F.date_add("DeliveryDate", F.floor(hash_u01(*key, seed=seed, salt=2) * 20).cast("int"))
    days = F.floor(hash_u01(*key, seed=seed, salt=3) * 15).cast("int") + 1
    solved = hash_u01(*key, seed=seed, salt=4) < 0.8
    return picked.select("CustomerKey", "OrderNumber", "OrderLineNumber", made.alias("ComplaintDate"), F.when(solved, F.date_add(made, days)).alias("ResolutionDate"), F.when(solved, days).alias("ResponseDays"))


def capped_shares(df: DataFrame, weight: str, cap: str, total: int, group: list[str], key: str) -> DataFrame:
    """Real shares of a total by weight, none above its cap, the excess spread over the others by weight (in whole numbers: `allocation.allocate_capped`).

    Closed form: rows in the order of cap over weight are full up to a point; the rest share what is left.
    """
    w = W.partitionBy(*group).orderBy(F.col(cap) / F.col(weight), key)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    caps = F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum(weight).over(W.partitionBy(*group)) - F.coalesce(F.sum(weight).over(before), F.lit(0))
    level = (F.lit(float(total)) - caps) / weights
    rows = df.withColumn("_level", level).withColumn("_full", F.col(cap) / F.col(weight) <= F.col("_level"))
    open_level = F.min(F.when(~F.col("_full"), F.struct((F.col(cap) / F.col(weight)).alias("o"), F.col(key).alias("k"), F.col("_level").alias("l")))).over(W.partitionBy(*group))["l"]
    return rows.withColumn("Share", F.when(F.col("_full"), F.col(cap).cast("double")).otherwise(F.col(weight) * open_level)).drop("_level", "_full")


def hierarchy(stores: DataFrame, per_district: int, per_region: int) -> DataFrame:
    """Districts of a country's stores in order, regions of districts."""
    n = F.row_number().over(W.partitionBy("Country").orderBy("StoreKey")) - 1
    return stores.withColumn("District", F.floor(n / per_district).cast("int") + 1).withColumn("StoreRegion", F.floor((F.col("District") - 1) / per_region).cast("int") + 1)


def short_number(value: Column) -> Column:
    return F.when(value >= 1_000_000, F.concat(F.floor(value / 1_000_000).cast("string"), F.lit("M"))).when(value >= 1000, F.concat(F.floor(value / 1000).cast("string"), F.lit("K"))).otherwise(F.floor(value).cast("string"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
