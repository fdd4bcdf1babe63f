"""Weights, scores and reassignments: column math and keyed picks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.hashing import hash_u01
from granary.operators.alias import weighted_pick


def mapped(value: Column, weights: dict[str, float], other: float = 1.0) -> Column:
    """The weight of a value; `other` for those that are not named, and for null."""
    out = F.lit(other)
    for k, w in weights.items():
        out = F.when(value == k, w).otherwise(out)
    return out


def keyword_weight(text: Column, rules: list[tuple[str, float]]) -> Column:
    """The product of the weights of all words that the lower-cased text holds."""
    out = F.lit(1.0)
    for word, w in rules:
        out = out * F.when(F.lower(text).contains(word), w).otherwise(1.0)
    return out


def lognormal(*keys: Column, spread: float, seed: int) -> Column:
    """exp(spread * z) with a keyed standard normal z from two keyed uniforms."""
    radius = F.sqrt(-2 * F.ln(1 - hash_u01(*keys, seed=seed, salt=1)))
    return F.exp(spread * radius * F.cos(2 * math.pi * hash_u01(*keys, seed=seed, salt=2)))


def clamp_year(date: Column, first_day: str, last_day: str, years: tuple[int, int], span: tuple[str, str]) -> Column:
    """A date clamped into its year's window (MM-DD to MM-DD) for the given years, else into the whole span."""
    year = F.year(date)
    edge = lambda d: F.make_date(year, F.lit(int(d[:2])), F.lit(int(d[3:])))
    inside = F.least(F.greatest(date, edge(first_day)), edge(last_day))
    return F.when(year.between(*years), inside).otherwise(F.least(F.greatest(date, F.lit(span[0]).cast("date")), F.lit(span[1]).cast("date")))


def distinct_targets(months: DataFrame, people: Column, ratio: float, swing: float, spikes: dict[int, float]) -> DataFrame:
    """Distinct customers of each month: a share of all, a yearly cycle, months that stand out, never more than there are."""
    m = F.month("MonthStart")
    boost = F.lit(1.0)
    for month, factor in spikes.items():
        boost = F.when(m == month, factor).otherwise(boost)
    wanted = F.floor(people * ratio * (1 + swing * F.sin(2 * F.pi() * m / 12.0)) * boost + 0.5)
    return months.withColumn("Target", F.least(wanted, people).cast("long"))


def repick(rows: DataFrame, bad: Column, pool: DataFrame, group: str, item: str, key: str, seed: int) -> DataFrame:
    """Rows with `item` picked anew where `bad` holds, from the pool of the row's group; as it was where that has none."""
    marked = rows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    choices = pool.select(group, F.col(item).alias("_new"), F.lit(1).alias("_w"))
    again = weighted_pick(marked.where("_bad"), choices, group, "_w", "_new", key, seed)
    good = marked.where("not _bad").withColumn("_new", F.lit(None).cast(rows.schema[item].dataType))
    return good.unionByName(again).withColumn("Old", F.col(item)).withColumn(item, F.coalesce("_new", item)).drop("_new", "_bad")


def pool_places(df: DataFrame, group: str, key: str) -> DataFrame:
    """Each row's place in its group's pool, and the pool's size."""
    w = W.partitionBy(group)
    return df.withColumn("Place", F.row_number().over(w.orderBy(key))).withColumn("PoolSize", F.count("*").over(w))


def sample_covering(df: DataFrame, group: str, weight: Column, key: str, n: int, seed: int) -> DataFrame:
    """n rows by weight without replacement, at least one of each group (all of these where groups are more than n).

    Each row has a keyed race time, the smaller the larger its weight: the first of each group are taken, and
    then the first of all others.
    """
    race = F.struct((-F.ln(1 - hash_u01(F.col(key), seed=seed)) / weight).alias("race"), F.col(key).alias("key"))
    rows = df.withColumn("_race", race)
    best = rows.groupBy(group).agg(F.min("_race").alias("_best")).select(F.col("_best.key").alias("_first"))
    first = rows.join(best, F.col(key) == F.col("_first"), "left_semi")
    rest = rows.join(best, F.col(key) == F.col("_first"), "left_anti").orderBy("_race").limit(max(0, n - best.count()))
    return first.withColumn("Covers", F.lit(True)).unionByName(rest.withColumn("Covers", F.lit(False))).drop("_race")


def brand_month_share(brands: DataFrame, months: DataFrame, exponent: float, boost: float, floor: float, seed: int) -> DataFrame:
    """Each month's shares of the brands: their sizes to a power, one brand boosted in turn by a keyed order, none below a floor before they are made to sum to 1.

    Brands are few: one row each, and a window over them.
    """
    turn = F.row_number().over(W.orderBy(hash_u01(F.col("Brand"), seed=seed), "Brand")) - 1
    ranked = brands.withColumns({"_turn": turn, "_n": F.count("*").over(W.partitionBy()), "_base": F.pow(F.col("Size").cast("double"), F.lit(exponent))})
    ranked = ranked.withColumn("_base", F.col("_base") / F.sum("_base").over(W.partitionBy()))
    index = F.year("MonthStart") * 12 + F.month("MonthStart")
    rows = months.crossJoin(F.broadcast(ranked)).withColumn("_w", F.greatest(F.col("_base") * F.when(index % F.col("_n") == F.col("_turn"), boost).otherwise(1.0), F.lit(floor)))
    return rows.withColumn("Share", F.col("_w") / F.sum("_w").over(W.partitionBy("MonthStart"))).select("MonthStart", "Brand", "Share")


def rotating_winners(brands: DataFrame, months: DataFrame, exponent: float, boost: float, tapers: tuple[float, ...], noise: float, floor: float, seed: int) -> DataFrame:
    """Each month's shares of the brands, where each year has a winner and the next years' winners rise before it.

    A cycle of as many years as there are brands has each brand as winner once, in a keyed order of its own.
    The winner of a year has the boost times the first taper, that of the next year the second, and so on; a
    brand that comes twice has its first. Shares are keyed-noisy, none below a floor before they are made to
    sum to 1. Brands and months are few: one row each, and windows over them.
    """
    base = F.pow(F.col("Size").cast("double"), F.lit(exponent))
    sized = brands.withColumns({"_b": F.count("*").over(W.partitionBy()), "_base": base / F.sum(base).over(W.partitionBy())})
    first = F.min("MonthStart").over(W.partitionBy())
    year = F.floor(F.round(F.months_between("MonthStart", first)) / 12).cast("int")
    dated = months.withColumn("_year", year).withColumn("_last", F.max("_year").over(W.partitionBy()))
    cycles = sized.select("Brand", "_b").join(dated.select("_last").distinct(), how="cross").withColumn("_cycle", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / F.col("_b")).cast("int"))))
    turn = F.row_number().over(W.partitionBy("_cycle").orderBy(hash_u01(F.col("Brand"), F.col("_cycle"), seed=seed), "Brand")) - 1
    winners = cycles.select("Brand", (F.col("_cycle") * F.col("_b") + turn).alias("_turn"))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(tapers)]))
    risen = dated.select("_year", "_last").distinct().withColumn("_s", steps).withColumn("_turn", F.least(F.col("_year") + F.col("_s.k"), F.col("_last")))
    risen = risen.join(winners, "_turn").groupBy("_year", "Brand").agg(F.min("_s").alias("_s")).select("_year", "Brand", F.col("_s.t").alias("_taper"))
    rows = dated.join(sized, how="cross").join(risen, ["_year", "Brand"], "left")
    raised = F.col("_base") * (1 + F.coalesce("_taper", F.lit(0.0)) * (boost - 1)) * lognormal(F.col("MonthStart"), F.col("Brand"), spread=noise, seed=seed + 1)
    rows = rows.withColumn("_w", F.greatest(raised, F.lit(floor)))
    return rows.withColumn("Share", F.col("_w") / F.sum("_w").over(W.partitionBy("MonthStart"))).select("MonthStart", "Brand", "Share")
