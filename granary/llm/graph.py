"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from granary.llm.common import discard, materialize


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a written table, with their number and the sum of their hashes."""
    seen = Observation()
    found = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return found, (seen.get["n"], seen.get["h"])


def components(links: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) for the nodes of `links` (a long, b long).

    Alternates large-star and small-star steps, with a written table after each: the number of rounds
    grows with the logarithm of the longest chain. A node with many neighbours takes part through
    minimums, which aggregate before the shuffle, and joins that may be split.
    """
    edges, before = _written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        ways = edges.union(edges.select("b", "a"))
        least = ways.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = ways.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, (edges, now) = edges, _written(small)
        discard(last)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def with_components(df: DataFrame, comps: DataFrame | None, key: str, name: str = "comp") -> DataFrame:
    """`df` with the component of its column `key` as `name`: the key itself where it has no link."""
    if comps is None:
        return df.withColumn(name, F.col(key))
    own = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return df.join(own, F.col(key) == F.col("_node"), "left").withColumn(name, F.coalesce("_comp", key)).drop("_node", "_comp")


def joined_components(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components `comps` (written) joined by further links: only links between components are followed."""
    if comps is None:
        return materialize(components(links), "components")
    between = with_components(with_components(links, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")
    over = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    old = comps.select("node", F.col("comp").alias("was"))
    moved = with_components(old, over, "was", "comp").select("node", "comp")
    new = over.join(comps.select("node"), "node", "left_anti").select("node", "comp")
    return materialize(moved.union(new), "components")
