"""Mixing sources to target weights by Poisson replication, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import free, materialize, whole_text

#: A table of sources up to this many rows is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def hash_uniform(*key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


#: Above this rate the distribution function is made from where it can first be told from 0.
LARGE_RATE = 400.0


def poisson_table(rates: DataFrame) -> DataFrame:
    """`rates` (source, rate) with start and steps: the Poisson distribution function at start, start + 1, ... as far as doubles below 1 can be told from 1.

    The terms are rows, numbered and added up by windows over a source, so a rate of r costs some 24 * sqrt(r)
    rows (r + 12 * sqrt(r) up to LARGE_RATE) and no array is copied as it grows. They are made in logarithms, so
    that large rates do not underflow; from a start above 0, whose own term is by Stirling's series, they are
    made to end at 1. Below the start lies a probability under 1e-30.
    """
    rate, k = F.col("rate"), F.greatest(F.col("k").cast("double"), F.lit(1.0))
    spread = 12 * F.sqrt(rate)
    rows = rates.where(rate > 0).withColumn("start", F.when(rate > LARGE_RATE, F.floor(rate - spread)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.col("start"), F.ceil(rate + spread + 40).cast("long"))))
    factorial = k * F.ln(k) - k + F.ln(2 * F.pi() * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)
    term = F.when(F.col("k") == 0, -rate).when(F.col("k") == F.col("start"), k * F.ln(rate) - rate - factorial).otherwise(F.ln(rate) - F.ln(k))
    upto = W.partitionBy("source").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("log", F.sum(term).over(upto)).withColumn("sum", F.sum(F.exp("log")).over(upto))
    rows = rows.withColumn("sum", F.when(F.col("start") > 0, F.col("sum") / F.max("sum").over(W.partitionBy("source"))).otherwise(F.col("sum")))
    steps = rows.groupBy("source", "rate", "start").agg(F.array_sort(F.collect_list(F.struct("k", "sum"))).alias("s")).select("source", "rate", "start", F.col("s.sum").alias("steps"))
    none = rates.where(rate <= 0).select("source", "rate", F.lit(0).cast("long").alias("start"), F.array(F.lit(1.0)).alias("steps"))
    return steps.unionByName(none)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float, scale: float) -> DataFrame:
    """source, rate: how often a document of the source is to be repeated in the mean.

    A source's size is the UTF-8 bytes of its texts, over all documents. Target shares are `weights` (a
    source that is not named has none), or else the sizes to the power alpha. The mixture's size is
    `scale` times that of the corpus; the rate is the source's share of it over its own size.
    """
    size = F.sum(F.octet_length(whole_text()).cast("long") + 1)
    sizes = docs.groupBy("source").agg(size.alias("size"))
    if weights is None:
        sizes = sizes.withColumn("want", F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        pairs = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))]) if weights else F.lit(None).cast("map<string,double>")
        sizes = sizes.withColumn("want", F.coalesce(pairs[F.col("source")], F.lit(0.0)))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("want").alias("all_want"))
    rate = F.lit(scale) * F.col("all_size") * (F.col("want") / F.nullif(F.col("all_want"), F.lit(0.0))) / F.col("size")
    return sizes.crossJoin(F.broadcast(total)).select("source", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, scale: float = 1.0, seed: int = 17, key: str = "doc_id", added: bool = True) -> DataFrame:
    """Repeats each row a Poisson number of times and shuffles all copies.

    The number is the inverse distribution function of a Poisson variable, with its source's rate for
    mean, at a uniform number hashed from seed and `key`: it does not depend on partitioning or on other
    rows of the source. Added columns: rate, copy (from 0) and shuffle_key, which orders the result.
    Rows with the same key have the same number of copies; a null key hashes as an empty one; null
    sources are one source. Null texts count as empty ones. Sources without a weight give no rows, nor does
    an empty table. Columns of `docs` named rate, copy or shuffle_key are refused; without `added` the
    result has the columns of `docs` alone, and these may have any name.
    """
    if clash := {"rate", "copy", "shuffle_key"} & set(docs.columns) if added else ():
        raise ValueError(f"columns would clash: {sorted(clash)}")
    rate, copy, shuffle, source, start, steps, u, n = free(docs.columns, "rate", "copy", "shuffle_key", "_source", "_start", "_steps", "_u", "_n")
    rates = materialize(poisson_table(source_rates(docs, weights, alpha, scale)), "rates").toDF(source, rate, start, steps)
    small = rates.count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col(source)))
    times = (F.col(start) + F.size(F.filter(steps, lambda s: s <= F.col(u)))).cast("int")
    copies = joined.withColumn(u, hash_uniform(F.col(key), seed=seed)).withColumn(n, times)
    # no filter on n: Spark would push one that reads `u` within the lambda to the side of the rates, which lacks it
    out = copies.select(*docs.columns, rate, F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1))).alias(copy))
    out = out.withColumn(shuffle, F.xxhash64(F.lit(seed), F.col(key), copy))
    out = out.repartitionByRange(shuffle).sortWithinPartitions(shuffle, key, copy)
    return out if added else out.select(docs.columns)
