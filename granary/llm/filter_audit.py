"""How filters interact: forward and backward path counts over the lattice of their subsets."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize, whole_text

WORD = r"[^\x20\x09-\x0D]+"
NAMES = "ABCDE"


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D: few words, repeated words, many capitals, markup characters."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each source by the set of filters that they fail (A is bit 0).

    Filter E fails a document whose text a smaller doc_id has too, anywhere in the table; a null doc_id is not
    smaller or larger than any. Texts are told apart by SHA-256. A null text counts as empty, a null source as
    the empty string. Rows that repeat an id count each. A document is good (toxic) if any of its labels says
    so; a null doc_id has no labels.
    """
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(text_failures(F.col("text")))]
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("own"), sum(bits[1:], bits[0]).alias("mask"))
    any_is = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(any_is("quality"), any_is("toxic"))
    rows = rows.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("quality", "toxic")})
    kind = ["own", "part", "mask", "quality", "toxic"]
    ids = rows.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    # a group's rows of its smallest id are the only ones that may be the text's first
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    groups = materialize(ids.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unknown"), first), "texts")
    least = groups.groupBy("own").agg(F.min("first.doc_id").alias("least"))
    found = groups.join(least, "own")
    fresh = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("m"), fresh.alias("c")), F.struct((F.col("mask") + (1 << 4)).alias("m"), (F.col("n") - fresh).alias("c")))
    found = found.select("part", "quality", "toxic", F.explode(both).alias("s")).select("part", "quality", "toxic", "s.*")
    sums = [F.sum("c").alias("n"), F.sum(F.col("c") * F.col("quality")).alias("good"), F.sum(F.col("c") * F.col("toxic")).alias("toxic")]
    return found.groupBy("part", F.col("m").alias("mask")).agg(*sums)


def lattice(n: int) -> list[tuple[int, int, int]]:
    """Edges (before, filter, ways): orders of all n filters that pass from the set `before` to that set with the filter added.

    Forward, a set's number of paths from the empty set; backward, to the full one; an edge has their product.
    """
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    edges = [(s, x) for s in range(full + 1) for x in range(n) if not s >> x & 1]
    for s, x in edges:
        reach[s | 1 << x] += reach[s]
    for s, x in reversed(edges):
        leave[s] += leave[s | 1 << x]
    return [(s, x, reach[s] * leave[s | 1 << x]) for s, x in edges]


def audit_orders(counts: DataFrame, names: str = NAMES) -> DataFrame:
    """part, filter_order, step and the counts of every step of every order of the filters, zeros included.

    `counts` has a row for each part and failed set (`failure_counts`), so the work here grows with parts, not
    with documents. Each edge of the lattice of subsets has one removal count; an order's steps are the edges
    of its path, and a filter's Shapley total is its edges' removals times the orders that pass them. A
    table without rows gives none.
    """
    spark = counts.sparkSession
    edges = [(s, x, ways) for s, x, ways in lattice(len(names))]
    every = F.array(*[F.struct(F.lit(s).alias("before"), F.lit(x).alias("filter"), F.lit(1 << x).alias("bit"), F.lit(w).cast("long").alias("ways")) for s, x, w in edges])
    rows = counts.withColumn("e", F.explode(every)).select("part", "mask", "n", "good", F.col("toxic").alias("bad"), "e.*")
    here, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    steps = rows.groupBy("part", "before", "filter", "ways").agg(
        total(~here & ~earlier).alias("kept"),
        total(here & ~earlier).alias("removed"),
        total(here & earlier).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here & ~earlier, "good").alias("good_lost"),
        total(here & ~earlier, "bad").alias("toxic_lost"),
    )
    steps = materialize(steps, "edges")
    shares = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("ways")).alias("shapley"))
    paths = [("".join(names[x] for x in order), k + 1, sum(1 << x for x in order[:k]), order[k]) for order in permutations(range(len(names))) for k in range(len(names))]
    paths = spark.createDataFrame(paths, "filter_order string, step int, before int, filter int")
    out = steps.join(shares, ["part", "filter"]).join(F.broadcast(paths), ["before", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E on `docs`: see `failure_counts` and `audit_orders`."""
    return audit_orders(failure_counts(docs, labels))
