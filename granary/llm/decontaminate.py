"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only.

A test item is short and a document may be long, so a document's MinHash says little of an item it
contains. The sketch is therefore the item's: its k smallest shingle hashes. If a share of at least t of
an item's n shingles is in a document, then fewer than (1 - t) n are not, so of any floor((1 - t) n) + 1
of them one is there. Items are partitioned by size, and each partition's k is the one for its largest
item: the search misses nothing. Exact containment of shingle texts then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialize, whole_text

#: Sketches and items are sent to all executors up to this many shingles; more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles(all_words: Column, n: int) -> Column:
    """Each run of n words as one text; all words as one where there are fewer; none without words."""
    # Single elements: slice() would copy the whole array for each shingle.
    many = F.transform(F.sequence(F.lit(0), F.size(all_words) - n), lambda i: F.concat_ws(" ", *[F.get(all_words, i + k) for k in range(n)]))
    return F.when(F.size(all_words) >= n, many).when(F.size(all_words) > 0, F.array(F.array_join(all_words, " "))).otherwise(F.array().cast("array<string>"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SHINGLES else df


def containment(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment: documents that hold at least `threshold` of an item's distinct word n-grams.

    A doc_id or item_id that occurs in several rows stands for all their texts together. Rows with a null
    id, null or empty texts and items without words match nothing; an item of fewer than n words is one
    shingle, which only a text of exactly those words holds. Other columns are ignored.
    """
    items = benchmark.where("item_id is not null").select("item_id", words(whole_text()).alias("words"))
    items = items.select("item_id", F.explode(shingles(F.col("words"), n)).alias("shingle")).distinct()
    items = items.withColumn("h", F.xxhash64("shingle"))
    items = items.join(items.groupBy("item_id").agg(F.count("*").alias("n_shingles")), "item_id")
    items = materialize(items, "items")
    n_items = items.count()
    # Partitions by size: powers of two. One k serves a partition, that of its largest possible item.
    upper = F.pow(F.lit(2), F.ceil(F.log2(F.col("n_shingles"))))
    ranked = items.groupBy("item_id", "n_shingles").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    k = F.floor(F.lit(1 - threshold + 1e-9) * upper).cast("int") + 1
    sketch = ranked.select("item_id", "n_shingles", upper.cast("int").alias("size_class"), F.explode(F.slice("hs", F.lit(1), F.least(k, F.size("hs")))).alias("h"))
    by_hash = sketch.select("h").distinct()

    own = docs.where("doc_id is not null").select("doc_id", words(whole_text()).alias("words"))
    hashes = F.transform(shingles(F.col("words"), n), lambda s: F.xxhash64(s))
    hits = own.select("doc_id", F.explode(F.array_distinct(hashes)).alias("h")).join(sized(by_hash, n_items), "h")
    pairs = hits.select("doc_id", "h").join(sized(sketch.select("h", "item_id"), n_items), "h").select("doc_id", "item_id").distinct()
    pairs = materialize(pairs, "candidates")

    # Exact: whole shingle texts of the documents found, against the items they were found with.
    suspects = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    exact = suspects.select("doc_id", words(whole_text()).alias("words"))
    exact = exact.select("doc_id", F.explode(F.array_distinct(shingles(F.col("words"), n))).alias("shingle"))
    exact = exact.join(sized(items.select("shingle", "item_id", "n_shingles"), n_items), "shingle").select("doc_id", "item_id", "n_shingles", "shingle").distinct()
    shared = exact.join(pairs, ["doc_id", "item_id"]).groupBy("doc_id", "item_id", "n_shingles").agg(F.count("*").alias("n_shared"))
    share = F.col("n_shared") / F.col("n_shingles")
    return shared.withColumn("containment", share).where(F.col("n_shared") >= F.col("n_shingles") * F.lit(threshold) - 1e-9)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` whose id no test item was found in; rows with a null id stay."""
    return docs.join(containment(docs, benchmark, n, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
