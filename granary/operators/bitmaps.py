"""Exact distinct counts that merge: bitmaps by bucket of the id, joined by OR from the finest level up."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import written


def cells(df: DataFrame, levels: list[str], key: str, **sums: Column) -> DataFrame:
    """The finest level: `levels`, _bucket, _bits and the sums, one row for each bucket of 32,768 ids that a cell has.

    Ids are whole numbers, best dense ones: a bitmap takes 4 KB however few ids of its bucket a cell has. A null
    id counts in the sums and not among the ids. Raw rows are read once, and combined before the shuffle.
    """
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key).cast("long"))).alias("_bits")
    return df.groupBy(*levels, F.bitmap_bucket_number(F.col(key).cast("long")).alias("_bucket")).agg(bits, *[c.alias(n) for n, c in sums.items()])


def merged(parts: DataFrame, levels: list[str], sums: list[str]) -> DataFrame:
    """Cells of coarser levels from finer ones, or from cells of several loads: bitmaps by OR, sums added."""
    return parts.groupBy(*levels, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"), *[F.sum(c).alias(c) for c in sums])


def counted(parts: DataFrame, levels: list[str], sums: list[str], name: str) -> DataFrame:
    """The different ids of each cell as `name`, and its sums."""
    return parts.groupBy(*levels).agg(F.sum(F.bitmap_count("_bits")).alias(name), *[F.sum(c).alias(c) for c in sums])


def grouping_sets(df: DataFrame, levels: list[str], sets: list[list[str]], key: str, name: str, **sums: Column) -> DataFrame:
    """Sums and distinct ids for each set of levels; absent levels are null, Level has their bits as grouping_id has.

    The finest cells are written once; each set is merged from the smallest set before it that holds its
    levels, so no raw row is expanded and no id is counted twice. Sets go from fine to coarse.
    """
    finest = written(cells(df, levels, key, **sums))
    have, out, kinds = {tuple(levels): finest}, [], dict(finest.dtypes)
    for own in sets:
        source = min((s for s in have if set(own) <= set(s)), key=len)
        parts = have[source] if len(source) == len(own) else merged(have[source], own, list(sums))
        have[tuple(own)] = parts
        level = sum(1 << (len(levels) - 1 - i) for i, c in enumerate(levels) if c not in own)
        row = counted(parts, own, list(sums), name)
        if not own:  # without rows there is no grand total either
            row = row.where(F.col(name).isNotNull())
        columns = [F.col(c) if c in own else F.lit(None).cast(kinds[c]).alias(c) for c in levels]
        out.append(row.select(*columns, F.lit(level).cast("long").alias("Level"), *sums, name))
    return reduce(DataFrame.unionByName, out)


def rollup_sets(levels: list[str]) -> list[list[str]]:
    return [levels[:n] for n in range(len(levels), -1, -1)]


def cube_sets(levels: list[str]) -> list[list[str]]:
    return [list(c) for n in range(len(levels), -1, -1) for c in combinations(levels, n)]
