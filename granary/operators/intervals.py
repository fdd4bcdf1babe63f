"""Dated intervals and versions: SCD2, as-of joins, unions, overlaps, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN_END = "2099-12-31"


def close_intervals(df: DataFrame, keys: list[str], start: str = "EffectiveStartDate", open_end: str = OPEN_END) -> DataFrame:
    """VersionNumber, EffectiveEndDate (the day before the next start), IsCurrent."""
    w = W.partitionBy(*keys).orderBy(start)
    after = F.lead(start).over(w)
    return df.withColumns({"VersionNumber": F.row_number().over(w), "EffectiveEndDate": F.coalesce(F.date_sub(after, 1), F.lit(open_end).cast("date")), "IsCurrent": after.isNull()})


def scd2_build(changes: DataFrame, keys: list[str], start: str, attributes: list[str], open_end: str = OPEN_END) -> DataFrame:
    """Effective-dated rows as closed versions: of rows of one day the last by attributes counts, and rows that change nothing go."""
    day = W.partitionBy(*keys, start).orderBy(*[F.desc_nulls_last(a) for a in attributes])
    one = changes.withColumn("_r", F.row_number().over(day)).where("_r = 1").drop("_r")
    w = W.partitionBy(*keys).orderBy(start)
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.lag(a).over(w))
    kept = one.withColumn("_same", same & (F.row_number().over(w) > 1)).where("not _same").drop("_same")
    return close_intervals(kept.withColumnRenamed(start, "EffectiveStartDate"), keys, open_end=open_end)


def scd2_merge(dim: DataFrame, batch: DataFrame, keys: list[str], start: str, attributes: list[str]) -> DataFrame:
    """Versions after more changes: only entities in the batch are rebuilt."""
    touched = batch.select(*keys).distinct()
    old = dim.join(touched, keys, "left_semi").select(*keys, F.col("EffectiveStartDate").alias(start), *attributes)
    rebuilt = scd2_build(old.unionByName(batch.select(*keys, start, *attributes)), keys, start, attributes)
    return dim.join(touched, keys, "left_anti").unionByName(rebuilt.select(dim.columns))


#: Keys of more versions than this are looked up by month.
MANY_VERSIONS = 64
#: So many keys of many versions at most are sent to all executors.
FEW_KEYS = 20_000


def scd2_as_of(fact: DataFrame, date: str, dim: DataFrame, key: str, payload: list[str], start: str = "EffectiveStartDate", many: int = MANY_VERSIONS) -> DataFrame:
    """The version valid at each row's date; dates before the first version take the first.

    An equi-join with a range on it, for keys of few versions. A key with more than `many` is joined by key
    and month: its versions are dealt to the months that they touch between the fact's first and last date, so
    a row meets those of its month alone, and a key that most rows have is spread over its months.
    """
    w = W.partitionBy(key).orderBy(start)
    rank = {"_at": F.row_number().over(w), "_to": F.coalesce(F.lead(start).over(w), F.lit("9999-12-31").cast("date"))}
    spans = dim.withColumns(rank).select(F.col(key).alias("_k"), *payload, F.when(F.col("_at") == 1, F.lit("0001-01-01").cast("date")).otherwise(F.col(start)).alias("_from"), "_to")
    heavy = dim.groupBy(F.col(key).alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > many).select("_h")
    n_heavy = heavy.count()
    valid = (F.col(key) == F.col("_k")) & (F.col(date) >= F.col("_from")) & (F.col(date) < F.col("_to"))
    if not n_heavy:
        return fact.join(spans, valid, "left").drop("_k", "_from", "_to")
    heavy = F.broadcast(heavy) if n_heavy <= FEW_KEYS else heavy
    plain = fact.join(heavy, F.col(key) == F.col("_h"), "left_anti").join(spans.join(heavy, F.col("_k") == F.col("_h"), "left_anti"), valid, "left")
    ends = fact.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))
    dense = spans.join(heavy, F.col("_k") == F.col("_h"), "left_semi").crossJoin(F.broadcast(ends)).where((F.col("_from") <= F.col("_last")) & (F.col("_to") > F.col("_first")))
    touched = F.sequence(month_index(F.greatest("_from", "_first")), month_index(F.least(F.date_sub("_to", 1), F.col("_last"))))
    dense = dense.withColumn("_m", F.explode(touched)).drop("_first", "_last")
    dated = fact.join(heavy, F.col(key) == F.col("_h"), "left_semi").withColumn("_fm", month_index(date))
    met = dated.join(dense, valid & (F.col("_fm") == F.col("_m")), "left").drop("_fm", "_m")
    return plain.unionByName(met).drop("_k", "_from", "_to")


def month_index(date: str | Column) -> Column:
    return F.year(date) * 12 + F.month(date) - 1


def in_interval(left: DataFrame, date: str, right: DataFrame, start: str, end: str, equal: list[str] = ()) -> DataFrame:
    """Rows whose date lies in an interval, ends included. Without an equal key the month is one: intervals are dealt to each month they touch."""
    if equal:
        return left.join(right, [*equal]).where(F.col(date).between(F.col(start), F.col(end)))
    months = right.withColumn("_m", F.explode(F.sequence(month_index(start), month_index(end))))
    return left.withColumn("_m", month_index(date)).join(months, "_m").where(F.col(date).between(F.col(start), F.col(end))).drop("_m")


def interval_union(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Overlapping and adjacent intervals of a key as one."""
    before = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    new = (F.col(start) > F.date_add(F.max(end).over(before), 1)) | F.max(end).over(before).isNull()
    islands = df.withColumn("_new", new.cast("int")).withColumn("_i", F.sum("_new").over(W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def overlaps(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    before = W.partitionBy(*keys).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("EarlierEnd", F.max(end).over(before)).where(F.col(start) <= F.col("EarlierEnd"))


def contiguity(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that do not begin on the day after the one before."""
    w = W.partitionBy(*keys).orderBy(start, end)
    return df.withColumn("PreviousEnd", F.lag(end).over(w)).where(F.col(start) != F.date_add("PreviousEnd", 1))


def version_pairs(dim: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Each version with the next one's columns."""
    w = W.partitionBy(key).orderBy("VersionNumber")
    return dim.withColumns({f"Next{c}": F.lead(c).over(w) for c in columns}).where(F.col(f"Next{columns[0]}").isNotNull())


def version_gaps(dim: DataFrame, key: str) -> DataFrame:
    before = F.lag("VersionNumber").over(W.partitionBy(key).orderBy("VersionNumber"))
    return dim.withColumn("Before", F.coalesce(before, F.lit(0))).where("VersionNumber <> Before + 1").select(key, "VersionNumber", "Before")


def coverage_gaps(assignments: DataFrame, key: str, start: str, end: str, first: str, last: str) -> DataFrame:
    """Spans of [first, last] in which a key has no interval."""
    a, b = F.lit(first).cast("date"), F.lit(last).cast("date")
    spans = interval_union(assignments, [key], start, end).where((F.col(end) >= a) & (F.col(start) <= b))
    w = W.partitionBy(key).orderBy(start)
    heads = spans.select(key, F.coalesce(F.date_add(F.lag(end).over(w), 1), a).alias("GapStart"), F.date_sub(start, 1).alias("GapEnd"))
    tails = spans.groupBy(key).agg(F.date_add(F.max(end), 1).alias("GapStart")).withColumn("GapEnd", b)
    return heads.unionByName(tails).where("GapStart <= GapEnd")


def fill_calendar(months: DataFrame, fact: DataFrame, date: str) -> DataFrame:
    """A row a month, also for months without rows."""
    counted = fact.groupBy(F.trunc(date, "month").alias("MonthStart")).agg(F.count("*").alias("Rows"))
    return months.join(counted, "MonthStart", "left").withColumn("Rows", F.coalesce("Rows", F.lit(0)))


def orphans(source: DataFrame, fk: str, dim: DataFrame, pk: str) -> DataFrame:
    """Distinct non-null keys that the dimension lacks."""
    return source.where(F.col(fk).isNotNull()).select(F.col(fk).alias("Orphan")).distinct().join(dim.select(F.col(pk).alias("Orphan")), "Orphan", "left_anti")


def active_per_month(df: DataFrame, start: str, end: str, months: DataFrame) -> DataFrame:
    """Entities active in each month from +1 and -1 events and a running sum: no range join."""
    events = df.select(F.trunc(start, "month").alias("MonthStart"), F.lit(1).alias("d")).union(df.where(F.col(end).isNotNull()).select(F.add_months(F.trunc(end, "month"), 1), F.lit(-1)))
    changed = events.groupBy("MonthStart").agg(F.sum("d").alias("d"))
    # One row a month.
    total = F.sum(F.coalesce("d", F.lit(0))).over(W.orderBy("MonthStart").rowsBetween(W.unboundedPreceding, 0))
    first = months.agg(F.min("MonthStart").alias("_f"))
    earlier = changed.crossJoin(F.broadcast(first)).select(F.greatest("MonthStart", "_f").alias("MonthStart"), "d").groupBy("MonthStart").agg(F.sum("d").alias("d"))
    return months.join(earlier, "MonthStart", "left").select("MonthStart", total.alias("Active"))


def split_by_closure(assign: DataFrame) -> DataFrame:
    """Assignments cut by a renovation into before, at another store, and after; a permanent closure has no return."""
    pieces = F.array(
        F.struct(F.lit("before").alias("Part"), F.col("StartDate").alias("PartStart"), F.least("EndDate", F.date_sub("ClosedFrom", 1)).alias("PartEnd")),
        F.struct(F.lit("away").alias("Part"), F.greatest("StartDate", "ClosedFrom").alias("PartStart"), F.least("EndDate", F.date_sub("ClosedTo", 1)).alias("PartEnd")),
        F.struct(F.lit("return").alias("Part"), F.greatest("StartDate", "ClosedTo").alias("PartStart"), F.col("EndDate").alias("PartEnd")),
    )
    return assign.withColumn("p", F.explode(pieces)).where("p.PartStart <= p.PartEnd and not (Permanent and p.Part <> 'before')").select("EmployeeKey", "StoreKey", "p.*")


def clip_to_closure(assign: DataFrame) -> DataFrame:
    """Assignments end on the day before the store closes; those that begin later go."""
    return assign.where("ClosedFrom is null or StartDate < ClosedFrom").withColumn("EndDate", F.when(F.col("ClosedFrom").isNotNull(), F.least("EndDate", F.date_sub("ClosedFrom", 1))).otherwise(F.col("EndDate")))
