"""Monthly stock of products in warehouses: a matrix of keys and months, folded a month at a time over many keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a season's products add to their reorder point, by month (1 to 12).
SEASONS = {
    "Holiday": {10: 0.3, 11: 0.6, 12: 0.6, 1: 0.2},
    "Winter": {11: 0.4, 12: 0.4, 1: 0.4, 2: 0.3},
    "Summer": {5: 0.2, 6: 0.4, 7: 0.4, 8: 0.3},
    "BackToSchool": {7: 0.3, 8: 0.5, 9: 0.3},
    "Spring": {3: 0.3, 4: 0.4, 5: 0.3},
}
SNAPSHOT = "ProductKey long, WarehouseKey long, SnapshotDate date, QuantityOnHand long, QuantityOnOrder long, QuantitySold long, QuantityReceived long, ReorderFlag boolean, StockoutFlag boolean, DaysOutOfStock int"
#: Rows of a batch that a task gives on.
ROWS = 100_000


@dataclass(frozen=True)
class StockRules:
    """How stock starts, shrinks and is ordered; multipliers by class, and the classes that are kept (None: all)."""

    opening_months: float = 2.0
    shrinkage: float = 0.02
    fragile: float = 2.5
    overstock: float = 1.0
    least_months: int = 3
    by_class: dict[str, float] = field(default_factory=lambda: {"A": 1.2, "B": 1.0, "C": 0.8})
    keep: tuple[str, ...] | None = None


def _whole(x: np.ndarray) -> np.ndarray:
    return np.floor(x).astype(np.int64)


def fold(sold: np.ndarray, first: np.ndarray, month0: int, p: dict[str, np.ndarray], rules: StockRules) -> dict[str, np.ndarray]:
    """All keys' months (rows by columns, the first column being month `month0`, counted from year 0).

    In each month a key receives what is due, sells its demand, shrinks, and orders at or below its seasonal
    reorder point; an order is due `LeadMonths` later. Stock below zero is a stock-out of as many days as the
    lack would have sold, 30 at most, and stock then is zero. Months before a key's first demand are none.
    """
    n, months = sold.shape
    with_demand = np.maximum((sold > 0).sum(1), 1)
    mean = np.maximum(sold.sum(1) / with_demand, 1.0)
    scale, lead = p["scale"], p["lead"]
    opening = _whole(mean * rules.opening_months * scale * rules.overstock)
    lot = np.maximum(_whole((p["safety"] + mean * lead) * scale * rules.overstock), _whole(mean * lead * scale))
    lot = _whole(np.ceil(lot / p["pack"])) * p["pack"]
    rate = rules.shrinkage / 12.0 * np.where(p["fragile"], rules.fragile, 1.0)
    season = np.ones((len(SEASONS) + 1, 12))
    for k, boosts in enumerate(SEASONS.values(), 1):
        for m, boost in boosts.items():
            season[k, m - 1] += boost
    due = np.zeros((n, months + int(lead.max(initial=1)) + 1), np.int64)
    out = {k: np.zeros((n, months), np.int64) for k in ("onhand", "onorder", "received", "reorder", "stockout", "days")}
    stock = np.zeros(n, np.int64)
    for t in range(months):
        live = first <= t
        stock = np.where(first == t, opening, stock) + np.where(live, due[:, t], 0)
        out["received"][:, t] = np.where(live, due[:, t], 0)
        stock = stock - np.where(live, sold[:, t] + _whole(stock * rate), 0)
        short = live & (stock < 0)
        out["days"][:, t] = np.where(short, np.minimum(30, _whole(np.abs(stock) / np.maximum(1.0, sold[:, t] * (1.0 / 30.0)))), 0)
        stock = np.maximum(stock, 0)
        reorder = live & (stock <= _whole(p["point"] * season[p["season"], (month0 + t) % 12]))
        order = np.flatnonzero(reorder)
        due[order, t + lead[order]] += lot[order]
        out["onorder"][order, t] = lot[order]
        out["onhand"][:, t], out["reorder"][:, t], out["stockout"][:, t] = stock, reorder, short
    return out


def inventory_snapshots(demand: DataFrame, profile: DataFrame, rules: StockRules = StockRules()) -> DataFrame:
    """A row a month for each product and warehouse, from its first demand to the last month of the table.

    `demand` has ProductKey, WarehouseKey, Year, Month, QuantitySold; `profile` has ProductKey, SafetyStock,
    ReorderPoint, LeadMonths, CasePack, IsFragile, Season (a name of SEASONS, or another for none) and Class. Keys
    with demand in fewer than `least_months` months, or of a class that is not kept, are left out; products
    without a profile are kept, with 20 units of safety stock, a reorder point of 10, a month of lead and single
    packs. Keys spread over the cluster, each with its months, whose number the calendar bounds; a task folds
    a batch of keys together, month by month.
    """
    at = (F.col("Year") * 12 + F.col("Month") - 1).cast("int")
    monthly = demand.groupBy("ProductKey", "WarehouseKey", at.alias("m")).agg(F.sum("QuantitySold").cast("long").alias("q")).where("q > 0")
    keys = monthly.groupBy("ProductKey", "WarehouseKey").agg(F.collect_list("m").alias("ms"), F.collect_list("q").alias("qs")).where(F.size("ms") >= rules.least_months)
    season = F.lit(0)
    for k, name in enumerate(SEASONS, 1):
        season = F.when(F.col("Season") == name, k).otherwise(season)
    scale = F.coalesce(F.create_map(*[F.lit(x) for c, v in rules.by_class.items() for x in (c, float(v))])[F.col("Class")], F.lit(1.0))
    own = profile.select(
        "ProductKey", F.col("Class").alias("_class"), scale.alias("scale"), F.coalesce(F.col("SafetyStock"), F.lit(20)).cast("long").alias("safety"), F.coalesce(F.col("ReorderPoint"), F.lit(10)).cast("long").alias("point"),
        F.greatest(F.coalesce(F.col("LeadMonths"), F.lit(1)), F.lit(1)).cast("long").alias("lead"), F.greatest(F.coalesce(F.col("CasePack"), F.lit(1)), F.lit(1)).cast("long").alias("pack"), F.coalesce("IsFragile", F.lit(False)).alias("fragile"), season.cast("long").alias("season"),
    )
    rows = keys.join(own, "ProductKey", "left")
    if rules.keep is not None:
        rows = rows.where(F.col("_class").isNull() | F.col("_class").isin(*rules.keep))
    absent = {"scale": 1.0, "safety": 20, "point": 10, "lead": 1, "pack": 1, "fragile": False, "season": 0}
    last = demand.agg(F.max(at).alias("last"))
    rows = rows.drop("_class").na.fill(absent).crossJoin(F.broadcast(last))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            get = lambda c: b.column(c).to_numpy(zero_copy_only=False)
            ms, qs = b.column("ms"), b.column("qs")
            m = ms.flatten().to_numpy().astype(np.int64)
            month0, months = int(m.min()), int(get("last")[0]) - int(m.min()) + 1
            key = np.repeat(np.arange(b.num_rows), np.diff(ms.offsets.to_numpy()))
            sold = np.zeros((b.num_rows, months), np.int64)
            sold[key, m - month0] = qs.flatten().to_numpy()
            first = (sold > 0).argmax(1)
            done = fold(sold, first, month0, {c: get(c) for c in absent}, rules)
            row, col = np.nonzero(np.arange(months) >= first[:, None])
            days = (month0 + np.arange(months) - 1970 * 12).astype("datetime64[M]").astype("datetime64[D]")
            whole = pa.RecordBatch.from_arrays(
                [pa.array(get("ProductKey")[row]), pa.array(get("WarehouseKey")[row].astype(np.int64)), pa.array(days[col]), *[pa.array(done[k][row, col]) for k in ("onhand", "onorder")], pa.array(sold[row, col]), pa.array(done["received"][row, col]),
                 *[pa.array(done[k][row, col].astype(bool)) for k in ("reorder", "stockout")], pa.array(done["days"][row, col].astype(np.int32))],
                names=[c.split()[0] for c in SNAPSHOT.split(", ")],
            )
            for k in range(0, whole.num_rows, ROWS):
                yield whole.slice(k, ROWS)

    return rows.mapInArrow(run, SNAPSHOT)


def by_quarter(snapshots: DataFrame) -> DataFrame:
    """Quarters: the last month's stock, sums of units, any flag, days without stock up to 90."""
    keys = ["ProductKey", "WarehouseKey", F.trunc("SnapshotDate", "quarter").alias("SnapshotDate")]
    last = F.max_by("QuantityOnHand", "SnapshotDate").alias("QuantityOnHand")
    return snapshots.groupBy(*keys).agg(
        last, F.sum("QuantityOnOrder").alias("QuantityOnOrder"), F.sum("QuantitySold").alias("QuantitySold"), F.sum("QuantityReceived").alias("QuantityReceived"), F.bool_or("ReorderFlag").alias("ReorderFlag"),
        F.bool_or("StockoutFlag").alias("StockoutFlag"), F.least(F.sum("DaysOutOfStock"), F.lit(90)).cast("int").alias("DaysOutOfStock"),
    )
