"""Tables that change by key: copy-on-write of the buckets that a batch touches, with a manifest for each version."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granary.sources.tables import _fs


class BucketTable:
    """A table under `path`: data/<version>/bucket=<b> and manifests/<version>.

    A manifest names, for each bucket that has rows, the version that wrote it; the newest that was written to
    its end counts. There is one writer at a time. Versions that neither the newest manifest nor the one before
    it names are deleted, so a reader may go on with the table that it opened for one more version.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _entries(self, path: str) -> list[str]:
        fs, p = _fs(self.spark, path)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        whole = [v for v in self._entries(f"{self.path}/manifests") if "_SUCCESS" in self._entries(f"{self.path}/manifests/{v}")]
        return sorted(map(int, whole))

    def manifest(self, version: int | None = None) -> dict | None:
        """schema, keys, number of buckets, and bucket -> version."""
        version = max(self.versions(), default=None) if version is None else version
        if version is None:
            return None
        found = json.loads(self.spark.read.text(f"{self.path}/manifests/{version}").first()[0])
        if (found["keys"], found["buckets"]) != (self.keys, self.buckets):
            raise ValueError(f"the table has {found['buckets']} buckets by {found['keys']}")
        return found | {"holds": {int(b): v for b, v in found["holds"].items()}}

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(manifest["holds"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The table as of a version, the newest one by default; None before the first."""
        manifest = self.manifest(version)
        return self._read(manifest) if manifest else None

    def apply(self, batch: DataFrame, number: int, combine: Callable[[DataFrame | None, DataFrame], DataFrame]) -> bool:
        """Rewrites the buckets of the batch's keys as combine(their rows so far, batch); other buckets stay as they are.

        Numbers rise: a batch with a number that the table has passed changes nothing and gives False. So a
        batch that is run again after a failure, before or after its manifest, counts once. An empty batch
        makes a version without new data.
        """
        have = self.versions()
        if have and number <= have[-1]:
            return False
        last = self.manifest(have[-1]) if have else None
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = {r.b for r in batch.select(bucket.alias("b")).distinct().collect()}  # as many as there are buckets at most
            made = combine(self._read(last, touched) if last else None, batch)
            holds = {b: v for b, v in (last["holds"] if last else {}).items() if b not in touched}
            own = f"{self.path}/data/{number}"
            made.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)
            holds |= {int(b.removeprefix("bucket=")): number for b in self._entries(own) if b.startswith("bucket=")}
        finally:
            batch.unpersist()
        text = json.dumps({"schema": made.schema.jsonValue(), "keys": self.keys, "buckets": self.buckets, "holds": holds})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{number}")
        self._clean([last, {"holds": holds}], [*have[-1:], number])
        return True

    def _clean(self, manifests: list[dict | None], versions: list[int]) -> None:
        used = {(str(v), f"bucket={b}") for m in manifests if m for b, v in m["holds"].items()}
        for v in self._entries(f"{self.path}/data"):
            inside = [b for b in self._entries(f"{self.path}/data/{v}") if b.startswith("bucket=")]
            gone = [b for b in inside if (v, b) not in used]
            for path in [f"data/{v}"] if len(gone) == len(inside) else [f"data/{v}/{b}" for b in gone]:
                self._delete(path)
        for v in set(self._entries(f"{self.path}/manifests")) - set(map(str, versions)):
            self._delete(f"manifests/{v}")

    def _delete(self, path: str) -> None:
        fs, p = _fs(self.spark, f"{self.path}/{path}")
        fs.delete(p, True)


def newest(keys: list[str], order: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Keeps the row with the greatest `order` of each key; of equal ones the greatest by all columns. Keys aggregate before the shuffle."""

    def combine(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        both = batch if old is None else old.unionByName(batch)
        rank = F.struct(order, *[c for c in both.columns if c not in (*keys, order)])
        return both.groupBy(*keys).agg(F.max(rank).alias("s")).select(*keys, "s.*").select(both.columns)

    return combine


def stream_upsert_buckets(stream: DataFrame, table: BucketTable, order: str, checkpoint: str):
    """Starts a query that keeps the newest row of each key in a bucketed table; a batch that is run again counts once."""
    combine = newest(table.keys, order)
    return stream.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, combine)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
