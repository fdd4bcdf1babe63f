"""Structured Streaming forms of the incremental folds, each with the batch function that it shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.ordered import dedupe_keep_last


def demand_by_day(events: DataFrame) -> DataFrame:
    """Events and value by day and type; `ts` is the event time. On a stream, rows later than its watermark are dropped."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("Events"), F.round(F.sum("value"), 2).alias("Value")).select(F.col("w.start").alias("Day"), "event_type", "Events", "Value")


def timed(stream: DataFrame) -> DataFrame:
    """Watermarks take timestamps with a time zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_demand(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    return demand_by_day(timed(stream).withWatermark("ts", watermark))


def stream_distinct(stream: DataFrame, keys: list[str], watermark: str = "1 day") -> DataFrame:
    return timed(stream).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys).select(*keys)


def stream_upsert(stream: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Starts a query that keeps the newest row of each key as a table: each batch is written as a new version beside the last."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.withColumn("_r", F.struct("ts")).groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), "ts").alias("s")).select("s.*")
        old = f"{path}/v{number - 1}"
        merged = dedupe_keep_last(spark.read.parquet(old), own, keys) if number else own
        merged.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()


def replay(spark, path: str, schema, sink: str, checkpoint: str, transform) -> DataFrame:
    """Runs a stream over all files there are, to a table, and returns the table."""
    stream = spark.readStream.schema(schema).parquet(path)
    query = transform(stream).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(sink)
