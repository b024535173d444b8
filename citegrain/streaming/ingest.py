"""Incremental ingest: files that arrive in an entity's directory are upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__last")).select(key, "__last.*").select(rows.columns)


def ingest(spark: SparkSession, path: str, schema: T.StructType | str, table: str, checkpoint: str, key: str = "id", order: str = "updated_date", shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """A query that reads what is new under path, shapes it and merges it into a parquet table: each batch
    writes a new version beside the old one, whose name the next batch reads. Stops when all is read."""

    def merge(batch: DataFrame, number: int) -> None:
        batch = latest(shape(batch) if shape else batch, key, order)
        before = f"{table}/v{number - 1}"
        if number:
            old = spark.read.parquet(before).join(batch.select(key), key, "left_anti")
            batch = old.unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{table}/v{number}")

    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").json(path)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and window; a window is final when the watermark has passed it."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")
