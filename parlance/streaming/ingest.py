"""Incremental forms of ingest and counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.streaming.ledger import Ledger, settings


def ingest(spark: SparkSession, landing: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, by: list[str] = ()) -> StreamingQuery:
    """Newly landed lines of JSON through ``transform``, appended once each to ``target``; ends when what has landed is done."""
    rows = spark.readStream.schema(schema).json(landing)
    writer = transform(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.partitionBy(*by) if by else writer).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, time: str, actor: str, every: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per window and actor; batches and streams alike, late rows up to the watermark."""
    stamped = rows.withWatermark(time, late) if rows.isStreaming else rows
    counts = stamped.groupBy(F.window(time, every).alias("w"), F.col(actor)).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), actor, "n")


def ingest_once(spark: SparkSession, landing: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "entry_ID", within: str = "7 days", by: list[str] = (), parts: int | None = None) -> StreamingQuery:
    """Newly landed lines of JSON, each ``key`` once, through ``transform`` into the batches of a ``Ledger``; ends when what has landed is done.

    A key that lands again ``within`` that time of its first landing is left out, in the same run or a later one; rows without a key
    are known by all their columns. ``transform`` gets a plain table for each batch, so any operator can be used. A batch that fails
    runs again and replaces what it left. ``parts`` of state are fixed by the first start (null: as the session shuffles).
    """
    ledger = Ledger(spark, target)
    rows = spark.readStream.schema(schema).json(landing)
    known = F.coalesce(F.col(key).cast("string"), F.sha2(F.to_json(F.struct("*")), 256))
    fresh = rows.withColumn("__key", known).withColumn("__landed", F.current_timestamp()).withWatermark("__landed", within).dropDuplicatesWithinWatermark(["__key"])
    writer = fresh.writeStream.foreachBatch(lambda batch, k: ledger.write(transform(batch.drop("__key", "__landed")), k, by))
    with settings(spark, spark__sql__shuffle__partitions=parts):
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
