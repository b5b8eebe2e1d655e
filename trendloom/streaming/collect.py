"""Incremental collection and event streams with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.sources.segments import Segments


def collect_pages(pages: DataFrame, raw_path: str, store_path: str, checkpoint: str, key: str = "observation_id"):
    """Run a stream of pages to its end: each micro-batch goes to raw storage first, under its batch id, then into
    the store. A batch that is run again overwrites its own raw folder and is in the store already, so the result is as
    if it had run once; a finished stream does nothing. Returns the ended query.

    The store has a segment for each micro-batch (see ``Segments``), with the rows that it brings and no others; of equal
    keys ``current`` shows the row of the last batch."""
    held = Segments(pages.sparkSession, store_path, {"rows": None})

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.write.mode("overwrite").option("compression", "gzip").json(f"{raw_path}/batch={batch_id:06d}")
        rows = batch.dropDuplicates([key])
        held.add(batch_id, {"rows": rows.select(F.col(key).cast("string").alias("key_"), F.lit(batch_id).cast("long").alias("version_"), F.struct("*").alias("row_"))}, _latest)
        batch.unpersist()

    query = pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _latest(_: str, rows: DataFrame) -> DataFrame:
    """Of each key the row that came last."""
    return rows.groupBy("key_").agg(F.max("version_").alias("version_"), F.max_by("row_", "version_").alias("row_"))


def current(spark: SparkSession, store_path: str) -> DataFrame | None:
    """The rows of a store that ``collect_pages`` or ``monthly_state`` has filled, or None before the first batch."""
    held = Segments(spark, store_path, {"rows": None})
    segments = held.manifest()[1]
    return _latest("rows", held.read("rows", segments)).select("row_.*") if segments else None


def tumbling_counts(events: DataFrame, late: str = "1 hour", every: str = "6 hours") -> DataFrame:
    """Counts by window and type; events later than the watermark allows are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def first_of_each(events: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Exact deduplication by key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def monthly_state(stream: DataFrame, path: str, checkpoint: str):
    """Keeps (trend_id, observation_id, period) of all observations seen, whatever their order and lateness. An observation
    of a trend keeps the place of its key, so a replay changes nothing. (``keyed.count_months`` keeps counts alone.)"""
    held = Segments(stream.sparkSession, path, {"rows": None})

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("trend_id", "observation_id", F.date_format("event_time", "yyyy-MM").alias("period")).dropDuplicates(["trend_id", "observation_id"])
        key = F.to_json(F.struct("trend_id", "observation_id"))
        # the first batch that brings an observation counts
        held.add(batch_id, {"rows": rows.select(key.alias("key_"), F.lit(-batch_id).cast("long").alias("version_"), F.struct("*").alias("row_"))}, _latest)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
