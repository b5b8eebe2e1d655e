"""Keyed state under a stream: months of trends, whatever the order, lateness and repetition of observations.

Which observations have been counted is the state of a streaming deduplication, kept by key in RocksDB, so that a micro-batch
looks up its own rows and nothing else. What is new is aggregated and appended as a segment of counts, under the
micro-batch's number; readers add segments up, and these merge geometrically. A micro-batch that is run again is in
already, and a stream that is started again goes on where it was. Work grows with the batch, not with the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trendloom.functions import scalars
from trendloom.sources.segments import Segments

_SHAPES = {"months": "trend_id string, period string, n long, first_at timestamp, last_at timestamp"}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _added(_: str, rows: DataFrame) -> DataFrame:
    return rows.groupBy("trend_id", "period").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))


def _segments(spark: SparkSession, path: str) -> Segments:
    return Segments(spark, path, _SHAPES)


def count_months(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Count a stream of observations (trend_id, observation_id, event_time) by trend and month until all there is has been
    read; the ended query. An observation counts once for a trend. A row without a trend, an id or a time takes no part."""
    spark = stream.sparkSession
    rows = stream.select(F.col("trend_id").cast("string").alias("trend_id"), F.col("observation_id").cast("string").alias("observation_id"), F.col("event_time").cast("timestamp").alias("event_time")).dropna()
    fresh = rows.dropDuplicates(["trend_id", "observation_id"])
    store = _segments(spark, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        one = F.col("event_time")
        months = batch.groupBy("trend_id", scalars.month_key(one).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.min(one).alias("first_at"), F.max(one).alias("last_at"))
        store.add(batch_id, {"months": months}, _added)

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        query = fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return query


def months(spark: SparkSession, path: str) -> DataFrame:
    """trend_id, period, n, first_at, last_at."""
    return _added("months", _segments(spark, path).read("months"))


def spans(spark: SparkSession, path: str) -> DataFrame:
    """trend_id, n, first_seen, last_seen: a late observation lowers first_seen."""
    rows = _segments(spark, path).read("months")
    return rows.groupBy("trend_id").agg(F.sum("n").alias("n"), F.min("first_at").alias("first_seen"), F.max("last_at").alias("last_seen"))
