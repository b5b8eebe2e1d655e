"""The observation store, raw batches and their names, as Parquet and JSON tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions import scalars


def _or_error(ok: Column, value: Column, message: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def checked_provider(provider: Column) -> Column:
    return _or_error(provider.rlike(r"\A[A-Za-z0-9_.-]+\z"), provider, "provider must match [A-Za-z0-9_.-]+")


def checked_key(key: Column) -> Column:
    return _or_error(F.trim(key) != "", key, "checkpoint key must be a non-empty string")


def checked_state(state_json: Column) -> Column:
    """A checkpoint's state as JSON text, which must be an object."""
    return _or_error(state_json.rlike(r"\A\s*\{") & F.try_parse_json(state_json).isNotNull(), state_json, "checkpoint state must be a JSON object")


def checked_time(observed_at: Column) -> Column:
    """The time, or now where there is none; one without a zone raises an error."""
    return F.when(observed_at.isNull(), F.current_timestamp()).otherwise(_or_error(scalars.strict_zoned_time(observed_at).isNotNull(), scalars.strict_zoned_time(observed_at), "observed_at must include timezone"))


def with_raw_ref(observations: DataFrame, uri: str | Column | None) -> DataFrame:
    """observations with the raw batch that holds them; without one, what they name stays."""
    if uri is None:
        return observations if "raw_ref" in observations.columns else observations.withColumn("raw_ref", F.lit(None).cast("string"))
    return observations.withColumn("raw_ref", F.lit(uri) if isinstance(uri, str) else uri)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new in place of those of equal key. Within new the last by order wins."""
    if order:
        new = new.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("rn_ = 1").drop("rn_")
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def upsert_stats(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: inserted and updated."""
    known = old.select(key).distinct().withColumn("known_", F.lit(True))
    return new.select(key).distinct().join(known, key, "left").agg(F.count_if(F.col("known_").isNull()).alias("inserted"), F.count_if("known_").alias("updated"))


def get(observations: DataFrame, observation_id: str) -> DataFrame:
    return observations.where(F.col("observation_id") == observation_id)


def list_observations(observations: DataFrame, direction: str | None = None, limit: int = 1000) -> DataFrame:
    """The first rows by (observed_at, observation_id): a top-k, not a global sort."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if direction is not None:
        observations = observations.where(F.col("technology_direction") == direction)
    return observations.orderBy("observed_at", "observation_id").limit(limit)


def promoted(observations: DataFrame) -> DataFrame:
    """The columns a store filters by, beside the whole document as JSON."""
    return observations.select(
        "observation_id", "provider", "evidence_type", "published_at", "observed_at",
        F.col("collection_context.technology_direction").alias("technology_direction"), F.col("analysis.cluster_id").alias("cluster_id"),
        F.to_json(F.struct("*")).alias("payload"),
    )


def write_store(rows: DataFrame, path: str) -> None:
    """A folder for each direction, sorted by date within a file, so that filters prune files and row groups."""
    rows.repartition("technology_direction").sortWithinPartitions("published_at").write.mode("overwrite").partitionBy("technology_direction").parquet(path)


def batch_id(provider: Column, key: Column, state_json: Column) -> Column:
    """A name that a rerun of the same page gives again."""
    return F.concat(F.lit("page-"), F.substring(F.sha2(F.concat_ws("|", provider, key, state_json), 256), 1, 24))


def write_raw(records: DataFrame, path: str, provider: str, observed_at: Column) -> None:
    """Untouched records as gzipped JSON lines under provider and day."""
    day = records.withColumns({"provider": F.lit(provider), "year": F.year(observed_at), "month": F.month(observed_at), "day": F.dayofmonth(observed_at)})
    day.write.mode("append").partitionBy("provider", "year", "month", "day").option("compression", "gzip").json(path)


def manifest(raw: DataFrame) -> DataFrame:
    """Records and digest of each raw file; the digest doesn't depend on the order of records."""
    line = F.sha2(F.to_json(F.struct(*(c for c in sorted(raw.columns)))), 256)
    by = raw.select(F.input_file_name().alias("file"), line.alias("line"))
    return by.groupBy("file").agg(F.count(F.lit(1)).alias("record_count"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("sha256"))
