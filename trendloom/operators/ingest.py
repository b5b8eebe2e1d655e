"""The durable store of trends: a planned batch of clusters applied to it as one keyed merge.

Counters are rows (trend, kind, name) with a count and a first time, so that a batch is aggregated before it meets
the store and no trend's history is held in one row or task. Nothing is changed in place: ``delta`` checks all new
records while it builds what a batch adds, and an error leaves the store as it was.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions import scalars
from trendloom.operators import state, units
from trendloom.sources.segments import Segments
from trendloom.sources.shared import materialize


class Store(NamedTuple):
    """trends: a row each; ownership: a row for each observation; counters: evidence, provider, artifact, period,
    actor and cluster by name; units: a representative of each independent unit."""

    trends: DataFrame
    ownership: DataFrame
    counters: DataFrame
    units: DataFrame


_SHAPES = Store(
    "trend_id string, profile string, direction_key string, model string, centroid array<double>, observation_count long, first_seen timestamp, last_seen timestamp, created_at timestamp, updated_at timestamp, update_count long",
    "trend_id string, observation_id string",
    "trend_id string, kind string, name string, n long, first_at timestamp",
    "trend_id string, unit_key string, observation_id string, verified boolean, event_time timestamp",
)


def empty(spark: SparkSession) -> Store:
    return Store(*(spark.createDataFrame([], shape) for shape in _SHAPES))


def members(clusters: DataFrame, observations: DataFrame) -> DataFrame:
    """cluster_id and the observation of each member; a member that isn't among observations raises an error."""
    each = clusters.select("cluster_id", F.explode("member_ids").alias("observation_id"))
    found = each.join(observations.withColumn("found_", F.lit(True)), "observation_id", "left")
    missing = F.raise_error(F.concat(F.lit("missing observation of "), F.col("cluster_id"), F.lit(": "), F.col("observation_id")))
    return found.withColumn("observation_id", F.when(F.col("found_").isNull(), missing).otherwise(F.col("observation_id"))).drop("found_")


def _facts(fresh: DataFrame) -> DataFrame:
    """(trend_id, kind, name, n, first_at) of new observations, aggregated."""
    fact = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    kinds = F.array(*(fact(kind, scalars.required(F.col(c), c)) for kind, c in (("evidence", "evidence_type"), ("provider", "provider"), ("artifact", "artifact_kind"))), fact("period", scalars.month_key(F.col("event_time"))))
    actors = F.transform("actors", lambda a: fact("actor", a))
    each = fresh.select("trend_id", "event_time", F.explode(F.concat(kinds, F.coalesce(actors, F.array().cast("array<struct<kind:string,name:string>>")))).alias("fact"))
    return each.groupBy("trend_id", "fact.kind", "fact.name").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first_at"))


def delta(store: Store, planned: DataFrame, observations: DataFrame, now: Column) -> Store:
    """What a batch adds to the store, as rows of its tables: the trends that it makes or changes, new owners, counts to add
    and new units. Its size is that of the batch, whatever the store's. planned: clusters as ``state.plan`` returns them; observations: observation_id,
    evidence_type, provider, artifact_kind, event_time, unit_key, verified, actors. Observations that a trend has
    count once, so a replay changes nothing but the names of its clusters. One that two clusters of the batch bring
    to different trends raises an error, and so does a blank type, provider or kind."""
    target = planned.select("cluster_id", "trend_id")
    fresh = members(planned, observations).join(store.ownership.select("observation_id"), "observation_id", "left_anti").join(target, "cluster_id")
    claims = fresh.groupBy("observation_id").agg(F.min("trend_id").alias("trend_id"), F.max("trend_id").alias("other"))
    clash = F.raise_error(F.concat(F.lit("observation of two trends: "), F.col("observation_id")))
    owned = materialize(claims.select(F.when(F.col("trend_id") != F.col("other"), clash).otherwise(F.col("trend_id")).alias("trend_id"), "observation_id"), "owned")
    fresh = materialize(owned.join(observations, "observation_id"), "fresh")

    named = planned.select("trend_id", F.lit("cluster").alias("kind"), F.col("cluster_id").alias("name"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("timestamp").alias("first_at"))
    counters = _facts(fresh).unionByName(named)

    found = fresh.select("trend_id", F.coalesce("unit_key", F.raise_error(F.concat(F.lit("no unit for "), F.col("observation_id")))).alias("unit_key"), "observation_id", "verified", "event_time")
    best = units.representatives(found)

    times = fresh.groupBy("trend_id").agg(F.min("event_time").alias("first_new"), F.max("event_time").alias("last_new"))
    steps = planned.where("fresh > 0").groupBy("trend_id").agg(F.count(F.lit(1)).alias("steps"), *(F.first(c).alias(f"{c}_new") for c in ("profile", "direction_key", "model")))
    changed = times.join(steps, "trend_id").join(state.applied_centroids(planned, store.trends).withColumnsRenamed({"centroid": "centroid_new", "n": "n_new"}), "trend_id")
    both = changed.join(store.trends, "trend_id", "left")
    trends = both.select(
        "trend_id", *(F.coalesce(c, f"{c}_new").alias(c) for c in ("profile", "direction_key", "model")), F.coalesce("centroid_new", "centroid").alias("centroid"),
        F.coalesce("n_new", "observation_count").alias("observation_count"), F.least("first_seen", "first_new").alias("first_seen"), F.greatest("last_seen", "last_new").alias("last_seen"),
        F.coalesce("created_at", now).alias("created_at"), now.alias("updated_at"), (F.coalesce("update_count", F.lit(0)) + F.coalesce("steps", F.lit(0))).cast("long").alias("update_count"),
    )
    columns = lambda df, like: df.select(*like.columns)
    return Store(*(columns(df, old) for df, old in zip((trends, owned, counters, best), store, strict=True)))


def merged(name: str, rows: DataFrame) -> DataFrame:
    """One row for each key of a table whose rows came in several batches: the last of a trend (by version), counts added up,
    one for each cluster's name, the best of a unit."""
    if name == "trends":
        rest = [c for c in rows.columns if c != "trend_id"]
        return rows.groupBy("trend_id").agg(F.max_by(F.struct(*rest), "version").alias("last")).select("trend_id", "last.*")
    if name == "counters":
        return rows.groupBy("trend_id", "kind", "name").agg(F.when(F.col("kind") == "cluster", F.lit(1).cast("long")).otherwise(F.sum("n")).alias("n"), F.min("first_at").alias("first_at"))
    return units.representatives(rows) if name == "units" else rows


def apply(store: Store, planned: DataFrame, observations: DataFrame, now: Column) -> Store:
    """The store after a batch (see ``delta``), as tables of their own."""
    new = delta(store, planned, observations, now)
    version = lambda df, n: df.withColumn("version", F.lit(n))
    trends = merged("trends", version(store.trends, 0).unionByName(version(new.trends, 1))).drop("version")
    rest = [merged(name, old.unionByName(add)) for name, old, add in zip(Store._fields[1:], store[1:], new[1:], strict=True)]
    return Store(*(materialize(df, name) for name, df in zip(Store._fields, (trends, *rest), strict=True)))


class DeltaStore:
    """The store on shared storage, a segment for each batch: an ingest writes what its batch changes and nothing else, a
    reader merges, and segments are merged geometrically (see ``Segments``). Batches are numbered from 0 in order; one
    that is in already changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        shapes = dict(zip(Store._fields, _SHAPES, strict=True))
        shapes["trends"] += ", version long"
        self.segments = Segments(spark, path, shapes | {"assignments": "batch long, cluster_id string, trend_id string, similarity double, reason string, fresh long"})

    def store(self) -> Store:
        held = self.segments.manifest()[1]
        return Store(*(merged(name, self.segments.read(name, held)).drop("version") for name in Store._fields))

    def assignments(self, batch: int) -> DataFrame:
        return self.segments.read("assignments").where(F.col("batch") == batch).drop("batch")

    def ingest(self, batch: int, clusters: DataFrame, observations: DataFrame, now: Column, threshold: float = 0.82) -> DataFrame:
        """The assignments of a batch, which is in the store with them."""
        if batch > self.segments.manifest()[0]:
            store = self.store()
            planned = materialize(state.plan(clusters, store.trends, store.ownership, threshold), "planned")
            number = F.lit(batch).cast("long")
            new = dict(zip(Store._fields, delta(store, planned, observations, now), strict=True))
            new["trends"] = new["trends"].withColumn("version", number)
            new["assignments"] = planned.select(number.alias("batch"), "cluster_id", "trend_id", "similarity", "reason", F.col("fresh").cast("long").alias("fresh"))
            self.segments.add(batch, new, merged)
        return self.assignments(batch)


def ingest(store: Store, clusters: DataFrame, observations: DataFrame, now: Column, threshold: float = 0.82) -> tuple[Store, DataFrame]:
    """Plan a batch against the store and apply it: the next store, and an assignment for each cluster."""
    planned = materialize(state.plan(clusters, store.trends, store.ownership, threshold), "planned")
    return apply(store, planned, observations, now), planned


def summary(planned: DataFrame) -> DataFrame:
    """One row of counters of a batch: clusters by what became of them, and new observations."""
    made = F.col("reason") == "new"
    return planned.agg(
        F.count(F.lit(1)).alias("clusters"), F.count_distinct(F.when(made, F.col("trend_id"))).alias("created"), F.count_distinct(F.when(~made & (F.col("fresh") > 0), F.col("trend_id"))).alias("updated"),
        *(F.count_if(F.col("reason") == r).alias(r) for r in ("deterministic_replay", "existing_observation", "centroid")), F.coalesce(F.sum("fresh"), F.lit(0)).alias("new_observations"),
    )
