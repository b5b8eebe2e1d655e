"""The live pipeline over tables: route directions, cluster what was discovered for them, ingest the clusters into the store
of trends, and let dated events of their repositories, if they pass the gate, move the trends' history.

All directions go through in one pass. Each count of the output is observed while the table that it counts is written, in
the job that writes it, so nothing is read again for it; observed rows are those of a job's last stage, where a task that
is run again counts once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trendloom.functions import scalars, vectors
from trendloom.operators import bridge, gates, linkage, routing, tfidf
from trendloom.operators.clustering import PROFILES
from trendloom.operators.ingest import DeltaStore
from trendloom.sources.shared import materialize

#: What the output says of itself, and what became of a check.
STATUS, HISTORY = "detector_evidence_snapshot_not_top15", "verified_git_event_and_semantic_gate_only"
ACCEPTED, REJECTED, NO_EVENT = "accepted", "rejected_by_semantic_gate", "no_text_verified_git_event"

_OBSERVED = ("observation_id", "evidence_type", "provider", "artifact_kind", "event_time", "unit_key", "verified", "actors")


class Output(NamedTuple):
    """summary: counts for each profile; trends: those the run has touched, as they are now; checks: a row for each
    event, and for each repository without one; observations: what was discovered, and the accepted events."""

    summary: DataFrame
    trends: DataFrame
    checks: DataFrame
    observations: DataFrame


class _Counts:
    """Counts by profile that are taken while tables are written."""

    def __init__(self):
        self.found: dict[str, dict[str, int]] = {p: {} for p in PROFILES}

    def written(self, df: DataFrame, name: str, **what: Column) -> DataFrame:
        """df, which has a column profile, as a table; what counts its rows by name."""
        seen = Observation()
        counts = [F.count_if((F.col("profile") == p) & cond).alias(f"{p} {n}") for n, cond in what.items() for p in PROFILES]
        table = materialize(df.observe(seen, *counts), name)
        for key, value in seen.get.items():
            profile, n = key.split(" ")
            self.found[profile][n] = value
        return table


def routed(directions: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """directions (id, direction) with profile and direction_key. routes (``routing.routes``) say which profiles may
    discover repositories; a direction of another one raises an error."""
    found = routing.classify(directions, routing.signals(directions.sparkSession)).withColumn("direction_key", routing.direction_key(F.col("direction")))
    if routes is not None:
        able = routes.where("provider = 'github' and enabled").select("profile", F.lit(True).alias("able"))
        off = F.raise_error(F.concat(F.lit("discovery disabled for profile "), F.col("profile")))
        found = found.join(F.broadcast(able), "profile", "left").withColumn("profile", F.when(F.col("able"), F.col("profile")).otherwise(off)).drop("able")
    return found.select(*directions.columns, "profile", "direction_key")


def _clustered(seen: DataFrame, profiles: dict[str, tuple[float, float]]) -> DataFrame:
    """observation_id, cluster of what was discovered, by average linkage within a direction, each profile with its own
    threshold and weight of the vectors against the terms of text. A tree is built for each weight and cut once."""
    block = F.concat_ws("|", "profile", F.col("id").cast("string"))
    seen, parts = seen.withColumn("block", block), []
    for alpha in sorted({a for _, a in profiles.values()}):
        own = {p: t for p, (t, a) in profiles.items() if a == alpha}
        mine = seen.where(F.col("profile").isin(*own))
        lexical = None if alpha == 1 else tfidf.vectors(mine, "block", "observation_id", "text").select("block", "observation_id", "term", "w")
        points = materialize(linkage.points(mine, "block", "observation_id", "vector", lexical, alpha), "points")
        top = F.element_at(F.create_map(*(F.lit(x) for pair in own.items() for x in pair)), F.substring_index("block", "|", 1))
        # heights never fall along a chain, so what a profile's threshold leaves of the tree is its clusters
        tree = linkage.merges(points, max(own.values())).where(F.col("height") < top)
        parts.append(linkage.labelled(points, tree, [float("inf")]).select(F.col("key").alias("observation_id"), "cluster"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _events(checked: DataFrame, events: DataFrame, now: Column, policy: bridge.Policy) -> DataFrame:
    """The events of checked repositories with similarity and label. Without the local gate only the earliest event of a
    repository is looked at. An event from the future, or whose vector isn't valid, raises an error."""
    order = F.struct("occurred_at", "kind", "event_id")
    if policy.local_threshold is None:
        first = events.groupBy("repo").agg(F.min_by(F.struct(*(c for c in events.columns if c != "repo")), order).alias("e"))
        events = first.select("repo", "e.*")
    met = checked.join(events.withColumnRenamed("vector", "event_vector"), "repo")
    vector = F.col("event_vector")
    sound = F.when(vectors.valid(vector) & (F.size(vector) == F.size("centroid")), vector).otherwise(F.raise_error(F.concat(F.lit("invalid vector of an event of "), F.col("repo"))))
    met = met.withColumns({"event_vector": sound, "observation_id": F.concat(F.lit("github:"), F.concat_ws(":", "repo", "kind", "event_id"))})
    if policy.local_threshold is None:
        met = met.withColumn("similarity", vectors.cosine(F.col("event_vector"), F.col("centroid"))).withColumn("eligible", F.col("similarity") >= policy.threshold)
    else:
        gated = gates.event_gate(met)
        near = vectors.cosine(F.col("event_vector"), F.col("direction_vector"))
        met = gated.withColumn("similarity", near).withColumn("eligible", (F.col("status") == "eligible") & F.coalesce(near >= policy.local_threshold, F.lit(False))).drop("family", "status", "reason", "evidence_span")
    dated = met.withColumns({"published_at": F.col("occurred_at"), "observed_at": now, "repository": F.col("repo")})
    return bridge.labelled(dated).drop("repository")


def run(
    store: DeltaStore, number: int, directions: DataFrame, discovered: DataFrame, events: DataFrame, now: Column, routes: DataFrame | None = None,
    policy: bridge.Policy = bridge.Policy(), profiles: dict[str, tuple[float, float]] = PROFILES, model: str = "BAAI/bge-m3", state_threshold: float = 0.82,
) -> Output:
    """One run, the number-th of its store from 0; its clusters are the store's batch 2 number, its events the next.

    directions: id, direction, and direction_vector with the local gate. discovered: id (its direction), observation_id,
    external_id (owner/name), published_at, text, vector, and what ``ingest.delta`` takes of an observation. events: repo, kind,
    event_id, occurred_at, vector, and title, text, source_diff with the local gate; those that name no checked repository
    are left alone. Ids are distinct. Nulls: a row without a direction, and an event without a repository, take no part; a
    vector that is null raises an error. Empty tables give counts of 0."""
    policy, counts = policy.checked(), _Counts()
    ways = routed(directions, routes)
    seen = counts.written(discovered.join(ways, "id"), "discovered", discovery_count=F.lit(True))

    mine = materialize(seen.join(_clustered(seen, profiles), "observation_id"), "clustered")
    center = vectors.centroids(mine, "cluster", "vector")
    groups = mine.groupBy("cluster", "profile", "direction_key").agg(F.collect_list("observation_id").alias("member_ids"), F.min("event_time").alias("first_seen")).join(center, "cluster")
    name = scalars.cluster_id(F.col("profile"), F.col("member_ids"))
    clusters = groups.select(name.alias("cluster_id"), "profile", "direction_key", F.lit(model).alias("model"), "member_ids", "centroid", "first_seen")
    clusters = counts.written(clusters, "microclusters", cluster_count=F.lit(True))
    observed = seen.select(*_OBSERVED)
    touched = store.ingest(2 * number, clusters, observed, now, state_threshold).select("trend_id").distinct()

    held = store.store()
    trends = held.trends.join(touched, "trend_id", "left_semi").select("trend_id", "profile", "direction_key", "centroid")
    checked = bridge.anchors(seen.drop("vector", "text"), held.ownership, policy.most, trends).withColumnsRenamed({"observation_id": "anchor_id", "external_id": "repo", "published_at": "anchor_at"})
    checked = counts.written(checked, "checked", checked_repository_count=F.lit(True))
    own = _events(checked, events, now, policy)
    own = counts.written(own, "events", verified_event_count=F.lit(True), accepted_event_count=F.col("label") == "accepted", rejected_event_count=F.col("label") != "accepted")

    chosen = own.where("label = 'accepted'")
    history = F.concat(F.lit("history:"), scalars.short_hash(F.col("anchor_id"), F.col("observation_id"), length=20))
    moved = chosen.select(history.alias("cluster_id"), "profile", "direction_key", F.lit(model).alias("model"), F.array("anchor_id", "observation_id").alias("member_ids"), F.col("event_vector").cast("array<double>").alias("centroid"), F.col("occurred_at").alias("first_seen"))
    dated = chosen.select("observation_id", F.lit("implementation").alias("evidence_type"), F.lit("github").alias("provider"), F.col("kind").alias("artifact_kind"), F.col("occurred_at").alias("event_time"), "unit_key", F.lit(True).alias("verified"), "actors")
    observed = observed.unionByName(dated)
    store.ingest(2 * number + 1, moved, observed, now, state_threshold)

    decision = F.when(F.col("label") == "accepted", ACCEPTED).otherwise(REJECTED)
    checks = own.select("trend_id", "profile", "repo", F.col("observation_id").alias("event_id"), F.col("kind").alias("event_kind"), "occurred_at", F.round("similarity", 5).alias("similarity"), F.col("label").alias("selection"), decision.alias("decision"))
    without = checked.join(own.select("trend_id", "repo"), ["trend_id", "repo"], "left_anti").select("trend_id", "profile", "repo", F.lit(NO_EVENT).alias("decision"))
    return Output(_summary(seen, counts), store.store().trends.join(touched, "trend_id", "left_semi"), checks.unionByName(without, allowMissingColumns=True), observed)


def _summary(like: DataFrame, counts: _Counts) -> DataFrame:
    """A row for each profile, five in all."""
    names = ("discovery_count", "cluster_count", "checked_repository_count", "verified_event_count", "accepted_event_count", "rejected_event_count")
    rows = [(p, *(found[n] for n in names), STATUS, HISTORY) for p, found in counts.found.items()]
    shape = ", ".join(("profile string", *(f"{n} long" for n in names), "status string", "historical_policy string"))
    return like.sparkSession.createDataFrame(rows, shape)
