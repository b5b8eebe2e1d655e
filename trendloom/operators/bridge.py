"""The history bridge: dated repository events as evidence of trends that already exist."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Policy(NamedTuple):
    """Repositories checked of a trend, least cosine of an event to the trend's centroid, and, for the local gate, to its
    direction (None: the centroid decides)."""

    most: int = 3
    threshold: float = 0.82
    local_threshold: float | None = None

    def checked(self) -> Policy:
        if self.most < 1:
            raise ValueError("most must be at least 1")
        if not 0 < self.threshold <= 1 or not (self.local_threshold is None or 0 < self.local_threshold <= 1):
            raise ValueError("thresholds must be in (0, 1]")
        return self


def anchors(observations: DataFrame, ownership: DataFrame, most: int = 3, trends: DataFrame | None = None) -> DataFrame:
    """Repositories that a trend owns and whose own date isn't known, most of each trend. With trends, only those that were
    collected for their trend's profile and direction_key."""
    Policy(most=most).checked()
    mine = observations.where("provider = 'github' and artifact_kind = 'repository' and published_at is null and external_id rlike '^[^/]+/[^/]+$'").join(ownership, "observation_id")
    if trends is not None:
        mine = mine.join(trends, ["trend_id", "profile", "direction_key"])
    place = F.row_number().over(Window.partitionBy("trend_id").orderBy("observation_id"))
    return mine.withColumn("place_", place).where(F.col("place_") <= most).drop("place_")


def labelled(events: DataFrame) -> DataFrame:
    """events (trend_id, repository, observation_id, published_at, eligible, observed_at) with label: the earliest
    eligible one of each repository is accepted, later ones are later, others rejected. An event dated after it
    was observed raises an error."""
    sane = F.when(F.col("published_at") > F.col("observed_at"), F.raise_error(F.concat(F.lit("event from the future: "), F.col("observation_id").cast("string")))).otherwise(F.col("eligible"))
    df = events.withColumn("eligible", sane)
    order = Window.partitionBy("trend_id", "repository", "eligible").orderBy("published_at", "observation_id")
    return df.withColumn("label", F.when(~F.col("eligible"), "rejected").when(F.row_number().over(order) == 1, "accepted").otherwise("later_supporting"))


def clusters(accepted: DataFrame, model: str) -> DataFrame:
    """A cluster of one for each accepted event, to be planned like any other; a bridge never makes a trend, so
    the caller keeps those whose plan isn't new."""
    return accepted.where("label = 'accepted'").select(F.concat(F.lit("bridge:"), F.col("observation_id").cast("string")).alias("cluster_id"), F.array("observation_id").alias("member_ids"), F.lit(model).alias("model"), F.col("published_at").alias("first_seen"), "trend_id", "repository")
