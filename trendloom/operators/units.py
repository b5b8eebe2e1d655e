"""Independent evidence: one representative per (trend, unit), and representative sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rank of evidence types among sources (fixed values).
PRIORITY = {"adoption": 90, "product": 85, "implementation": 80, "patent": 70, "research": 60, "investment": 50, "regulation": 40, "analysis": 30, "other": 10}


def unit_key(provider: Column, artifact_kind: Column, observation_id: Column, repository: Column) -> Column:
    """Evidence of one repository is one unit, other evidence its own; an event without its repository is an
    error, since it could be counted any number of times."""
    linked = F.when(repository.isNotNull(), F.concat(F.lit("github:repo:"), F.lower(repository)))
    return F.when(provider == "github", F.coalesce(linked, F.raise_error(F.concat(F.lit("no repository for "), observation_id)))).otherwise(F.concat(F.lit("observation:"), observation_id))


def repository_of(relationships: Column) -> Column:
    """owner/name of the first belongs_to_repository edge to a github target."""
    edge = F.filter(relationships, lambda r: (r["type"] == "belongs_to_repository") & r["target_id"].startswith("github:"))
    return F.substring_index(F.get(edge, F.lit(0))["target_id"], "github:", -1)


def representatives(evidence: DataFrame) -> DataFrame:
    """Verified before unverified, then the earliest, then the least id; whatever the order of arrival."""
    order = Window.partitionBy("trend_id", "unit_key").orderBy(F.desc("verified"), "event_time", "observation_id")
    return evidence.withColumn("rn_", F.row_number().over(order)).where("rn_ = 1").drop("rn_")


def priority(evidence_type: Column) -> Column:
    out = F.lit(PRIORITY["other"])
    for k, v in PRIORITY.items():
        out = F.when(evidence_type == k, v).otherwise(out)
    return out


def activity(metrics: Column) -> Column:
    """The sum of a record's four public counts (a map), each cut to a whole number; what is no number counts
    nothing."""
    each = [F.coalesce(F.try_element_at(metrics, F.lit(k)).try_cast("double").cast("bigint"), F.lit(0)) for k in ("stars", "citations", "cited_by_count", "forks")]
    return each[0] + each[1] + each[2] + each[3]


def references(evidence: Column, sources: Column) -> Column:
    """All names under which a trend's evidence (structs with observation_id, url, source_ref, raw_ref) and sources
    (id, url, source_ref) can be cited, distinct and sorted; null arrays have none."""
    named = lambda items, keys: F.coalesce(F.flatten(F.transform(items, lambda i: F.array(*(i[k] for k in keys)))), F.array().cast("array<string>"))
    every = F.concat(named(evidence, ("observation_id", "url", "source_ref", "raw_ref")), named(sources, ("id", "url", "source_ref")))
    return F.array_sort(F.array_distinct(F.filter(every, lambda r: r != "")))


def representative_sources(evidence: DataFrame, n: int, activity: str | Column = "stars") -> DataFrame:
    """The first n of each trend by type, activity and date."""
    ranked = evidence.withColumn("priority", priority(F.col("evidence_type")))
    order = Window.partitionBy("trend_id").orderBy(F.desc("priority"), F.desc(activity), F.desc("event_time"), "observation_id")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def source_eligible() -> Column:
    """Title, URL, provider and type aren't blank."""
    out = F.lit(True)
    for c in ("title", "canonical_url", "provider", "evidence_type"):
        out = out & (F.coalesce(F.trim(c), F.lit("")) != "")
    return out


def source_ref(title_cap: int = 180, text_cap: int = 600) -> Column:
    """A struct with a trend card's view of one observation."""
    return F.struct(
        F.col("observation_id"),
        F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("observation_id")), 1, title_cap).alias("title"),
        F.substring(F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.trim("title")), 1, text_cap).alias("description"),
        F.col("canonical_url"), F.col("provider"), F.col("evidence_type"), F.col("published_at"),
    )
