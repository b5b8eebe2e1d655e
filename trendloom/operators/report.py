"""The ranked answer: which candidates count and why others don't, their cards, and the document with its warnings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import scoring, timeline, units
from trendloom.sources.shared import materialize

#: Trends of an answer (fixed value).
LIMIT = 15


def cards(top: DataFrame, e: DataFrame, sources: int = 5, buckets: int = 12, citable: Column | None = None) -> DataFrame:
    """A card for each selected trend: score, evidence summary, trajectory, representative sources. The selected
    trends are fifteen at most; they and their evidence are written once, since each part of a card reads them. Sources
    and countries are taken from citable evidence."""
    top = materialize(top, "top")
    return _cards(top, _evidence_of(top, e), sources, buckets, citable)


def _evidence_of(top: DataFrame, e: DataFrame) -> DataFrame:
    """The evidence of top's trends, fifteen at most: as literals their ids reach the scans, before any shuffle."""
    ids = [r.trend_id for r in top.select("trend_id").collect()]
    return materialize(e.where(F.col("trend_id").isin(ids) if ids else F.lit(False)), "evidence")


def _cards(top: DataFrame, mine: DataFrame, sources: int = 5, buckets: int = 12, citable: Column | None = None) -> DataFrame:
    cited = mine if citable is None else mine.where(citable)
    by = mine.groupBy("trend_id", "evidence_type").agg(F.count(F.lit(1)).alias("n")).groupBy("trend_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("evidence_type", "n")))).alias("by_type"))
    path = timeline.trajectory(mine, buckets)
    refs = units.representative_sources(cited, sources).groupBy("trend_id").agg(F.array_sort(F.collect_list(F.struct("place", "observation_id", "evidence_type", "provider"))).alias("sources"))
    places = cited.groupBy("trend_id").agg(F.nullif(F.count_distinct("country"), F.lit(0)).alias("country_count"))
    out = top.join(by, "trend_id").join(path, "trend_id").join(refs, "trend_id").join(places, "trend_id")
    notes = F.array_compact(F.array(F.lit("Ranked by a fixed score."), F.when(F.col("research_only"), F.lit("Research only: no applied evidence."))))
    return out.select(
        "rank", "trend_id", "stage", F.round("total", 4).alias("score"), F.round("confidence", 4).alias("confidence"), F.date_format("first_seen", "yyyy-MM").alias("first_period"),
        "observation_count", "by_type", "actor_count", "provider_count", "country_count", "trajectory", "sources", notes.alias("limitations"), scoring.explanation().alias("explanation"),
    )


def candidates(evidence: DataFrame, profile: str, as_of: date) -> DataFrame:
    """Scored states of all trends with sources, their number of evidence up to as_of that can be cited, and skipped: null, or why the
    trend can't be in the answer (another profile; no source with title, address, provider and type)."""
    df = scoring.scored(scoring.trend_states(evidence, as_of, more=(F.count_if(units.source_eligible()).alias("sources"),)), as_of)
    return df.withColumn("skipped", F.when(~F.col("profile").eqNullSafe(profile), "profile").when(F.col("sources") == 0, "no_source"))


def document(evidence: DataFrame, direction: str, profile: str, as_of: date, failed: tuple[str, ...] = ()) -> DataFrame:
    """One row (status, trend_count, document): the answer as JSON. Skipped candidates are counted by reason, since a list of
    them grows with the store; ``candidates`` names each. Failed providers are told beside those that were used. With no
    candidate the document has no trends and says so. Scores are compared as rounded to six places."""
    if not direction.strip() or not profile.strip():
        raise ValueError("direction and profile must not be blank")
    every = materialize(candidates(evidence, profile, as_of), "candidates")
    kept = every.where("skipped is null").withColumns({"total": F.round("total", 6), "confidence": F.round("confidence", 6)})
    top = materialize(scoring.top(kept.drop("sources", "skipped"), LIMIT), "top")
    mine = _evidence_of(top, evidence)
    listed = _cards(top, mine, citable=units.source_eligible()).withColumn("by_type", F.map_entries("by_type"))
    trends = listed.agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("*").alias("trend")))).alias("t"))  # fifteen at most
    counted = every.agg(F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("skipped") == "profile").alias("other"), F.count_if(F.col("skipped") == "no_source").alias("unsourced"))
    chosen = top.agg(F.count(F.lit(1)).alias("trend_count"), F.coalesce(F.sum("observation_count"), F.lit(0)).alias("observation_count"), F.count_if("research_only").alias("research_only"), F.date_format(F.min("first_seen"), "yyyy-MM-dd").alias("coverage_start"))
    used = mine.agg(F.array_sort(F.collect_set("provider")).alias("providers"))
    df = trends.join(F.broadcast(counted)).join(F.broadcast(chosen)).join(F.broadcast(used))  # one row each
    number = lambda c, text: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(text)))
    warnings = F.array_compact(F.array(
        number("other", f" candidate(s) skipped: their profile is not {profile}."),
        number("unsourced", " candidate(s) skipped: no source that can be cited."),
        number("research_only", " candidate(s) have research evidence only: signals to look into, not adoption."),
        F.when((F.col("trend_count") > 0) & (F.col("trend_count") < LIMIT), F.concat(F.lit("Only "), F.col("trend_count").cast("string"), F.lit(f" trends have evidence; the {LIMIT} asked for are not filled up."))),
    ))
    status = F.when(F.col("trend_count") == 0, "insufficient_evidence").when(F.col("trend_count") < LIMIT, "partial").otherwise("ok")
    words = lambda found: F.array(*map(F.lit, sorted(set(found)))).cast("array<string>")
    request = F.struct(F.lit(direction.strip()).alias("technology_direction"), F.lit(profile.strip()).alias("source_profile"), F.lit(LIMIT).alias("requested_limit"), "coverage_start", F.lit(str(as_of)).alias("coverage_end"))
    coverage = F.struct(F.array_sort(F.array_union("providers", words(failed))).alias("attempted"), F.array_except("providers", words(failed)).alias("succeeded"), words(failed).alias("failed"))
    summary = F.struct(status.alias("status"), "trend_count", "candidate_count", "observation_count", F.col("providers").alias("providers_used"), coverage.alias("coverage"), warnings.alias("warnings"))
    whole = F.struct(request.alias("request"), summary.alias("summary"), F.transform("t", lambda x: x["trend"]).alias("trends"))
    return df.select(status.alias("status"), "trend_count", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))
