"""Retrospective validation: would a technology's score have shown it before its milestone, from the evidence of each
month alone?

A case has case_id, profile, start, origin and milestone (dates), anchor, aliases and context. A provider's count of a
month is what a search gives; the gate judges a sample of it and estimates how much of the count is the technology's.
Months are grouping keys throughout: all cases, providers and months go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.scalars import month_index
from trendloom.operators import gates, scoring, timeline

#: Score and confidence that make a signal useful, and the lead on the milestone that is asked for (fixed values).
USEFUL_SCORE, USEFUL_CONFIDENCE, TARGET_LEAD = 60.0, 0.45, 3
_KINDS = ("research", "implementation")


def gated_months(cases: DataFrame, counts: DataFrame, samples: DataFrame, keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(case_id, evidence_type, period, raw, samples, matched, estimated) of counts (case_id, evidence_type, period, raw), and
    the distinct (case_id, period, actor) of samples (case_id, evidence_type, period, sample_id, text, actor). A month's
    actors are those of its accepted samples, or of all its samples if none was accepted; blank ones don't count.
    Blank texts are samples that never match; a month with none is estimated at 0."""
    by = ["case_id", "evidence_type", "period"]
    key = F.to_json(F.struct(*by))
    told = cases.select("case_id", "anchor", "aliases", "context").join(samples.select(*by).distinct(), "case_id").select(key.alias("case_id"), "anchor", "aliases", "context")
    texts = samples.select(key.alias("case_id"), "sample_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    verdicts = gates.sample_gate(told, texts).select(F.col("case_id").alias("key_"), "sample_id", "accepted")
    judged = keep(samples.withColumn("key_", key).join(verdicts, ["key_", "sample_id"]).drop("key_"), "judged")
    matched = judged.groupBy(*by).agg(F.count(F.lit(1)).alias("samples"), F.count_if("accepted").alias("matched"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    months = counts.join(matched, by, "left").select(*by, F.col("raw").cast("long").alias("raw"), zero("samples"), zero("matched"))
    months = months.withColumn("estimated", gates.estimate(F.col("raw"), F.col("samples"), F.col("matched")))
    named = judged.where("trim(actor) <> ''").join(matched.select(*by, "matched"), by)
    actors = named.where((F.col("matched") == 0) | F.col("accepted")).select("case_id", "period", "actor").distinct()
    return months, actors


def curve(cases: DataFrame, months: DataFrame) -> DataFrame:
    """A row for each month of each case from its start to its milestone, with zeros: case_id, profile, origin, milestone,
    period, start, end, raw_total, research, implementation and total."""
    windows = cases.select("case_id", "profile", "origin", "milestone", F.explode(timeline.calendar_windows(F.trunc("start", "MM"), F.col("milestone"))).alias("w"))
    wide = months.groupBy("case_id", "period").agg(F.sum("raw").alias("raw_total"), *(F.sum(F.when(F.col("evidence_type") == k, F.col("estimated"))).alias(k) for k in _KINDS))
    df = windows.select("case_id", "profile", "origin", "milestone", "w.*").join(wide, ["case_id", "period"], "left")
    return df.fillna(0, ["raw_total", *_KINDS]).withColumn("total", F.col("research") + F.col("implementation"))


def _first_of_month(period: Column) -> Column:
    return F.to_date(F.concat(period, F.lit("-01")))


def prefix_states(months: DataFrame, actors: DataFrame) -> DataFrame:
    """A state for each case and month of a curve, from that month and those before it; first_seen is null until the
    signal has been sustained. Actors count from the first month that has them."""
    w = Window.partitionBy("case_id").orderBy("period")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    fresh = actors.groupBy("case_id", "actor").agg(F.min("period").alias("period")).groupBy("case_id", "period").agg(F.count(F.lit(1)).alias("new_actors"))
    begun = timeline.prefix_sustained(months.select("case_id", "period", "total"), count="total").select("case_id", "period", "first_sustained")
    df = months.join(fresh, ["case_id", "period"], "left").join(begun, ["case_id", "period"], "left")
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("long")
    active = lambda c: F.when(F.col(c) > 0, _first_of_month(F.col("period")))
    kinds = []
    for t in scoring.TYPES:
        kinds += [total(t).alias(f"n_{t}"), F.min(active(t)).over(upto).alias(f"first_{t}")] if t in _KINDS else [F.lit(0).cast("long").alias(f"n_{t}"), F.lit(None).cast("date").alias(f"first_{t}")]
    out = df.select(
        F.col("case_id").alias("trend_id"), "profile", "period", "milestone", month_index(_first_of_month(F.col("period"))).alias("as_of_index"),
        _first_of_month(F.col("first_sustained")).alias("first_seen"), F.max(active("total")).over(upto).alias("last_seen"), total("total").alias("observation_count"), total("new_actors").alias("actor_count"),
        F.count(active("total")).over(upto).alias("active_periods"), F.array(*(F.coalesce(F.lag("total", k).over(w), F.lit(0)) for k in range(11, -1, -1))).alias("months"), *kinds,
    )
    return out.withColumn("provider_count", sum((F.col(f"n_{k}") > 0).cast("long") for k in _KINDS))


def score_timeline(states: DataFrame) -> DataFrame:
    """case_id, period, milestone, score, confidence, stage and the components of each month; before the signal is sustained
    there is a reason in their place."""
    parts = [*scoring.WEIGHTS, "maturity"]
    scores = scoring.scored(states, None)
    known = F.col("first_seen").isNotNull()
    told = {"score": F.round("total", 4), "confidence": F.round("confidence", 4), "stage": F.col("stage"), **{k: F.round(k, 4) for k in parts}}
    return scores.select(F.col("trend_id").alias("case_id"), "period", "milestone", *(F.when(known, c).alias(k) for k, c in told.items()), F.when(~known, "no_sustained_signal_yet").alias("reason"))


def summary(months: DataFrame, scores: DataFrame, score: float = USEFUL_SCORE, confidence: float = USEFUL_CONFIDENCE, lead: int = TARGET_LEAD) -> DataFrame:
    """A row a case: first raw, semantic, sustained and useful month, months of lead on the milestone, whether that meets
    the target, and evidence in months that start before the origin. A case without a useful month has no lead and
    doesn't meet the target."""
    raw = lambda c: F.min(F.when(F.col(c) > 0, F.col("period")))
    early = lambda c: F.sum(F.when(F.col("start") < F.col("origin"), F.col(c)).otherwise(0)).cast("long")
    base = months.groupBy("case_id").agg(raw("raw_total").alias("first_raw"), early("raw_total").alias("pre_origin_raw"), early("total").alias("pre_origin"))
    active = timeline.sustained(months, count="total")
    useful = scores.where((F.col("score") >= score) & (F.col("confidence") >= confidence)).groupBy("case_id").agg(F.min("period").alias("first_useful"), F.first("milestone").alias("milestone"))
    useful = useful.select("case_id", "first_useful", (month_index(F.col("milestone")) - month_index(_first_of_month(F.col("first_useful")))).cast("long").alias("lead_months"))
    out = base.join(active, "case_id", "left").join(useful, "case_id", "left")
    return out.withColumn("target_met", F.coalesce(F.col("lead_months") >= lead, F.lit(False)))


def validate(cases: DataFrame, counts: DataFrame, samples: DataFrame, keep=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """(summary, score timeline) of all cases. keep(df, name) may write a step that several later ones read: the
    judged samples, the curve and the actors."""
    gated, actors = gated_months(cases, counts, samples, keep)
    months, actors = keep(curve(cases, gated), "curve"), keep(actors, "actors")
    scores = score_timeline(prefix_states(months, actors))
    return summary(months, scores), scores
