"""The emerging score: one select over pre-aggregated trend states.

A state has trend_id, profile, first_seen, last_seen, observation_count, actor_count, provider_count,
active_periods, months (12 counts, the last one of as_of), and n_<type> and first_<type> for each evidence type.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.scalars import clamp, log_saturation, month_index, shrink

#: Weights of the positive components, and points that full maturity takes off (fixed values).
WEIGHTS = {"growth": 0.22, "acceleration": 0.18, "novelty": 0.18, "evidence": 0.14, "actors": 0.10, "recency": 0.08, "persistence": 0.10}
MATURITY_POINTS = 30.0
TYPES = ("research", "patent", "implementation", "product", "adoption", "investment", "regulation", "analysis", "other")
APPLIED, MARKET = ("patent", "implementation", "product", "adoption"), ("product", "adoption")
#: Evidence types and weight of each bucket, by profile (fixed values).
_SCIENCE = ((("research",), 0.25), (("patent",), 0.30), (("implementation", "product"), 0.25), (("adoption", "investment"), 0.15), (("regulation", "analysis"), 0.05))
BUCKETS = {
    "software_ai": ((("research",), 0.25), (("implementation", "patent"), 0.35), (("product", "adoption", "investment"), 0.25), (("regulation", "analysis"), 0.15)),
    "hardware_semiconductor": _SCIENCE,
    "materials_energy": _SCIENCE,
    "bio_medtech": _SCIENCE,
}
OTHER_BUCKETS = ((("research",), 0.25), (("patent", "implementation"), 0.30), (("product", "adoption", "investment"), 0.25), (("regulation", "analysis"), 0.20))


def trend_states(evidence: DataFrame, as_of: date, strict: bool = True, more: tuple[Column, ...] = ()) -> DataFrame:
    """States of evidence (trend_id, profile, event_time, evidence_type, provider, actor). With strict, evidence
    after as_of is left out altogether; else it counts in all but the monthly window. more are further aggregates."""
    now = as_of.year * 12 + as_of.month - 1
    if strict:
        evidence = evidence.where(F.col("event_time") < F.date_add(F.lit(as_of), 1))
    return _states(_first_marked(evidence), ["trend_id", "profile"], F.lit(now), more)


def states_at(evidence: DataFrame, dates: list[date]) -> DataFrame:
    """States at each of dates, from the evidence up to it alone, in one pass over evidence: as ``trend_states`` at
    each. Column as_of_index is the date's month."""
    evidence = evidence.where(F.col("event_time") < F.date_add(F.lit(max(dates)), 1))
    asked = F.array(*(F.struct(F.lit(d.year * 12 + d.month - 1).alias("as_of_index"), F.lit(d).alias("as_of_")) for d in dates))
    # the first of its kind up to a date is the first of all, if that is not later
    df = _first_marked(evidence).select("*", F.inline(asked)).where(F.col("event_time") < F.date_add("as_of_", 1))
    return _states(df, ["trend_id", "profile", "as_of_", "as_of_index"], F.col("as_of_index"), ()).drop("as_of_")


def _first_marked(evidence: DataFrame) -> DataFrame:
    """evidence with mi (its month) and whether it is the first of its trend with its actor, provider and month. All of it
    needs evidence by trend_id alone, so rows are shuffled once, as they are, and no aggregate is; a trend's rows
    are sorted, not held."""
    keys = ["trend_id", "profile"]
    df = evidence.withColumn("mi", month_index(F.col("event_time")))
    before = Window.partitionBy("trend_id").orderBy("profile", "event_time")
    again = F.lag("profile").over(before).eqNullSafe(F.col("profile")) & F.lag("mi").over(before).eqNullSafe(F.col("mi")) & (F.row_number().over(before) > 1)
    df = df.withColumn("new_month", ~again & F.col("mi").isNotNull())
    first = lambda c: F.col(c).isNotNull() & (F.row_number().over(Window.partitionBy(*keys, c).orderBy("event_time")) == 1)
    return df.withColumn("new_provider", first("provider")).withColumn("new_actor", first("actor"))


def _kinds(n: str, first: str) -> list[Column]:
    return [x for t in TYPES for x in (F.count_if(F.col("evidence_type") == t).alias(f"{n}_{t}"), F.min(F.when(F.col("evidence_type") == t, F.col("event_time"))).alias(f"{first}_{t}"))]


def _states(marked: DataFrame, keys: list[str], now: Column, more: tuple[Column, ...]) -> DataFrame:
    names = [f"m{k}" for k in range(11, -1, -1)]
    out = marked.groupBy(*keys).agg(
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if("new_actor").alias("actor_count"),
        F.count_if("new_provider").alias("provider_count"),
        F.count_if("new_month").alias("active_periods"),
        *(F.count_if(now - F.col("mi") == k).alias(f"m{k}") for k in range(11, -1, -1)),
        *_kinds("n", "first"),
        *more,
    )
    return out.withColumn("months", F.array(*names)).drop(*names)


def longest_run(counts: Column) -> Column:
    """Most consecutive positive elements."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(s: Column, n: Column) -> Column:
        now = F.when(n > 0, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    return F.aggregate(counts, start, step, lambda s: s["best"])


def _mean(counts: Column, a: int, n: int) -> Column:
    return sum((F.element_at(counts, a + i) for i in range(n)), F.lit(0.0)) / n


def _slope(counts: Column, a: int) -> Column:
    """Least-squares slope of three points over their mean plus one."""
    return (F.element_at(counts, a + 2) - F.element_at(counts, a)) / 2 / (_mean(counts, a, 3) + 1)


def _bucket_value(buckets) -> Column:
    value = F.lit(0.0)
    for types, weight in buckets:
        some = F.lit(False)
        for t in types:
            some = some | (F.col(f"n_{t}") > 0)
        value = value + F.when(some, weight * 100.0).otherwise(0.0)
    return value


def scored(states: DataFrame, as_of: date | None) -> DataFrame:
    """states with the eight components, total, confidence and stage; without as_of, each at its as_of_index."""
    now = F.col("as_of_index") if as_of is None else F.lit(as_of.year * 12 + as_of.month - 1)
    c, n = F.col("months"), F.col("observation_count")
    df = states.withColumns({"age": F.greatest(F.lit(0), now - month_index(F.col("first_seen"))), "idle": F.greatest(F.lit(0), now - month_index(F.col("last_seen")))})
    some = lambda i: (F.element_at(c, i) > 0).cast("int")
    active = sum((some(i) for i in range(7, 13)), F.lit(0))
    df = df.withColumns({"available": F.least(F.lit(6), F.greatest(F.lit(1), F.col("age") + 1)), "r_growth": F.least(F.lit(1.0), active / 4), "r_acceleration": F.least(F.lit(1.0), active / 5)})
    window = F.slice(c, 13 - F.col("available"), F.col("available"))
    ratio = sum((F.when(F.col("available") > 12 - i, some(i)).otherwise(0) for i in range(7, 13)), F.lit(0)) / F.col("available")
    run = F.least(F.lit(1.0), longest_run(window) / F.least(F.lit(3), F.col("available")))
    growth = clamp(50 + 25 * F.log2((_mean(c, 10, 3) + 0.5) / (_mean(c, 7, 3) + 0.5)))
    acceleration = clamp(50 + 50 * F.tanh(2 * (_slope(c, 10) - _slope(c, 7))))
    evidence = _bucket_value(OTHER_BUCKETS)
    for profile, buckets in BUCKETS.items():
        evidence = F.when(F.col("profile") == profile, _bucket_value(buckets)).otherwise(evidence)
    applied = F.least(*(F.col(f"first_{t}") for t in APPLIED))
    bonus = F.when(applied >= F.col("first_research"), 10.0).otherwise(0.0)
    market = (F.col("n_product") > 0) | (F.col("n_adoption") > 0)
    age_part = clamp((F.col("age") - 36) / 60, 0.0, 1.0)
    volume = clamp(log_saturation(n, 500), 0.0, 1.0)
    df = df.withColumn("r_persistence", F.least(F.lit(1.0), F.col("available") / 4))
    df = df.withColumns(
        {
            "growth": shrink(growth, F.col("r_growth")),
            "acceleration": shrink(acceleration, F.col("r_acceleration")),
            "novelty": 100 * F.exp(-F.greatest(F.lit(0), F.col("age") - 2) / 30.0),
            "recency": 100 * F.exp(-F.col("idle") / 12.0),
            "evidence": clamp(evidence + bonus),
            "actors": clamp(100 * log_saturation(F.col("actor_count"), 20)),
            "persistence": shrink(70 * ratio + 30 * run, F.col("r_persistence")),
            "maturity": clamp(100 * age_part * (0.70 + 0.20 * volume + 0.10 * market.cast("int"))),
        }
    )
    types = sum(((F.col(f"n_{t}") > 0).cast("int") for t in TYPES), F.lit(0))
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) - MATURITY_POINTS * F.col("maturity") / 100
    dynamic = (F.col("r_growth") + F.col("r_acceleration") + F.col("r_persistence")) / 3
    least = lambda x, most: F.least(F.lit(1.0), x / most)
    confidence = 0.30 * F.least(F.lit(1.0), log_saturation(n, 30)) + 0.20 * least(F.col("provider_count"), 3) + 0.20 * least(types, 3) + 0.15 * least(F.col("active_periods"), 6) + 0.15 * dynamic
    df = df.withColumns({"type_count": types, "total": clamp(total), "confidence": clamp(confidence, 0.0, 1.0)})
    research_only = is_research_only()
    stage = (
        F.when(F.col("total") < 40, "unknown")
        .when(research_only, "weak_signal")
        .when(market & (F.col("total") >= 50) & (F.col("maturity") < 60), "early_adoption")
        .when((F.col("total") >= 60) & (F.col("confidence") >= 0.45), "emerging")
        .otherwise("weak_signal")
    )
    return df.withColumns({"research_only": research_only, "stage": stage})


def is_research_only() -> Column:
    applied = F.lit(False)
    for t in APPLIED:
        applied = applied | (F.col(f"n_{t}") > 0)
    return (F.col("n_research") > 0) & ~applied


def explanation() -> Column:
    """A sentence on the score's parts."""
    return F.format_string("growth %.1f, acceleration %.1f, novelty %.1f, evidence %.1f, actors %.1f, recency %.1f, persistence %.1f, maturity penalty %.1f", *(F.round(k, 1) for k in ("growth", "acceleration", "novelty", "evidence", "actors", "recency", "persistence", "maturity")))


def top(scored_states: DataFrame, n: int = 15) -> DataFrame:
    """The first n by total, confidence, observations and id."""
    order = [F.desc("total"), F.desc("confidence"), F.desc("observation_count"), F.asc("trend_id")]
    return scored_states.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def prefix_states(evidence: DataFrame, start: date, end: date) -> DataFrame:
    """A state for each trend and month end from start to end, from the evidence up to it alone: as ``trend_states``
    at each of these dates, but in one pass. Months are aggregated first; running windows over each trend's own
    months do the rest, and a month without evidence takes the state before it, its months moved on. Column
    as_of_index is the month's index."""
    begin, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    keys = ["trend_id", "profile"]
    e = _first_marked(evidence.where(F.col("event_time") < F.lit(date((last + 1) // 12, (last + 1) % 12 + 1, 1))))
    # a month's own mark is one of its rows; asking for it keeps the window by trend_id alone in the plan
    fresh = [F.count_if(f"new_{c}").alias(f"new_{c}") for c in ("actor", "provider", "month")]
    monthly = e.groupBy(*keys, "mi").agg(F.count(F.lit(1)).alias("n"), F.min("event_time").alias("lo"), F.max("event_time").alias("hi"), *fresh, *_kinds("k", "f"))
    w = Window.partitionBy(*keys).orderBy("mi")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = monthly.select(
        *keys, "mi", F.min("lo").over(upto).alias("first_seen"), F.max("hi").over(upto).alias("last_seen"), F.sum("n").over(upto).alias("observation_count"),
        F.sum("new_actor").over(upto).alias("actor_count"), F.sum("new_provider").over(upto).alias("provider_count"), F.sum("new_month").over(upto).alias("active_periods"),
        *(F.sum(f"k_{t}").over(upto).alias(f"n_{t}") for t in TYPES), *(F.min(f"f_{t}").over(upto).alias(f"first_{t}") for t in TYPES),
        F.collect_list(F.struct("mi", "n")).over(w.rangeBetween(-11, 0)).alias("near_"), (F.lead("mi").over(w) - 1).alias("until_"),
    )
    df = df.withColumn("until_", F.coalesce("until_", F.lit(last))).where(F.col("until_") >= begin).withColumn("near_", F.map_from_entries("near_"))
    own = F.array(*(F.coalesce(F.try_element_at("near_", F.col("mi") - k), F.lit(0)) for k in range(11, -1, -1)), *[F.lit(0).cast("long")] * 12)
    df = df.withColumn("near_", own).withColumn("as_of_index", F.explode(F.sequence(F.greatest("mi", F.lit(begin)), F.col("until_"))))
    return df.withColumn("months", F.slice("near_", F.least(F.col("as_of_index") - F.col("mi"), F.lit(12)) + 1, 12)).drop("near_", "until_", "mi")
