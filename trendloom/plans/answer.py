"""The ranked answer: trend cards, the result document, retrospective timelines."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.operators import report, scoring
from trendloom.plans.evidence import _PARTS, _ROUNDED, AS_OF, EVIDENCE_SQL, evidence, score_sql, states_sql


def _top(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = evidence(spark, sf_dir).where(F.col("event_time") < F.date_add(F.lit(AS_OF), 1))
    found = scoring.scored(scoring.trend_states(e, AS_OF), AS_OF)
    return e, scoring.top(found.withColumns({"total": F.round("total", 6), "confidence": F.round("confidence", 6)}))


_DIRECTION, _PROFILE = "software of all parts", "software_ai"


def _listed(spark, sf_dir) -> DataFrame:
    """Evidence of up to the coverage's end; a line that was sent back has no address to cite."""
    e = evidence(spark, sf_dir).where(F.col("event_time") < F.date_add(F.lit(AS_OF), 1))
    return e.withColumns({"title": F.concat(F.lit("line "), F.col("observation_id")), "canonical_url": F.when(F.col("verified"), F.concat(F.lit("https://shop.example/"), F.col("observation_id")))})


def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the whole answer for one profile as JSON."""
    return report.document(_listed(spark, sf_dir), _DIRECTION, _PROFILE, AS_OF)


def candidate_status(spark, sf_dir):
    """What became of each candidate: selected, ranked beyond the first fifteen, or skipped and why."""
    return report.candidates(_listed(spark, sf_dir), _PROFILE, AS_OF).select("trend_id", "skipped", F.round("total", 6).alias("total"), "sources")


def trend_cards(spark, sf_dir):
    e, top = _top(spark, sf_dir)
    c = report.cards(top, e)
    return c.select(F.col("rank").cast("long").alias("rank"), "trend_id", "stage", "score", "first_period", "observation_count", F.size("by_type").cast("long").alias("types"), F.size("trajectory").cast("long").alias("buckets"), F.get(F.col("sources"), F.lit(0))["observation_id"].alias("primary_source"), "country_count", F.size("limitations").cast("long").alias("notes"))


def analyze(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """The answer for one profile, as a service would give it."""
    e = evidence(spark, sf_dir).where(F.col("profile") == profile)
    return report.cards(scoring.top(scoring.scored(scoring.trend_states(e, AS_OF), AS_OF)), e)


def analyze_software(spark, sf_dir):
    return analyze(spark, sf_dir, "software_ai").select(F.col("rank").cast("long").alias("rank"), "trend_id", "stage", "score", "observation_count")


_AT = [date(1996, 6, 30), date(1997, 6, 30), date(1997, 12, 31)]


def retrospective_scores(spark, sf_dir):
    found = scoring.scored(scoring.prefix_states(evidence(spark, sf_dir), date(1996, 1, 1), AS_OF), None)
    kept = found.where(F.col("as_of_index").isin(*(d.year * 12 + d.month - 1 for d in _AT)))
    return kept.select("trend_id", F.col("as_of_index").cast("long").alias("as_of_index"), "observation_count", *(F.round(k, 6).alias(k) for k in _PARTS), "stage")


def retrospective_first_useful(spark, sf_dir):
    """The first month end at which a trend scores 60 with confidence 0.45, and its lead on the milestone."""
    found = scoring.scored(scoring.prefix_states(evidence(spark, sf_dir), date(1996, 1, 1), AS_OF), None)
    useful = found.where((F.round("total", 6) >= 60) & (F.round("confidence", 6) >= 0.45)).groupBy("trend_id").agg(F.min("as_of_index").cast("long").alias("useful_at"))
    return useful.select("trend_id", "useful_at", (F.lit(1997 * 12 + 11) - F.col("useful_at")).alias("lead_months"), (F.lit(1997 * 12 + 11) - F.col("useful_at") >= 3).alias("target_met"))


def _at_sql(dates) -> str:
    parts = []
    for d in dates:
        parts.append(f"select * from (with {states_sql(str(d))}, {score_sql(str(d))} select trend_id, {d.year * 12 + d.month - 1}::bigint as as_of_index, observation_count, {_ROUNDED}, stage from scored)")
    return " union all ".join(parts)


def _month_ends(y0: int, y1: int) -> list[date]:
    from calendar import monthrange

    return [date(y, m, monthrange(y, m)[1]) for y in range(y0, y1 + 1) for m in range(1, 13)]


_SAID = "growth %.1f, acceleration %.1f, novelty %.1f, evidence %.1f, actors %.1f, recency %.1f, persistence %.1f, maturity penalty %.1f"
_SAID_OF = ", ".join(f"round({k}::double, 1)" for k in ("growth", "acceleration", "novelty", "evidence", "actors", "recency", "persistence", "maturity"))
_PRIORITY_SQL = "case evidence_type when 'adoption' then 90 when 'product' then 85 when 'implementation' then 80 when 'patent' then 70 when 'research' then 60 else 10 end"
_LATE = f"late as (select * from evidence where event_time < date '{AS_OF}' + interval 1 day)"

_CANDIDATES = f"""{EVIDENCE_SQL}, {states_sql()}, {score_sql()}, {_LATE}, cited as (select trend_id, profile, count(*) filter (verified) as sources from late group by all),
  cand as (select scored.*, sources, case when profile <> '{_PROFILE}' then 'profile' when sources = 0 then 'no_source' end as skipped from scored join cited using (trend_id, profile))"""

QUERIES = {
    "trend_cards": (trend_cards, f"""with {EVIDENCE_SQL}, {states_sql()}, {score_sql()}, {_LATE}, top as (select row_number() over (order by round(total, 6) desc, round(confidence, 6) desc, observation_count desc, trend_id) as rank, * from scored qualify rank <= 15)
      select rank, trend_id, stage, round(round(total, 6), 4) as score, strftime(first_seen, '%Y-%m') as first_period, observation_count, (select count(distinct evidence_type) from late l where l.trend_id = top.trend_id) as types,
      least(12, active_periods) as buckets, (select arg_min(observation_id, (-case evidence_type when 'adoption' then 90 when 'product' then 85 when 'implementation' then 80 when 'patent' then 70 when 'research' then 60 else 10 end, -stars, -epoch_us(event_time), observation_id)) from late l where l.trend_id = top.trend_id) as primary_source,
      (select count(distinct country) from late l where l.trend_id = top.trend_id) as country_count, case when research_only then 2 else 1 end::bigint as notes from top"""),
    "candidate_status": (candidate_status, f"with {_CANDIDATES} select trend_id, skipped, round(total, 6) as total, sources from cand"),
    "result_document": (result_document, f"""with {_CANDIDATES}, top as (select row_number() over (order by round(total, 6) desc, round(confidence, 6) desc, observation_count desc, trend_id) as rank, * from cand where skipped is null qualify rank <= 15),
      mine as (select late.* from late join top using (trend_id)),
      types as (select trend_id, list(struct_pack(key := evidence_type, value := n) order by evidence_type) as by_type from (select trend_id, evidence_type, count(*) as n from mine group by all) group by trend_id),
      paths as (select trend_id, list(struct_pack(period := p, total := n) order by p) as trajectory from (select trend_id, strftime(event_time, '%Y-%m') as p, count(*) as n from mine group by trend_id, p qualify row_number() over (partition by trend_id order by p desc) <= 12) group by trend_id),
      refs as (select trend_id, list(struct_pack(place := place, observation_id := observation_id, evidence_type := evidence_type, provider := provider) order by place) as sources from (select *, row_number() over (partition by trend_id order by {_PRIORITY_SQL} desc, stars desc, event_time desc, observation_id) as place from mine where verified qualify place <= 5) group by trend_id),
      places as (select trend_id, count(distinct country) as country_count from mine where verified group by trend_id),
      cards as (select rank, trend_id, stage, round(round(total, 6), 4) as score, round(round(confidence, 6), 4) as confidence, strftime(first_seen, '%Y-%m') as first_period, observation_count, by_type, actor_count, provider_count, country_count, trajectory, refs.sources,
        case when research_only then ['Ranked by a fixed score.', 'Research only: no applied evidence.'] else ['Ranked by a fixed score.'] end as limitations, printf('{_SAID}', {_SAID_OF}) as explanation from top join types using (trend_id) join paths using (trend_id) join refs using (trend_id) join places using (trend_id)),
      n as (select count(*) as all_, count(*) filter (skipped = 'profile') as other, count(*) filter (skipped = 'no_source') as unsourced from cand), t as (select count(*) as k, coalesce(sum(observation_count), 0)::bigint as obs, count(*) filter (research_only) as ro, strftime(min(first_seen), '%Y-%m-%d') as since from top),
      p as (select coalesce(list(distinct provider order by provider), []) as used from mine), st as (select case when k = 0 then 'insufficient_evidence' when k < 15 then 'partial' else 'ok' end as status from t)
      select status, k as trend_count, to_json(struct_pack(request := struct_pack(technology_direction := '{_DIRECTION}', source_profile := '{_PROFILE}', requested_limit := 15, coverage_start := since, coverage_end := '{AS_OF}'),
        summary := struct_pack(status := status, trend_count := k, candidate_count := all_, observation_count := obs, providers_used := used, coverage := struct_pack(attempted := used, succeeded := used, failed := []::varchar[]),
          warnings := list_filter([case when other > 0 then other || ' candidate(s) skipped: their profile is not {_PROFILE}.' end, case when unsourced > 0 then unsourced || ' candidate(s) skipped: no source that can be cited.' end,
            case when ro > 0 then ro || ' candidate(s) have research evidence only: signals to look into, not adoption.' end, case when k > 0 and k < 15 then 'Only ' || k || ' trends have evidence; the 15 asked for are not filled up.' end], lambda x: x is not null)),
        trends := (select coalesce(list(cards order by rank), []) from cards)))::varchar as document from n, t, p, st"""),
    "analyze_software": (analyze_software, f"with {EVIDENCE_SQL}, {states_sql()}, {score_sql()} select row_number() over (order by total desc, confidence desc, observation_count desc, trend_id) as rank, trend_id, stage, round(total, 4) as score, observation_count from scored where profile = 'software_ai' qualify rank <= 15"),
    "retrospective_scores": (retrospective_scores, f"with {EVIDENCE_SQL} {_at_sql(_AT)}"),
    "retrospective_first_useful": (retrospective_first_useful, f"with {EVIDENCE_SQL}, a as ({_at_sql(_month_ends(1996, 1997))}), u as (select trend_id, min(as_of_index) as useful_at from a where total >= 60 and confidence >= 0.45 group by trend_id) select trend_id, useful_at, 23975 - useful_at as lead_months, 23975 - useful_at >= 3 as target_met from u"),
}
