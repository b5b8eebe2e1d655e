"""The evidence view over the star schema, and the score queries on it.

A part is a trend; an order line is one piece of evidence, whose type follows the order's priority, whose
provider is the supplier's region, and whose repository is the supplier's nation.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.functions.scalars import month_key
from trendloom.operators import scoring, timeline, units

AS_OF = date(1997, 12, 31)
#: Suppliers that are broadcast (key and nation alone), at most.
BROADCAST_SUPPLIERS = 2_000_000
_TYPES = {"1-URGENT": "adoption", "2-HIGH": "product", "3-MEDIUM": "implementation", "4-NOT SPECIFIED": "research", "5-LOW": "patent"}
_PROFILES = {"STANDARD": "software_ai", "ECONOMY": "hardware_semiconductor", "MEDIUM": "materials_energy", "PROMO": "bio_medtech", "LARGE": "mixed", "SMALL": "mixed"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _case(column, mapping: dict, other: str):
    out = F.lit(other)
    for k, v in reversed(mapping.items()):
        out = F.when(column == k, v).otherwise(out)
    return out


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    # nations and regions are fixed small dimensions, whose names follow after the shuffles; suppliers are counted first
    place = supplier.select("s_suppkey", "s_nationkey")
    place = F.broadcast(place) if place.count() <= BROADCAST_SUPPLIERS else place
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    df = line.join(place, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(part, F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey"))
    return df.select(
        F.col("p_partkey").alias("trend_id"),
        _case(F.col("p_type"), _PROFILES, "mixed").alias("profile"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("observation_id"),
        _case(F.col("o_orderpriority"), _TYPES, "other").alias("evidence_type"),
        F.col("r_name").alias("provider"),
        F.col("o_custkey").alias("actor"),
        F.col("n_name").alias("country"),
        F.col("s_nationkey").alias("unit_key"),
        (F.col("l_returnflag") != "R").alias("verified"),
        F.col("o_orderdate").alias("event_time"),
        F.col("l_quantity").alias("stars"),
    )


EVIDENCE_SQL = """evidence as (select p_partkey as trend_id,
  case p_type when 'STANDARD' then 'software_ai' when 'ECONOMY' then 'hardware_semiconductor' when 'MEDIUM' then 'materials_energy' when 'PROMO' then 'bio_medtech' else 'mixed' end as profile,
  l_orderkey * 10 + l_linenumber as observation_id,
  case o_orderpriority when '1-URGENT' then 'adoption' when '2-HIGH' then 'product' when '3-MEDIUM' then 'implementation' when '4-NOT SPECIFIED' then 'research' when '5-LOW' then 'patent' else 'other' end as evidence_type,
  r_name as provider, o_custkey as actor, n_name as country, s_nationkey as unit_key, l_returnflag <> 'R' as verified, o_orderdate as event_time, l_quantity as stars
  from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""


def states_sql(as_of: str = "1997-12-31", source: str = "evidence") -> str:
    y, m, _ = map(int, as_of.split("-"))
    now = y * 12 + m - 1
    months = ", ".join(f"count(*) filter ({now} - mi = {k}) as m{k}" for k in range(12))
    kinds = ", ".join(f"count(*) filter (evidence_type = '{t}') as n_{t}, min(event_time) filter (evidence_type = '{t}') as first_{t}" for t in scoring.TYPES)
    return f"""states as (select trend_id, profile, min(event_time) as first_seen, max(event_time) as last_seen, count(*) as observation_count, count(distinct actor) as actor_count,
  count(distinct provider) as provider_count, count(distinct mi) as active_periods, {months}, {kinds}
  from (select *, year(event_time) * 12 + month(event_time) - 1 as mi from {source}) where event_time < date '{as_of}' + interval 1 day group by trend_id, profile)"""


def score_sql(as_of: str = "1997-12-31", now: str | None = None) -> str:
    """The score at a date, or at the month whose index the column named now holds."""
    y, m, _ = map(int, as_of.split("-"))
    now = now or y * 12 + m - 1

    def buckets(rows) -> str:
        return " + ".join(f"(case when {' or '.join(f'n_{t} > 0' for t in types)} then {w * 100.0} else 0.0 end)" for types, w in rows)

    evidence_value = "case " + " ".join(f"when profile = '{p}' then {buckets(b)}" for p, b in scoring.BUCKETS.items()) + f" else {buckets(scoring.OTHER_BUCKETS)} end"
    bits = "case when m5 > 0 then '1' else '0' end || case when m4 > 0 then '1' else '0' end || case when m3 > 0 then '1' else '0' end || case when m2 > 0 then '1' else '0' end || case when m1 > 0 then '1' else '0' end || case when m0 > 0 then '1' else '0' end"
    run = "case " + " ".join(f"when contains(w, '{'1' * k}') then {k}" for k in range(6, 0, -1)) + " else 0 end"
    types = " + ".join(f"(case when n_{t} > 0 then 1 else 0 end)" for t in scoring.TYPES)
    applied = "least(" + ", ".join(f"first_{t}" for t in scoring.APPLIED) + ")"
    cl = lambda x: f"least(100.0, greatest(0.0, {x}))"
    return f"""base as (select *, greatest(0, {now} - (year(first_seen) * 12 + month(first_seen) - 1)) as age, greatest(0, {now} - (year(last_seen) * 12 + month(last_seen) - 1)) as idle,
    (case when m0 > 0 then 1 else 0 end) + (case when m1 > 0 then 1 else 0 end) + (case when m2 > 0 then 1 else 0 end) + (case when m3 > 0 then 1 else 0 end) + (case when m4 > 0 then 1 else 0 end) + (case when m5 > 0 then 1 else 0 end) as act,
    {bits} as bits from states),
  b2 as (select *, least(6, greatest(1, age + 1)) as avail, least(1.0, act / 4.0) as rg, least(1.0, act / 5.0) as ra,
    (m2 + m1 + m0) / 3.0 as mr, (m5 + m4 + m3) / 3.0 as mp from base),
  b3 as (select *, right(bits, avail::int) as w, least(1.0, avail / 4.0) as rp from b2),
  b4 as (select *, length(replace(w, '0', '')) / avail::double as ratio, least(1.0, ({run}) / least(3, avail)::double) as runr from b3),
  parts as (select *,
    {cl(f"rg * {cl('50 + 25 * log2((mr + 0.5) / (mp + 0.5))')} + (1 - rg) * 25")} as growth,
    {cl(f"ra * {cl('50 + 50 * tanh(2 * ((m0 - m2) / 2.0 / (mr + 1) - (m3 - m5) / 2.0 / (mp + 1)))')} + (1 - ra) * 25")} as acceleration,
    100 * exp(-greatest(0, age - 2) / 30.0) as novelty, 100 * exp(-idle / 12.0) as recency,
    {cl(f"({evidence_value}) + case when {applied} >= first_research then 10.0 else 0.0 end")} as evidence,
    {cl("100 * ln(1 + actor_count) / ln(21)")} as actors,
    {cl("rp * (70 * ratio + 30 * runr) + (1 - rp) * 25")} as persistence,
    {cl("100 * least(1.0, greatest(0.0, (age - 36) / 60.0)) * (0.70 + 0.20 * least(1.0, ln(1 + observation_count) / ln(501)) + 0.10 * (case when n_product > 0 or n_adoption > 0 then 1 else 0 end))")} as maturity,
    {types} as type_count from b4),
  totals as (select *, {cl("0.22 * growth + 0.18 * acceleration + 0.18 * novelty + 0.14 * evidence + 0.10 * actors + 0.08 * recency + 0.10 * persistence - 30.0 * maturity / 100")} as total,
    least(1.0, greatest(0.0, 0.30 * least(1.0, ln(1 + observation_count) / ln(31)) + 0.20 * least(1.0, provider_count / 3.0) + 0.20 * least(1.0, type_count / 3.0) + 0.15 * least(1.0, active_periods / 6.0) + 0.15 * (rg + ra + rp) / 3)) as confidence,
    n_research > 0 and not (n_patent > 0 or n_implementation > 0 or n_product > 0 or n_adoption > 0) as research_only from parts),
  scored as (select *, case when total < 40 then 'unknown' when research_only then 'weak_signal' when (n_product > 0 or n_adoption > 0) and total >= 50 and maturity < 60 then 'early_adoption'
    when total >= 60 and confidence >= 0.45 then 'emerging' else 'weak_signal' end as stage from totals)"""


_PARTS = ("growth", "acceleration", "novelty", "evidence", "actors", "recency", "persistence", "maturity", "total", "confidence")


def _rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *(F.round(k, 6).alias(k) for k in _PARTS), "stage")


_ROUNDED = ", ".join(f"round({k}, 6) as {k}" for k in _PARTS)


def score_components_all(spark, sf_dir):
    return _rounded(scoring.scored(scoring.trend_states(evidence(spark, sf_dir), AS_OF), AS_OF), "trend_id", "profile", "observation_count")


def rank_top15_emerging(spark, sf_dir):
    found = scoring.scored(scoring.trend_states(evidence(spark, sf_dir), AS_OF), AS_OF)
    exact = found.withColumns({"total": F.round("total", 6), "confidence": F.round("confidence", 6)})
    return _rounded(scoring.top(exact).withColumn("rank", F.col("rank").cast("long")), "rank", "trend_id", "profile", "observation_count")


def score_mature(spark, sf_dir):
    late = date(2001, 8, 31)
    return _rounded(scoring.scored(scoring.trend_states(evidence(spark, sf_dir), late), late), "trend_id", "profile", "observation_count")


def stage_distribution(spark, sf_dir):
    found = scoring.scored(scoring.trend_states(evidence(spark, sf_dir), AS_OF), AS_OF)
    return found.groupBy("profile", "stage", "research_only").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("avg_total"))


def score_without_lookahead(spark, sf_dir):
    """Scores at four dates, each from evidence up to it alone."""
    dates = [date(y, 6, 30) for y in (1996, 1997, 1998, 1999)]
    found = scoring.scored(scoring.states_at(evidence(spark, sf_dir), dates), None).groupBy("as_of_index", "stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total"), 6).alias("avg_total"))
    return found.select("stage", "n", "avg_total", F.concat(F.floor(F.col("as_of_index") / 12).cast("string"), F.lit("-06-30")).alias("as_of"))


def monthly_buckets(spark, sf_dir):
    return timeline.monthly(evidence(spark, sf_dir))


def monthly_grouping_sets(spark, sf_dir):
    return timeline.monthly_totals(evidence(spark, sf_dir))


def independent_units(spark, sf_dir):
    return units.representatives(evidence(spark, sf_dir)).select("trend_id", "unit_key", "observation_id", "verified", "event_time")


def unit_projection_counts(spark, sf_dir):
    found = units.representatives(evidence(spark, sf_dir))
    return found.groupBy("trend_id").agg(F.count(F.lit(1)).alias("units"), F.count_distinct("evidence_type").alias("types"), F.count_distinct("provider").alias("providers"), F.count_distinct("actor").alias("actors"), F.count_distinct(month_key(F.col("event_time"))).alias("periods"), F.min("event_time").alias("first_seen"), F.max("event_time").alias("last_seen"))


def score_independent_units(spark, sf_dir):
    found = units.representatives(evidence(spark, sf_dir).where(F.col("event_time") < F.date_add(F.lit(AS_OF), 1)))
    return _rounded(scoring.scored(scoring.trend_states(found, AS_OF), AS_OF), "trend_id", "observation_count")


def longest_active_run(spark, sf_dir):
    return timeline.longest_active_run(evidence(spark, sf_dir))


def recent_month_spine(spark, sf_dir):
    return timeline.recent_months(evidence(spark, sf_dir), AS_OF, 12)


def trajectory_last12(spark, sf_dir):
    return timeline.trajectory(evidence(spark, sf_dir), 12).select("trend_id", F.posexplode("trajectory").alias("pos", "b")).select("trend_id", "pos", "b.period", "b.total")


def representative_sources(spark, sf_dir):
    return units.representative_sources(evidence(spark, sf_dir), 5).select("trend_id", F.col("place").cast("long").alias("place"), "observation_id", "evidence_type", "priority")


def country_count(spark, sf_dir):
    return evidence(spark, sf_dir).groupBy("trend_id").agg(F.nullif(F.count_distinct(F.upper(F.trim("country"))), F.lit(0)).alias("countries"))


def coverage_summary(spark, sf_dir):
    return timeline.coverage(evidence(spark, sf_dir))


def first_evidence_transition(spark, sf_dir):
    e = evidence(spark, sf_dir)
    first = e.groupBy("trend_id").agg(F.min(F.when(F.col("evidence_type") == "research", F.col("event_time"))).alias("research_at"), F.min(F.when(F.col("evidence_type").isin(*scoring.APPLIED), F.col("event_time"))).alias("applied_at"))
    return first.select("trend_id", "research_at", "applied_at", F.coalesce(F.col("applied_at") >= F.col("research_at"), F.lit(False)).alias("transition"), F.datediff("applied_at", "research_at").cast("long").alias("lag_days"))


def result_status(spark, sf_dir):
    """How many of the profile's trends the answer has, and its status."""
    found = scoring.scored(scoring.trend_states(evidence(spark, sf_dir), AS_OF), AS_OF)
    n = found.where("total >= 40").groupBy("profile").agg(F.count(F.lit(1)).alias("candidates"))
    shown = F.least(F.col("candidates"), F.lit(15))
    return n.select("profile", "candidates", shown.alias("trend_count"), F.when(shown == 0, "insufficient_evidence").when(shown < 15, "partial").otherwise("ok").alias("status"))


_E, _S, _C = EVIDENCE_SQL, states_sql(), score_sql()
_MONTHS = "strftime(event_time, '%Y-%m')"
_UNITS = "units as (select * from (select *, row_number() over (partition by trend_id, unit_key order by verified desc, event_time, observation_id) as rn from {src}) where rn = 1)"
_LATE = states_sql("2001-08-31")
_SCORES = f"with {_E}, {_S}, {_C} "


def _lookahead_sql() -> str:
    parts = []
    for y in (1996, 1997, 1998, 1999):
        at = f"{y}-06-30"
        parts.append(f"select * from (with {states_sql(at)}, {score_sql(at)} select stage, count(*) as n, round(avg(total), 6) as avg_total, '{at}' as as_of from scored group by stage)")
    return f"with {_E} " + " union all ".join(parts)


QUERIES = {
    "rank_top15_emerging": (rank_top15_emerging, _SCORES + f"select row_number() over (order by round(total, 6) desc, round(confidence, 6) desc, observation_count desc, trend_id) as rank, trend_id, profile, observation_count, {_ROUNDED}, stage from scored qualify rank <= 15"),
    "score_components_all": (score_components_all, _SCORES + f"select trend_id, profile, observation_count, {_ROUNDED}, stage from scored"),
    "score_mature": (score_mature, f"with {_E}, {_LATE}, {score_sql('2001-08-31')} select trend_id, profile, observation_count, {_ROUNDED}, stage from scored"),
    "score_without_lookahead": (score_without_lookahead, _lookahead_sql()),
    "stage_distribution": (stage_distribution, _SCORES + "select profile, stage, research_only, count(*) as n, round(avg(total), 6) as avg_total from scored group by all"),
    "result_status": (result_status, _SCORES + "select profile, count(*) as candidates, least(count(*), 15) as trend_count, case when count(*) < 15 then 'partial' else 'ok' end as status from scored where total >= 40 group by profile"),
    "monthly_buckets": (monthly_buckets, f"with {_E} select trend_id, {_MONTHS} as period, evidence_type, provider, count(*) as n from evidence group by all"),
    "monthly_grouping_sets": (monthly_grouping_sets, f"with {_E} select trend_id, {_MONTHS} as period, evidence_type, provider, count(*) as n from evidence group by grouping sets ((trend_id, {_MONTHS}), (trend_id, {_MONTHS}, evidence_type), (trend_id, {_MONTHS}, provider))"),
    "independent_units": (independent_units, f"with {_E}, {_UNITS.format(src='evidence')} select trend_id, unit_key, observation_id, verified, event_time from units"),
    "unit_projection_counts": (unit_projection_counts, f"with {_E}, {_UNITS.format(src='evidence')} select trend_id, count(*) as units, count(distinct evidence_type) as types, count(distinct provider) as providers, count(distinct actor) as actors, count(distinct {_MONTHS}) as periods, min(event_time) as first_seen, max(event_time) as last_seen from units group by trend_id"),
    "score_independent_units": (score_independent_units, f"with {_E}, {_UNITS.format(src='''(select * from evidence where event_time < date '1997-12-31' + interval 1 day)''')}, {states_sql(source='units')}, {_C} select trend_id, observation_count, {_ROUNDED}, stage from scored"),
    "longest_active_run": (longest_active_run, f"with {_E}, m as (select distinct trend_id, year(event_time) * 12 + month(event_time) - 1 as mi from evidence), g as (select *, mi - row_number() over (partition by trend_id order by mi) as grp from m) select trend_id, max(n) as longest from (select trend_id, grp, count(*) as n from g group by all) group by trend_id"),
    "recent_month_spine": (recent_month_spine, f"with {_E}, cal as (select strftime(d, '%Y-%m') as period from (select unnest(generate_series(date '1997-01-01', date '1997-12-01', interval 1 month)) as d)), t as (select distinct trend_id from evidence), c as (select trend_id, {_MONTHS} as period, count(*) as n from evidence group by all) select t.trend_id, cal.period, coalesce(c.n, 0) as n from t cross join cal left join c on c.trend_id = t.trend_id and c.period = cal.period"),
    "trajectory_last12": (trajectory_last12, f"with {_E}, c as (select trend_id, {_MONTHS} as period, count(*) as total from evidence group by all), r as (select *, row_number() over (partition by trend_id order by period desc) as rn from c) select trend_id, (row_number() over (partition by trend_id order by period) - 1)::int as pos, period, total from r where rn <= 12"),
    "representative_sources": (representative_sources, f"with {_E}, p as (select *, case evidence_type when 'adoption' then 90 when 'product' then 85 when 'implementation' then 80 when 'patent' then 70 when 'research' then 60 else 10 end as priority from evidence) select trend_id, row_number() over (partition by trend_id order by priority desc, stars desc, event_time desc, observation_id) as place, observation_id, evidence_type, priority from p qualify place <= 5"),
    "country_count": (country_count, f"with {_E} select trend_id, nullif(count(distinct upper(trim(country))), 0) as countries from evidence group by trend_id"),
    "coverage_summary": (coverage_summary, f"with {_E} select profile, count(distinct trend_id) as trends, count(distinct observation_id) as observations, strftime(min(event_time), '%Y-%m-%d') as coverage_start, string_agg(distinct provider, ',' order by provider) as providers_used from evidence group by profile"),
    "first_evidence_transition": (first_evidence_transition, f"with {_E}, f as (select trend_id, min(event_time) filter (evidence_type = 'research') as research_at, min(event_time) filter (evidence_type in ('patent', 'implementation', 'product', 'adoption')) as applied_at from evidence group by trend_id) select *, coalesce(applied_at >= research_at, false) as transition, date_diff('day', research_at, applied_at) as lag_days from f"),
}
