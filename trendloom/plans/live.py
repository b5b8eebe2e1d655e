"""Queries over the live pipeline: vectors as repositories and their events, labels as directions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trendloom.operators import bridge, live
from trendloom.operators.ingest import DeltaStore
from trendloom.plans.evidence import read
from trendloom.plans.space import _COS, _LINK, _V
from trendloom.sources.shared import materialize, shared_root

#: A direction for each label, and the profile that the router gives it.
_DIRECTIONS = (
    ("AI agent framework", "software_ai"), ("solid-state battery electrolyte", "materials_energy"), ("gene editing therapy", "bio_medtech"), ("quantum processor chip", "hardware_semiconductor"), ("maintenance of bridges", "mixed"),
    ("machine learning software", "software_ai"), ("hydrogen catalyst", "materials_energy"), ("protein diagnostic", "bio_medtech"), ("photonic accelerator", "hardware_semiconductor"), ("deep learning framework", "software_ai"),
)
#: Thresholds wide enough for vectors that lie far apart.
_PROFILES = {"software_ai": (0.8, 1.0), "hardware_semiconductor": (0.75, 1.0), "materials_energy": (0.7, 1.0), "bio_medtech": (0.85, 1.0), "mixed": (0.65, 1.0)}
_NEAR, _MOST = 0.5, 3


def _run(spark, sf_dir) -> live.Output:
    """Of three vectors two are repositories and one is an event of the repository two rows before it or one after it."""
    e = materialize(read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")), "vectors")
    names = F.array(*(F.lit(d) for d, _ in _DIRECTIONS))
    directions = e.select(F.col("label").alias("id")).where("id is not null").distinct().withColumn("direction", F.element_at(names, F.col("id") % len(_DIRECTIONS) + 1))
    day = lambda start, days: (F.lit(start).cast("timestamp") + F.make_dt_interval(days.cast("int")))
    repo = F.concat(F.lit("org/r"), "vec_id")
    r = e.where("vec_id % 3 <> 0").select(
        F.col("label").alias("id"), F.concat(F.lit("repo:"), "vec_id").alias("observation_id"), repo.alias("external_id"), F.lit(None).cast("timestamp").alias("published_at"), F.lit("").alias("text"), F.col("v").alias("vector"),
        F.lit("implementation").alias("evidence_type"), F.lit("github").alias("provider"), F.lit("repository").alias("artifact_kind"), day("2024-01-01", F.col("vec_id") % 50).alias("event_time"), F.concat(F.lit("github:"), repo).alias("unit_key"),
        F.lit(False).alias("verified"), F.array(F.lit("id:org")).alias("actors"),
    )
    odd = F.col("vec_id") % 6 == 3
    own = e.where("vec_id % 3 = 0").select("vec_id", "v", odd.alias("odd"), (F.col("vec_id") + F.when(odd, -2).otherwise(1)).alias("of"))
    met = own.join(e.select(F.col("vec_id").alias("of"), F.col("v").alias("w")), "of")
    mixed = F.zip_with("v", "w", lambda a, b: a * F.when(F.col("odd"), 2.0).otherwise(0.5) + b)
    events = met.select(F.concat(F.lit("org/r"), "of").alias("repo"), F.lit("commit").alias("kind"), F.col("vec_id").cast("string").alias("event_id"), day("2020-01-01", F.col("vec_id") * 7 % 1000).alias("occurred_at"), mixed.alias("vector"))
    store = DeltaStore(spark, f"{shared_root(spark)}/trendloom/live-{uuid.uuid4().hex}")
    return live.run(store, 0, directions, r, events, F.to_timestamp(F.lit("2024-06-01")), policy=bridge.Policy(_MOST, _NEAR), profiles=_PROFILES)


def live_pipeline_summary(spark, sf_dir):
    return _run(spark, sf_dir).summary


def live_pipeline_trends(spark, sf_dir):
    t = _run(spark, sf_dir).trends
    day = lambda c: F.col(c).cast("date").cast("string").alias(c)
    return t.select("trend_id", "profile", "direction_key", "observation_count", day("first_seen"), day("last_seen"), "update_count")


def live_pipeline_checks(spark, sf_dir):
    c = _run(spark, sf_dir).checks
    return c.select("trend_id", "repo", "event_id", F.col("occurred_at").cast("date").cast("string").alias("occurred_on"), "similarity", "selection", "decision")


_ROUTED = ", ".join(f"({i}, '{d.replace('-', ' ').lower()}', '{p}', {_PROFILES[p][0]})" for i, (d, p) in enumerate(_DIRECTIONS))
# clusters by the recursive linkage; their trends; the repositories checked of each; the earliest event of each of these
_SQL = f"""{_V}, way(i, direction, profile, top) as (values {_ROUTED}), r as (select vec_id as id, label, v, 'repo:' || vec_id as oid, (date '2024-01-01' + (vec_id % 50)::int) as day from p where vec_id % 3 <> 0),
  s as (select 1.0::double as alpha, a.label as block, a.id as x, b.id as y, {_COS.format(a='a.v', b='b.v')} as cos from r a join r b on a.label = b.label and a.id < b.id), pts as (select 1.0::double as alpha, label as block, id as vec_id from r), {_LINK.format(top=0.85)},
  lab as (select st.id, arg_max(c, it) as cluster from st join way on way.i = st.block % 10 where h < top group by st.id),
  m as (select r.*, cluster, direction, profile from r join lab on lab.id = r.id join way on way.i = r.label % 10),
  cen as (select cluster, list(x order by i) as c from (select cluster, i, avg(v[i]) as x from m, range(1, 65) t(i) group by all) group by cluster),
  g as (select cluster, label, direction, profile, count(*) as n, min(day) as first, max(day) as last, 'micro:' || profile || ':' || substr(sha256(profile || chr(10) || string_agg(oid, chr(10) order by oid)), 1, 16) as cid from m group by cluster, label, direction, profile),
  t as (select g.*, 'trend:' || profile || ':' || substr(sha256(profile || '|' || direction || '|' || strftime(first, '%Y-%m-%dT00:00:00Z') || '|' || cid), 1, 20) as tid from g),
  chk as (select cluster, id, oid from m qualify row_number() over (partition by cluster order by oid) <= {_MOST}),
  ev as (select e.vec_id as eid, w.vec_id as rid, (date '2020-01-01' + (e.vec_id * 7 % 1000)::int) as day, [e.v[i] * case when e.vec_id % 6 = 3 then 2.0 else 0.5 end + w.v[i] for i in range(1, 65)]::double[] as v
    from p e join p w on w.vec_id = e.vec_id + case when e.vec_id % 6 = 3 then -2 else 1 end where e.vec_id % 3 = 0),
  one as (select * from ev qualify row_number() over (partition by rid order by day, eid::varchar) = 1),
  looked as (select tid, profile, chk.id, one.eid, one.day, {_COS.format(a='one.v', b='cen.c')} as sim from chk join t on t.cluster = chk.cluster join cen on cen.cluster = chk.cluster left join one on one.rid = chk.id)"""
_PROFILE_NAMES = ", ".join(f"('{p}')" for p in _PROFILES)


QUERIES = {
    "live_pipeline_summary": (live_pipeline_summary, f"""with recursive {_SQL}, d as (select profile, sum(n) as d, count(*) as c from t group by profile),
      l as (select profile, count(*) as k, count(eid) as v, count(*) filter (sim >= {_NEAR}) as a, count(*) filter (sim < {_NEAR}) as r from looked group by profile)
      select names.profile, coalesce(d, 0)::bigint as discovery_count, coalesce(c, 0) as cluster_count, coalesce(k, 0) as checked_repository_count, coalesce(v, 0) as verified_event_count, coalesce(a, 0) as accepted_event_count, coalesce(r, 0) as rejected_event_count,
        '{live.STATUS}' as status, '{live.HISTORY}' as historical_policy from (values {_PROFILE_NAMES}) names(profile) left join d on d.profile = names.profile left join l on l.profile = names.profile"""),
    "live_pipeline_trends": (live_pipeline_trends, f"""with recursive {_SQL}, a as (select tid, count(*) as a, min(day) as first from looked where sim >= {_NEAR} group by tid)
      select t.tid as trend_id, profile, direction as direction_key, n + coalesce(a, 0) as observation_count, least(t.first, a.first)::varchar as first_seen, last::varchar as last_seen, 1 + coalesce(a, 0) as update_count from t left join a on a.tid = t.tid"""),
    "live_pipeline_checks": (live_pipeline_checks, f"""with recursive {_SQL} select tid as trend_id, 'org/r' || id as repo, case when eid is not null then 'github:org/r' || id || ':commit:' || eid end as event_id, day::varchar as occurred_on, round(sim, 5) as similarity,
      case when sim >= {_NEAR} then 'accepted' when sim is not null then 'rejected' end as selection, case when sim >= {_NEAR} then '{live.ACCEPTED}' when sim is not null then '{live.REJECTED}' else '{live.NO_EVENT}' end as decision from looked"""),
}
