"""Retrospective validation over the star schema: a brand is a case, whose anchor is the name of its first part; an order
line is a search result, of research or implementation by its order's priority, with its part's name as text."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.functions.scalars import month_key
from trendloom.operators import scoring, validation
from trendloom.plans.corpus import _WORDS, _tf
from trendloom.plans.evidence import read, score_sql
from trendloom.sources.shared import materialize

#: Results of a provider and month that are sampled (fixed value).
SAMPLED = 15
_PROFILES = [*scoring.BUCKETS, "mixed"]
_PARTS = [*scoring.WEIGHTS, "maturity"]


def _cases(part):
    b = F.substring("case_id", 7, 9).cast("int")
    found = part.groupBy(F.col("p_brand").alias("case_id")).agg(F.min_by("p_name", "p_partkey").alias("anchor"))
    milestone = F.add_months(F.lit(date(1997, 6, 15)), b % 12)
    some = lambda *x: F.when(b % 3 == 0, F.array(*x)).otherwise(F.array().cast("array<string>"))
    return found.select(
        "case_id", "anchor", F.element_at(F.array(*map(F.lit, _PROFILES)), b % len(_PROFILES) + 1).alias("profile"), F.lit(date(1996, 1, 1)).alias("start"), F.add_months(milestone, -6).alias("origin"), milestone.alias("milestone"),
        some(F.col("anchor")).alias("aliases"), some(F.substring_index("anchor", " ", 1)).alias("context"),
    )


def _validated(spark, sf_dir):
    line, orders, part = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    cases = materialize(_cases(part), "cases")
    df = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).join(cases, F.col("p_brand") == F.col("case_id"))
    df = df.where((F.col("o_orderdate") >= F.col("start")) & (F.col("o_orderdate") < F.date_add("milestone", 1)))
    kind = F.when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), "research").otherwise("implementation")
    results = df.select("case_id", kind.alias("evidence_type"), month_key(F.col("o_orderdate")).alias("period"), F.col("p_name").alias("text"), F.col("o_custkey").cast("string").alias("actor"), "o_orderdate", "l_orderkey", "l_linenumber", "p_partkey")
    by = ["case_id", "evidence_type", "period"]
    order = Window.partitionBy(*by).orderBy("o_orderdate", "l_orderkey", "l_linenumber", "p_partkey")
    samples = results.withColumn("sample_id", F.row_number().over(order).cast("long")).where(F.col("sample_id") <= SAMPLED)
    counts = results.groupBy(*by).agg(F.count(F.lit(1)).alias("raw"))
    return validation.validate(cases, counts, materialize(samples.select(*by, "sample_id", "text", "actor"), "samples"), materialize)


def validation_summary(spark, sf_dir):
    return _validated(spark, sf_dir)[0]


def validation_timeline(spark, sf_dir):
    return _validated(spark, sf_dir)[1].drop("milestone")


_MONTH = "make_date(({0} // 12)::int, ({0} % 12 + 1)::int, 1)"
_KINDS_SQL = ", ".join(
    f"sum(p.{t})::bigint as n_{t}, min({_MONTH.format('p.i')}) filter (p.{t} > 0) as first_{t}" if t in ("research", "implementation") else f"0::bigint as n_{t}, null::date as first_{t}" for t in scoring.TYPES
)
_VALIDATED = rf"""named as (select p_brand as case_id, substr(p_brand, 7)::int as b, arg_min(p_name, p_partkey) as anchor from part group by p_brand),
  cases as (select *, {_PROFILES}[b % {len(_PROFILES)} + 1] as profile, (date '1997-06-15' + to_months(b % 12))::date as milestone, (date '1997-06-15' + to_months(b % 12 - 6))::date as origin from named),
  results as (select case_id, case when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 'research' else 'implementation' end as kind, strftime(o_orderdate, '%Y-%m') as period, p_name as t, o_custkey::varchar as actor, o_orderdate, l_orderkey, l_linenumber, p_partkey
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join cases on p_brand = case_id where o_orderdate >= date '1996-01-01' and o_orderdate < milestone + interval 1 day),
  counts as (select case_id, kind, period, count(*) as raw from results group by all),
  sampled as (select *, case_id || '/' || kind || '/' || period as g, row_number() over (partition by case_id, kind, period order by o_orderdate, l_orderkey, l_linenumber, p_partkey) as d from results qualify d <= {SAMPLED}),
  src as (select g, d, t from sampled union all select distinct g, -1, anchor from sampled join cases using (case_id)), {_tf(f"[{_WORDS[1:-2]}-]" + "{2,}", '(1 + ln(tf))')},
  cos as (select x.g, x.d, sum(x.w * y.w) as c from v x join v y on x.g = y.g and x.term = y.term and y.d = -1 where x.d <> -1 group by all),
  k as (select g, d, list_distinct(list_filter([trim(x, '-') for x in regexp_extract_all(lower(t), '[{_WORDS[1:-2]}-]+')], lambda x: length(x) >= 3)) as k from src),
  s as (select a.g, a.d, coalesce(c, 0) as c, len(list_intersect(z.k, a.k)) / len(z.k)::double as cov from k a join k z on a.g = z.g and z.d = -1 left join cos on cos.g = a.g and cos.d = a.d where a.d <> -1),
  judged as (select sampled.*, case when b % 3 = 0 then (contains(t, anchor) and contains(t, split_part(anchor, ' ', 1))) or (c >= 0.42 and cov >= 0.67) else c >= 0.16 and cov >= 0.34 end as ok from sampled join s using (g, d) join cases using (case_id)),
  met as (select case_id, kind, period, count(*) as samples, count(*) filter (ok) as matched from judged group by all),
  told as (select *, (case when matched = 0 then 0 when raw <= samples then least(raw, matched) when matched = 1 then 1 else least(raw, greatest(matched, round_even(raw * (matched / samples::double), 0)::bigint)) end)::bigint as estimated from counts join met using (case_id, kind, period)),
  actors as (select distinct case_id, period, actor from judged join met using (case_id, kind, period) where ok or matched = 0),
  days as (select case_id, profile, origin, milestone, unnest(range(1996 * 12, year(milestone) * 12 + month(milestone))) as i from cases),
  cv as (select days.*, strftime({_MONTH.format('i')}, '%Y-%m') as period, coalesce(sum(raw), 0)::bigint as raw_total, coalesce(sum(estimated) filter (kind = 'research'), 0)::bigint as research, coalesce(sum(estimated) filter (kind = 'implementation'), 0)::bigint as implementation, coalesce(sum(estimated), 0)::bigint as total
    from days left join told on told.case_id = days.case_id and told.period = strftime({_MONTH.format('i')}, '%Y-%m') group by all),
  confirmed as (select x.case_id, x.i, min(y.i) as at from cv x join cv y on x.case_id = y.case_id and y.i between x.i + 1 and x.i + 2 and y.total > 0 where x.total > 0 group by all),
  states as (select x.case_id as trend_id, x.profile, x.period, x.i as as_of_index, (select {_MONTH.format('min(f.i)')} from confirmed f where f.case_id = x.case_id and f.at <= x.i) as first_seen, max({_MONTH.format('p.i')}) filter (p.total > 0) as last_seen,
    sum(p.total)::bigint as observation_count, (select count(distinct actor) from actors a where a.case_id = x.case_id and a.period <= x.period) as actor_count, (sum(p.research) > 0)::int + (sum(p.implementation) > 0)::int as provider_count,
    count(*) filter (p.total > 0) as active_periods, {', '.join(f'coalesce(sum(p.total) filter (p.i = x.i - {k}), 0)::bigint as m{k}' for k in range(12))}, {_KINDS_SQL}
    from cv x join cv p on p.case_id = x.case_id and p.i <= x.i group by x.case_id, x.profile, x.period, x.i),
  {score_sql(now='as_of_index')}"""

QUERIES = {
    "validation_timeline": (validation_timeline, f"""with {_VALIDATED} select trend_id as case_id, period, {', '.join(f'case when first_seen is not null then {c} end as {n}' for n, c in [('score', 'round(total, 4)'), ('confidence', 'round(confidence, 4)'), ('stage', 'stage'), *((k, f'round({k}::double, 4)') for k in _PARTS)])},
      case when first_seen is null then 'no_sustained_signal_yet' end as reason from scored"""),
    "validation_summary": (validation_summary, f"""with {_VALIDATED}, useful as (select trend_id as case_id, min(as_of_index) as u from scored where first_seen is not null and round(total, 4) >= 60 and round(confidence, 4) >= 0.45 group by all),
      seen as (select case_id, milestone, min(period) filter (raw_total > 0) as first_raw, sum(case when {_MONTH.format('i')} < origin then raw_total else 0 end)::bigint as pre_origin_raw, sum(case when {_MONTH.format('i')} < origin then total else 0 end)::bigint as pre_origin, min(period) filter (total > 0) as first_active from cv group by all),
      held as (select case_id, min(i) as h from confirmed group by all)
      select seen.case_id, first_raw, pre_origin_raw, pre_origin, first_active, strftime({_MONTH.format('h')}, '%Y-%m') as first_sustained, strftime({_MONTH.format('u')}, '%Y-%m') as first_useful,
      year(milestone) * 12 + month(milestone) - 1 - u as lead_months, coalesce(year(milestone) * 12 + month(milestone) - 1 - u >= 3, false) as target_met from seen left join held using (case_id) left join useful using (case_id)"""),
}
