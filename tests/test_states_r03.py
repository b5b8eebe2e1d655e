"""Evidence is read once, and a row of it is shuffled once, as it is, not as wide aggregates of it."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trendloom.operators import report, scoring, timeline

SCHEMA = "trend_id long, profile string, event_time timestamp, evidence_type string, provider string, actor string, observation_id long"
DATES = [date(2020, 1, 31), date(2021, 3, 15), date(2022, 6, 30), date(2024, 12, 31)]


def made():
    """Trends that begin at different times and have gaps of over a year, two profiles of one trend, nulls, and times that tie."""
    rng = random.Random(9)
    rows = []
    for t in range(12):
        for _ in range(rng.choice([1, 4, 40])):
            when = datetime(2018, 6, 1) + timedelta(days=rng.choice([0, 1, 30, 400, 900]) + rng.randrange(60) + 100 * t)
            rows.append((t, rng.choice(["mixed", "software_ai", None] if t == 3 else ["mixed"]), when, rng.choice(["research", "product", "adoption", None]), rng.choice(["p1", "p2", "p3", None]), rng.choice(["a", "b", "c", "d", None]), rng.randrange(30)))
    return rows + [(20, "mixed", None, "research", "p9", "z", 99)]


def plain(rows, at):
    out = {}
    for r in rows:
        if r[2] and r[2].date() <= at:
            out.setdefault(r[:2], []).append(r)
    now, month = at.year * 12 + at.month - 1, lambda r: r[2].year * 12 + r[2].month - 1
    seen = lambda g, i: len({r[i] for r in g if r[i] is not None})
    return {k: (min(r[2] for r in g), max(r[2] for r in g), len(g), seen(g, 5), seen(g, 4), len({month(r) for r in g}), [sum(now - month(r) == i for r in g) for i in range(11, -1, -1)], sum(r[3] == "product" for r in g), min((r[2] for r in g if r[3] == "product"), default=None)) for k, g in out.items()}


def told(df):
    names = ("first_seen", "last_seen", "observation_count", "actor_count", "provider_count", "active_periods", "months", "n_product", "first_product")
    return {(r.trend_id, r.profile): tuple(r[n] for n in names) for r in df.collect()}


def shuffles(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_states_of_several_dates_in_one_pass(spark):
    rows = made()
    e = spark.createDataFrame(rows, SCHEMA)
    many = scoring.states_at(e, DATES)
    for at in DATES:
        want = plain(rows, at)
        assert told(scoring.trend_states(e, at)) == want and want
        assert told(many.where(F.col("as_of_index") == at.year * 12 + at.month - 1)) == want
    assert shuffles(many) == shuffles(scoring.trend_states(e, DATES[-1])) == 1


def test_history_of_each_month_in_one_shuffle(spark):
    rows = made()
    found = scoring.prefix_states(spark.createDataFrame(rows, SCHEMA), date(2019, 11, 1), date(2022, 6, 30))
    assert shuffles(found) == 1
    found = found.localCheckpoint()
    for i in range(2019 * 12 + 10, 2022 * 12 + 6):
        at = date((i + 1) // 12, (i + 1) % 12 + 1, 1) - timedelta(days=1)
        assert told(found.where(F.col("as_of_index") == i)) == plain(rows, at)


@pytest.mark.parametrize("name", ["score_without_lookahead", "score_mature", "retrospective_scores", "retrospective_first_useful"])
def test_lines_are_read_once(spark, name):
    from trendloom import catalogue

    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_totals_by_sets(spark):
    rows = made()[:-1]
    found = timeline.monthly_totals(spark.createDataFrame(rows, SCHEMA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    # a row for each set only beyond the one shuffle
    assert shuffles(found) == 1 and "Expand" not in plan and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    want = Counter()
    for r in rows:
        at = (r[0], r[2].strftime("%Y-%m"))
        want.update([(*at, "all", None), (*at, "type", r[3]), (*at, "provider", r[4])])
    want = Counter((a, b, v if k == "type" else None, v if k == "provider" else None, n) for (a, b, k, v), n in want.items())
    assert Counter((r.trend_id, r.period, r.evidence_type, r.provider, r.n) for r in found.collect()) == want


def test_coverage_without_a_copy_for_each_count(spark):
    rows = made()
    found = timeline.coverage(spark.createDataFrame(rows, SCHEMA))
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    want = {}
    for p in {r[1] for r in rows}:
        g = [r for r in rows if r[1] == p]
        want[p] = (len({r[0] for r in g}), len({r[6] for r in g}), str(min(r[2] for r in g if r[2]).date()), ",".join(sorted({r[4] for r in g if r[4]})))
    assert {r.profile: tuple(r)[1:] for r in found.collect()} == want


def test_a_document_takes_two_looks_at_the_evidence(spark, tmp_path, monkeypatch):
    """One for all candidates and their sources, one for the fifteen chosen, whose ids reach the scan."""
    more = [F.lit("FR").alias("country"), F.lit(1).cast("long").alias("stars"), F.lit("t").alias("title"), F.lit("https://a.example").alias("canonical_url")]
    spark.createDataFrame(made(), SCHEMA).na.fill("patent", ["evidence_type"]).select("*", *more).write.parquet(f"{tmp_path}/evidence_here.parquet")
    plans, real = [], report.materialize
    monkeypatch.setattr(report, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        found = report.document(spark.read.parquet(f"{tmp_path}/evidence_here.parquet"), "x", "mixed", DATES[-1])
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    looks = [p for p in plans if "evidence_here.parquet" in p]
    assert [p.count("evidence_here.parquet") for p in looks] == [1, 1] and "PushedFilters: [In(trend_id" in looks[1]
    assert found.first().trend_count > 5
