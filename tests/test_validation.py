"""Retrospective validation against a plain sequential run, case by case and month by month."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from trendloom.operators import gates, validation

CASE = "case_id string, profile string, start date, origin date, milestone date, anchor string, aliases array<string>, context array<string>"
COUNT = "case_id string, evidence_type string, period string, raw long"
SAMPLE = "case_id string, evidence_type string, period string, sample_id long, text string, actor string"
ANCHOR = "solid state battery"


def months(start, milestone):
    i, last = start.year * 12 + start.month - 1, milestone.year * 12 + milestone.month - 1
    return [f"{k // 12}-{k % 12 + 1:02d}" for k in range(i, last + 1)]


def index(period):
    return int(period[:4]) * 12 + int(period[5:]) - 1


def plain_estimate(raw, n, hits):
    if not raw or not n or not hits:
        return 0
    if raw <= n:
        return min(raw, hits)
    return 1 if hits == 1 else min(raw, max(hits, round(raw * (hits / n))))


def plain_run(case, counts, samples):
    """Each month's state from its own prefix alone: (period, sustained, last, total, actors, active, research, implementation)."""
    curve, actors_at = [], []
    for p in months(case[2], case[4]):
        row, actors = {"raw": 0}, set()
        for kind in ("research", "implementation"):
            raw = counts.get((case[0], kind, p), 0)
            mine = samples.get((case[0], kind, p), [])
            good = [(t, a) for t, a in mine if ANCHOR in t]
            row["raw"] += raw
            row[kind] = plain_estimate(raw, len(mine), len(good))
            actors |= {a for _, a in (good or mine) if a and a.strip()}
        curve.append((p, row))
        actors_at.append(actors)
    out = []
    for end in range(1, len(curve) + 1):
        totals = [r["research"] + r["implementation"] for _, r in curve[:end]]
        held = next((curve[i][0] for i, n in enumerate(totals) if n and sum(x > 0 for x in totals[i : i + 3]) >= 2), None)
        active = [p for (p, _), n in zip(curve, totals) if n]
        out.append((curve[end - 1][0], held, active[-1] if active else None, sum(totals), len(set().union(*actors_at[:end])), len(active), sum(r["research"] for _, r in curve[:end]), sum(r["implementation"] for _, r in curve[:end]), totals[-12:]))
    return curve, out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    cases = [(f"c{i}|{i}", "materials_energy", date(2020, 1, 15), date(2021, 1 + i, 10), date(2021, 6 + i, 20), ANCHOR, [ANCHOR], ["battery"]) for i in range(3)]
    cases.append(("silent", "mixed", date(2020, 1, 1), date(2020, 6, 1), date(2020, 12, 31), ANCHOR, [ANCHOR], []))
    counts, samples = {}, {}
    for c in cases[:3]:
        for p in months(c[2], c[4]):
            for kind in ("research", "implementation"):
                if rng.random() < 0.6:
                    n = rng.randint(1, 4)
                    counts[c[0], kind, p] = n if rng.random() < 0.3 else rng.randint(n, 40)
                    texts = [rng.choice([f"A {ANCHOR} cell", "metal bridge works", "zinc pump", ""]) for _ in range(n)]
                    samples[c[0], kind, p] = [(t, rng.choice(["ann", "bob", "cy", "dee", " ", None])) for t in texts]
    counts["silent", "research", "2020-03"] = 5
    c = spark.createDataFrame(cases, CASE)
    n = spark.createDataFrame([(*k, v) for k, v in counts.items()], COUNT)
    s = spark.createDataFrame([(*k, i, t, a) for k, v in samples.items() for i, (t, a) in enumerate(v)], SAMPLE)
    return cases, counts, samples, c, n, s


def test_states_equal_a_plain_run(made):
    cases, counts, samples, c, n, s = made
    gated, actors = validation.gated_months(c, n, s)
    got = {(r.trend_id, r.period): r for r in validation.prefix_states(validation.curve(c, gated), actors).collect()}
    assert len(got) == sum(len(months(x[2], x[4])) for x in cases)
    for case in cases:
        for p, held, last, total, people, active, research, implementation, window in plain_run(case, counts, samples)[1]:
            r = got[case[0], p]
            assert (r.first_seen and r.first_seen.strftime("%Y-%m"), r.last_seen and r.last_seen.strftime("%Y-%m")) == (held, last)
            assert (r.observation_count, r.actor_count, r.active_periods, r.n_research, r.n_implementation) == (total, people, active, research, implementation)
            assert list(r.months) == [0] * (12 - len(window)) + window
            assert r.provider_count == (research > 0) + (implementation > 0)


def test_summary(made):
    cases, counts, samples, c, n, s = made
    found, scores = validation.validate(c, n, s)
    scores = {(r.case_id, r.period): r for r in scores.collect()}
    for r in found.collect():
        case = next(x for x in cases if x[0] == r.case_id)
        curve, states = plain_run(case, counts, samples)
        total = lambda row: row["research"] + row["implementation"]
        before = [row for p, row in curve if date(int(p[:4]), int(p[5:]), 1) < case[3]]
        assert (r.pre_origin_raw, r.pre_origin) == (sum(x["raw"] for x in before), sum(map(total, before)))
        assert r.first_raw == next((p for p, x in curve if x["raw"]), None)
        assert r.first_active == next((p for p, x in curve if total(x)), None)
        assert r.first_sustained == states[-1][1]
        for p, held, *_ in states:
            told = scores[case[0], p]
            assert (told.score is None) == (held is None) == (told.reason == "no_sustained_signal_yet")
        useful = next((p for p, *_ in states if (scores[case[0], p].score or 0) >= 60 and scores[case[0], p].confidence >= 0.45), None)
        lead = useful and case[4].year * 12 + case[4].month - 1 - index(useful)
        assert (r.first_useful, r.lead_months, r.target_met) == (useful, lead, lead is not None and lead >= 3)
    assert {r.case_id for r in found.collect()} == {x[0] for x in cases}


def test_nothing_ahead_changes_a_month(made):
    """Leaving out all that comes after a month leaves its row as it was."""
    _, _, _, c, n, s = made
    at = "2020-09"
    rows = lambda df: sorted(map(tuple, df.where(F.col("period") <= at).collect()), key=repr)
    whole = validation.validate(c, n, s)[1]
    cut = validation.validate(c, n.where(F.col("period") <= at), s.where(F.col("period") <= at))[1]
    assert rows(whole) == rows(cut)


def test_empty(spark):
    e = [spark.createDataFrame([], x) for x in (CASE, COUNT, SAMPLE)]
    found, scores = validation.validate(*e)
    assert found.collect() == [] and scores.collect() == []


def test_gate_leaves_one_match_alone(spark):
    raw = spark.createDataFrame([(100, 15, 1, 1), (100, 15, 3, 20), (10, 15, 4, 4), (0, 0, 0, 0)], "raw long, n long, m long, want long")
    assert all(r.got == r.want for r in raw.withColumn("got", gates.estimate(F.col("raw"), F.col("n"), F.col("m"))).collect())
