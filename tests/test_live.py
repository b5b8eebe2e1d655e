"""The live pipeline against a plain sequential version."""

import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import bridge, clustering, live
from trendloom.operators.ingest import DeltaStore
from trendloom.sources.shared import shared_root

SEEN = "id int, observation_id string, external_id string, published_at timestamp, text string, vector array<double>, evidence_type string, provider string, artifact_kind string, event_time timestamp, unit_key string, verified boolean, actors array<string>"
EVENT = "repo string, kind string, event_id string, occurred_at timestamp, vector array<double>"
PROFILES = {p: (0.3, 0.9 if p in ("software_ai", "mixed") else 1.0) for p in clustering.PROFILES}
DAY = datetime(2024, 1, 1)


def now():
    return F.to_timestamp(F.lit("2024-06-01"))


def store_of(spark):
    return DeltaStore(spark, f"{shared_root(spark)}/trendloom/live-{uuid.uuid4().hex}")


def unit(v):
    return v / np.linalg.norm(v)


@pytest.fixture(scope="module")
def world():
    """Three directions, points around six centres, up to three events a repository, ties in time."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    seen, events = [], []
    for i in range(30):
        v = (centres[i % 6] + 0.2 * rng.normal(size=8)).tolist()
        repo = f"o/r{i:02d}" if i != 4 else "no-slash"
        seen.append((i % 3, f"x{i:02d}", repo, DAY if i == 5 else None, "same words here", v, "implementation", "github", "repository", DAY + timedelta(days=i), f"github:{repo}", False, [f"id:{i}"]))
        for n in range(i % 4):
            far = 0.2 if (i + n) % 2 else 3.0
            events.append((repo, "commit", f"{i}-{n}", datetime(2020, 1, 1) + timedelta(days=n // 2), (np.array(v) + far * rng.normal(size=8)).tolist()))
    return seen, events + [("o/unknown", "commit", "z", DAY, [1.0] * 8), (None, "commit", "y", DAY, [1.0] * 8)]


def directions(spark):
    return spark.createDataFrame([(0, "AI agent framework"), (1, "gene editing therapy"), (2, "bridges"), (9, "quantum processor chip")], "id int, direction string")


def test_equals_a_plain_run_and_a_rerun_changes_nothing(spark, world):
    seen, events = world
    store = store_of(spark)
    args = directions(spark), spark.createDataFrame(seen, SEEN), spark.createDataFrame(events, EVENT), now()
    policy = bridge.Policy(2, 0.8)
    out = live.run(store, 0, *args, policy=policy, profiles=PROFILES)

    profile = ["software_ai", "bio_medtech", "mixed"]
    want = {p: [0] * 6 for p in PROFILES}
    trends, checks = [], set()
    for d in range(3):
        mine = [s for s in seen if s[0] == d]
        x = np.array([unit(np.array(s[5])) for s in mine])
        near = x @ x.T if profile[d] == "bio_medtech" else 0.9 * (x @ x.T) + 0.1
        label = clustering.average_link(1 - near, 0.3)
        total = want[profile[d]]
        total[0] += len(mine)
        for c in sorted(set(label.tolist())):
            rows = [m for m, own in zip(mine, label, strict=True) if own == c]
            total[1] += 1
            centre, n, first = unit(np.mean([r[5] for r in rows], axis=0)), len(rows), min(r[9] for r in rows)
            moved = []
            for r in [r for r in sorted(rows, key=lambda r: r[1]) if r[3] is None and r[2].count("/") == 1][:2]:
                total[2] += 1
                found = sorted((e for e in events if e[0] == r[2]), key=lambda e: (e[3], e[1], e[2]))
                if not found:
                    checks.add((r[2], None, live.NO_EVENT))
                    continue
                total[3] += 1
                ok = float(unit(np.array(found[0][4])) @ centre) >= 0.8
                total[4 if ok else 5] += 1
                checks.add((r[2], f"github:{r[2]}:commit:{found[0][2]}", live.ACCEPTED if ok else live.REJECTED))
                if ok:
                    moved.append(found[0])
            trends.append((profile[d], n + len(moved), min([first, *(e[3] for e in moved)]), 1 + len(moved)))

    got = {r.profile: r for r in out.summary.collect()}
    assert {p: [got[p][i + 1] for i in range(6)] for p in PROFILES} == want
    assert min(want["software_ai"]) >= 1 and want["bio_medtech"][4] + want["mixed"][5] >= 2
    assert {(r.repo, r.event_id, r.decision) for r in out.checks.collect()} == checks
    state = lambda t: sorted((r.profile, r.observation_count, r.first_seen, r.update_count) for r in t.collect())
    assert state(out.trends) == sorted(trends)
    accepted = sum(v[4] for v in want.values())
    assert out.observations.count() == len(seen) + accepted == store.store().ownership.count()

    before = sorted(map(repr, store.store().trends.collect()))
    live.run(store, 0, *args, policy=policy, profiles=PROFILES)
    assert sorted(map(repr, store.store().trends.collect())) == before


def test_local_gate_takes_the_earliest_eligible_event(spark):
    """Text and the direction's vector decide; of two that fit the later one is kept for information alone."""
    d = spark.createDataFrame([(0, "Low-rank adaptation for language models", [1.0, 0.0])], "id int, direction string, direction_vector array<double>")
    row = lambda i, repo: (0, f"x{i}", repo, None, "", [1.0, 0.1 * i], "implementation", "github", "repository", DAY, f"github:{repo}", False, [])
    seen = spark.createDataFrame([row(0, "o/a"), row(1, "o/b")], SEEN)
    said = "Add LoRA fine-tuning for LLM adapters"
    events = [
        ("o/a", "commit", "1", DAY, [1.0, 0.0], "Fix LoRaWAN gateway", "Fix lora radio gateway config", None),
        ("o/a", "commit", "2", DAY + timedelta(1), [1.0, 0.1], said, "", None), ("o/a", "commit", "3", DAY + timedelta(2), [1.0, 0.0], said, "", None),
        ("o/b", "commit", "4", DAY, [0.0, 1.0], said, "", None),
    ]
    e = spark.createDataFrame(events, EVENT + ", title string, text string, source_diff string")
    one = {p: (0.9, 1.0) for p in PROFILES}
    out = live.run(store_of(spark), 0, d, seen, e, now(), policy=bridge.Policy(3, 0.82, 0.5), profiles=one)
    assert {(r.event_id[-1], r.selection, r.decision) for r in out.checks.collect()} == {("1", "rejected", live.REJECTED), ("2", "accepted", live.ACCEPTED), ("3", "later_supporting", live.REJECTED), ("4", "rejected", live.REJECTED)}


def test_empty_tables(spark):
    none = lambda shape: spark.createDataFrame([], shape)
    out = live.run(store_of(spark), 0, none("id int, direction string"), none(SEEN), none(EVENT), now())
    assert all(r[i] == 0 for r in out.summary.collect() for i in range(1, 7)) and out.summary.count() == 5
    assert out.trends.isEmpty() and out.checks.isEmpty() and out.observations.isEmpty()


def test_what_is_refused(spark, world):
    seen, events = world
    routes = spark.createDataFrame([("software_ai", "github", True), ("mixed", "github", False), ("bio_medtech", "other", True)], "profile string, provider string, enabled boolean")
    with pytest.raises(Exception, match="discovery disabled for profile"):
        live.routed(directions(spark), routes).collect()
    for bad in (bridge.Policy(0), bridge.Policy(1, 0.0), bridge.Policy(1, 1.5), bridge.Policy(1, 0.5, 0.0)):
        with pytest.raises(ValueError):
            bad.checked()
    one = {p: (0.3, 1.0) for p in PROFILES}
    some = directions(spark), spark.createDataFrame(seen[:4], SEEN)
    for event, told in (((seen[1][2], "commit", "f", datetime(2030, 1, 1), [1.0] * 8), "event from the future"), ((seen[1][2], "commit", "f", DAY, [1.0] * 3), "invalid vector of an event")):
        with pytest.raises(Exception, match=told):
            live.run(store_of(spark), 0, *some, spark.createDataFrame([event], EVENT), now(), profiles=one)
