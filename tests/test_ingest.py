"""The store of trends, graph clusters and the small operators, against constructed rows and plain versions."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import bridge, clustering, dedup, gates, ingest, routing, state, timeline, units
from trendloom.sources import projections, segments, store

SEEN = "observation_id string, evidence_type string, provider string, artifact_kind string, event_time timestamp, unit_key string, verified boolean, actors array<string>"
CLUSTERS = "cluster_id string, profile string, direction_key string, model string, member_ids array<string>, centroid array<double>, first_seen timestamp"


def day(n):
    return datetime(2024, 1, n)


def seen(spark, *rows):
    return spark.createDataFrame([(i, t, "github", "commit", day(d), u, v, a) for i, t, d, u, v, a in rows], SEEN)


def clusters(spark, *rows):
    return spark.createDataFrame([(c, "mixed", k, "m", ids, v, day(d)) for c, k, ids, v, d in rows], CLUSTERS)


def now(n):
    return F.lit(day(n))


def test_batches_merge_and_a_replay_changes_nothing(spark):
    rows = seen(spark, ("a", "patent", 3, "u1", False, ["x"]), ("b", "research", 2, "u1", True, ["x", "y"]), ("c", "patent", 1, "u2", True, None))
    first = clusters(spark, ("c1", "k", ["a", "b"], [3.0, 4.0], 2))
    one, planned = ingest.ingest(ingest.empty(spark), first, rows, now(10))
    assert tuple(ingest.summary(planned).first()) == (1, 1, 0, 0, 0, 0, 2)
    two, planned = ingest.ingest(one, clusters(spark, ("c2", "k", ["b", "c"], [4.0, 3.0], 1)), rows, now(11))
    assert [(r.reason, r.fresh) for r in planned.collect()] == [("existing_observation", 1)]
    t = two.trends.first()
    assert (t.observation_count, t.first_seen, t.last_seen, t.created_at, t.updated_at, t.update_count) == (3, day(1), day(3), day(10), day(11), 2)
    mixed = np.array([0.6, 0.8]) * 2 + np.array([0.8, 0.6])
    assert np.allclose(t.centroid, mixed / np.linalg.norm(mixed))
    counted = {(r.kind, r.name): (r.n, r.first_at) for r in two.counters.collect()}
    assert counted[("evidence", "patent")] == (2, day(1)) and counted[("evidence", "research")] == (1, day(2))
    assert counted[("actor", "x")][0] == 2 and counted[("period", "2024-01")][0] == 3 and {("cluster", "c1"), ("cluster", "c2")} <= set(counted)
    assert {r.unit_key: r.observation_id for r in two.units.collect()} == {"u1": "b", "u2": "c"}
    three, planned = ingest.ingest(two, first, rows, now(12))
    assert [r.reason for r in planned.collect()] == ["deterministic_replay"]
    for before, after in zip(two, three, strict=True):
        assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_ingest_refuses_what_it_cannot_count(spark):
    rows = seen(spark, ("a", "patent", 3, "u1", False, []), ("b", " ", 3, "u2", False, []))
    start = ingest.empty(spark)
    for bad, message in (
        (clusters(spark, ("c1", "k", ["a", "gone"], [1.0], 3)), "missing observation"),
        (clusters(spark, ("c1", "k", ["b"], [1.0], 3)), "evidence_type"),
        (clusters(spark, ("c1", "k", ["a"], [1.0], 3), ("c2", "j", ["a"], [1.0], 3)), "two trends"),
    ):
        with pytest.raises(PySparkException, match=message):
            ingest.ingest(start, bad, rows, now(10))
    after, planned = ingest.ingest(start, clusters(spark), rows, now(10))
    assert planned.count() == 0 and all(df.count() == 0 for df in after)


def plain_ingest(batches):
    """Trends (members, observation count, centroid) by applying clusters one by one, in order of cluster_id."""
    trends, owner = {}, {}
    for batch in batches:
        snapshot = {k: t["v"] for k, t in trends.items()}
        aims = []
        for cid, key, ids, v, _ in sorted(batch):
            v = np.array(v) / np.linalg.norm(v)
            owned = {owner[i] for i in ids if i in owner}
            near = max(((float(snapshot[k] @ v), k) for k in snapshot if k[0] == key), default=(0, None))
            aims.append((ids, v, next(iter(owned)) if owned else near[1] if near[0] >= 0.82 else (key, cid)))
        for ids, v, aim in aims:
            t = trends.setdefault(aim, {"ids": set(), "n": 0, "v": None})
            new = [i for i in ids if i not in t["ids"]]
            if new:
                mixed = v if t["v"] is None else t["v"] * t["n"] + v * len(new)
                t |= {"n": t["n"] + len(new), "v": mixed / np.linalg.norm(mixed), "ids": t["ids"] | set(new)}
                owner.update(dict.fromkeys(new, aim))
    return sorted((t["n"], sorted(t["ids"]), t["v"].round(9).tolist()) for t in trends.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_clusters_count_each_member_once(spark, seed):
    rng = np.random.default_rng(seed)
    rows = seen(spark, *((f"{k}{i}", "patent", 3, f"u{k}{i}", False, []) for k in "kj" for i in range(12)))
    batches = [[("c0", "k", ["k0"], [1.0, 0.0], 1), ("d0", "j", ["j0"], [0.0, 1.0], 1)]]
    for b in (1, 2):  # clusters of a trend share its first member, and others among them
        batch = []
        for k, base in (("k", [1.0, 0.0]), ("j", [0.0, 1.0])):
            for c in range(3):
                ids = {f"{k}0"} | {f"{k}{i}" for i in rng.choice(12, 5)}
                batch.append((f"c{b}{k}{c}", k, sorted(ids), (np.array(base) + rng.random(2) * 0.3).tolist(), 2))
        batches.append(batch)
    kept = ingest.empty(spark)
    for batch in batches:
        kept, planned = ingest.ingest(kept, clusters(spark, *batch), rows, now(10))
    owned = {}
    for r in kept.ownership.collect():
        owned.setdefault(r.trend_id, []).append(r.observation_id)
    got = sorted((t.observation_count, sorted(owned[t.trend_id]), np.round(t.centroid, 9).tolist()) for t in kept.trends.collect())
    assert got == plain_ingest(batches)
    by = {r.trend_id: r.n for r in kept.counters.where("kind = 'evidence'").collect()}
    assert by == {t.trend_id: t.observation_count for t in kept.trends.collect()}


def test_a_store_of_deltas_equals_one_that_is_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    rows = seen(spark, *((f"o{i}", ("patent", "research")[i % 2], 1 + i % 20, f"u{i // 2}", i % 3 == 0, [f"a{i % 4}"]) for i in range(24)))
    path = str(tmp_path / "store")
    kept = ingest.empty(spark)
    for b in range(4):
        batch = clusters(spark, *((f"c{b}{k}", f"k{k}", [f"o{6 * k + b}", f"o{6 * k + b + 1}", f"o{6 * k}"], [1.0, 0.1 * b], 2 + b) for k in range(4 if b < 3 else 1)))
        kept, want = ingest.ingest(kept, batch, rows, now(10 + b))
        before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
        deltas = ingest.DeltaStore(spark, path)
        got = deltas.ingest(b, batch, rows, now(10 + b))
        facts = lambda df: sorted((r.cluster_id, r.trend_id, r.reason, r.fresh) for r in df.collect())
        assert facts(got) == facts(want)
        # nothing that was written is touched, and a batch writes what it changes
        assert all(p.stat().st_mtime_ns == t for p, t in before.items())
        assert spark.read.parquet(f"{path}/batch-{b:09d}/trends").count() == (4 if b < 3 else 1)
        assert spark.read.parquet(f"{path}/batch-{b:09d}/ownership").count() == sum(r.fresh for r in got.collect())
        for one, other in zip(kept, deltas.store(), strict=True):
            assert sorted(map(str, one.collect())) == sorted(map(str, other.select(one.columns).collect()))
    files = set(tmp_path.rglob("*.parquet"))
    assert facts(ingest.DeltaStore(spark, path).ingest(2, batch, rows, now(20))) != [] and set(tmp_path.rglob("*.parquet")) == files
    with pytest.raises(PySparkException, match="missing observation"):
        deltas.ingest(4, clusters(spark, ("bad", "k0", ["gone"], [1.0, 0.0], 1)), rows, now(20))
    assert deltas.segments.manifest()[0] == 3 and deltas.store().trends.count() == 4


def plain_dbscan(x, least, most):
    near = np.round(x @ x.T, 6) >= most
    core = near.sum(1) >= least
    label, cluster = [None] * len(x), 0
    for i in range(len(x)):
        if label[i] is None and core[i]:
            label[i], stack = i, [i]
            while stack:
                k = stack.pop()
                for j in np.flatnonzero(near[k]) if core[k] else []:
                    if label[j] is None:
                        label[j] = i
                        stack.append(int(j))
    return dict(enumerate(label))


def test_dbscan_against_a_plain_one(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, id long, v array<double>")
    for block in (7, 1000):
        pairs = clustering.close_pairs(df, "g", "id", "v", 0.97, block)
        near = np.round(x @ x.T, 6) >= 0.97
        assert sorted(map(tuple, pairs.collect())) == [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    got = dict(map(tuple, clustering.dbscan(df.select("id"), pairs, 3).collect()))
    assert got == plain_dbscan(x, 3, 0.97) and None in got.values()
    assert clustering.dbscan(df.select("id").limit(0), pairs.limit(0), 3).count() == 0


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 90), (90, 95)]
    got = dict(map(tuple, clustering.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(61)} | {90: 90, 95: 90, 100: 90}


def test_ranking_prefers_pure_clusters_then_fewer_leftovers(spark):
    rows = [("a", 0.5, 0.1, 0.4, 3, 0, 1), ("b", 0.6, 0.0, 0.3, 9, 2, 1), ("c", 0.5, 0.1, 0.4, 4, 1, 0), ("d", 0.5, 0.1, 0.4, 4, 0, 2)]
    df = spark.createDataFrame(rows, "run string, purity_weighted_v double, ari double, v_measure double, clusters int, noise int, singletons int")
    assert [r.run for r in clustering.ranking(df, 4).orderBy("place").collect()] == ["b", "d", "c", "a"]


def test_noise_is_no_cluster(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, None), (1, None)], "label int, cluster int")
    r = clustering.quality(df).first()
    assert (r.clusters, r.noise, r.singletons) == (2, 2, 1) and r.nmi == r.v_measure and r.homogeneity == 1.0


def test_event_observations_count_as_their_repository(spark):
    df = spark.createDataFrame([("o/r", "commit", "s1", "2024-01-01", "t", "", ["chip", "x"])], "repo string, kind string, event_id string, occurred_at string, title string, body string, matched_terms array<string>")
    o = projections.event_observations(df, "chip", "mixed", "q", "2024-02-01")
    r = o.first()
    assert (r.observation_id, r.external_id, r.text, r.source_topics) == ("github:o/r:commit:s1", "o/r:commit:s1", "t", ["chip", "x"])
    assert (r.actors[0].name, r.actors[0].kind, r.quality_flags.historical_timestamp_verified) == ("o", "organization", True)
    assert o.select(units.unit_key(F.col("provider"), F.col("artifact_kind"), F.col("observation_id"), units.repository_of(F.col("relationships"))).alias("u")).first().u == "github:repo:o/r"
    raw = store.with_raw_ref(o, "raw/x.jsonl.gz")
    assert raw.first().raw_ref == "raw/x.jsonl.gz" and store.with_raw_ref(raw, None).first().raw_ref == "raw/x.jsonl.gz" and store.with_raw_ref(o, None).first().raw_ref is None


def test_case_lookup(spark):
    cases = spark.createDataFrame([(1, "rag", "Retrieval", ["Vector search"]), (0, "gaa", "Gate all around", None)], "pos int, id string, label string, aliases array<string>")
    found = lambda asked: [r.id for r in routing.match_case(cases, asked).collect()]
    assert (found(" VECTOR "), found("what about GAA and rag?"), found(" "), found(None), found("zzz")) == (["rag"], ["gaa"], [], [], [])


def test_actors_of_accepted_samples(spark):
    samples = spark.createDataFrame([("m1", 0, ["b", "a"]), ("m1", 1, ["z"]), ("m1", 2, ["a", " "]), ("m2", 0, ["q"])], "month string, sample int, actor_keys array<string>")
    accepted = spark.createDataFrame([("m1", 0), ("m1", 2), ("m1", 9)], "month string, sample int")
    assert [tuple(r) for r in gates.accepted_actors(samples, accepted, ["month"]).collect()] == [("m1", ["a", "b"])]


def test_first_periods(spark):
    curve = spark.createDataFrame([("c", "2024-02", 0, 2), ("c", "2024-01", 0, 0), ("c", "2024-03", 5, 1)], "case_id string, period string, papers int, repos int")
    assert tuple(timeline.first_periods(curve, "case_id", ["papers", "repos"]).first()) == ("c", "2024-03", "2024-02")
    with pytest.raises(PySparkException, match="no active period"):
        timeline.first_periods(curve.where("papers = 0"), "case_id", ["papers"]).collect()


def test_activity_and_references(spark):
    df = spark.range(1).select(
        units.activity(F.create_map(*map(F.lit, ("stars", "3.9", "forks", "2", "citations", "many", "watchers", "50")))).alias("n"),
        units.references(F.array(F.struct(F.lit("o1").alias("observation_id"), F.lit("").alias("url"), F.lit(None).cast("string").alias("source_ref"), F.lit("raw").alias("raw_ref"))), F.lit(None).cast("array<struct<id:string,url:string,source_ref:string>>")).alias("refs"),
    )
    assert tuple(df.first()) == (5, ["o1", "raw"])


def test_stored_simhash_comes_first(spark):
    df = spark.createDataFrame([("ff", "a title here"), ("0xFFFFFFFFFFFFFFFF", "x"), ("none", "a title here"), (None, "a title here")], "h string, t string")
    got = [r.s for r in df.select(text.resolved_simhash(F.col("h"), F.col("t")).alias("s")).collect()]
    assert got[:2] == [255, -1] and got[2] == got[3] not in (0, 255)


def test_checks_of_identity_state_and_time(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(store.checked_provider(F.lit("open.alex-1"))) == "open.alex-1" and one(store.checked_state(F.lit('{"page": 2}'))) == '{"page": 2}'
    assert one(store.checked_time(F.lit("2024-01-01T02:00:00+02:00"))) == day(1) and one(store.checked_time(F.lit(None).cast("string"))) is not None
    for bad in (store.checked_provider(F.lit("a b")), store.checked_provider(F.lit(None).cast("string")), store.checked_key(F.lit("  ")), store.checked_state(F.lit("[1]")), store.checked_state(F.lit('{"a":')), store.checked_time(F.lit("2024-01-01T00:00:00"))):
        with pytest.raises(PySparkException):
            one(bad)


def test_settings_out_of_bounds_are_errors(spark):
    df = spark.range(0)
    for call in (lambda: dedup.fuzzy_pairs(df, jaccard=1.5), lambda: dedup.fuzzy_pairs(df, hamming=65), lambda: dedup.fuzzy_pairs(df, least=0), lambda: bridge.anchors(df, df, most=0), lambda: state.plan(df, df, df, threshold=0)):
        with pytest.raises(ValueError):
            call()
