"""Golden scenarios of single operators."""

import hashlib
import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.functions import scalars, text, vectors
from trendloom.operators import clustering, dedup, gates, metrics, routing, scoring, state, units
from trendloom.sources import projections, specs, store
from trendloom.sources.pages import PageSource
from trendloom.streaming import collect


def one(df):
    return df.collect()[0]


def test_text_normal_forms(spark):
    df = spark.createDataFrame([("Straße-Test_Ａ  x", "https://Doi.org/10.1234/Ab. ", "HTTPS://Ex.org/Chip/?item=42&utm_source=n&ref=1#top")], "a string, d string, u string")
    r = one(df.select(text.normalise(F.col("a")).alias("a"), text.normalise_doi(F.col("d")).alias("d"), text.normalise_url(F.col("u")).alias("u"), text.normalise_doi(F.lit("11.1/x")).alias("no")))
    assert (r.a, r.d, r.u, r.no) == ("strasse test a x", "10.1234/ab", "https://ex.org/Chip?item=42", None)


def test_simhash_of_nothing_and_of_one(spark):
    r = one(spark.range(1).select(text.simhash(F.array().cast("array<bigint>")).alias("none"), text.simhash(F.array(F.lit(5).cast("bigint"))).alias("one"), text.hamming(F.lit(5).cast("bigint"), F.lit(6).cast("bigint")).alias("d")))
    assert (r.none, r.one, r.d) == (0, 5, 2)


def test_jaccard_of_empty_sets_is_one(spark):
    e = F.array().cast("array<string>")
    assert one(spark.range(1).select(text.jaccard(e, e).alias("j"))).j == 1.0


def evidence(spark, rows):
    shape = "trend_id int, profile string, event_time timestamp, evidence_type string, provider string, actor string"
    return spark.createDataFrame(rows, shape)


def months(counts, end=(2026, 8)):
    index = end[0] * 12 + end[1] - 1 - len(counts) + 1
    return [datetime((index + i) // 12, (index + i) % 12 + 1, 10) for i, n in enumerate(counts) for _ in range(n)]


def test_accelerating_trend_is_emerging_and_a_spike_is_weak(spark):
    kinds = ("research", "patent", "implementation", "analysis")
    rows = [(1, "hardware_semiconductor", t, kinds[i % 4], f"p{i % 3}", f"a{i}") for i, t in enumerate(months([1, 1, 2, 3, 5, 8]))]
    rows += [(2, "hardware_semiconductor", t, "research", "p", "a") for t in months([20])]
    at = date(2026, 8, 29)
    got = {r.trend_id: r for r in scoring.scored(scoring.trend_states(evidence(spark, rows), at), at).collect()}
    assert got[1].total > 75 and got[1].confidence > 0.75 and got[1].stage == "emerging" and got[1].maturity == 0
    assert got[2].total < 60 and got[2].confidence < 0.55 and got[2].stage == "weak_signal" and got[2].research_only


def test_old_trends_pay_for_maturity(spark):
    rows = [(1, "mixed", t, "product", "p", f"a{i}") for i, t in enumerate(months([2] * 120))]
    at = date(2026, 8, 29)
    r = one(scoring.scored(scoring.trend_states(evidence(spark, rows), at), at))
    assert r.maturity > 60 and r.stage != "emerging"


def test_prefix_states_equal_states_at_each_date(spark):
    rows = [(i % 3, "mixed", t, ("research", "patent")[i % 2], f"p{i % 2}", f"a{i % 5}") for i, t in enumerate(months([1, 0, 2, 0, 3, 1, 4]))]
    e = evidence(spark, rows)
    many = {(r.trend_id, r.as_of_index): r for r in scoring.scored(scoring.prefix_states(e, date(2026, 4, 1), date(2026, 8, 31)), None).collect()}
    for at in (date(2026, 5, 31), date(2026, 8, 31)):
        for r in scoring.scored(scoring.trend_states(e, at), at).collect():
            m = many[r.trend_id, at.year * 12 + at.month - 1]
            assert m.total == pytest.approx(r.total) and m.confidence == pytest.approx(r.confidence) and m.stage == r.stage


def test_any_number_of_commits_is_one_unit(spark):
    rows = [(1, "r", f"o{i}", i > 0, datetime(2026, 1, 1 + i)) for i in range(6)]
    df = spark.createDataFrame(rows, "trend_id int, unit_key string, observation_id string, verified boolean, event_time timestamp")
    assert [r.observation_id for r in units.representatives(df).collect()] == ["o1"]


def test_unlinked_git_event_is_an_error(spark):
    df = spark.createDataFrame([("github", "commit", "o1", None)], "p string, k string, o string, r string")
    with pytest.raises(Exception, match="no repository"):
        df.select(units.unit_key(*(F.col(c) for c in "pkor"))).collect()


def test_exact_dedup_tries_keys_in_order(spark):
    rows = [("a", 1, ["doi:1"]), ("b", 2, ["url:x", "doi:1"]), ("c", 3, ["url:x"])]
    got = dedup.exact_matches(spark.createDataFrame(rows, "id string, seq int, keys array<string>"), "id", "keys", "seq")
    assert {r.id: r.duplicate_of for r in got.collect()} == {"b": "a", "c": "b"}


def test_greedy_resolution_is_not_transitive(spark):
    nodes = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3), ("D", 4)], "id string, seq int")
    edges = spark.createDataFrame([("A", "B", "fuzzy_title", 0.9), ("B", "C", "fuzzy_title", 0.9), ("A", "D", "fuzzy_title", 0.99), ("C", "D", "exact", 1.0)], "a string, b string, reason string, similarity double")
    got = {r.id: (r.unique, r.duplicate_of, r.reason) for r in dedup.resolve(nodes, edges).collect()}
    assert got == {"A": (True, None, None), "B": (False, "A", "fuzzy_title"), "C": (True, None, None), "D": (False, "C", "exact")}


def test_fuzzy_pairs_need_actors_that_meet(spark):
    t = [f"t{i}" for i in range(9)]
    rows = [(1, "x", t, 7, ["p"]), (2, "x", t, 7, ["q"]), (3, "x", t, 7, []), (4, "y", t, 7, ["p"]), (5, "x", t[:8], 7, ["p"])]
    got = dedup.fuzzy_pairs(spark.createDataFrame(rows, "id int, block string, tokens array<string>, simhash bigint, actors array<string>"))
    assert {(r.a, r.b) for r in got.collect()} == {(1, 3), (2, 3), (1, 5), (3, 5)}


def test_routing(spark):
    rows = [(1, "AI agent framework"), (2, "solid-state battery electrolyte"), (3, "maintenance of bridges"), (4, "AI drug discovery protein software"), (5, "ии для врачей")]
    got = {r.id: r for r in routing.classify(spark.createDataFrame(rows, "id int, direction string"), routing.signals(spark)).collect()}
    assert got[1].profile == "software_ai" and got[2].profile == "materials_energy" and got[5].profile == "software_ai"
    assert (got[3].profile, got[3].confidence, got[3].matched) == ("mixed", 0.25, [])
    assert got[4].profile == "mixed" and got[4].confidence == 0.55 and "drug discovery" in got[4].matched


def test_unknown_provider_is_an_error(spark):
    policies = spark.createDataFrame([("p", "nobody", True, None, 0.5)], "profile string, provider string, enabled boolean, role string, collection_priority double")
    providers = spark.createDataFrame([("known", "research", None, None)], "provider string, evidence_type string, default_role string, execution_status string")
    with pytest.raises(Exception, match="unknown provider"):
        routing.routes(policies, providers).collect()


def test_event_gate(spark):
    d = "Low-rank adaptation for language models"
    rows = [(1, d, "Add LoRA fine-tuning for LLM adapters", "", None), (2, d, "Fix LoRaWAN gateway", "Fix lora radio gateway config", None), (3, "Bridges", "Add steel", "", None), (4, d, "wip", "GIT_PATCH_ADDED_LINES\nadd lora support for llm", None), (5, d, "wip", "wip", "FILE peft/lora.py\n+class LoraConfig:")]
    got = {r.id: (r.status, r.reason) for r in gates.event_gate(spark.createDataFrame(rows, "id int, direction string, title string, text string, source_diff string")).collect()}
    assert got[1][0] == "eligible" and got[2][0] == "rejected" and got[3] == ("review_required", "no_calibrated_family_policy")
    assert got[4][0] == "rejected" and got[5] == ("eligible", "same_sha_executable_lora_code")


def test_source_patch_takes_added_code_only(spark):
    files = [("src/lora.py", "+# lora\n+lora = 1\n-lora = 2\n+++ b\n+x = 1"), ("tests/test_lora.py", "+lora = 1"), ("README.md", "+lora")]
    df = spark.createDataFrame([(files,)], "files array<struct<filename:string,patch:string>>")
    assert one(df.select(gates.source_patch(F.col("files")).alias("p"))).p == "FILE src/lora.py\n+lora = 1"


def test_sample_gate(spark):
    cases = spark.createDataFrame([("c", "low rank adaptation of large language models", ["lora"], ["language model"])], "case_id string, anchor string, aliases array<string>, context array<string>")
    samples = spark.createDataFrame([("c", 1, "LoRA for a language model"), ("c", 2, "LoRa radio network"), ("c", 3, "low rank adaptation of large language models")], "case_id string, sample_id int, text string")
    got = {r.sample_id: (r.accepted, r.cosine) for r in gates.sample_gate(cases, samples).collect()}
    assert [got[i][0] for i in (1, 2, 3)] == [True, False, True] and got[3][1] == pytest.approx(1.0)


def test_average_link_merges_strictly_below_the_threshold():
    d = np.array([[0, 0.4, 1], [0.4, 0, 1], [1, 1, 0.0]])
    assert len(set(clustering.average_link(d, 0.4))) == 3 and len(set(clustering.average_link(d, 0.41))) == 2


def test_microclusters_and_quality(spark):
    rows = [("b", i, [1.0, 0.01 * i], 0) for i in range(4)] + [("b", 10 + i, [0.01 * i, 1.0], 1) for i in range(4)]
    df = spark.createDataFrame(rows, "block string, id int, v array<double>, label int")
    found = clustering.microclusters(df, "block", "id", "v", 0.3)
    q = one(clustering.quality(found.join(df, "id")))
    assert (q.clusters, q.ari, q.v_measure) == (2, 1.0, 1.0)


def test_ingest_plan_and_running_centroid(spark):
    day = datetime(2026, 1, 1)
    clusters = spark.createDataFrame(
        [("c1", "p", "d", "m", ["o1", "o2"], [1.0, 0.0], day), ("c2", "p", "d", "m", ["o9"], [0.99, 0.1], day), ("c3", "p", "d", "m", ["o8"], [0.0, 1.0], day), ("c4", "p", "d", "m", ["o1"], [1.0, 0.0], day)],
        "cluster_id string, profile string, direction_key string, model string, member_ids array<string>, centroid array<double>, first_seen timestamp",
    )
    states = spark.createDataFrame([("t1", "p", "d", "m", [1.0, 0.0], day, 1)], "trend_id string, profile string, direction_key string, model string, centroid array<double>, created_at timestamp, observation_count long")
    owned = spark.createDataFrame([("o1", "t1")], "observation_id string, trend_id string")
    planned = state.plan(clusters, states, owned)
    got = {r.cluster_id: (r.reason, r.trend_id) for r in planned.collect()}
    assert got["c1"] == ("existing_observation", "t1") and got["c2"] == ("centroid", "t1") and got["c4"] == ("deterministic_replay", "t1")
    assert got["c3"][0] == "new" and got["c3"][1].startswith("trend:p:")
    c = {r.trend_id: r for r in state.applied_centroids(planned, states).collect()}["t1"]
    want = np.array([2.0, 0.0]) + np.array([0.99, 0.1]) / np.hypot(0.99, 0.1)
    assert c.n == 3 and np.allclose(c.centroid, want / np.linalg.norm(want))


def test_cluster_that_bridges_two_trends_is_an_error(spark):
    clusters = spark.createDataFrame([("c", ["a", "b"])], "cluster_id string, member_ids array<string>")
    owned = spark.createDataFrame([("a", "t1"), ("b", "t2")], "observation_id string, trend_id string")
    with pytest.raises(Exception, match="bridges"):
        state.owners(clusters, owned).collect()


def test_retrieval_counts_all_queries_for_hard_negatives(spark):
    rows = [(1, 1, 0.9, True, False), (1, 2, 0.1, False, True), (2, 1, 0.9, True, False)]
    r = one(metrics.retrieval(metrics.ranked(spark.createDataFrame(rows, "query_id int, doc_id int, similarity double, relevant boolean, hard boolean")), []))
    assert (r.recall_at_1, r.mrr, r.hard_negative_win_rate) == (1.0, 1.0, 0.5)


def test_vectors_that_are_invalid_are_rejected(spark):
    rows = [(1, "g", [1.0, 0.0]), (2, "g", [0.0, 0.0]), (3, "g", [float("nan"), 1.0])]
    centroid = spark.createDataFrame([("g", [1.0, 0.0])], "g string, centroid array<double>")
    got = gates.vector_gate(spark.createDataFrame(rows, "id int, g string, vector array<double>"), centroid, "g")
    assert {r.id: r.accepted for r in got.collect()} == {1: True, 2: False, 3: False}
    assert one(spark.range(1).select(vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("v"))).v == pytest.approx([0.6, 0.8])


def test_work_projection(spark):
    work = {"id": "https://x.org/W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2024, "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0, 2]},
            "authorships": [{"author": {"id": "x/A1", "display_name": "N"}, "institutions": [{"id": "x/I1", "display_name": "U", "country_code": "DE"}]}] * 2}
    df = spark.read.schema(projections.WORK).json(spark.sparkContext.parallelize([json.dumps(work)]))
    r = one(projections.work_observations(df, "2026-01-01T00:00:00Z"))
    assert (r.observation_id, r.canonical_url, r.text, r.published_at) == ("openalex:W1", "https://doi.org/10.1/a", "a b a", "2024-01-01")
    assert [a.external_id for a in r.actors] == ["A1", "I1"] and r.metrics == {"cited_by_count": "3"}
    assert projections.contract(projections.work_observations(df, "never")).collect()[0].violations == ["observed_at is no time"]


def test_repositories_are_distinct_before_the_filter(spark):
    rows = [("o/a", True, False, 1, 1), ("o/a", False, False, 2, 1), ("o/b", False, False, 1, 2)]
    df = spark.createDataFrame(rows, "full_name string, fork boolean, archived boolean, page int, pos int").selectExpr("*", "'u' as html_url", "'d' as description", "'en' as language", "array('x','x') as topics", "'-3' as stargazers_count", "null as forks_count", "'NOASSERTION' as license")
    got = projections.repository_observations(df, "2026-01-01").collect()
    assert [r.external_id for r in got] == ["o/b"] and got[0].published_at is None and got[0].metrics["stars"] == "0" and got[0].license is None


def test_patents_and_unsafe_xml(spark):
    good = '<r xmlns="u"><exchange-document country="EP" doc-number="12" kind="A1"><publication-reference><document-id><date>20240305</date></document-id></publication-reference><invention-title lang="de">Ding</invention-title><invention-title lang="en">Thing</invention-title><applicant><name>Acme</name></applicant><applicant><name>Acme</name></applicant></exchange-document></r>'
    df = spark.createDataFrame([(good,), ("<!DOCTYPE x>" + good,)], "xml string")
    got = projections.patent_observations(df).collect()
    assert len(got) == 1 and (got[0].observation_id, got[0].title, got[0].published_at, got[0].applicants) == ("epo_ops:EP12A1", "Thing", "2024-03-05", ["Acme"])


def test_narrative_check(spark):
    full = dict.fromkeys(("problem", "advantage", "description", "name", "case_example", "limitations"), "x")
    rows = [("a", json.dumps(full | {"source_refs": ["s1"]}), ["s1"]), ("b", json.dumps(full | {"source_refs": ["s2"]}), ["s1"]), ("c", json.dumps(full | {"name": " ", "source_refs": ["s1"]}), ["s1"])]
    got = {r.trend_id: r.problem for r in projections.narrative_check(spark.createDataFrame(rows, "trend_id string, content string, allowed_refs array<string>")).collect()}
    assert got == {"a": None, "b": "unknown source", "c": "a field is empty"}


def test_git_events(spark):
    commits = spark.createDataFrame([("r", "s1", "Add lora", "2024-02-01", None), ("r", "s2", "other", "2024-01-01", None), ("r", "s1", "Add lora", "2024-02-01", None)], "repo string, sha string, message string, committed_at string, authored_at string")
    releases = spark.createDataFrame([("r", 1, "lora v1", "t", "", "2024-01-15", "u", False), ("r", 2, "lora v2", "t", "", "2023-01-15", "u", True)], "repo string, release_id int, name string, tag string, body string, published_at string, html_url string, draft boolean")
    pool = projections.git_events(commits, releases, F.array(F.lit("LoRA")))
    assert [(r.kind, r.event_id) for r in pool.orderBy("place").collect()] == [("release", "1"), ("commit", "s1")]
    assert one(projections.earliest_events(pool)).event_id == "1"


def test_times(spark):
    r = one(spark.range(1).select(scalars.canonical_time(F.lit("2024-01-02")).alias("d"), scalars.strict_zoned_time(F.lit("2024-01-02T03:04:05")).alias("n"), scalars.strict_zoned_time(F.lit("2024-01-02T03:04:05Z")).alias("z"), scalars.canonical_time(F.lit("never")).alias("x")))
    assert (r.d, r.n, r.z, r.x) == (datetime(2024, 1, 2), None, datetime(2024, 1, 2, 3, 4, 5), None)


def test_collection_resumes_and_replays_to_the_same_store(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()

    def page(n, ids):
        (pages / f"page-{n}.jsonl").write_text("".join(json.dumps({"observation_id": i, "n": n}) + "\n" for i in ids))

    spark.dataSource.register(PageSource)
    page(1, ["a", "b"])
    assert spark.read.format("trendloom_pages").option("path", str(pages)).load().count() == 2
    run = lambda: collect.collect_pages(spark.readStream.format("trendloom_pages").option("path", str(pages)).load(), str(tmp_path / "raw"), str(tmp_path / "store"), str(tmp_path / "cp"))
    run()
    page(2, ["b", "c"])
    run()
    run()
    got = {r.observation_id: r.page for r in collect.current(spark, str(tmp_path / "store")).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}


def test_monthly_state_takes_late_rows_once(spark, tmp_path):
    shape = "trend_id int, observation_id string, event_time timestamp"
    src = str(tmp_path / "in")
    for rows in ([(1, "a", datetime(2024, 3, 1))], [(1, "a", datetime(2024, 3, 1)), (1, "b", datetime(2023, 1, 1))]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(src)
        collect.monthly_state(spark.readStream.schema(shape).parquet(src), str(tmp_path / "st"), str(tmp_path / "cp"))
    got = collect.current(spark, str(tmp_path / "st")).groupBy("period").count().collect()
    assert {r.period: r["count"] for r in got} == {"2024-03": 1, "2023-01": 1}


def test_tumbling_counts_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([(datetime(2024, 1, 1, 1), "view"), (datetime(2024, 1, 1, 2), "view"), (datetime(2024, 1, 3), "view")], "ts timestamp, event_type string").write.parquet(src)
    q = collect.tumbling_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(src)).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("tumbling").collect()) == [1, 2]


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("o1", "d1", "2024-01-01"), ("o2", "d2", "2024-01-02")], "observation_id string, technology_direction string, published_at string")
    store.write_store(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert one(store.get(back, "o2")).technology_direction == "d2"
    store.write_raw(rows, str(tmp_path / "raw"), "p", F.to_date("published_at"))
    assert sum(r.record_count for r in store.manifest(spark.read.json(str(tmp_path / "raw"))).collect()) == 2
    with pytest.raises(ValueError):
        store.list_observations(back, limit=0)


def test_query_specs(spark):
    shape = "technology_direction string, source_profile string, from_date date, to_date date, query_text string, query_id string, per_page int, max_pages int, extra_filters array<string>"
    rows = [("AI", "p", date(2024, 1, 1), date(2024, 2, 1), None, None, 100, 1, ["a:b"]), (" ", "p", date(2024, 3, 1), date(2024, 2, 1), None, "x", 500, 0, [])]
    good, bad = specs.works(spark.createDataFrame(rows, shape)).collect()
    assert good.violations == [] and good.effective_id == "openalex:" + hashlib.sha1(b"ai|p|2024-01-01|2024-02-01|ai|a:b").hexdigest()[:12]
    assert good.filter == "from_publication_date:2024-01-01,to_publication_date:2024-02-01,a:b"
    assert bad.violations == ["technology_direction", "dates", "per_page", "max_pages"] and bad.effective_id == "x"
    h = spark.createDataFrame([("o/n", "d", "p", ["a"], []), ("on", "d", "p", [" "], [])], "repository string, technology_direction string, source_profile string, aliases array<string>, distinctive_terms array<string>")
    assert [r.violations for r in specs.histories(h).collect()] == [[], ["repository", "terms"]]
    e = spark.createDataFrame([("D", "p", "ti=x", None, 25, 2), ("D", "p", "a\nb", None, 26, 21)], "technology_direction string, source_profile string, cql string, query_id string, per_page int, max_pages int")
    assert [r.violations for r in specs.patents(e).collect()] == [[], ["cql", "per_page", "max_pages"]]


def test_events_from_the_future_are_errors(spark):
    from trendloom.operators import bridge

    df = spark.createDataFrame([(1, "r", "o", datetime(2030, 1, 1), True, datetime(2026, 1, 1))], "trend_id int, repository string, observation_id string, published_at timestamp, eligible boolean, observed_at timestamp")
    with pytest.raises(Exception, match="future"):
        bridge.labelled(df).collect()


def test_materialized_tables_can_be_removed(spark):
    from trendloom.sources import shared

    df = shared.materialize(spark.range(3), "x")
    assert df.count() == 3
    files = df.inputFiles()
    shared.clean_up(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
