"""The answer's document: what is told of candidates that are skipped, of few candidates and of none."""

import json
from datetime import date, datetime

import pytest

from trendloom.operators import report

SCHEMA = "trend_id long, profile string, observation_id long, evidence_type string, provider string, actor string, country string, event_time timestamp, stars long, title string, canonical_url string"
AS_OF = date(2024, 6, 30)


def line(trend, i, profile="software_ai", kind="research", url="https://a.example/x", provider="p1", country="FR", day=3):
    return (trend, profile, trend * 100 + i, kind, provider, f"actor{i}", country, datetime(2024, 1 + i % 6, day), i, "a title", url)


def told(spark, rows, **more):
    r = report.document(spark.createDataFrame(rows, SCHEMA), "  direction ", "software_ai", AS_OF, **more).collect()
    assert len(r) == 1
    return r[0], json.loads(r[0].document)


def test_each_skip_is_counted_and_named(spark):
    rows = [line(1, i, kind="adoption") for i in range(6)] + [line(2, i) for i in range(3)]
    rows += [line(3, 1, profile="mixed"), line(4, 1, profile=None), line(5, 1, url=None), line(6, 1, url="  ")]
    r, d = told(spark, rows)
    assert (r.status, r.trend_count) == ("partial", 2)
    s = d["summary"]
    assert s["candidate_count"] == 6 and s["observation_count"] == 9 and s["providers_used"] == ["p1"]
    assert [w.split(" ")[0] for w in s["warnings"]] == ["2", "2", "1", "Only"]
    assert [t["trend_id"] for t in d["trends"]] == [1, 2] and [t["rank"] for t in d["trends"]] == [1, 2]
    assert d["request"] == {"technology_direction": "direction", "source_profile": "software_ai", "requested_limit": 15, "coverage_start": "2024-01-03", "coverage_end": "2024-06-30"}
    named = {c.trend_id: c.skipped for c in report.candidates(spark.createDataFrame(rows, SCHEMA), "software_ai", AS_OF).collect()}
    assert named == {1: None, 2: None, 3: "profile", 4: "profile", 5: "no_source", 6: "no_source"}


def test_what_cannot_be_cited_counts_but_is_no_source(spark):
    rows = [line(1, i, url=None if i % 2 else "https://a.example", country=f"C{i}") for i in range(6)]
    card = told(spark, rows)[1]["trends"][0]
    assert card["observation_count"] == 6 and card["by_type"] == [{"key": "research", "value": 6}]
    assert [x["observation_id"] for x in card["sources"]] == [104, 102, 100] and card["country_count"] == 3
    assert card["limitations"][1:] == ["Research only: no applied evidence."]


def test_fifteen_are_selected_and_the_rest_left_unwarned(spark):
    r, d = told(spark, [line(t, i, kind="product") for t in range(1, 20) for i in range(t)])
    assert (r.status, r.trend_count, len(d["trends"])) == ("ok", 15, 15) and d["summary"]["warnings"] == []
    assert [t["rank"] for t in d["trends"]] == list(range(1, 16))


def test_none(spark):
    for rows in ([], [line(1, 1, profile="mixed")]):
        r, d = told(spark, rows, failed=("p9", "p9"))
        assert (r.status, r.trend_count, d["trends"]) == ("insufficient_evidence", 0, [])
        assert d["summary"]["coverage"] == {"attempted": ["p9"], "succeeded": [], "failed": ["p9"]}
        assert d["summary"]["observation_count"] == 0 and d["request"]["coverage_start"] is None


def test_blank_request(spark):
    with pytest.raises(ValueError, match="blank"):
        report.document(spark.createDataFrame([], SCHEMA), " ", "mixed", AS_OF)
