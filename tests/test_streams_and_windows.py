"""Keyed state under a stream, and joins with windows of time."""

import random
from datetime import date, datetime, timedelta

import pytest

from trendloom.operators import windows
from trendloom.sources import segments
from trendloom.streaming import collect, keyed

SHAPE = "trend_id string, observation_id string, event_time timestamp"


def test_months_under_a_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    rng, src, out, cp = random.Random(1), str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp")
    rows = [(f"t{rng.randrange(4)}", f"o{i}", datetime(2024, 1, 1) + timedelta(days=rng.randrange(300))) for i in range(60)]
    run = lambda: keyed.count_months(spark.readStream.schema(SHAPE).parquet(src), out, cp)
    given = []
    for b in range(4):
        # rows of this batch, some of earlier ones again, one that is very late, and some that are incomplete
        batch = rows[b * 15 : b * 15 + 15] + rng.sample(given, min(len(given), 9)) + [("t0", f"late{b}", datetime(2020 - b, 5, 1)), (None, "x", datetime(2024, 1, 1)), ("t0", None, datetime(2024, 1, 1)), ("t0", "y", None)]
        given += [r for r in batch if None not in r]
        spark.createDataFrame(batch + batch[:3], SHAPE).coalesce(1).write.mode("append").parquet(src)
        run()
        want = {}
        for trend, oid, at in set(given):
            want.setdefault((trend, at.strftime("%Y-%m")), []).append(at)
        got = {(r.trend_id, r.period): (r.n, r.first_at, r.last_at) for r in keyed.months(spark, out).collect()}
        assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}
    spans = {r.trend_id: r for r in keyed.spans(spark, out).collect()}
    assert spans["t0"].first_seen == datetime(2017, 5, 1) and sum(r.n for r in spans.values()) == 64
    before = sorted(tmp_path.rglob("*.parquet"))
    run()
    assert sorted(tmp_path.rglob("*.parquet")) == before and [s.level for s in keyed._segments(spark, out).manifest()[1]] == [1, 0]
    # a micro-batch that is run again is in already
    assert not keyed._segments(spark, out).add(2, {"months": keyed.months(spark, out)})


def test_collection_writes_what_a_batch_brings(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "store")
    for b, ids in enumerate((["a", "b", "b"], ["b", "c"], ["d"])):
        spark.createDataFrame([(i, b) for i in ids], "observation_id string, n int").coalesce(1).write.mode("append").parquet(str(src))
        collect.collect_pages(spark.readStream.schema("observation_id string, n int").parquet(str(src)), str(tmp_path / "raw"), out, str(tmp_path / "cp"))
    assert sorted(map(tuple, collect.current(spark, out).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert [spark.read.parquet(f"{out}/batch-{b:09d}/rows").count() for b in range(3)] == [2, 2, 1]
    assert collect.current(spark, str(tmp_path / "nothing")) is None


@pytest.mark.parametrize("days", [1, 7, 31, 400])
def test_windows_equal_a_nested_loop(spark, days):
    rng, day = random.Random(days), lambda: date(2023, 1, 1) + timedelta(days=rng.randrange(200))
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *(datetime.combine(day(), datetime.min.time()) + timedelta(hours=rng.randrange(24)) for _ in range(5))])) for i in range(80)]
    spans = [(j, rng.choice(["a", "b", "c", None]), rng.choice([None, day(), day(), day()]), rng.choice([None, day(), day(), day()])) for j in range(40)] + [(99, "a", date(1960, 1, 1), date(2040, 1, 1))]
    left = spark.createDataFrame(rows, "row int, case string, ts timestamp")
    right = spark.createDataFrame(spans, "window int, case string, start date, end date")
    want = {(i, j) for i, c, t in rows for j, k, a, b in spans if c is not None and c == k and None not in (t, a, b) and a <= t.date() <= b}
    met = windows.within(left, right, "case", "ts", days)
    assert sorted((r.row, r.window) for r in met.collect()) == sorted(want) and met.columns == ["row", "case", "ts", "window", "start", "end"]
    assert {r.window: r.n for r in windows.counted(left, right, "case", "ts", days).collect()} == {j: sum(w == j for _, w in want) for j, *_ in spans}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
