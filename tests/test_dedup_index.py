"""The dedup index that lasts, against a plain sequential version, and the segments it is kept in."""

import random

import pytest
from pyspark.sql import functions as F

from trendloom.operators.dedup_index import DedupIndex
from trendloom.sources import segments
from trendloom.sources.segments import Segments

SHAPE = "id string, seq long, keys array<string>, block string, tokens array<string>, simhash long, actors array<string>"


def plain(rows, jaccard, hamming, least):
    """(id, unique, duplicate_of, reason, similarity) by taking the rows one by one."""
    keys, kept, out = {}, [], []
    for id_, _, own, block, tokens, simhash, actors in rows:
        tokens, actors, simhash = set(tokens or ()), set(actors or ()), simhash or 0
        own = [k for k in own or () if k is not None]
        hit = next((keys[k] for k in own if k in keys), None)
        if hit is not None:
            out.append((id_, False, hit, "exact", 1.0))
            continue
        best = None
        for other, b, t, h, a in kept if len(tokens) >= least else ():
            if b != block or len(t) < least or (actors and a and not actors & a):
                continue
            j, d = len(tokens & t) / len(tokens | t), bin((simhash ^ h) & (1 << 64) - 1).count("1")
            if j >= jaccard and d <= hamming and (best is None or min(j, 1 - d / 64) > best[1]):
                best = (other, min(j, 1 - d / 64))
        if best:
            out.append((id_, False, best[0], "fuzzy_title", best[1]))
            continue
        for k in own:
            keys.setdefault(k, id_)
        kept.append((id_, block, tokens, simhash, actors))
        out.append((id_, True, None, None, None))
    return sorted(out)


def some_rows(seed, n):
    """Titles that drift from one another word by word, so that likeness isn't transitive, with shared keys."""
    rng, rows, title = random.Random(seed), [], [f"w{i}" for i in range(12)]
    for i in range(n):
        if rng.random() < 0.4:
            title = list(title)
            title[rng.randrange(12)] = f"w{rng.randrange(40)}"
        tokens = sorted(set(title[: rng.choice([3, 11, 12, 12, 12])]))
        keys = rng.sample([f"k{rng.randrange(n)}" for _ in range(3)] + [None], rng.choice([0, 1, 2]))
        rows.append((f"r{i:03d}", i, keys or None, rng.choice(["x", "x", "y", None]), tokens, rng.choice([0, 0, 1, 7, 255]), rng.choice([None, [], ["p"], ["p", "q"], ["z"]])))
    return rows


def got(results):
    return sorted((r.id, r.unique, r.duplicate_of, r.reason, r.similarity) for r in results.collect())


def test_any_batches_give_what_a_sequential_pass_gives(spark, tmp_path):
    for seed in (1, 2):
        rows = some_rows(seed, 90)
        want = plain(rows, 0.7, 3, 4)
        assert 10 < sum(not u for _, u, *_ in want) < 80 and {r for *_, r, _ in want} == {None, "exact", "fuzzy_title"}
        for n in (1, 3):
            path, size = f"{tmp_path}/{seed}-{n}", -(-len(rows) // n)
            for b in range(n):
                # a new object each time: what lasts is on storage alone
                index = DedupIndex(spark, path, 0.7, 3, 4)
                index.add(spark.createDataFrame(rows[b * size : (b + 1) * size], SHAPE), b)
            found = got(DedupIndex(spark, path, 0.7, 3, 4).results())
            assert [x[:4] for x in found] == [x[:4] for x in want]
            assert all(x[4] == pytest.approx(y[4]) for x, y in zip(found, want, strict=True) if x[4] is not None)
            assert sorted(r.id for r in index.store.read("titles").collect()) == [x[0] for x, r in zip(want, sorted(rows), strict=True) if x[1] and len(r[4]) >= 4]


def test_a_batch_that_is_in_is_told_again_and_changes_nothing(spark, tmp_path):
    rows = some_rows(5, 20)
    index = DedupIndex(spark, str(tmp_path), 0.7, 3, 4)
    first = got(index.add(spark.createDataFrame(rows, SHAPE), 0))
    files = sorted(p.name for p in tmp_path.rglob("*.parquet"))
    assert got(index.add(spark.createDataFrame(rows[:3], SHAPE), 0)) == first
    assert sorted(p.name for p in tmp_path.rglob("*.parquet")) == files
    again = got(index.add(spark.createDataFrame([(i + "b", *rest) for i, *rest in rows], SHAPE), 1))
    assert all(not u for (_, u, *_), r in zip(again, rows, strict=True) if r[2] and any(r[2]))
    assert index.add(spark.createDataFrame([], SHAPE), 2).collect() == []


def test_a_common_token_and_many_copies(spark, tmp_path):
    """A token in a third of the titles and one title in another third: signatures meet, rows don't."""
    rows = [(f"c{i}", i, None, "x", ["the", "same", "old", "title", "again"], 3, None) for i in range(300)]
    rows += [(f"d{i}", 300 + i, None, "x", ["the", f"a{i}", f"b{i}", f"c{i}", f"d{i}"], i, None) for i in range(300)]
    found = DedupIndex(spark, str(tmp_path)).add(spark.createDataFrame(rows, SHAPE), 0)
    assert {r.id for r in found.where("unique").collect()} == {"c0"} | {f"d{i}" for i in range(300)}
    assert {(r.duplicate_of, r.reason, r.similarity) for r in found.where("not unique").collect()} == {("c0", "fuzzy_title", 1.0)}


def test_a_long_chain_is_decided_in_order(spark, tmp_path):
    """Each row is like its neighbours alone: every other one stays."""
    rows = [(f"r{i:02d}", i, [f"k{i}", f"k{i + 1}"], "x", [], 0, None) for i in range(12)]
    found = DedupIndex(spark, str(tmp_path)).add(spark.createDataFrame(rows, SHAPE), 0)
    assert [r.unique for r in found.orderBy("seq").collect()] == [True, False] * 6


def test_segments_merge_geometrically_and_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "FAN", 3)
    store = Segments(spark, str(tmp_path), {"t": "x long"})
    for b in range(7):
        assert store.add(b, {"t": spark.range(b * 10, b * 10 + 10).select(F.col("id").alias("x"))})
        assert not store.add(b, {"t": spark.range(1).select(F.col("id").alias("x"))})
        assert sorted(r.x for r in store.read("t").collect()) == list(range(b * 10 + 10))
    assert [s.level for s in store.manifest()[1]] == [1, 1, 0]
    # a segment that was written without a manifest doesn't count, and is written again
    spark.range(99).toDF("x").write.parquet(f"{tmp_path}/batch-000000007/t")
    assert store.read("t").count() == 70 and store.vacuum() == 7
    assert store.add(7, {"t": spark.range(70, 80).toDF("x")}) and sorted(r.x for r in store.read("t").collect()) == list(range(80))


def test_settings_out_of_bounds(spark, tmp_path):
    for bad in ({"jaccard": 0}, {"hamming": 65}, {"least": 0}):
        with pytest.raises(ValueError):
            DedupIndex(spark, str(tmp_path), **bad)
