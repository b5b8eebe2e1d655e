"""Decontamination by winnowing against a plain search for every span."""

import hashlib
import random
import re

import numpy as np
import pytest

from trendloom.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, span=10):
    """(doc, n_words, hit words, item ids) by comparing every span of words."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    ids |= found
        out.append((doc, len(w), tuple(sorted(hit)), tuple(sorted(ids))))
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = winnow.contamination(d, b, **more).collect()
    for r in rows:
        assert r.n_hit == sum(s.end - s.begin for s in r.spans)
        assert all(x.end < y.begin for x, y in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, tuple(i for s in r.spans for i in range(s.begin, s.end)), tuple(r.items)) for r in rows), key=repr)


def test_equals_a_plain_search_on_random_texts(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "straße", "Ünder", "7", "日本"]
    text = lambda n: rng.choice([" ", "-", "\n", "..."]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 4, 5, 7, 9, 10, 11, 25]))) for i in range(12)]
    items = [(i, t) for i, t in items if len(words(t)) not in (1, 3)] + [(90, "xx"), (91, "b xx b")]
    docs = [(i, text(rng.randrange(0, 90))) for i in range(60)]
    for i in range(20):  # parts of items, at the edges and inside
        w = re.split(r"[ \n.-]+", rng.choice(items)[1])
        a = rng.randrange(len(w))
        docs.append((100 + i, text(rng.randrange(6)) + " " + " ".join(w[a:]) + " " + text(rng.randrange(6))))
    docs.append((200, "b XX. B"))
    assert run(spark, docs, items) == plain(docs, items)


def test_no_span_of_ten_words_is_missed_and_none_of_nine_found(spark):
    item = " ".join(f"w{i}" for i in range(40))
    w = item.split()
    docs = [(i, f"x{i} {' '.join(w[i : i + 10])} y{i}") for i in range(31)] + [(100 + i, f"x{i} {' '.join(w[i : i + 9])} y{i}") for i in range(32)]
    got = {r[0]: len(r[2]) for r in run(spark, docs, [(1, item)])}
    assert got == {**{i: 10 for i in range(31)}, **{100 + i: 0 for i in range(32)}}


def test_hostile_rows(spark):
    phrase = "one two three four five six seven eight nine ten eleven"
    long = "pad " * 30_000 + phrase + " " + "z" * 3_000_000 + " " + phrase
    items = [(1, phrase), (1, phrase), (2, phrase.upper()), (None, "seven eight"), (3, None), (4, ""), (5, "... !")]
    docs = [(1, None), (2, ""), (3, "?!"), (4, phrase), (4, phrase), (4, "other text"), (None, phrase), (None, None), (5, long), (6, "seven eight")]
    assert run(spark, docs, items) == plain(docs, items)
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.contamination(empty, none).collect() == []
    assert {r.n_hit for r in winnow.contamination(some, none).collect()} == {0}


def test_copies_on_both_sides_multiply_nothing(spark):
    phrase = " ".join(f"w{i}" for i in range(60))
    docs = [(i, phrase + (" tail" if i % 2 else "")) for i in range(300)]
    items = [(i, phrase) for i in range(200)]
    assert run(spark, docs, items) == plain(docs, items)
    own = winnow.item_spans(spark.createDataFrame(items, "item_id long, text string")).cache()
    found = winnow.candidates(spark.createDataFrame(docs, "row_ long, text string"), winnow.bitmap(own), [10])
    classes = own.groupBy("n", "print", "whole").agg({"item": "min"}).withColumnRenamed("min(item)", "class")
    # two texts of 51 spans of ten words that items have
    assert winnow.hit_spans(found, classes).count() == 2 * 51


def test_clean_rows_stay_with_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", 1, 2), (2, "fresh words", 3, 4), (3, None, 5, 6)], "doc_id long, text string, sign_ int, hits int")
    items = spark.createDataFrame([(9, "A b c d e f g h i j")], "item_id long, text string")
    assert sorted(map(tuple, winnow.decontaminated(docs, items).collect())) == [(2, "fresh words", 3, 4), (3, None, 5, 6)]


def test_pieces_cut_no_word(monkeypatch):
    data = ("ab cd-efg " * 50 + "q" * 300 + " end").encode()
    whole = winnow.hashed_words(data)
    monkeypatch.setattr(winnow, "BYTES", 16)
    parts = winnow.hashed_words(data)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and len(whole[0]) == 152


@pytest.mark.parametrize("n", [1, 4, 5, 9, 10])
def test_runs_of_words_are_windowed_in_overlapping_parts(monkeypatch, n):
    rng = np.random.default_rng(n)
    w, owner = rng.integers(0, 1 << 62, 200).astype(np.uint64), np.sort(rng.integers(0, 7, 200))
    whole = [np.concatenate(x) for x in zip(*winnow.spans_of(w, owner, n), strict=True)]
    monkeypatch.setattr(winnow, "WORDS", 13)
    parts = [np.concatenate(x) for x in zip(*winnow.spans_of(w, owner, n), strict=True)]
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert whole[0].tolist() == [i for i in range(200 - n + 1) if owner[i] == owner[i + n - 1]]


def test_digest_equals_plain_on_the_smallest_tables(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = sorted(map(tuple, winnow.contamination_digest(spark, "/root/testdata/sf0.001").collect()))
    want = [(d, n, len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)) for d, n, hit, ids in plain(small[1], items)]
    assert got == sorted(want) and any(r[2] for r in got)
