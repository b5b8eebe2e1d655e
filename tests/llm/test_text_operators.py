"""Operators on texts against brute force, and their defined edge cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trendloom.llm import jaccard, lines, lz, packing, suffixes
from trendloom.llm.queries import tokenizer_path
from trendloom.llm.unionfind import components

EDGES = [(1, None), (2, ""), (3, "x"), (4, "a b c"), (5, "a b c"), (6, "  \n\t "), (None, "a b c d e f"), (7, "Aä " * 700)]


def roots(n, links):
    par = list(range(n))

    def find(i):
        while par[i] != i:
            par[i] = par[par[i]]
            i = par[i]
        return i

    for a, b in links:
        par[find(a)] = find(b)
    return [find(i) for i in range(n)]


# --- packing


def expected_pieces(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in rows}


@pytest.mark.parametrize("which", ["edges", "small"])
def test_packing_keeps_every_id_once(make, small, which):
    df, rows = small if which == "small" else (make(EDGES), EDGES)
    ids = expected_pieces(rows)
    got = packing.pack_documents(df, tokenizer_path()).collect()
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for d, pieces in by.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = ids[d][at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[d]), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r.length
        assert at == len(ids[d])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.sequence_length == (at if at & (at - 1) == 0 else 2048) for r in pieces)
        padding += pieces[0].sequence_length - at
    if which == "small":
        assert padding < 0.02 * sum(map(len, ids.values()))


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(3)
    for _ in range(20):
        h = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 2049, rng.integers(1, 60))}
        used = collections.Counter()
        for p, n in packing.plan(h):
            assert sum(p) <= 2048 and n > 0
            for k in p:
                used[k] += n
        assert used == h


def test_packing_of_nothing_and_of_wrong_lengths(spark, make):
    assert packing.pack_documents(make([]), tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 0, 0, 4000)], "doc_id long, start long, ids_crc32 long, length long"))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    e, plain = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "<|endoftext", "", " ", "\n\n x\t\ty\r\n", "don't I'll 'sx ''s", "²³ ½ a1b2 é\x85\xa0 z\x1c\x1dq", "日本 語 text", "<|endoftext|> a", "a  b   c"]
    for x, ids in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(x, add_special_tokens=False).ids


# --- Lempel-Ziv fingerprints


def lz_rows(rows):
    rows = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    for i, (d, x) in enumerate(rows):
        x, y = x or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(x) // 2
        edited = x[: len(x) - half] + y[:half]
        a, b, c = lz.fingerprint(x), lz.fingerprint(edited), lz.fingerprint(y)
        yield d, len(x), hashlib.sha256(edited.encode()).hexdigest(), lz.to_text(a), lz.to_text(b), lz.likeness(a, b), lz.likeness(a, c)


@pytest.mark.parametrize("which", ["edges", "small", "one", "none"])
def test_lz_against_plain_parsing(make, small, which, monkeypatch):
    monkeypatch.setattr(lz, "RANGE_ROWS", 40)
    df, rows = small if which == "small" else (make(r := {"edges": EDGES, "one": [(4, "abcabc")], "none": []}[which]), r)
    got = sorted(map(tuple, lz.fingerprint_digest(df).collect()), key=repr)
    assert got == sorted(lz_rows(rows), key=repr)


def test_lz_likeness():
    same = lz.fingerprint("to be or not to be " * 20)
    assert lz.likeness(same, same) == 1.0 and lz.likeness(same, lz.fingerprint("")) == 0.0


# --- n-gram Jaccard join


def linked(rows, k, part, of):
    sets = []
    for _, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links, holders = [], collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g])
        links += [(i, j) for j, n in shared.items() if of * n >= part * (len(s) + len(sets[j]) - n)]
        for g in s:
            holders[g].append(i)
    root = roots(len(rows), links)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    return sorted((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))


def near_copies(n, words=60, seed=1):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 500, words)]
    for i in range(n):
        w = list(base)
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(words)] = f"x{rng.integers(9)}"
        yield i + 1, " ".join(w)


@pytest.mark.parametrize(("k", "part", "rounds"), [(4, 85, 1), (5, 80, 3)])
def test_join_against_all_pairs(make, small, k, part, rounds):
    df, rows = small
    assert sorted(map(tuple, jaccard.near_duplicates(df, k, part, 100, rounds).collect())) == linked(rows, k, part, 100)


@pytest.mark.parametrize("limits", [{}, {"CROWD": 4}, {"LARGE": 6}, {"TILE": 300, "SKETCH_TILE": 500}])
def test_join_of_many_near_copies(make, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = list(near_copies(90)) + [(200 + d, x) for d, x in near_copies(20, 7, 2)] + [(300, ""), (301, None), (302, "one two"), (303, "one two")]
    assert sorted(map(tuple, jaccard.near_duplicates(make(rows), 4, 85, 100).collect())) == linked(rows, 4, 85, 100)


def test_join_of_nothing(make):
    assert jaccard.near_duplicates(make([])).count() == 0
    assert sorted(map(tuple, jaccard.near_duplicates(make([(1, None), (2, "")])).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_join_keeps_links_of_null_ids(make):
    words = [f"w{i}" for i in range(60)]
    edited = [*words[:59], "x"]
    rows = [(5, " ".join(words)), (None, " ".join(edited)), (7, " ".join([*edited[1:], "y"])), (9, "other " * 9)]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(make(rows), 4, 85, 100).collect()}
    assert got == {5: 5, None: 5, 7: 5, 9: 9}
    alone = [(None, " ".join(words)), (None, " ".join(edited)), (3, "z")]
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(make(alone), 4, 85, 100).collect()} == {(None, None), (3, 3)}


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[20:], rng.integers(0, 1 << 63, 15).astype(np.uint64)]))
        for bits in (512, 1024):
            x, y = (np.frombuffer(jaccard.folded(s, bits), np.uint8) for s in (a, b))
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


# --- union-find


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffix index


def covered(rows, length):
    count, raws = collections.Counter(), [(d, (x or "").encode()) for d, x in rows]
    for _, r in raws:
        count.update(r[i : i + length] for i in range(len(r) - length + 1))
    for d, r in raws:
        marks = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                marks[i] += 1
                marks[i + length] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        spans = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(r) else 0
        yield d, len(r), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("limits", [{}, {"HELD": 3000}])
def test_repeats_against_all_windows(small, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)
    df, rows = small
    assert sorted(map(tuple, suffixes.repeat_digest(df).collect())) == sorted(covered(rows, 400))


def test_repeats_within_a_text_and_in_periodic_ones(make):
    rng = np.random.default_rng(5)
    part = "".join(map(chr, rng.integers(97, 123, 500)))
    rows = [(1, part + "!" + part[:450]), (2, "ab" * 400), (3, "z" * 399), (4, "z" * 400), (5, part[50:460] + "?"), (6, None), (7, ""), (8, "same" * 200), (9, "same" * 200), (9, "same" * 200)]
    assert sorted(map(tuple, suffixes.repeat_digest(make(rows)).collect())) == sorted(covered(rows, 400))
    assert suffixes.repeat_digest(make([])).count() == 0


def test_levels_merge_geometrically(spark, make):
    index = suffixes.SuffixIndex(40, 16)
    rng = np.random.default_rng(1)
    for i in range(5):
        texts = make([(i * 10 + j, "".join(map(chr, rng.integers(97, 123, 200)))) for j in range(3)]).withColumn("sign", F.xxhash64("text"))
        index.add(texts)
    assert sorted(index.levels) == [0, 2]
    assert index.all().select("sign").distinct().count() == 15


def test_merge_scan_finds_neighbours_across_batches_and_ranges(spark):
    """Runs that ranges cut into pieces, in small Arrow batches, against a plain count by gram."""
    rng = np.random.default_rng(2)
    keys = np.sort(rng.integers(0, 60, 700))
    rows = sorted({(int(k) // 7, int(k), int(s), int(p), bool(f)) for k, s, p, f in zip(keys, rng.integers(0, 40, 700), rng.integers(0, 3, 700), rng.integers(0, 12, 700) == 0, strict=True)})
    rows += [(99, 99, 7, 7, False)] * 20 + [(99, 100, 1, 1, True)]
    places, fresh = collections.defaultdict(set), set()
    for _, gram, sign, low, new in rows:
        places[gram].add((sign, low))
        if new:
            fresh.add(gram)
    want = {g for g in fresh if len(places[g]) > 1}
    schema = pa.schema([("head", pa.int64()), ("gram", pa.int64()), ("sign", pa.int64()), ("low", pa.int32()), ("new", pa.bool_())])
    for cuts in ([0, len(rows)], [0, 1, 300, 301, 500, len(rows)]):
        runs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : min(i + 9, b)]], schema) for i in range(a, b, 9)]
            runs += [r for x in suffixes._neighbours(iter(batches)) for r in x.to_pylist()]
        got = collections.defaultdict(lambda: [False, set()])
        for r in runs:
            got[r["gram"]][0] |= r["new"]
            got[r["gram"]][1] |= {(r["sign_a"], r["low_a"]), (r["sign_b"], r["low_b"])}
        assert {g for g, (new, at) in got.items() if new and len(at) > 1} == want


def test_levels_hold_suffix_order(spark, make):
    """A level's files, read in their order, are one sorted array; a later batch meets what an earlier one has."""
    index = suffixes.SuffixIndex(40, 16)
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 90))) for _ in range(6)]
    first = make([(i, w) for i, w in enumerate(words)]).withColumn("sign", F.xxhash64("text"))
    assert index.add(first).count() == 0
    second = make([(9, "0" * 30 + words[4] + "1" * 9)]).withColumn("sign", F.xxhash64("text"))
    assert index.add(second).count() > 0
    level = index.levels[1].withColumn("file", F.input_file_name())
    parts = collections.defaultdict(list)
    for r in level.collect():
        parts[r.file].append((r.head, r.gram, r.sign, r.low))
    assert all(p == sorted(p) for p in parts.values())
    ends = [(p[0], p[-1]) for _, p in sorted(parts.items())]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


# --- line dedup


def test_line_dedup_against_all_pairs(small):
    df, rows = small
    gone = all_shingles_removed(rows)
    for r in lines.dedup_lines(df).collect():
        text = dict(rows)[r.doc_id]
        kept = [x for p, x in enumerate(text.split("\n")) if (r.doc_id, p) not in gone]
        assert (r.text, r.n_lines, r.n_removed) == ("\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept))


def test_line_dedup_edges(make):
    long = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the wide forest near our old small town while seven grey wolves watch from their hill and wait until dark night falls over every quiet house below"
    rows = [(1, long + "\nshort\n" + long), (2, "short\n  " + long.upper() + " "), (3, None), (4, ""), (5, long.replace("lazy", "tired") + "\n" + "ü" * 30)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(make(rows)).collect()}
    assert got == {1: (long + "\nshort", 3, 1), 2: ("short", 2, 1), 3: (None, 0, 0), 4: ("", 1, 0), 5: ("ü" * 30, 2, 1)}
    assert lines.dedup_lines(make([])).count() == 0


def test_line_dedup_finds_lines_with_edited_words(make):
    words = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the wide forest near our old small town".split()
    longer = words + "while seven grey wolves watch".split()
    one, two = list(words[:25]), list(longer)
    one[12] = "far"
    two[0], two[30] = "dry", "cat"
    pairs = [(" ".join(words[:25]), " ".join(one)), (" ".join(longer), " ".join(two))]
    rows = [(2 * i + j, x) for i, p in enumerate(pairs) for j, x in enumerate(p)]
    assert [r.n_removed for r in sorted(lines.dedup_lines(make(rows)).collect())] == [0, 1, 0, 1]


def all_shingles_removed(rows):
    """Lines that go by all pairs of distinct lines, with a shingle at each character."""
    first = {}
    for d, x in rows:
        for p, line in enumerate((x or "").split("\n")):
            if len(z := line.strip(" ").lower()) >= lines.MIN_CHARS:
                first.setdefault(z, []).append((d, p))
    names = list(first)
    sets = [{z[i : i + 8] for i in range(len(z) - 7)} for z in names]
    links, holders = [], collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g])
        links += [(i, j) for j, n in shared.items() if 100 * n >= 80 * (len(s) + len(sets[j]) - n)]
        for g in s:
            holders[g].append(i)
    root = roots(len(names), links)
    groups = collections.defaultdict(list)
    for z, r in zip(names, root, strict=True):
        groups[r] += first[z]
    return {o for places in groups.values() for o in places if o != min(places)}


def test_line_dedup_against_all_pairs_of_whole_lines(small):
    df, rows = small
    gone = collections.Counter(d for d, _ in all_shingles_removed(rows))
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(df).collect()} == {d: gone[d] for d, _ in rows}


def test_line_dedup_reads_words_to_their_end(make):
    rng = np.random.default_rng(2)
    tails = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 40))) for _ in range(3)] + ["".join(map(chr, rng.integers(97, 123, 60))) for _ in range(3)]
    heads = ["今天我们要讨论的是一个非常重要的问题"] * 3 + ["https://www.example.org/"] * 3
    rows = [(i, h + t) for i, (h, t) in enumerate(zip(heads, tails, strict=True))] + [(9, heads[5] + tails[5][:-1] + "0")]
    assert [r.n_removed for r in sorted(lines.dedup_lines(make(rows)).collect())] == [0] * 6 + [1]


def test_line_dedup_of_repeated_rows_and_clashing_columns(spark):
    a, b = "the first of two lines that are long", "quite another one, which is also long"
    rows = [(3, f"{a}\n{b}\nok", 1, 1, 9), (3, f"{a}\n{b}\nok", 2, 2, 9), (None, f"{b}\nonly the last one has this line", 3, 3, 9), (None, None, 4, 4, 9), (5, "", 5, 5, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot_ int, row_ int, n_removed int").withColumns({"doc": F.lit("x"), "removed_": F.lit(0)})
    got = lines.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "slot_", "row_", "doc", "removed_", "n_lines", "n_removed"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=repr)
    assert found == sorted([(3, f"{a}\n{b}\nok", 3, 0), (3, "ok", 3, 2), (None, "only the last one has this line", 2, 1), (None, None, 0, 0), (5, "", 1, 0)], key=repr)
    with pytest.raises(TypeError):
        lines.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@pytest.mark.parametrize("large", [1000, 7])
def test_line_dedup_compares_all_of_a_bucket(make, monkeypatch, large):
    monkeypatch.setattr(lines, "LARGE", large)
    # one bucket for all lines: a template that fills two thirds of each, and couples of near copies among them
    found = lines.signatures

    def one_bucket(rows):
        return found(rows).withColumn("keys_", F.when(F.size("keys_") > 0, F.array(F.lit(7).cast("long"))))

    monkeypatch.setattr(lines, "signatures", one_bucket)
    rng = np.random.default_rng(4)
    template = "".join(map(chr, rng.integers(97, 123, 100)))
    rows = []
    for i in range(40):
        own = "".join(map(chr, rng.integers(97, 123, 50)))
        rows += [(2 * i, template + own), (2 * i + 1, template + own[:-1] + "0")]
    assert [r.n_removed for r in sorted(lines.dedup_lines(make(rows)).collect())] == [0, 1] * 40
