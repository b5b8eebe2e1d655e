"""Findings of the fourth round: what was cut or grew faster than its input."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from trendloom.llm import jaccard, lines, unionfind
from trendloom.operators import dedup, lineage, linkage


def test_verdicts_read_all_files_and_whole_lines(spark):
    """A commit's seventieth file, and a name behind the 220th character of a line."""
    parents = spark.createDataFrame([("r", "b", "a"), ("r", "c", "a"), ("r", "d", "a")], "repo string, sha string, parent_sha string")
    below = lineage.descendants(parents, parents.select("repo", F.col("parent_sha").alias("sha")).distinct())
    far = "+" + "x" * 300 + " = LoraLayer()"
    changed = [("b", f"a{i:02}.py", "+pass") for i in range(69)] + [("b", "peft/lora.py", "+class LoraLayer:"), ("c", "peft/utils.py", far), ("d", "peft/utils.py", far.replace("Lora", ""))]
    files = spark.createDataFrame([("r", sha, name, None, "modified", patch) for sha, name, patch in changed], "repo string, sha string, filename string, previous_filename string, status string, patch string")
    diff = "FILE peft/lora.py\n+class LoraConfig:\nFILE peft/utils.py\n+x"
    base = ("Low-rank adaptation for language models", "r", "a", 1, "commit", "Add LoRA fine-tuning for LLM adapters", None, diff, "r")
    shape = "case_id int, technology_direction string, anchor_repo string, anchor_sha string, anchor_at int, anchor_kind string, anchor_title string, anchor_text string, anchor_diff string, repo string, sha string, at int, kind string"
    cases = spark.createDataFrame([(i, *base, sha, 2, "commit") for i, sha in enumerate("bcd")], shape)
    assert [r.verdict for r in lineage.verdicts(cases, files, below).orderBy("case_id").collect()] == ["supporting", "supporting", "rejected"]


def test_lines_of_a_crowded_bucket_meet_as_in_a_plain_comparison(monkeypatch, spark):
    """Squares, steps and batches of any size give the same components: those of all pairs that agree."""
    rng = np.random.default_rng(4)
    forms = ["".join(rng.choice(list("abcdefgh "), 60)) for _ in range(12)]
    texts = ["".join(c if x else "z" for c, x in zip(forms[i % 12], rng.random(60) > 0.05 * (i % 5), strict=True)) for i in range(400)]
    docs = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "row_ long, doc_ long, text string")
    found = lines.signatures(docs).cache()
    rows = {r.hash_: r for r in found.where("left_ is not null").collect()}
    plain = []
    for a, b in itertools.combinations(rows.values(), 2):
        same = sum((x >> 8 * i & 255) == (y >> 8 * i & 255) for x, y in ((a.left_, b.left_), (a.right_, b.right_)) for i in range(lines.BANDS))
        if set(a["keys_"]) & set(b["keys_"]) and same >= lines.AGREE:
            plain.append((a.hash_, b.hash_))
    want = [x.tolist() for x in unionfind.forest(*(np.array([p[k] for p in plain]) for k in (0, 1)))]
    assert len(set(want[1])) > 3
    for side, held in ((8, 5), (16, 100), (4000, 1 << 16)):
        # tasks read these from the closure of the module's functions
        monkeypatch.setattr(lines, "SIDE", side)
        monkeypatch.setattr(lines, "HELD", held)
        edges = inner(lines.candidate_edges)
        order = sorted((k, r.hash_, r.left_, r.right_) for r in rows.values() for k in r["keys_"])
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*order[i : i + 37], strict=True)], list("klab")) for i in range(0, len(order), 37)]
        pairs = [np.concatenate([b.column(k).to_numpy() for b in edges(iter(batches))]) for k in (0, 1)]
        assert [x.tolist() for x in unionfind.forest(*pairs)] == want


def inner(function):
    """The numpy function that a step hands to mapInArrow."""

    class Rows:
        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    rows = Rows()
    function(rows)
    return rows.run


def test_work_on_a_large_cluster_is_narrow(monkeypatch):
    """Sketches of a cluster are as wide as its sets' sizes ask for, not as its largest set does, and links are those of
    all pairs."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (20, 60, 90, 100, 400, 3000)]
    sets = []
    for i in range(240):
        x = base[i % 6].copy()
        hit = rng.random(len(x)) < (0, 0.02, 0.1, 0.3)[i // 6 % 4]
        x[hit] = rng.integers(0, 1 << 63, int(hit.sum()))
        sets.append(np.unique(x))
    bands, side = jaccard.Bands(80, 100), np.arange(240) % 2
    bits = []
    parity = jaccard.parity
    monkeypatch.setattr(jaccard, "parity", lambda hashes, owner, n, width, shift: bits.append((len(hashes) / n, width)) or parity(hashes, owner, n, width, shift))
    linked = [(i, j) for i, j in itertools.combinations(range(240), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    for given in (None, side):
        want = [(i, j) for i, j in linked if given is None or side[i] != side[j]]
        ends = lambda pairs: [x.tolist() for x in unionfind.forest(*(np.array([p[k] for p in pairs]) for k in (0, 1)))]
        assert ends(jaccard.link_tile(sets, given, bands)) == ends(want)
    assert all(width <= max(256, 4 * mean) for mean, width in bits)


def test_tiles_of_one_block_are_dealt_to_many_tasks(monkeypatch, spark):
    """All pairs of tiles meet once, in more tasks than there are blocks."""
    monkeypatch.setattr(linkage, "TILE", 5)
    rows = spark.createDataFrame([("b", i, [1.0, float(i)]) for i in range(100)], "block string, id long, v array<double>")
    rows = linkage.points(rows, "block", "id", "v").selectExpr("block", "key", "xxhash64(key) as h", "1L as n", "v", "t", "w").cache()
    pairs = linkage._met(rows.where("key % 2 = 0"), rows).select(F.explode("rows").alias("a"), "more").select("a.key", F.explode("more").alias("b")).groupBy("key", "b.key").count()
    assert pairs.count() == 50 * 100 and pairs.where("count <> 1").isEmpty()
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        assert linkage._met(rows, rows).select(F.spark_partition_id()).distinct().count() > 2
    finally:
        spark.conf.unset(coalesce)


def test_nearest_of_a_tile_makes_no_second_product():
    """Clusters of several sizes: the nearest as by a plain search, with temporary arrays for a few rows at a time."""
    rng = np.random.default_rng(6)
    none = np.zeros(0, np.int64)
    n = rng.integers(1, 9, 1000)
    sums = linkage._Sums(rng.normal(size=(1000, 8)), none, none, none.astype(float), n)
    h = rng.permutation(1000)
    tracemalloc.start()
    row, far, _, at = linkage._least(sums, sums, h, h)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    plain = np.round(1 - sums.v @ sums.v.T / np.outer(n, n), linkage.DIGITS)
    np.fill_diagonal(plain, np.inf)
    assert row.tolist() == list(range(1000)) and (far == plain.min(axis=1)).all() and (plain[row, at] == far).all()
    assert peak < 2 * 8 * 1000 * 1000


def test_a_long_chain_is_resolved_in_a_task_as_by_rounds(monkeypatch, spark):
    """A chain of sixty rows, and a random graph: the walk and the rounds against a plain loop."""
    rng = np.random.default_rng(7)
    pairs = {(i, i + 1) for i in range(60)} | {(int(a), int(b)) for a, b in np.sort(rng.integers(100, 160, (150, 2)), axis=1) if a < b}
    edges = [(a, b, "exact" if (a + b) % 7 == 0 else "fuzzy_title", float(rng.integers(6, 9)) / 10) for a, b in sorted(pairs)]
    want = {}
    for i in range(200):
        near = [((r == "exact", s, -a), a, r, s) for a, b, r, s in edges if b == i and want[a][0]]
        want[i] = (False, *max(near)[1:]) if near else (True, None, None, None)
    nodes = spark.createDataFrame([(i, i) for i in range(200)], "id long, seq long")
    frame = spark.createDataFrame(edges, "a long, b long, reason string, similarity double")
    rounds = []
    write = dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    for most, few in ((dedup.MOST, True), (70, False)):
        monkeypatch.setattr(dedup, "MOST", most)
        rounds.clear()
        got = {r.id: (r.unique, r.duplicate_of, r.reason, r.similarity) for r in dedup.resolve(nodes, frame).collect()}
        assert got == want
        assert (len(rounds) < 10) == few
    assert dedup.resolve(nodes, frame.limit(0)).where("unique and duplicate_of is null").count() == 200
