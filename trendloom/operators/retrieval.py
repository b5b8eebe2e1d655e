"""All queries against all documents, by products of blocks: what is asked of a pair is counted where the pair is made, so
that no pair becomes a row. A pair of blocks is a group of its own, whose size doesn't grow with the tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.sources.shared import materialize

#: Rows of a block, queries of one product, and what a similarity of none stands as.
BLOCK, STEP, NONE = 4096, 256, -2_000_000


def by_blocks(docs: DataFrame, queries: DataFrame, by: list[str], met: Callable[[pa.Table, pa.Table], pa.Table], shape: str, block: int | None = None) -> DataFrame:
    """met of each block of docs (doc_id, ...) with each block of queries (query_id, ...) of equal by."""
    block = block or BLOCK
    sizes = [df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(n)) for df, n in ((docs, "nd"), (queries, "nq"))]
    both = sizes[0].join(sizes[1], by) if by else sizes[0].crossJoin(sizes[1])
    dealt = lambda df: df.join(both, by) if by else df.crossJoin(F.broadcast(both))
    every = lambda n: F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), lambda i: i < F.col(n)))
    left = dealt(docs).withColumn("d", F.pmod(F.xxhash64("doc_id"), F.col("nd")).cast("int")).select("*", every("nq").alias("q")).drop("nd", "nq")
    right = dealt(queries).withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("nq")).cast("int")).select("*", every("nd").alias("d")).drop("nd", "nq")
    keys = [*by, "d", "q"]
    # columns of their own, since both sides may come of one table
    left, right = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, shape)


def _matrix(found: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, zeros to the right, and their sizes: -1 for null ones and those with a null."""
    found = found.combine_chunks()
    out, sizes = np.zeros((len(found), width)), np.full(len(found), -1)
    if found.null_count == 0 and found.values.null_count == 0 and len(found.flatten()) == len(found) * width:
        return found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width), np.full(len(found), width)
    for i, v in enumerate(found.to_pylist()):
        if v is not None and None not in v:
            out[i, : len(v)], sizes[i] = v, len(v)
    return out, sizes


def similarities(queries: pa.ChunkedArray, docs: pa.ChunkedArray):
    """For queries by steps: (slice, cosines in millionths, as doubles). Where vectors have none (zero, null, other size)
    it is NONE; one that isn't finite counts as 1, as least() and greatest() make it."""
    width = max(int(pc.max(pc.list_value_length(c)).as_py() or 0) for c in (queries, docs))
    (a, na), (b, nb) = _matrix(queries, width), _matrix(docs, width)
    with np.errstate(all="ignore"):
        la, lb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        alike = len(np.unique(np.concatenate([na, nb]))) <= 1
        for start in range(0, len(a), STEP):
            at = slice(start, start + STEP)
            length = la[at, None] * lb
            s = a[at] @ b.T
            s /= length
            bad = ~np.isfinite(s)
            if bad.any():
                s[bad] = 1.0
            np.clip(s, -1.0, 1.0, out=s)
            s *= 1e6
            np.rint(s, out=s)
            none = length == 0
            if not alike:
                none |= (na[at, None] != nb) | (na[at, None] < 0)
            if none.any():
                s[none] = NONE
            yield at, s


_BEST = "query_id {0}, query_label {1}, tops array<struct<s: long, doc: {2}, hit: boolean>>, best struct<s: long, doc: {2}>, worst struct<s: long, doc: {2}>"


def retrieval(docs: DataFrame, queries: DataFrame, labels: int, block: int | None = None) -> DataFrame:
    """query_id, query_label, r1, r3, r5, best (rank of the first relevant document), won (it stands before all hard ones).
    docs: (doc_id, label, vector), queries: (query_id, query_label, vector). Relevant: of the query's label; hard: of the
    next one (of labels). Documents stand in order of the cosine's six digits and then of the id, both falling. One pass
    finds each query's first documents, another counts what stands before its first relevant one."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    shape = _BEST.format(kind(queries, "query_id"), kind(queries, "query_label"), kind(docs, "doc_id"))

    def firsts(d: pa.Table, q: pa.Table) -> pa.Table:
        if not len(d) or not len(q):
            return pa.table({"query_id": q["query_id"][:0], "query_label": q["query_label"][:0], "tops": [], "best": [], "worst": []})
        d = d.sort_by([("doc_id", "ascending")])
        ids, n = d["doc_id"].to_pylist(), len(d)
        code = {x: i for i, x in enumerate(dict.fromkeys(d["label"].to_pylist()))}
        own = np.array([code[x] for x in d["label"].to_pylist()])
        order = np.argsort(own, kind="stable")  # labels side by side
        place, starts = order.astype(np.float64), np.searchsorted(own[order], np.arange(len(code)))
        said, tops, best, worst = q["query_label"].to_pylist(), [], [], []
        told = lambda key: {"s": int(key // n), "doc": ids[int(key % n)]}
        k = min(5, n)
        for at, s in similarities(q["vector"], d.take(pa.array(order))["vector"]):
            s *= n
            s += place  # one number that stands for similarity and id
            most = np.maximum.reduceat(s, starts, axis=1)
            first = np.partition(s, n - k, axis=1)[:, n - k :]
            for i, label in enumerate(said[at]):
                tops.append([told(x) | {"hit": label is not None and own[int(x % n)] == code.get(label, -1)} for x in first[i]])
                best.append(told(most[i, code[label]]) if label is not None and label in code else None)
                hard = None if label is None else (label + 1) % labels
                worst.append(told(most[i, code[hard]]) if hard is not None and hard in code else None)
        pair = pa.struct([("s", pa.int64()), ("doc", d["doc_id"].type)])
        three = pa.struct([("s", pa.int64()), ("doc", d["doc_id"].type), ("hit", pa.bool_())])
        return pa.table({"query_id": q["query_id"], "query_label": q["query_label"], "tops": pa.array(tops, pa.list_(three)), "best": pa.array(best, pair), "worst": pa.array(worst, pair)})

    found = by_blocks(docs, queries, [], firsts, shape, block).groupBy("query_id", "query_label").agg(F.slice(F.sort_array(F.flatten(F.collect_list("tops")), asc=False), 1, 5).alias("tops"), F.max("best").alias("best"), F.max("worst").alias("worst"))
    found = materialize(found, "firsts")

    def before(d: pa.Table, q: pa.Table) -> pa.Table:
        n, counts = len(d), []
        if n and len(q):
            d = d.sort_by([("doc_id", "ascending")])
            ids = d["doc_id"].to_numpy()
            least = np.array([b["s"] * n + np.searchsorted(ids, b["doc"], "right") - 1 for b in q["best"].to_pylist()], dtype=np.float64)
            for at, s in similarities(q["vector"], d["vector"]):
                s *= n
                s += np.arange(n)
                counts.append(np.count_nonzero(s > least[at, None], axis=1))
        return pa.table({"query_id": q["query_id"] if counts else q["query_id"][:0], "ahead": pa.array(np.concatenate(counts) if counts else [], pa.int64())})

    asked = queries.select("query_id", "vector").join(found.where("best is not null").select("query_id", "best"), "query_id")
    ahead = by_blocks(docs.select("doc_id", "vector"), asked, [], before, f"query_id {kind(queries, 'query_id')}, ahead long", block).groupBy("query_id").agg((F.sum("ahead") + 1).alias("best_rank"))
    relevant = docs.groupBy(F.col("label").alias("query_label")).agg(F.count(F.lit(1)).alias("relevant"))
    hit = lambda k: (F.size(F.filter(F.slice("tops", 1, k), lambda t: t["hit"])) / F.col("relevant")).alias(f"r{k}")
    return found.join(relevant, "query_label", "left").join(ahead, "query_id", "left").select("query_id", "query_label", *map(hit, (1, 3, 5)), F.col("best_rank").alias("best"), F.coalesce(F.col("best") > F.col("worst"), F.lit(False)).alias("won"))


def ordered(pairs: DataFrame, queries: DataFrame, block: int | None = None) -> DataFrame:
    """One row: pairs, ordered: of the pairs (doc_id, label, vector, other_label, other) with a query (query_id, query_label,
    vector) of the first's label and not of the other's, how many there are, and how many of the first ones are nearer."""
    own = pairs.where("label <> other_label").select("doc_id", "label", "vector", "other")
    asked = queries.select("query_id", F.col("query_label").alias("label"), "vector")

    def met(d: pa.Table, q: pa.Table) -> pa.Table:
        n = 0
        if len(d) and len(q):
            for (_, a), (_, b) in zip(similarities(q["vector"], d["vector"]), similarities(q["vector"], d["other"]), strict=True):
                n += int(np.count_nonzero((a > b) & (b != NONE)))
        return pa.table({"pairs": [len(d) * len(q)], "ordered": [n]})

    return by_blocks(own, asked, ["label"], met, "pairs long, ordered long", block).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("ordered"), F.lit(0)).alias("ordered"))
