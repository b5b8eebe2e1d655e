"""Distributed union-find: forests within partitions, then alternating large and small stars until no edge changes.

A partition's edges become a forest of stars in numpy, in chunks of a bounded size, wherever an exchange has put
them; that is often all, since adaptive execution joins small partitions. Every round then groups edges by node
with a map-side minimum, and writes its edges to the shared folder. Neither edges nor components reach the driver;
the question whether all edges form stars does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import discard, materialize

#: Edges of a partition that are held at once.
CHUNK = 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges with the least node it is connected to, but for that one itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        # hooks on the roots, too, so that trees join as wholes
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            rest = label != np.arange(len(nodes))
            return nodes[rest], nodes[label[rest]]
        label = after


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush() -> pa.RecordBatch:
        found = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["u", "v"])

    for batch in batches:
        held.append(tuple(c.to_numpy() for c in batch.columns))
        n += batch.num_rows
        if n > CHUNK:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.repartition("v").mapInArrow(_contract, "u long, v long")


def _star(edges: DataFrame, least: DataFrame, keep) -> DataFrame:
    joined = edges.join(least, "u")
    return joined.where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours get its least neighbour, itself included."""
    ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _star(both, least, F.col("v") > F.col("u"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours get the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _star(down, least, F.lit(True)).union(least.select("u", F.col("m").alias("v"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two roots, and no root has one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for the nodes of edges (two long columns) that aren't roots themselves: root is the least node
    of the component. Loops, repeated edges and null ends are ignored; no edges give no rows; other columns are
    left out."""
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = materialize(_contracted(edges).distinct(), "edges")
    while not _stars(now):
        before, now = now, materialize(_contracted(_small(_large(now))).distinct(), "edges")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
