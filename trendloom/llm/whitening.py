"""Embedding whitening by a singular value decomposition with plane rotations.

Entries become whole numbers, the distinct vectors are the fit list, and its sums are exact. Centred rows are compressed
to a triangular factor R in blocks: each task folds its rows into one R, and Rs are stacked and factored again, a bounded
number a task, until one is left. That one, as large as the vectors are long, squared, is all that the driver gets beside the
sums. There plane rotations make R's columns orthogonal (one-sided Jacobi); their lengths are the singular values, and the
rotations, accumulated, are the components. No covariance is formed on this way, so small variances keep their digits.

Defined results: a null vector, and one that holds a null or an entry that isn't finite (or is 2^34 or more), takes no part; where
lengths differ, the vectors of the commonest length do (of several, the longest); equal rows each get theirs, and count
once in the fit; components without variance to working precision aren't returned (of one vector, or of equal ones, none
are); a deviation beyond a long is null; an empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm.common import materialize, small_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Entries from this on take no part, like those that aren't finite: their squares would leave nothing of the others.
MOST = 2.0**34
#: Rows folded into R at once, and Rs that one task stacks.
BLOCK, FAN_IN = 4096, 64
#: Rotations stop when no two columns' cosine exceeds this; sweeps at most.
TOLERANCE, SWEEPS = 1e-15, 60


class Fit(NamedTuple):
    """n rows with sums (exact); components as rows, by falling variance; their variances; all variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float


def whole_entries(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry; null where the vector, or an entry, is null or not below MOST."""
    x = vector.cast("array<double>")
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST))
    return F.when(x.isNotNull() & ok & (F.size(x) > 0), F.transform(x, lambda c: F.floor(c * SCALE) + SHIFT))


def entries(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows that take part."""
    rows = df.select(key, whole_entries(F.col(vector)).alias("x")).where("x is not null")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("x") == sizes[0].d) if sizes else rows


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(fit: DataFrame) -> tuple[int, np.ndarray]:
    """Number and sums of the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, sums = n + len(x), x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.int64()))], ["n", "sums"])

    part = fit.select("x").mapInArrow(run, "n long, sums array<long>").select("n", F.posexplode("sums").alias("pos", "s"))
    rows = part.groupBy("pos").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("pos").collect()
    return (rows[0].n, np.array([r.s for r in rows], np.int64)) if rows else (0, np.zeros(0, np.int64))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - sums, exact in whole numbers: large parts cancel before they are multiplied. What could pass 64 bits is
    done in Python's integers."""
    base, rest = sums // n, sums % n
    x = x - base
    if len(x) and n * (float(np.abs(x).max()) + 1) >= 2.0**62:
        return n * x.astype(object) - rest
    return n * x - rest


def _fold(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _factor(fit: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred fit list, up to the signs of its rows."""
    d = len(sums)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in (b for b in batches if b.num_rows):
            x = (centred(_matrix(batch.column(0)), n, sums) / n).astype(float)
            for a in range(0, len(x), BLOCK):
                r = _fold(r, x[a : a + BLOCK])
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()])], ["r"])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for x in batch.column(0):
                r = _fold(r, np.array(x.values).reshape(-1, d))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel().tolist()])], ["r"])

    found = materialize(fit.select("x").mapInArrow(blocks, "r array<double>"), "factors")
    left = found.count()
    while left > 1:
        tasks = -(-left // FAN_IN)
        # round robin deals them evenly
        found = materialize(found.repartition(tasks).mapInArrow(stack, "r array<double>"), "factors")
        left = found.count()
    return np.array(found.first().r).reshape(-1, d)


def _rounds(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns in rounds, each column once a round: all pairs in d - 1 rounds (d even)."""
    ring = np.arange(d)
    for _ in range(d - 1):
        left, right = ring[: d // 2], ring[d // 2 :][::-1]
        yield np.minimum(left, right), np.maximum(left, right)
        ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r and right singular vectors (as columns), largest first, by one-sided rotations. A round
    turns disjoint pairs of columns at once."""
    d = r.shape[1]
    even = d + d % 2
    a, v = np.zeros((len(r), even)), np.eye(even)
    a[:, :d] = r
    for _ in range(SWEEPS):
        turned = False
        for p, q in _rounds(even):
            x, y = a[:, p], a[:, q]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            need = np.abs(xy) > TOLERANCE * np.sqrt(xx * yy)
            if not need.any():
                continue
            turned = True
            p, q, xx, yy, xy = p[need], q[need], xx[need], yy[need], xy[need]
            with np.errstate(over="ignore"):
                zeta = (yy - xx) / (2 * xy)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    a, v = a[:, :d], v[:d, :d]
    sigma = np.sqrt((a * a).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def fit_of(x: DataFrame, most: int = COMPONENTS) -> Fit:
    """Fit to the distinct rows x: at most so many components as given, the largest first. Of each, the largest
    entry is positive."""
    n, sums = _totals(x)
    if not n:
        return Fit(0, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    sigma, v = jacobi(_factor(x, n, sums))
    held = int((sigma[:most] > sigma[:1] * max(n, len(sums)) * np.finfo(float).eps).sum()) if sigma[0] > 0 else 0
    found = v[:, :held].T
    found = found * np.where(found[np.arange(held), np.abs(found).argmax(axis=1)] < 0, -1.0, 1.0)[:, None] if held else found
    return Fit(n, sums, found, sigma[:held] ** 2 / n, float((sigma**2).sum()) / n)


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (centred(x, fit.n, fit.sums) / fit.n).astype(float) @ fit.components.T / np.sqrt(fit.variances)


def identity_error(x: DataFrame, fit: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(fit.variances)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                w = _whitened(_matrix(batch.column(0)), fit)
                gram += w.T @ w
                total += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel().tolist() + total.tolist()])], ["sums"])

    part = x.select("x").mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("pos", "s"))
    sums = np.array([r.s for r in part.groupBy("pos").agg(F.sum("s").alias("s")).orderBy("pos").collect()])
    mean = sums[k * k :] / fit.n
    return float(np.abs(sums[: k * k].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def _deviations(c: np.ndarray) -> pa.Array:
    """Sums of squares of each row, exact; null where one doesn't fit a long."""
    if len(c) and float(np.abs(c).max()) ** 2 * c.shape[1] >= 2.0**62:
        exact = [sum(int(v) ** 2 for v in row) for row in c.tolist()]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
    return pa.array((c * c).sum(axis=1))


def apply(rows: DataFrame, fit: Fit, key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened) of rows (key, x): whitened has an entry for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                white = _whitened(x, fit)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1], pa.int32()), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(centred(x, fit.n, fit.sums)), lists], [key, "deviation", "whitened"])

    return rows.select(key, "x").mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each row of df that takes part
    and each component, from 1."""
    small_batches(df.sparkSession, rows=BLOCK)
    rows = entries(df, key, vector)
    distinct = materialize(rows.select("x").distinct(), "fit-list")
    fit = fit_of(distinct, most)
    shape = f"`{key}` {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(fit.variances):
        return df.sparkSession.createDataFrame([], shape)
    explained = F.array(*(F.lit(float(e / fit.trace)) for e in fit.variances))
    each = apply(rows, fit, key).select(key, "deviation", F.posexplode("whitened").alias("pos", "white"))
    return each.select(key, (F.col("pos") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"), F.get(explained, F.col("pos")).alias("explained"), F.lit(identity_error(distinct, fit)).alias("identity_error"))


def whitening_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
