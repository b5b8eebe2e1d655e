"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text's terms are pairs of neighbouring character classes over the whole text, and a few shape terms (how
varied, how loud, how broken up it is). Their logarithmic counts are weighted by inverse document frequency
and projected on the leading singular vectors of a bounded labelled sample. The sample's vectors and labels go
to all tasks; every text gets exact cosine products with all of them, in blocks, and its nearest neighbours
vote for their labels with their similarity.

Defined results: a text without terms (null or empty) gets the sample's share of label 1, as does every text
where no row is labelled 0 and 1 (without any labels: 0); equal texts get equal scores; repeated labels of a
document all count; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import crc_of, groups_of, small_batches

#: Labelled rows in the sample at most (about), size of the vectors, neighbours that vote.
SAMPLE_ROWS, DIMENSIONS, NEIGHBOURS = 4000, 32, 15
_CLASSES = 64


def _class_table() -> np.ndarray:
    """Character classes: a letter each for a-z, one for A-Z, digits, three for white space, one for each
    ASCII punctuation mark, one for all the rest."""
    out = np.full(256, 30, np.uint16)
    out[97:123], out[65:91], out[48:58], out[32], out[10] = np.arange(26), 26, 27, 28, 29
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    out[marks] = np.arange(31, 31 + len(marks))
    out[128:] = 63
    return out


_TABLE = _class_table()
_SHAPES, _STEPS = 5, 16
TERMS = _CLASSES * _CLASSES + _SHAPES * _STEPS


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Weighted counts of each text's terms, a row each: log(1 + count) for pairs, a constant for shape terms."""
    raws = [(x or "").encode() for x in texts]
    out = np.zeros((len(raws), TERMS), np.float32)
    for a, b in groups_of([len(r) for r in raws], 1 << 20):
        # a text's bytes are followed by one separator, whose pairs are left out
        data = np.frombuffer(b"\0".join(raws[a:b]) + b"\0", np.uint8)
        code = _TABLE[data].astype(np.int64)
        owner = np.repeat(np.arange(b - a), [len(r) + 1 for r in raws[a:b]])
        ends = np.cumsum([len(r) + 1 for r in raws[a:b]]) - 1
        inner = np.ones(len(data) - 1, bool)
        inner[ends[:-1]] = False
        inner[ends - 1] = False
        pair = (owner[:-1] * _CLASSES + code[:-1]) * _CLASSES + code[1:]
        counts = np.bincount(pair[inner], minlength=(b - a) * _CLASSES * _CLASSES).reshape(b - a, -1).astype(np.float32)
        total = counts.sum(axis=1)
        some = np.maximum(total, 1)
        single = counts.reshape(b - a, _CLASSES, _CLASSES).sum(axis=2)
        share = counts / some[:, None]
        entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
        letters = np.maximum(single[:, :27].sum(axis=1), 1)
        # how varied, as a share of what a text of this length can be
        shapes = (entropy / np.minimum(np.log2(some + 1), 8.5), single[:, 26] / letters, single[:, 31:63].sum(axis=1) / some * 4, single[:, 27] / some * 8, single[:, 28] / some * 3)
        block = out[a:b]
        block[:, : _CLASSES * _CLASSES] = np.log1p(counts)
        norm = np.sqrt((block * block).sum(axis=1))
        for k, value in enumerate(shapes):
            place = np.clip(value, 0, 1) * (_STEPS - 1)
            low = np.floor(place).astype(int)
            at = _CLASSES * _CLASSES + k * _STEPS
            rows = np.flatnonzero(total > 0)
            block[rows, at + low[rows]] += (norm * (1 - (place - low)))[rows]
            block[rows, at + np.minimum(low + 1, _STEPS - 1)[rows]] += (norm * (place - low))[rows]
    return out


class Voter:
    """Latent-semantic vectors of a labelled sample, and the vote of the nearest."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS):
        self.prior, self.labels, self.neighbours = float(labels.mean()), labels.astype(np.float32), min(neighbours, len(labels))
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = self._weighted(counts)
        # leading right singular vectors by subspace iteration, from a fixed start
        q = np.random.default_rng(5).standard_normal((x.shape[1], min(dimensions, *x.shape))).astype(np.float32)
        for _ in range(8):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        self.project = q.astype(np.float32)
        self.vectors = self._unit(x @ self.project).T.copy()

    def _weighted(self, counts: np.ndarray) -> np.ndarray:
        return self._unit(counts * self.idf)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        near = self._unit(self._weighted(counts) @ self.project) @ self.vectors
        top = np.argpartition(near, -self.neighbours, axis=1)[:, -self.neighbours :]
        weight = np.maximum(np.take_along_axis(near, top, 1), 0) ** 8
        total = weight.sum(axis=1)
        vote = (weight * self.labels[top]).sum(axis=1)
        return np.where((total > 1e-9) & counts.any(axis=1), vote / np.maximum(total, 1e-9), self.prior)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Voter | None:
    """A voter from docs (doc_id, text) and labels (doc_id, quality), about most rows of them at most."""
    small_batches(docs.sparkSession)
    marked = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    n = marked.count()
    if not n:
        return None
    key = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / float(1 << 53)
    chosen = marked.where(key < min(1.0, most / n))
    rows = docs.select("doc_id", "text").where(key < min(1.0, most / n)).join(chosen, "doc_id").select("text", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = term_counts(batch.column(0).to_pylist())
            at = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays([pa.array([a.astype("<u2").tobytes() for a in at]), pa.array([c[a].astype("<f4").tobytes() for a, c in zip(at, counts, strict=True)]), batch.column(1)], ["at", "value", "quality"])

    got = rows.mapInArrow(run, "at binary, value binary, quality int").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.quality, bytes(r.at), bytes(r.value)))
    counts = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        counts[i, np.frombuffer(r.at, "<u2")] = np.frombuffer(r.value, "<f4")
    return Voter(counts, np.array([r.quality for r in got]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. The voter learns from labels of rows whose crc32 mod 5 isn't 0."""
    small_batches(docs.sparkSession)
    voter = learn(docs, labels.where(crc_of(F.col("doc_id")) % 5 != 0))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if voter is None:
                found = np.zeros(len(texts))
            else:
                found = np.concatenate([np.zeros(0), *(voter.scores(term_counts(texts[a : a + 128])) for a in range(0, len(texts), 128))])
            found = np.clip(found.astype(np.float64), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found), pa.array((found >= 0.3).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (crc_of(F.col("doc_id")) % 5 == 0).alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
