"""Language identification with a byte convolutional network.

A text's bytes are cut into windows of fixed length. Filters of several widths slide over a window; each
filter's maximum is pooled, and a softmax layer turns the pooled values into language probabilities. The
network is trained here, in numpy, on a bounded sample of labelled windows; every window of every text is
then classified in batches, and a text gets the mean of its windows' probabilities, weighted by their letters.

Defined results: a text that is null or has no letter is 'und' with score 0; without labelled rows all texts
are; equal texts get equal results; extra columns are kept by ``identify``, but for those named like its own,
which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trendloom.llm.common import bounded_sample, crc_of, small_batches

#: Bytes of a window; widths of the filters, and how many have each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Labelled rows used for training at most, spread over the languages, and windows taken from each.
TRAIN_ROWS, WINDOWS_EACH = 3000, 4
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[195:] = True


class ByteConvNet:
    """Filters are tables: ``tables[w][j]`` has the weight of each byte at place j for the filters of width w."""

    def __init__(self, languages: list[str], widths: tuple[int, ...] = WIDTHS, filters: int = FILTERS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.filters = languages, widths, filters
        self.tables = {w: (rng.standard_normal((w, 256, filters)) * 0.3).astype(np.float32) for w in widths}
        self.weight = (rng.standard_normal((len(widths) * filters, len(languages))) * 0.1).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)
        self.pairs: dict[int, list[np.ndarray]] = {}

    def _convolve(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter values at all places of windows x, an array (windows, places, filters) for each width."""
        n, out = x.shape[1], []
        for w in self.widths:
            table = self.tables[w]
            total = table[0].take(x[:, : n - w + 1], axis=0)
            for j in range(1, w):
                total += table[j].take(x[:, j : n - w + 1 + j], axis=0)
            out.append(total)
        return out

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.weight + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy. Through max pooling a filter learns at its best place alone."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.weight, self.bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), batch):
                part = order[a : a + batch]
                rows, goal = x[part], y[part]
                values = self._convolve(rows)
                best = [v.argmax(axis=1) for v in values]
                pooled = np.concatenate([np.take_along_axis(v, b[:, None], 1)[:, 0] for v, b in zip(values, best, strict=True)], axis=1)
                slope = self._softmax(pooled)
                slope[np.arange(len(part)), goal] -= 1
                slope /= len(part)
                grads = []
                back = slope @ self.weight.T * (pooled > 0)
                for i, (w, b) in enumerate(zip(self.widths, best, strict=True)):
                    own, grad = back[:, i * self.filters : (i + 1) * self.filters], np.zeros_like(self.tables[w])
                    for j in range(w):
                        at = np.take_along_axis(rows, b + j, 1).astype(np.int64) * self.filters + np.arange(self.filters)
                        grad[j] = np.bincount(at.ravel(), own.ravel(), 256 * self.filters).reshape(256, self.filters)
                    grads.append(grad)
                grads += [np.maximum(pooled, 0).T @ slope, slope.sum(axis=0)]
                step += 1
                for p, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def _pair_tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables over byte pairs (and one byte where the width is odd): half the look-ups."""
        if not self.pairs:
            for w, table in self.tables.items():
                self.pairs[w] = [(table[j + 1][None] + table[j][:, None]).reshape(65536, -1) for j in range(0, w - 1, 2)] + ([table[w - 1]] if w % 2 else [])
        return self.pairs

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of windows x (windows, bytes)."""
        pairs, n, pooled = self._pair_tables(), x.shape[1], []
        both = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        for w in self.widths:
            tables, places = pairs[w], n - w + 1
            total = tables[0].take(both[:, :places], axis=0)
            for i, t in enumerate(tables[1:], 1):
                j = 2 * i
                total += t.take((both if len(t) > 256 else x)[:, j : j + places], axis=0)
            pooled.append(total.max(axis=1))
        return self._softmax(np.concatenate(pooled, axis=1))


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with spaces."""
    return np.frombuffer(raw + b" " * (-len(raw) % WINDOW), np.uint8).reshape(-1, WINDOW)


def train(df: DataFrame, rows: int = TRAIN_ROWS) -> ByteConvNet | None:
    """A network for the non-null languages of df (doc_id, text, lang), or None where there are none. At most
    about 1.5 * rows texts give windows, at places spread over the whole text."""
    labelled = df.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    n = F.length("text")
    places = [F.substring("text", F.greatest(F.lit(1), ((n - WINDOW) * (k / max(1, WINDOWS_EACH - 1))).cast("int") + 1), F.lit(WINDOW)) for k in range(WINDOWS_EACH)]
    got = bounded_sample(labelled, "lang", rows).select("lang", F.array_distinct(F.array(*places)).alias("parts")).collect()
    pairs = sorted((r.lang, p) for r in got for p in r.parts if any(map(str.isalpha, p)))
    if not pairs:
        return None
    net = ByteConvNet(sorted({k for k, _ in pairs}))
    x = np.concatenate([windows_of(p.lower().encode())[:1] for _, p in pairs])
    net.fit(x, np.array([net.languages.index(k) for k, _ in pairs]))
    return net


def predict(net: ByteConvNet, texts: list[str | None], most: int = 192) -> tuple[list[str], list[float]]:
    """Language and score of each text, over all its windows; most windows at a time."""
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    waiting: list[tuple[int, np.ndarray]] = []
    sums = np.zeros((len(texts), len(net.languages)))

    def flush() -> None:
        x, owner = np.concatenate([w for _, w in waiting]), np.repeat([i for i, _ in waiting], [len(w) for _, w in waiting])
        np.add.at(sums, owner, net.probabilities(x) * (_LETTER[x].sum(axis=1)[:, None] + 0.01))
        waiting.clear()

    held = 0
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            continue
        rows = windows_of(text.lower().encode())
        for a in range(0, len(rows), most):
            waiting.append((i, rows[a : a + most]))
            held += len(waiting[-1][1])
            if held >= most:
                flush()
                held = 0
        langs[i] = ""
    if waiting:
        flush()
    for i, lang in enumerate(langs):
        if not lang:
            k = int(sums[i].argmax())
            langs[i], scores[i] = net.languages[k], float(sums[i, k] / sums[i].sum())
    return langs, scores


def identify(df: DataFrame, net: ByteConvNet | None) -> DataFrame:
    """df with lang_pred and score."""
    small_batches(df.sparkSession)
    df = df.drop("lang_pred", "score")
    if net is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    at = df.columns.index("text")
    shape = StructType([*df.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, shape)


def language_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. The network learns from rows whose crc32 mod 3 isn't 1."""
    net = train(docs.where(crc_of(F.col("doc_id")) % 3 != 1))
    held = docs.select("doc_id", "text", (crc_of(F.col("doc_id")) % 3 == 1).alias("held_out"))
    return identify(held, net).select("doc_id", "held_out", "lang_pred", "score")
