"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the shortest string from its start that is no phrase yet). The
phrases' hashes fall into bins, and the least hash of each bin makes the fingerprint: texts that compress
alike share phrases, and so minima. The likeness of two fingerprints is the share of equal minima among the
bins that either fills, an estimate of the phrase sets' Jaccard index (0 to 1).

Defined results: null is an empty text; an empty text's fingerprint has no minima, its likeness is 1 to
another such and 0 to all others; equal texts have equal fingerprints; rows of equal doc_id follow each other
in the order of their texts; null doc_ids come first; doc_id is an integer; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from trendloom.llm.common import mix64, powers, small_batches

#: Bins of a fingerprint (a power of two); each minimum keeps 16 bits, of which 0 marks an empty bin.
BINS = 128
#: Rows of a range of neighbouring ids, about, and ranges at most (their bounds go to every task).
RANGE_ROWS, RANGES = 1000, 10_000
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _parse(text: str, known: set[str], begun: str, ends: list[int], at: int) -> str:
    """Go on parsing with text, which starts at position at: ends gets where each new phrase ends. Returns the
    phrase that is still open."""
    add, put = known.add, ends.append
    for i, c in enumerate(text, at + 1):
        begun += c
        if begun not in known:
            add(begun)
            put(i)
            begun = ""
    return begun


def _phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """64-bit hashes of the phrases that end there; each begins where the one before ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * powers(len(codes), _BASE), out=sums[1:])
    last = np.array(ends, np.int64)
    first = np.concatenate([[0], last[:-1]])
    return mix64((sums[last] - sums[first]) * powers(len(codes) + 1, _BASE_INV)[first] + (last - first).astype(np.uint64))


def _minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin, as 16 bits; a bin is an equal range of hashes."""
    out = np.zeros(BINS, np.uint16)
    if len(hashes):
        hashes = np.sort(hashes)
        bins = (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
        lead = np.concatenate([[True], bins[1:] != bins[:-1]])
        out[bins[lead]] = (hashes[lead] & np.uint64(0xFFFF)) % np.uint64(65535) + np.uint64(1)
    return out


def fingerprint(text: str) -> np.ndarray:
    ends: list[int] = []
    if _parse(text, set(), "", ends, 0):
        ends.append(len(text))
    return _minima(_phrase_hashes(text, ends)) if ends else np.zeros(BINS, np.uint16)


def fingerprints(text: str, tail: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Fingerprints of text and of its edited text, whose last half is replaced by as much of tail; and the
    edited text. The half they share is parsed once."""
    half = len(text) // 2
    cut = len(text) - half
    edited = text[:cut] + tail[:half]
    known: set[str] = set()
    ends: list[int] = []
    begun = _parse(text[:cut], known, "", ends, 0)
    other, other_ends = known.copy(), ends.copy()
    if _parse(text[cut:], known, begun, ends, cut):
        ends.append(len(text))
    if _parse(edited[cut:], other, begun, other_ends, cut):
        other_ends.append(len(edited))
    empty = np.zeros(BINS, np.uint16)
    return _minima(_phrase_hashes(text, ends)) if ends else empty, _minima(_phrase_hashes(edited, other_ends)) if other_ends else empty, edited


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = int(np.count_nonzero(a | b))
    return float(np.count_nonzero((a == b) & (a > 0)) / some) if some else 1.0


def to_text(minima: np.ndarray) -> str:
    return minima.astype(">u2").tobytes().hex()


def with_neighbours(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with order_ (the id as a number), range_ and place_, dealt by range_: a task that
    reads a range in order also finds the row that follows its last, since the first row of each range is
    copied behind the range before it (place_ 1), and that of the first range behind the last. Only ids are
    looked at to lay out the ranges; their bounds and first ids, RANGES at most, go to the tasks."""
    least = -(1 << 63)
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("order_"))
    ids = docs.select("order_")
    n = ids.count()
    ranges = int(min(RANGES, max(1, n // RANGE_ROWS)))
    found = ids.select(F.percentile_approx("order_", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else []
    bounds = np.array(sorted(set(found or [])), np.int64)

    def heads_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.sort(batch.column(0).to_numpy())
            at, first = np.unique(np.searchsorted(bounds, order), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(order[first], pa.int64())], ["range_", "head_"])

    heads = sorted(map(tuple, ids.mapInArrow(heads_of, "range_ long, head_ long").groupBy("range_").agg(F.min("head_")).collect()))
    head = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column(2).to_numpy()
            copied = [(i, head[k]) for i, k in enumerate(order.tolist()) if k in head]
            rows = np.concatenate([np.arange(len(order)), np.array([i for i, _ in copied], np.int64)])
            at = np.concatenate([np.searchsorted(bounds, order), np.array([k for _, k in copied], np.int64)])
            side = np.repeat([0, 1], [len(order), len(copied)])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), pa.array(at, pa.int64()), pa.array(side, pa.int32())], [*batch.schema.names, "range_", "place_"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = docs.mapInArrow(place, f"doc_id {kind}, text string, order_ long, range_ long, place_ int")
    return placed.repartition("range_").sortWithinPartitions("range_", "place_", "order_", "text")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Rows of the result. A row waits for the text that follows it, and then for that one's minima."""
        waiting = done = None  # (range, id, text); (row without near_next, minima)
        for batch in batches:
            for who, text, where, side in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                text = text or ""
                if waiting is not None and waiting[0] == where:
                    own, other, edited = fingerprints(waiting[2], text)
                    row = (waiting[1], len(waiting[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(other), likeness(own, other))
                    if done is not None:
                        yield *done[0], likeness(done[1], own)
                    done, waiting = (row, own), None
                if side == 0:
                    waiting = (where, who, text)
                elif done is not None:
                    yield *done[0], likeness(done[1], fingerprint(text))
                    done = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True))], names)

        for row in finished(batches):
            held.append(row)
            if len(held) >= 500:
                yield flush()
        if held:
            yield flush()

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    return with_neighbours(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
