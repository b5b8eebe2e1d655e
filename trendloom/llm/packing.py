"""Packing by non-negative least squares.

Texts become token pieces of at most one window. The lengths' histogram (as many rows as a window has
tokens, at most) goes to the driver, which enumerates shallow combinations of lengths that fill a window,
solves for the repeat counts that come closest to the histogram, rounds them, and packs what is left over
greedily. The pieces never leave the executors: a piece finds its place from its rank among those of its
length, and ranks come from salted groups, so that a length that a third of all pieces have is no hot spot.

Defined results: a null text is an empty one; an empty text is its end token alone; repeated rows are packed
like others; an empty table gives no rows; columns besides doc_id and text are ignored by ``pieces_of`` and
kept by ``pack``.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendloom.llm.common import groups_of, materialize, set_aside, small_batches

WINDOW, END_ID = 2048, 1
#: Groups into which the pieces of one length are dealt for ranking.
SALTS = 256
#: Words whose ids a worker remembers (twice as many at most); beyond it they age, and go when as many newer ones
#: have come.
REMEMBERED = 400_000


def _splitter() -> re.Pattern:
    """The byte-level pre-tokenizer's pattern for texts below U+0250, with Unicode's classes written out."""
    low = [chr(c) for c in range(0x250)]
    letters, numbers = (re.escape("".join(c for c in low if unicodedata.category(c)[0] == k)) for k in "LN")
    spaces = re.escape("".join(c for c in low if c.isspace() and not "\x1c" <= c <= "\x1f"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes to id of a byte-level BPE model, if its ids rise with its merges: then the pair to merge next is
    the one whose token has the least id, and any implementation of that rule gives the tokenizer's ids."""
    vocabulary = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in pairs]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)) or min(made, default=0) < 0:
        return None
    # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    singles = {bytes([b]): vocabulary[c] for c, b in byte_of.items()}
    return singles | {bytes(byte_of[c] for c in a + b): i for (a, b), i in zip(pairs, made, strict=True)}


class Encoder:
    """Token ids as little-endian 32-bit bytes. Words are looked up; new ones are merged in one call for all,
    or by the tokenizer itself where its model isn't of the plain kind, as are texts beyond U+024F and those that
    hold one of its added tokens, such as an end-of-text mark."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.split, self.beyond = _splitter().findall, re.compile("[^\x00-ɏ]").search
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            ranks = byte_ranks(json.load(f)["model"])
        if ranks:
            import tiktoken

            self.merge = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.line = ranks[b"\n"]
        else:
            self.merge = None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words that the pre-tokenizer has cut."""
        plain = [w for w in words if "\n" not in w] if self.merge else []
        out: dict[str, bytes] = {}
        if plain:
            ids = np.array(self.merge("\n".join(plain)), "<u4")
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)) * 4
            raw, at = ids.tobytes(), 0
            for w, end in zip(plain, ends.tolist(), strict=True):
                out[w] = raw[at:end]
                at = end + 4
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, self._ids(rest), strict=True))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for a, b in groups_of([len(x) for x in texts], 1 << 20):
            part = texts[a:b]
            words = [None if self.beyond(x) or any(t in x for t in self.added) else self.split(x) for x in part]
            if len(self.known) > self.remembered:
                self.known, self.older = {}, self.known
            new = set().union(*(w for w in words if w)).difference(self.known)
            again = new.intersection(self.older)
            self.known.update((w, self.older[w]) for w in again)
            self.known.update(self._words(list(new - again)))
            for x, w in zip(part, words, strict=True):
                yield self._ids([x])[0] if w is None else b"".join(map(self.known.__getitem__, w))


@functools.lru_cache(maxsize=1)
def encoder_for(path: str, remembered: int) -> Encoder:
    """The worker's encoder, which the tasks it runs share."""
    return Encoder(path, remembered)


def pieces_of(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """For each row (doc_id, text): its ids and the end id, cut into pieces of window ids and a rest:
    doc_id, start, length, ids_crc32, doc_tokens."""
    small_batches(df.sparkSession)
    kind = df.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer_path, remembered)
        for batch in batches:
            owner, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode([x or "" for x in batch.column(1).to_pylist()])):
                ids += end
                n = len(ids) // 4
                for a in range(0, n, window):
                    part = ids[4 * a : 4 * (a + window)]
                    owner.append(i)
                    start.append(a)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names)

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(lengths: np.ndarray, window: int, spread: int = 6) -> list[tuple[int, ...]]:
    """Shallow combinations, one to three of the given lengths, each filled as far as the lengths allow.
    There are at most len(lengths) * (spread + 2) of them."""
    have, found = lengths.tolist(), set()

    def below(room: int) -> int | None:
        i = bisect.bisect_right(have, room)
        return have[i - 1] if i else None

    for a in have:
        b = below(window - a)
        if b is None:
            found.add((a,))
            continue
        found.add(tuple(sorted((a, b), reverse=True)))
        upto = bisect.bisect_right(have, window - a)
        for i in np.unique(np.linspace(0, upto - 1, spread).astype(int)).tolist():
            c = below(window - a - have[i])
            if c is not None:
                found.add(tuple(sorted((a, have[i], c), reverse=True)))
    return sorted(found, key=lambda p: (sum(p) - window, p))


def repeat_counts(patterns: list[tuple[int, ...]], lengths: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative x for which the patterns' lengths come closest to the histogram: min |D(Ax - h)|, where D
    weighs a length by 1/sqrt(count). Each round multiplies x by the ratio of the gradient's two parts, which
    keeps it non-negative and never makes the residual larger."""
    at = np.searchsorted(lengths, np.concatenate(patterns))
    of = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    weight, n = 1.0 / np.maximum(counts, 1), len(lengths)
    want = np.bincount(of, (weight * counts)[at], len(patterns))
    x = np.full(len(patterns), counts.sum() / max(1, len(at)))
    for _ in range(rounds):
        made = np.bincount(at, x[of], n)
        x *= want / np.maximum(np.bincount(of, (weight * made)[at], len(patterns)), 1e-12)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), which use up the histogram exactly."""
    out = [((window,), n) for k, n in histogram.items() if k == window and n]
    left = {k: n for k, n in histogram.items() if 0 < k < window and n > 0}
    if not left:
        return out
    lengths = np.array(sorted(left))
    patterns = combinations(lengths, window)
    solved = repeat_counts(patterns, lengths, np.array([left[k] for k in lengths.tolist()], float))
    for p, x in zip(patterns, np.rint(solved).astype(int).tolist(), strict=True):
        n = min(x, *(left[k] // p.count(k) for k in p))
        if n > 0 and window - sum(p) <= window // 64:
            out.append((p, n))
            for k in p:
                left[k] -= n
    have = sorted(k for k, n in left.items() if n)
    while have:
        used: dict[int, int] = {}
        room, top = window, len(have)
        while top := bisect.bisect_right(have, room, 0, top):
            k = have[top - 1]
            if used.get(k, 0) < left[k]:
                used[k] = used.get(k, 0) + 1
                room -= k
            else:
                top -= 1
        n = min(left[k] // m for k, m in used.items())
        out.append((tuple(sorted((k for k, m in used.items() for _ in range(m)), reverse=True)), n))
        for k, m in used.items():
            left[k] -= n * m
        have = [k for k in have if left[k]]
    return out


def _places(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """By length and rank: from which rank on, first sequence, copies in a sequence, offset, tokens used."""
    rows, begun, first = [], {}, 0
    for p, n in planned:
        offset = 0
        for k in sorted(set(p), reverse=True):
            m = p.count(k)
            rows.append((k << 40 | begun.get(k, 0), first, m, offset, sum(p)))
            begun[k] = begun.get(k, 0) + m * n
            offset += m * k
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "first", "copies", "offset", "used"), table.T.copy(), strict=True))


def ranked(df: DataFrame, length: str, order: list[str]) -> DataFrame:
    """df with rank_: 0, 1, ... among the rows of equal length. Salted groups are ranked on their own and
    shifted by the sizes of those before them."""
    df = df.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    group = [length, "salt_"]
    before = Window.partitionBy(length).orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*group).count().select(*group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base_"))
    own = df.withColumn("row_", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return own.join(base, group).withColumn("rank_", F.col("base_") + F.col("row_") - 1).drop("salt_", "row_", "base_")


def pack(pieces: DataFrame, length: str = "length", order: tuple[str, ...] = ("doc_id", "start", "ids_crc32"), window: int = WINDOW) -> DataFrame:
    """pieces (lengths from 1 to window) with sequence_id, offset and sequence_length: window, or the tokens
    used where they are a power of two; these three replace columns of their names, and other columns are kept
    whatever their names. A row whose length is null or out of bounds raises an error; no pieces give no rows, and
    equal pieces take places of their own."""
    pieces, back = set_aside(pieces.drop("sequence_id", "offset", "sequence_length"), ("salt_", "row_", "base_", "rank_", "count"))
    pieces = materialize(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(k is None or not 0 < k <= window for k in histogram):
        raise ValueError(f"lengths must be from 1 to {window}")
    places = _places(plan(histogram, window))
    schema = StructType(list(pieces.schema.fields))
    at = pieces.columns.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(at).to_numpy().astype(np.int64)
            rank = batch.column(batch.num_columns - 1).to_numpy().astype(np.int64)
            row = np.searchsorted(places["key"], k << 40 | rank, "right") - 1
            nth, copies, used = (k << 40 | rank) - places["key"][row], places["copies"][row], places["used"][row]
            more = (places["first"][row] + nth // copies, places["offset"][row] + nth % copies * k, np.where(used & (used - 1), window, used))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, more)], [*batch.schema.names[:-1], "sequence_id", "offset", "sequence_length"])

    shape = schema.add("sequence_id", "long").add("offset", "long").add("sequence_length", "long")
    return ranked(pieces, length, list(order)).select(*pieces.columns, "rank_").mapInArrow(run, shape).withColumnsRenamed(back)


def pack_documents(df: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, remembered: int = REMEMBERED) -> DataFrame:
    """The pieces of df's texts (doc_id, text; other columns are left out) in sequences."""
    return pack(pieces_of(df, tokenizer_path, window, end_id, remembered), window=window)
