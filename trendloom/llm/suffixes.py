"""Removal of long repeats with a logarithmic family of sparse suffix arrays.

An entry of a suffix array is an anchor: the place of the least hash of a gram within some window of ``length``
bytes. Equal windows have their anchors at equal places, so entries for these places alone find all repeats
of that length. A new batch of texts gets a suffix array: its entries in order of the suffix's first bytes, then
of the hash of its gram, dealt over tasks by ranges of that order. It is merged with all existing levels into one
order and scanned once: entries with a common gram are neighbours there, and where one of them is new and their
places differ, there is a long match. Two levels of one rank merge into one of the next, so n batches leave about
log2(n) levels.

Only windows at matched grams are then compared, by hash of all their bytes: first whole runs of windows with
equal surroundings, then, for what is left, window by window.

Defined results: null is an empty text; texts shorter than ``length`` lose nothing; a text with an equal one
in another row loses all its bytes (if it is that long), also where the rows have the same doc_id; an empty
table gives no rows; extra columns are ignored. Texts and windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import PrefixHash, discard, groups_of, materialize, small_batches

LENGTH, GRAM = 400, 128
#: Batches in which the registered query adds its table; bytes of text at one gram that a task holds at most.
BATCHES, HELD = 3, 8_000_000
#: Suffix order; the place breaks ties, so that ranges may cut through a gram that a third of all entries share.
_ORDER = ("head", "gram", "sign", "low")
_SLOT_BITS = 20
_ENTRY = "head long, gram long, sign long, at int, low int, high int, around long"


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: suffix minima of one block meet prefix minima of the next."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def entries(raws: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Sparse suffix entries of some texts: which text, head, gram, at, low, high, around. Windows low to high
    of the text have their anchor at ``at``; around is the hash of all their bytes."""
    for a, b in groups_of([len(r) for r in raws], 1 << 20):
        data = np.frombuffer(b"".join(raws[a:b]), np.uint8)
        size = np.array([len(r) for r in raws[a:b]], np.int64)
        if not (size >= length).any():
            continue
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        hashes = PrefixHash(data)
        places = np.arange(len(data) - gram + 1)
        grams = hashes.of(places, places + gram)
        bits = np.uint64(len(data).bit_length())
        anchor = (_window_minima(grams >> bits << bits | places.astype(np.uint64), length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(len(anchor) + 2, bool)
        for s, n in zip(start.tolist(), size.tolist(), strict=True):
            if n >= length:
                inside[s + 1 : s + n - length + 2] = True
        turn = np.concatenate([[True], anchor[1:] != anchor[:-1], [True]])
        low = np.flatnonzero(inside[1:-1] & (turn[:-1] | ~inside[:-2]))
        high = np.flatnonzero(inside[1:-1] & (turn[1:] | ~inside[2:]))
        at = anchor[low]
        owner = np.searchsorted(start, low, "right") - 1
        # texts of no bytes share a start with the next; the last of them is the one meant
        head = np.zeros(len(at), np.int64)
        for j in range(7):
            head = head << 8 | data[at + j]
        base = start[owner]
        yield owner + a, head, grams[at].view(np.int64), at - base, low - base, high - base, hashes.of(low, high + length).view(np.int64)


def sparse_suffixes(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Entries of texts (sign, text), as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _ENTRY.split(", ")]
        for batch in batches:
            once = {s: x for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if len(x) * 4 >= length}
            signs = np.array(list(once), np.int64)
            for owner, head, grams, at, low, high, around in entries([x.encode("utf-8", "surrogatepass") for x in once.values()], length, gram):
                small = (pa.array(c, pa.int32()) for c in (at, low, high))
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(grams), pa.array(signs[owner]), *small, pa.array(around)], names)

    return texts.select("sign", "text").mapInArrow(run, _ENTRY)


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows in suffix order, a range of it in each task."""
    return rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)


_RUN = "head long, gram long, new boolean, sign_a long, low_a long, sign_b long, low_b long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a range of entries (head, gram, sign, low, new) in suffix order. Runs of neighbours with a
    common gram, with their first and last place, if they are matches; the first and the last run of the range in
    any case, since they may go on in the ranges beside it. Only the run at hand is held."""
    names = [c.split()[0] for c in _RUN.split(", ")]

    def batch_of(runs: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "new" else pa.int64()) for c, n in zip(runs, names, strict=True)], names)

    held, edge = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        head, gram, sign, low, new = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        lead = np.flatnonzero(np.concatenate([[True], (head[1:] != head[:-1]) | (gram[1:] != gram[:-1])]))
        last = np.append(lead[1:], len(head)) - 1
        runs = [head[lead], gram[lead], np.logical_or.reduceat(new, lead), sign[lead], low[lead], sign[last], low[last]]
        if held is not None and held[0] == head[0] and held[1] == gram[0]:
            runs[2][0] |= held[2]
            runs[3][0], runs[4][0] = held[3], held[4]
        elif held is not None:
            runs = [np.append(h, c) for h, c in zip(held, runs, strict=True)]
        held, runs = [c[-1] for c in runs], [c[:-1] for c in runs]
        hit = runs[2].astype(bool) & ((runs[3] != runs[5]) | (runs[4] != runs[6]))
        if edge and len(hit):
            hit[0], edge = True, False
        if hit.any():
            yield batch_of([c[hit] for c in runs])
    if held is not None:
        yield batch_of([np.array([x]) for x in held])


class SuffixIndex:
    """Levels of sparse suffix arrays in the shared folder, by rank."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self.levels: dict[int, DataFrame] = {}

    def add(self, texts: DataFrame) -> DataFrame:
        """Index texts (sign, text), and return the grams (gram) for which they have a match, among themselves
        or in the levels."""
        raw = materialize(sparse_suffixes(texts, self.length, self.gram), "entries")
        new = materialize(_in_order(raw), "suffixes")
        discard(raw)
        both = new.select(*_ORDER, F.lit(True).alias("new"))
        for level in self.levels.values():
            both = both.union(level.select(*_ORDER, F.lit(False).alias("new")))
        runs = _in_order(both).mapInArrow(_neighbours, _RUN)
        # a run that ranges cut is put together here
        met = runs.groupBy("head", "gram").agg(F.min(F.struct("sign_a", "low_a")).alias("a"), F.max(F.struct("sign_b", "low_b")).alias("b"), F.max("new").alias("new"))
        found = materialize(met.where("new and (a.sign_a <> b.sign_b or a.low_a <> b.low_b)").select("gram"), "matches")
        rank, merged = 0, [new]
        while rank in self.levels:
            merged.append(self.levels.pop(rank))
            rank += 1
        if rank:
            array = new
            for level in merged[1:]:
                array = array.union(level)
            new = materialize(_in_order(array), "suffixes")
            discard(*merged)
        self.levels[rank] = new
        return found

    def all(self) -> DataFrame:
        out, *rest = self.levels.values()
        for x in rest:
            out = out.union(x)
        return out


def _near(texts: DataFrame, signs: DataFrame, kind: str) -> DataFrame:
    """Texts whose slot is (not) taken by one of signs: a bounded table, 2**20 rows at most, tells."""
    slot = F.pmod(F.xxhash64("sign"), F.lit(1 << _SLOT_BITS))
    taken = F.broadcast(signs.select(slot.alias("slot_")).distinct())
    return texts.join(taken, slot == F.col("slot_"), kind)


def repeated_windows(texts: DataFrame, matched: DataFrame, length: int) -> DataFrame:
    """(sign, low, high): runs of windows that also start elsewhere. texts: (sign, text), one row a sign or
    more; matched: the entries at matched grams."""
    key = ["gram", "around", "lead", "span"]
    place = F.struct("sign", "low")
    matched = matched.withColumns({"lead": F.col("at") - F.col("low"), "span": F.col("high") - F.col("low")})
    alike = matched.groupBy(*key).agg(F.min(place).alias("one"), F.max(place).alias("last")).withColumn("many", F.col("one") != F.col("last"))
    alike = materialize(alike, "alike")
    whole = matched.join(alike.where("many").select(*key), key, "left_semi").select("sign", "low", "high")
    open_grams = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("many").alias("settled")).where("n > 1 and not settled").select("gram")
    asked = alike.join(open_grams, "gram", "left_semi").select("gram", "one.sign", "one.low", "span", "many")
    asked = materialize(asked, "asked")
    cuts = asked.groupBy("sign").agg(F.collect_list(F.struct("gram", "low", "span", "many")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sign, text, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["gram"], sign, x["low"], x["many"], raw[x["low"] : x["low"] + x["span"] + length]) for x in asks]
            for a in range(0, len(rows), 5000):
                part = list(zip(*rows[a : a + 5000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), strict=True)], ["gram", "sign", "low", "many", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of windows that occur twice within their gram; where a gram's bytes are too many for a task,
        the hash of each window, which a later stage groups."""
        held: list[tuple] = []

        def windows(rows: list[tuple]) -> tuple[np.ndarray, ...]:
            size = np.array([len(r[4]) for r in rows])
            base = np.concatenate([[0], np.cumsum(size)[:-1]])
            per = size - length + 1
            of = np.repeat(np.arange(len(rows)), per)
            nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            at = base[of] + nth
            return PrefixHash(np.frombuffer(b"".join(r[4] for r in rows), np.uint8)).of(at, at + length), of, nth

        def batch_of(sign, low, high, window) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sign, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(window, pa.int64())], ["sign", "low", "high", "window"])

        def settle(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            hashes, of, nth = windows(rows)
            many = np.array([r[3] for r in rows])
            _, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
            weight = np.bincount(back, many[of], len(count)) + count
            hit = (weight[back] > 1) & ~many[of]
            lead = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (of[1:] == of[:-1])]))
            stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (of[1:] == of[:-1]), [False]]))
            low = np.array([r[2] for r in rows], np.int64)[of[lead]]
            yield batch_of([rows[i][1] for i in of[lead].tolist()], low + nth[lead], low + nth[stop], pa.nulls(len(lead), pa.int64()))

        def loose(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            hashes, of, nth = windows(rows)
            low = np.array([r[2] for r in rows], np.int64)[of] + nth
            # low -1 marks a window of surroundings that occur twice: a witness, not a question
            low = np.where(np.array([r[3] for r in rows])[of], -1, low)
            yield batch_of(np.array([r[1] for r in rows], np.int64)[of], low, low, hashes.view(np.int64))

        total, gram, first, large = 0, None, 0, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != gram:
                    if large:
                        yield from loose(held)
                        held, total, large = [], 0, False
                    elif total > 1_000_000:
                        yield from settle(held)
                        held, total = [], 0
                    gram, first = row[0], len(held)
                held.append(row)
                total += len(row[4])
                if total > HELD:
                    yield from settle(held[:first])
                    yield from loose(held[first:])
                    held, total, first, large = [], 0, 0, True
        yield from loose(held) if large else settle(held)

    pieces = _near(texts, asked, "left_semi").join(cuts, "sign").select("sign", "text", "cuts").mapInArrow(cut, "gram long, sign long, low int, many boolean, bytes binary")
    found = pieces.repartition("gram").sortWithinPartitions("gram").mapInArrow(compare, "sign long, low long, high long, window long")
    found = materialize(found, "windows")
    single = found.where("window is not null")
    twice = single.groupBy("window").agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("least")).where("n > 1 or least < 0").select("window")
    single = single.where("low >= 0").join(twice, "window", "left_semi").select("sign", "low", "high")
    return whole.select("sign", F.col("low").cast("long"), F.col("high").cast("long")).union(found.where("window is null").select("sign", "low", "high")).union(single)


def _spans(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text) with spans: the byte ranges of each text that are covered by a string of length
    bytes which also starts elsewhere; null where there are none."""
    if not 8 <= gram <= length:
        raise ValueError("gram must be from 8 to length")
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("sign", F.xxhash64("text"))
    known = texts.groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(F.octet_length("text")).alias("size"))
    copies = materialize(known.where(F.col("n") > 1), "copies")
    index, grams = SuffixIndex(length, gram), None
    for i in range(batches):
        found = index.add(texts.where(F.pmod(F.xxhash64(F.lit("batch"), "sign"), F.lit(batches)) == i))
        grams = found if grams is None else grams.union(found)
    matched = materialize(index.all().join(grams.distinct(), "gram", "left_semi").dropDuplicates(["sign", "low"]), "matched")
    # one row of each text is enough here
    windows = repeated_windows(_first_rows(texts, copies).select("sign", "text"), matched, length)
    windows = windows.union(copies.where(F.col("size") >= length).select("sign", F.lit(0).cast("long"), (F.col("size") - length).cast("long")))
    ranges = materialize(windows.groupBy("sign").agg(F.sort_array(F.collect_list(F.struct("low", F.expr(f"high + {length}").alias("end")))).alias("ranges")), "ranges")
    clean = _near(texts, ranges, "left_anti").select("doc_id", "text", F.lit(None).cast("array<struct<low:bigint,end:bigint>>").alias("ranges"))
    hit = _near(texts, ranges, "left_semi").join(ranges, "sign", "left").select("doc_id", "text", "ranges")
    return clean.union(hit)


def _first_rows(texts: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows of texts without those copies that aren't of their text's least doc_id. (Rows of equal doc_id and
    text stay; later stages take each text once.)"""
    rest = copies.select(F.col("sign").alias("sign_"), "least")
    alone = _near(texts, copies, "left_anti")
    some = _near(texts, copies, "left_semi").join(rest, F.col("sign") == F.col("sign_"), "left").where("least is null or doc_id is null or doc_id = least")
    return alone.select("doc_id", "text", "sign").union(some.select("doc_id", "text", "sign"))


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                spans = _spans([(r["low"], r["end"]) for r in ranges or []])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names)

    return remove_repeats(docs, length).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
