"""N-gram Jaccard join with parity sketches.

A document's set is its distinct word shingles. Hashing every shingle into a bit sketch by XOR makes the
Hamming distance of two sketches a lower bound of the sets' symmetric difference, and two sets that link differ
in at most D = (1 - t) / (1 + t) * (n_a + n_b) shingles. So:

1. Sets are hashed to one number each; equal sets are one class from here on.
2. For each band of sizes a sketch has more blocks than a linked pair can differ in, so some block is equal
   in both: classes are joined on (band, block, the block's parity word and count). Blocks of fewer than two
   shingles (or none, for low thresholds) say little; there are enough blocks to do without them, and a set
   with too many such blocks sends all it has. Shingles that are frequent in a sample are taken out of all sets before. A task sends a crowded
   key once and ties its other classes to that one, so a large group of near copies is thinned before the
   shuffle.
3. Classes that share a key, and whose sizes and folded sketches don't rule a link out, form a candidate
   cluster, directly or through others (distributed union-find); crowded keys are taken whole. Sketches as
   wide as the sets need then part the clusters further. Within what is left, pairs that aren't connected yet
   are compared by full sketches in blocks of bit operations, and those within the bound are verified on the
   sets. Clusters beyond a bound are split into tiles; each pair of tiles is a task's work, so no pair is lost.
4. Verified links go through union-find; a component's id is its least doc_id.

Defined results: null and empty texts, and texts without words, have an empty set and link with nothing; fewer
words than a shingle has form one shingle; rows of equal doc_id count as separate documents; a null doc_id is
larger than all; an empty table gives no rows; extra columns are ignored. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import PrefixHash, among, discard, groups_of, lower_ascii, materialize, mix64, small_batches, words_of
from trendloom.llm.unionfind import components, forest

#: Bits of the sketch that goes along with candidates; classes of one key in a batch from which it is sent once
#: for all; rows of one key that a task compares.
FOLD, CROWD, LARGE = 512, 32, 2048
#: Texts in the sample for frequent shingles, about, and in how many of them such a shingle is.
SAMPLE, OFTEN = 8000, 4
#: Shingles that a tile of a cluster holds when sets are compared, about, and bytes when sketches are.
TILE, SKETCH_TILE = 4_000_000, 16_000_000


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles, A-Z lower-cased."""
    raws = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    out: list[np.ndarray] = []
    for a, b in groups_of([len(r) for r in raws], 1 << 20):
        data = lower_ascii(np.frombuffer(b"\n".join(raws[a:b]) + b"\n", np.uint8))
        start, end = words_of(data)
        word = PrefixHash(data).of(start, end)
        ends = np.searchsorted(start, np.cumsum([len(r) + 1 for r in raws[a:b]]))
        at = 0
        full = _shingles(word, k) if len(word) >= k else np.zeros(0, np.uint64)
        for stop in ends.tolist():
            n = stop - at
            # shingles that start in this text and end in it
            out.append(np.unique(full[at : stop - k + 1]) if n >= k else _shingles(word[at:stop], n) if n else np.zeros(0, np.uint64))
            at = stop
    return out


def _shingles(word: np.ndarray, k: int) -> np.ndarray:
    n = len(word) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + word[j : n + j])
    return out


def set_sign(hashes: np.ndarray) -> int:
    """One signed number for a set."""
    total = mix64(hashes + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix64(np.array([total]))[0].astype(np.int64))


class Bands:
    """Size bands and their numbers of blocks, for links of Jaccard index above / of or more."""

    def __init__(self, part: int, of: int, most: int = 1 << 40):
        self.part, self.of = part, of
        starts = [1]
        while starts[-1] < most:
            starts.append(max(starts[-1] + 1, starts[-1] * 6 // 5))
        self.starts = np.array(starts, np.int64)
        # a linked pair whose larger set lies in a band differs in so many shingles at most
        self.differ = self.bound(2 * (self.starts[1:] - 1))
        # shingles in a block of a band's smallest sets: where they are few, blocks of one shingle are sent, too,
        # and fewer blocks are spare, which keeps blocks larger
        mean = part / of / (1.2 * 1.3 * 2 * (of - part) / (of + part))
        self.least, spare = (2, 30) if np.exp(-mean) * (1 + mean) < 0.2 else (1, 8)
        self.blocks = np.where(self.differ > 0, self.differ + 1 + (self.differ + 1) * spare // 100 + 2, 0)

    def bound(self, sizes: np.ndarray) -> np.ndarray:
        """The largest symmetric difference of a linked pair whose sizes sum to that."""
        return (self.of - self.part) * sizes // (self.of + self.part)

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, n, "right") - 1

    def largest_partner(self, n: np.ndarray) -> np.ndarray:
        return n * self.of // self.part


class Common:
    """Frequent shingles. Taking them out of two sets never adds to their symmetric difference, so sketches of
    what is left obey the same bounds, and blocks that are equal share something rare."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        self.table = np.zeros(1 << 22, bool)
        self.table[(self.sorted >> np.uint64(42)).astype(np.int64)] = True

    def without(self, hashes: np.ndarray) -> np.ndarray:
        """Where hashes aren't frequent."""
        rare = ~self.table[(hashes >> np.uint64(42)).astype(np.int64)]
        maybe = np.flatnonzero(~rare)
        at = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), max(0, len(self.sorted) - 1))
        if len(maybe):
            rare[maybe] = self.sorted[at] != hashes[maybe]
        return rare


def block_keys(sets: list[np.ndarray], bands: Bands, common: Common | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of the sets' sketch blocks, and which set each is of."""
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low, high = bands.band(np.maximum(size, 1)), bands.band(bands.largest_partner(np.maximum(size, 1)))
    keys, owners = [], []
    for step in range(int((high - low).max()) + 1):
        scheme = low + step
        blocks = np.where((scheme <= high) & (size > 0), bands.blocks[scheme], 0)
        use = np.flatnonzero(blocks)
        if not len(use):
            continue
        hashes = np.concatenate([sets[i] for i in use])
        per, base = blocks[use], np.concatenate([[0], np.cumsum(blocks[use])[:-1]])
        owner = np.repeat(np.arange(len(use)), size[use])
        if common is not None:
            rare = common.without(hashes)
            hashes, owner = hashes[rare], owner[rare]
        # sorted hashes fall into ascending blocks
        cell = base[owner] + ((hashes >> np.uint64(32)) * per[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])[: len(cell)])
        count = np.diff(np.append(lead, len(cell)))
        word = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), lead) if len(lead) else np.zeros(0, np.uint64)
        of, block = owner[lead], cell[lead] - base[owner[lead]]
        telling = count >= bands.least
        dumb = per - np.bincount(of[telling], minlength=len(use))
        spare = per - bands.differ[scheme[use]] - 1
        send = telling | (dumb > spare)[of]
        tag = (scheme[use][of].astype(np.uint64) << np.uint64(40)) + (block.astype(np.uint64) << np.uint64(12)) + np.minimum(count, 4095).astype(np.uint64)
        keys.append(mix64(word[send] * np.uint64(0x9E3779B97F4A7C15) + mix64(tag[send])))
        owners.append(use[of[send]])
        # blocks without shingles are equal to one another; a set that sends all must send those too
        for i in np.flatnonzero(dumb > spare):
            empty = np.setdiff1d(np.arange(per[i]), block[of == i])
            tag = (np.uint64(scheme[use[i]]) << np.uint64(40)) + (empty.astype(np.uint64) << np.uint64(12))
            keys.append(mix64(mix64(tag)))
            owners.append(np.full(len(empty), use[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def shared_of(a: np.ndarray, b: np.ndarray) -> int:
    """Numbers that two sorted lists of distinct ones share."""
    both = np.concatenate([a, b])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def link_tile(sets: list[np.ndarray], side: np.ndarray | None, bands: Bands) -> list[tuple[int, int]]:
    """Links that connect the sets as all linked pairs do (those of different sides, if sides are given). Sets of like size
    meet by sketches of about a bit for each shingle, and those within the bound are compared whole."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size, n = size[order], len(sets)
    sides = None if side is None else side[order]
    group, out = np.arange(n), []
    reach = np.searchsorted(size, bands.largest_partner(size), "right")
    bound = bands.bound(np.arange(2 * int(size[-1]) + 1)) if n else size

    def meet(i: int, others: np.ndarray) -> None:
        for j in others.tolist():
            if group[j] != group[i]:
                shared = shared_of(sets[order[i]], sets[order[j]])
                if bands.of * shared >= bands.part * (size[i] + size[j] - shared):
                    out.append((int(order[i]), int(order[j])))
                    group[group == group[j]] = group[i]

    start = 0
    while start < n - 1:
        # rows whose sizes are within twice the first, and all that they may link with
        end = min(n - 1, int(np.searchsorted(size, 2 * max(1, size[start]))))
        stop = int(reach[end - 1])
        if stop - start <= 3:
            for i in range(start, end):
                near = np.arange(i + 1, int(reach[i]))
                meet(i, near if sides is None else near[sides[near] != sides[i]])
            start = end
            continue
        words = max(4, 1 << (max(0, int(size[end - 1]) - 1) // 64).bit_length())
        sketch = np.zeros((stop - start, words), np.uint64)
        per = max(1, (1 << 16) // words)
        for i in range(start, stop, per):
            part = [sets[k] for k in order[i : min(stop, i + per)]]
            owner = np.repeat(np.arange(len(part)), size[i : i + len(part)])
            sketch[i - start : i - start + len(part)] = parity(np.concatenate(part), owner, len(part), words * 64, 20).view(np.uint64)
        # a row for each word, so that a set meets its neighbours by whole rows
        sketch = np.ascontiguousarray(sketch.T)
        for i in range(start, end):
            for a in range(i + 1, int(reach[i]), 1 << 16):
                b = min(a + (1 << 16), int(reach[i]))
                apart = np.zeros(b - a, np.uint32)
                for row in sketch:
                    apart += np.bitwise_count(row[a - start : b - start] ^ row[i - start])
                near = (apart <= bound[size[a:b] + size[i]]) & (group[a:b] != group[i])
                if sides is not None:
                    near &= sides[a:b] != sides[i]
                meet(i, np.flatnonzero(near) + a)
        start = end
    return out


def folded(hashes: np.ndarray, bits: int = FOLD) -> bytes:
    """A parity sketch of so many bits (a power of two). Its distances are lower bounds, as those of any parity
    sketch; its halves XORed make the sketch of half the bits."""
    bit = np.bincount((hashes >> np.uint64(9) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(bit.astype(np.uint8)).tobytes()


def wide_bits(n: int) -> int:
    """Bits with which unrelated sets of that size are told apart: half as many as shingles, FOLD at least."""
    return max(FOLD, 1 << max(0, (n + 1) // 2 - 1).bit_length())


def near_tile(size: np.ndarray, sketches: list[bytes], side: np.ndarray | None, bands: Bands) -> list[tuple[int, int]]:
    """Pairs within the sketches' bound that connect what all such pairs connect (of different sides, if given)."""
    order = np.argsort(size, kind="stable")
    size, n = size[order], len(order)
    width = np.array([len(sketches[i]) for i in order])
    first = {w: int(np.searchsorted(width, w)) for w in np.unique(width).tolist()}
    rows = {w: np.frombuffer(b"".join(sketches[i] for i in order[width == w]), np.uint64).reshape(-1, w // 8) for w in first}
    halves = {w // 2: (first[w], m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]) for w, m in rows.items()}
    reach = np.searchsorted(size, bands.largest_partner(size), "right")
    group, out = np.arange(n), []
    for i in range(n - 1):
        w = int(width[i])
        own = rows[w][i - first[w]]
        parts = [(first[w], rows[w])] + ([halves[w]] if w in halves else [])
        for base, matrix in parts:
            a, b = max(i + 1, base), min(int(reach[i]), base + len(matrix))
            if a >= b:
                continue
            near = np.arange(a, b)
            near = near[group[near] != group[i]]
            if side is not None:
                near = near[side[order[near]] != side[order[i]]]
            apart = np.bitwise_count(matrix[near - base] ^ own).sum(axis=1, dtype=np.int64)
            for j in near[apart <= bands.bound(size[near] + size[i])].tolist():
                if group[j] != group[i]:
                    out.append((int(order[i]), int(order[j])))
                    group[group == group[j]] = group[i]
    return out


def parity(hashes: np.ndarray, owner: np.ndarray, n: int, bits: int, shift: int = 9) -> np.ndarray:
    """Parity sketches of so many bits (a power of two), a row of bytes for each of n sets."""
    cell = owner * bits + (hashes >> np.uint64(shift) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8)).reshape(n, -1)


def digests(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes | None], list[bytes | None]]:
    """Sign, folded and wide sketch of each set; an empty one has no sketches."""
    size = np.array([len(x) for x in sets], np.int64)
    sign, fold, wide = np.zeros(len(sets), np.int64), [None] * len(sets), [None] * len(sets)
    bits = np.array([wide_bits(n) for n in size.tolist()], np.int64)
    for w in np.unique(bits[size > 0]).tolist():
        of = np.flatnonzero((bits == w) & (size > 0))
        per = max(1, (1 << 22) // w)
        for part in (of[i : i + per] for i in range(0, len(of), per)):
            flat = np.concatenate([sets[i] for i in part])
            owner = np.repeat(np.arange(len(part)), size[part])
            lead = np.cumsum(size[part]) - size[part]
            total = np.add.reduceat(mix64(flat + np.uint64(0x632BE59BD9B4E019)), lead) + size[part].astype(np.uint64)
            sign[part] = mix64(total).view(np.int64)
            rows = parity(flat, owner, len(part), w)
            small = rows.view(np.uint64)
            while small.shape[1] * 64 > FOLD:  # halves XORed are the sketch of half the bits
                small = small[:, : small.shape[1] // 2] ^ small[:, small.shape[1] // 2 :]
            for i, x, y in zip(part.tolist(), rows, np.ascontiguousarray(small), strict=True):
                wide[i], fold[i] = x.tobytes(), y.tobytes()
    return sign, fold, wide


SetsOf = Callable[[list[str | None]], list[np.ndarray]]


def row_key() -> Column:
    """A row by id and text, which a null id has too."""
    return F.xxhash64("doc_id", "text")


def set_digest(docs: DataFrame, sets_of: SetsOf) -> DataFrame:
    """doc_id, row_ (row_key), n_shingles, sign, folded and wide sketch (null for an empty set) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = sets_of(batch.column(2).to_pylist())
            size = np.array([len(x) for x in sets], np.int64)
            sign, fold, wide = digests(sets)
            found = [pa.array(size), pa.array(sign, mask=size == 0), pa.array(fold, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "row_", "n_shingles", "sign", "sketch", "wide"])

    return docs.select("doc_id", row_key().alias("row_"), "text").mapInArrow(run, f"doc_id {kind}, row_ long, n_shingles long, sign long, sketch binary, wide binary")


def _tiled(members: DataFrame, weight: Column, most: int) -> DataFrame:
    """members (cluster, sign, ...) with tile, low and high: once for each pair of tiles it is in. A cluster
    whose weights sum to more than most has more than one tile."""
    weights = members.groupBy("cluster").agg(F.ceil(F.sum(weight) / most).cast("int").alias("tiles"))
    members = members.join(weights, "cluster").withColumn("tile", F.pmod(F.xxhash64("sign"), F.col("tiles")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return members.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("tiles", "other")


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    """One batch of what many clusters link."""
    left, right = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(left, right)], ["a", "b"])


def refined_edges(digest: DataFrame, clusters: DataFrame, bands: Bands) -> DataFrame:
    """Edges (a, b) within clusters (sign, cluster) that the wide sketches don't rule out; they connect all that
    such pairs connect."""
    sketches = digest.where("sign is not null").groupBy("sign").agg(F.min("n_shingles").alias("size"), F.first("wide").alias("wide"))
    rows = _tiled(clusters.join(sketches, "sign"), F.octet_length("wide") + 64, SKETCH_TILE)
    rows = rows.select("cluster", "low", "high", "tile", "sign", "size", "wide")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        where = None

        def flush() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            _, sign, size, wide = zip(*held, strict=True)
            side = np.array([r[0] for r in held]) if where[1] != where[2] else None
            return [(sign[i], sign[j]) for i, j in near_tile(np.array(size, np.int64), list(wide), side, bands)]

        for batch in batches:
            found = []
            for *at, tile, sign, size, wide in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != where:
                    found += flush()
                    held, where = [], at
                held.append((tile, sign, size, wide))
            if found:
                yield _edges(found)
        yield _edges(flush())

    return rows.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high").mapInArrow(compare, "a long, b long")


def frequent_shingles(docs: DataFrame, rows: int, k: int) -> np.ndarray:
    """Shingles that OFTEN texts or more of a sample have, which takes about SAMPLE of the rows; there are at
    most as many of them as the sample has shingles over OFTEN. Any set would do: the choice only thins out
    buckets, and no link depends on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {set_sign(s): s for s in shingle_sets(batch.column(0).to_pylist(), k) if len(s)}
            if sets:
                found, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["shingle", "n"])

    share = F.shiftrightunsigned(F.xxhash64(F.lit("frequent"), "text"), 11) / float(1 << 53) < min(1.0, SAMPLE / max(1, rows))
    counts = docs.where(share).select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= OFTEN).select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64)


def candidate_edges(docs: DataFrame, digest: DataFrame, k: int, bands: Bands, rounds: int = 1) -> DataFrame:
    """Edges (a, b) between signs, which connect all classes that share a sketch block's key and whose folded
    sketches and sizes don't rule a link out. Each round takes its share of the keys, so that more rounds, which
    read the texts again, need less disk."""
    frequent = frequent_shingles(docs, digest.count(), k)
    return functools.reduce(DataFrame.union, [_edges_of_round(docs, digest, k, bands, frequent, rounds, i) for i in range(rounds)])


def _edges_of_round(docs: DataFrame, digest: DataFrame, k: int, bands: Bands, frequent: np.ndarray, rounds: int, nth: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, sign, other). In a batch, a key of CROWD classes or more is sent once, with an edge to
        each of its other classes; other is then its own sign, which keeps the key's bucket whole."""
        common = Common(frequent)
        for batch in batches:
            sets = {set_sign(s): s for s in shingle_sets(batch.column(0).to_pylist(), k) if len(s)}
            signs = np.array(list(sets), np.int64)
            keys, owner = block_keys(list(sets.values()), bands, common)
            if rounds > 1:
                mine = keys % np.uint64(rounds) == nth
                keys, owner = keys[mine], owner[mine]
            if not len(keys):
                continue
            order = np.argsort(keys, kind="stable")
            keys, owner = keys[order].view(np.int64), owner[order]
            lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            count = np.diff(np.append(lead, len(keys)))
            crowd = np.repeat(count >= CROWD, count)
            head = np.repeat(owner[lead], count)
            pairs = np.unique(np.stack([head[crowd], owner[crowd]]), axis=1)
            one = np.zeros(len(keys), bool)
            one[lead] = True
            keep = ~crowd | one
            own = np.where(crowd, signs[owner], 0)[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(keys[keep]), pa.nulls(pairs.shape[1], pa.int64())]),
                    pa.array(np.concatenate([signs[owner[keep]], signs[pairs[0]]])),
                    pa.concat_arrays([pa.array(own, pa.int64(), mask=~crowd[keep]), pa.array(signs[pairs[1]])]),
                ],
                ["key", "sign", "other"],
            )

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key has another row (sorted by key), and those that are edges."""
        held = None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            key, sign = batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()
            edge = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            # copies of a text send the same rows from several tasks; a crowded one comes first and stays
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (sign[1:] != sign[:-1]) | edge[1:]])
            batch, key, edge = batch.filter(pa.array(fresh)), key[fresh], edge[fresh]
            same = (key[1:] == key[:-1]) & ~edge[1:] & ~edge[:-1]
            keep = edge | np.concatenate([[False], same]) | np.concatenate([same, [False]])
            # the last row waits for the next batch; with its neighbour, if that has the same key
            last = len(key) - (2 if len(same) and same[-1] else 1)
            yield batch.slice(0, last).filter(pa.array(keep[:last]))
            held = batch.slice(last)
        if held is not None and held.num_rows:
            yield held.filter(pa.array(held.column(0).is_null().to_numpy(zero_copy_only=False) | (held.num_rows > 1)))

    sent = docs.select("text").mapInArrow(send, "key long, sign long, other long")
    # edges that are ready are dealt by themselves
    dealt = sent.repartition(F.coalesce("key", F.xxhash64("sign", "other"))).sortWithinPartitions("key", "sign", F.col("other").desc_nulls_last())
    shared = materialize(dealt.mapInArrow(share, "key long, sign long, other long"), "shared")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges within the runs of equal keys (sorted by key and size)."""
        held, tied = None, None
        for batch in batches:
            batch = batch if held is None else pa.concat_batches([held, batch])
            key = batch.column(0).to_numpy()
            start = int(np.searchsorted(key, key[-1]))
            if len(key) - start > LARGE:  # too many to wait for: this bucket's rows are all tied together
                yield edges_of(batch, tied if tied == key[0] else None, key[-1])
                held, tied = batch.slice(len(key) - 1), key[-1]
            else:
                if start:
                    yield edges_of(batch.slice(0, start), tied if tied == key[0] else None, None)
                held = batch.slice(start)
        if held is not None and held.num_rows:
            yield edges_of(held, tied if tied == held.column(0)[0].as_py() else None, None)

    def edges_of(batch: pa.RecordBatch, tied: int | None, also: int | None) -> pa.RecordBatch:
        key, sign, size = (batch.column(i).to_numpy() for i in range(3))
        crowd = batch.column(3).to_numpy(zero_copy_only=False)
        has = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        sketch = np.zeros((len(key), FOLD // 64), np.uint64)
        if has.any():
            sketch[has] = np.frombuffer(b"".join(batch.column(4).drop_null().to_pylist()), np.uint64).reshape(-1, FOLD // 64)
        lead = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(lead, len(key)))
        whole = np.logical_or.reduceat(crowd, lead) | (count > LARGE) | np.isin(key[lead], [x for x in (tied, also) if x is not None])
        chain = np.flatnonzero((key[1:] == key[:-1]) & np.repeat(whole, count)[1:])
        a, b = [sign[chain]], [sign[chain + 1]]
        at = np.flatnonzero(~np.repeat(whole, count))
        for step in range(1, int(count[~whole].max(initial=1))):
            at = at[at + step < len(key)]
            at = at[key[at] == key[at + step]]
            fit = at[size[at + step] <= bands.largest_partner(size[at])]
            near = np.bitwise_count(sketch[fit] ^ sketch[fit + step]).sum(axis=1, dtype=np.int64) <= bands.bound(size[fit] + size[fit + step])
            near |= ~(has[fit] & has[fit + step])  # left to the wide sketches
            a.append(sign[fit[near]])
            b.append(sign[fit[near] + step])
        found = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    sketches = digest.where("sign is not null").groupBy("sign").agg(F.min("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    # folded sketches of large sets can't rule anything out
    telling = F.lit(2) * (bands.of - bands.part) * F.col("size") < F.lit((bands.of + bands.part) * FOLD * 45 // 100)
    sketches = sketches.withColumn("sketch", F.when(telling, F.col("sketch")))
    rows = shared.where("key is not null").select("key", "sign", F.col("other").isNotNull().alias("crowd")).join(sketches, "sign")
    rows = rows.select("key", "sign", "size", "crowd", "sketch").repartition("key").sortWithinPartitions("key", "size")
    edges = rows.mapInArrow(meet, "a long, b long").union(shared.where("key is null").select("sign", "other")).distinct()
    edges = materialize(edges, "candidates")
    discard(shared)
    return edges


def texts_of(docs: DataFrame, digest: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sign, text) of the classes in clusters, each from one of its rows (from all that are equal in id and text)."""
    members = clusters.select("sign").join(digest.groupBy("sign").agg(F.min("row_").alias("row_")), "sign")
    members = materialize(members, "members")
    # a table of occupied slots, 2**20 rows at most, keeps most other texts out of the shuffle
    return among(docs.select(row_key().alias("row_"), "text"), "row_", members).join(members, "row_").select("sign", "text")


def verified_edges(texts: DataFrame, digest: DataFrame, clusters: DataFrame, sets_of: SetsOf, bands: Bands) -> DataFrame:
    """Links (a, b) between signs that connect, within clusters (sign, cluster), all classes that link. texts:
    (sign, text) of all classes in clusters."""
    sizes = digest.where("sign is not null").groupBy("sign").agg(F.min("n_shingles").alias("n_shingles"))
    places = _tiled(materialize(clusters.join(sizes, "sign"), "places"), F.col("n_shingles"), TILE).select("sign", "cluster", "tile", "low", "high")
    rows = texts.join(places, "sign").select("cluster", "low", "high", "tile", "sign", "text")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        where = None

        def flush() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            signs, sets = list(held), [s for _, s in held.values()]
            side = np.array([t for t, _ in held.values()]) if where[1] != where[2] else None
            return [(signs[i], signs[j]) for i, j in link_tile(sets, side, bands)]

        for batch in batches:
            found = []
            sets = sets_of(batch.column(5).to_pylist())
            for *at, tile, sign, hashes in zip(*(batch.column(i).to_pylist() for i in range(5)), sets, strict=True):
                if at != where:
                    found += flush()
                    held, where = {}, at
                held[sign] = (tile, hashes)
            if found:
                yield _edges(found)
        yield _edges(flush())

    return rows.repartition("cluster", "low", "high").sortWithinPartitions("cluster", "low", "high").mapInArrow(link, "a long, b long")


def clusters_of(roots: DataFrame) -> DataFrame:
    """(sign, cluster) of all nodes, roots included."""
    return materialize(roots.select(F.col("node").alias("sign"), F.col("root").alias("cluster")).union(roots.select("root", "root").distinct()), "clusters")


def near_duplicates(docs: DataFrame, k: int = 5, part: int = 80, of: int = 100, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; sets link when of * intersection >= part * union. rounds:
    see candidate_edges; results don't depend on it."""
    small_batches(docs.sparkSession)
    bands = Bands(part, of)
    sets_of = functools.partial(shingle_sets, k=k)
    digest = materialize(set_digest(docs, sets_of), "sets")
    rough = clusters_of(components(candidate_edges(docs, digest, k, bands, rounds)))
    links = components(linked_within(docs, digest, rough, sets_of, bands))
    classes = digest.where("sign is not null").groupBy("sign").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(links.withColumnRenamed("node", "sign"), "sign", "left").withColumn("root", F.coalesce("root", "sign"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.select("sign", "root").join(least, "root").select("sign", "component")
    return digest.join(labels, "sign", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def linked_within(docs: DataFrame, digest: DataFrame, rough: DataFrame, sets_of: SetsOf, bands: Bands) -> DataFrame:
    """Links (a, b) that connect all classes of a rough cluster which link, directly or through others."""
    fine = clusters_of(components(refined_edges(digest, rough, bands)))
    discard(rough)
    return verified_edges(texts_of(docs, digest, fine), digest, fine, sets_of, bands)
