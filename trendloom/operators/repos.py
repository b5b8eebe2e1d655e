"""Chain labels and ancestors of whole repositories in numpy, many at once: what ``ancestry`` does by rounds for repositories that are
too large. Rows come in the order of repositories; those of one that is over the limits are handed back as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows taken at once; rows of a repository, and products of its questions and chains or links, that a task holds at most.
BATCH, ROWS, CELLS = 50_000, 200_000, 20_000_000


def _plain(found: pa.Table) -> Iterator[pa.RecordBatch]:
    # all with fields that may be null, so that they have one schema
    for batch in found.to_batches():
        yield pa.RecordBatch.from_arrays(batch.columns, batch.schema.names)


def by_repo(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], Iterator[pa.Table]], back: Callable[[pa.Table], pa.Table], batch_rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """solve of tables of whole repositories (column 0, in order), back of rows of those that are null or too large."""
    held, large = None, None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        none = pc.is_null(part.column(0))
        if pc.any(none).as_py():
            yield from _plain(back(part.filter(none)))
            part = part.filter(pc.invert(none))
        if large is not None:
            same = pc.equal(part.column(0), large)
            yield from _plain(back(part.filter(same)))
            part = part.filter(pc.invert(same))
        if not len(part):
            continue
        large = None
        held = part if held is None else pa.concat_tables([held, part])
        if len(held) < batch_rows:
            continue
        last = held.column(0)[len(held) - 1]
        start = pc.index(held.column(0), last).as_py()
        for done in solve(held.slice(0, start)) if start else ():
            yield from _plain(done)
        held = held.slice(start)
        if len(held) > most:
            yield from _plain(back(held))
            held, large = None, last
    for done in solve(held) if held is not None and len(held) else ():
        yield from _plain(done)


def codes(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values in order, and each column's places among them; -1 for null."""
    one = pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks()
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    coded = one.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order) + 1, np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    rank[-1] = -1
    at = rank[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
    return coded.dictionary.take(order), np.split(at, np.cumsum([len(x) for x in columns])[:-1])


def first_of(*sorted_: np.ndarray) -> np.ndarray:
    """Places where sorted rows differ from the one before."""
    new = np.zeros(len(sorted_[0]), bool)
    new[:1] = True
    for x in sorted_:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def fallen(up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pointers up (-1: none) end, after how many steps, and which of them don't."""
    end, far, up = np.where(up < 0, np.arange(len(up)), up), (up >= 0).astype(np.int64), up.copy()
    for _ in range(len(up).bit_length() + 1):
        on = np.flatnonzero(up >= 0)
        if not len(on):
            break
        to = up[on]
        end[on], far[on], up[on] = end[to], far[on] + far[to], up[to]
    return end, far, up >= 0


def label(rows: pa.Table) -> Iterator[pa.Table]:
    """rows (repo, sha, parent_sha, nth) as (kind, repo, sha, chain, pos, to_chain, to_pos): commits (0), links (1), and rows of
    repositories whose first parents form a cycle (2)."""
    repos, (r,) = codes(rows.column(0))
    names, (s, p) = codes(rows.column(1), rows.column(2))
    nth = rows.column(3).to_numpy()
    none, size = pc.is_null(rows.column(3)).to_numpy(), max(1, len(names))
    nth = np.where(none, np.iinfo(np.int64).max, np.nan_to_num(nth)).astype(np.int64)
    nodes = np.unique(np.concatenate([(r * size + s)[s >= 0], (r * size + p)[p >= 0]]))
    edge = (s >= 0) & (p >= 0)
    u, v, nth, none = np.searchsorted(nodes, (r * size + s)[edge]), np.searchsorted(nodes, (r * size + p)[edge]), nth[edge], none[edge]
    order = np.lexsort((nth, none, v, u))
    order = order[first_of(u[order], v[order])]
    u, v, nth, none = u[order], v[order], nth[order], none[order]
    lead = np.lexsort((v, nth, ~none, u))
    lead = lead[first_of(u[lead])]
    up = np.full(len(nodes), -1)
    up[u[lead]] = v[lead]
    _, depth, round_ = fallen(up)
    if round_.any():
        # the rounds of ``ancestry`` tell of it
        bad = np.isin(r, nodes[round_] // size)
        yield handed_back(rows.filter(pa.array(bad)))
        rest = rows.filter(pa.array(~bad))
        if len(rest):
            yield from label(rest)
        return
    deep, order = np.zeros(len(nodes), np.int64), np.argsort(-depth, kind="stable")
    for level in np.split(order, first_of(depth[order])[1:]):
        if len(level) and up[level[0]] >= 0:
            np.maximum.at(deep, up[level], deep[level] + 1)
    child = np.flatnonzero(up >= 0)
    child = child[np.lexsort((-child, -deep[child], up[child]))]
    heir = child[first_of(up[child])]
    on = np.full(len(nodes), -1)
    on[heir] = up[heir]
    chain, pos, _ = fallen(on)
    far = (chain[u] != chain[v]) | (pos[v] != pos[u] - 1)
    a, b = u[far], v[far]
    order = np.lexsort((-pos[b], pos[a], chain[b], chain[a]))
    a, b = a[order], b[order]
    start = first_of(chain[a], chain[b])
    part = np.zeros(len(a), np.int64)
    part[start[1:]] = 1
    high = np.cumsum(part) * (len(nodes) + 1) + pos[b]
    before = np.maximum.accumulate(high) if len(high) else high
    best = np.ones(len(a), bool)
    best[1:] = high[1:] > before[:-1]
    a, b = a[best], b[best]
    name = lambda x: names.take(pa.array(nodes[x] % size))
    all_, null = np.arange(len(nodes)), lambda n, kind: pa.nulls(n, kind)
    n, m, kind = len(nodes), len(a), names.type
    yield pa.table([pa.array(np.zeros(n, np.int32)), repos.take(pa.array(nodes // size)), name(all_), name(chain), pa.array(pos), null(n, kind), null(n, pa.int64())], COLUMNS)
    yield pa.table([pa.array(np.ones(m, np.int32)), repos.take(pa.array(nodes[a] // size)), null(m, kind), name(chain[a]), pa.array(pos[a]), name(chain[b]), pa.array(pos[b])], COLUMNS)


COLUMNS = ["kind", "repo", "sha", "chain", "pos", "to_chain", "to_pos"]


def handed_back(rows: pa.Table) -> pa.Table:
    n, kind = len(rows), rows.schema.field(1).type
    return pa.table([pa.array(np.full(n, 2, np.int32)), *(rows.column(i) for i in range(4)), pa.nulls(n, kind), pa.nulls(n, pa.int64())], COLUMNS)


def answer(rows: pa.Table, cells: int) -> Iterator[pa.Table]:
    """rows (repo, kind, sha, chain, pos, to_chain, to_pos): commits (0), links (1) and questions (2: sha above chain?) as the same,
    of which those of kind 3 are the distinct questions answered by yes; others are of repositories too entangled to hold."""
    repos, (r,) = codes(rows.column(0))
    kind = rows.column(1).to_numpy()
    names, (s, c, t) = codes(rows.column(2), rows.column(3), rows.column(5))
    pos, to_pos = (np.nan_to_num(rows.column(i).to_numpy()).astype(np.int64) for i in (4, 6))
    size = max(1, len(names))
    count = lambda x: np.bincount(r[x], minlength=len(repos))
    commit, link, ask = kind == 0, kind == 1, kind == 2
    heads = np.bincount(np.unique((r * size + c)[commit]) // size, minlength=len(repos))
    bad = np.minimum(count(ask), count(commit)) * np.maximum(heads, count(link)) > cells
    if bad.any():
        bad = bad[r]
        yield told_back(rows.filter(pa.array(bad)))
        rest = rows.filter(pa.array(~bad))
        if len(rest):
            yield from answer(rest, cells)
        return
    node, chain, to = r * size + s, r * size + c, r * size + t
    order = np.flatnonzero(commit)
    order = order[np.argsort(node[order])]
    keys, on, at = node[order], chain[order], pos[order]
    up, down = node[ask], chain[ask]
    twice = np.lexsort((down, up))
    twice = twice[first_of(up[twice], down[twice])]
    up, down = up[twice], down[twice]
    i, j = (np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1)) for x in (up, down))
    known = (keys[i] == up) & (keys[j] == down) & (up != down) if len(keys) else np.zeros(len(up), bool)
    i, j = i[known], j[known]
    yes = (on[i] == on[j]) & (at[i] < at[j])
    open_ = np.flatnonzero(~yes)
    # the highest place that each asking commit reaches on each chain
    chains, number = np.unique(on, return_inverse=True)
    lc, lt = (np.searchsorted(chains, x[link]) for x in (chain, to))
    lp, lq = pos[link], to_pos[link]
    order = np.lexsort((lp, lc))
    lc, lp, lt, lq = lc[order], lp[order], lt[order], lq[order]
    span = 1 + max(int(at.max(initial=0)), int(lp.max(initial=0)))
    ends, first = lc * span + lp, np.searchsorted(lc, np.arange(len(chains)))
    who = np.unique(j[open_])
    width = max(1, len(chains))
    cell, best = who * width + number[who], at[who]
    front, place = cell, best
    while len(front):
        fc = front % width
        last = np.searchsorted(ends, fc * span + place, side="right")
        times = np.maximum(last - first[fc], 0)
        f = np.repeat(np.arange(len(front)), times)
        g = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[fc][f]
        new, high = front[f] // width * width + lt[g], lq[g]
        order = np.lexsort((-high, new))
        order = order[first_of(new[order])]
        new, high = new[order], high[order]
        old = np.minimum(np.searchsorted(cell, new), len(cell) - 1)
        there = cell[old] == new
        better = ~there | (high > best[old])
        front, place = new[better], high[better]
        both, place_ = np.concatenate([cell, front]), np.concatenate([best, place])
        order = np.lexsort((-place_, both))
        order = order[first_of(both[order])]
        cell, best = both[order], place_[order]
    if len(open_):
        asked = j[open_] * width + number[i[open_]]
        near = np.minimum(np.searchsorted(cell, asked), len(cell) - 1)
        yes[open_] = (cell[near] == asked) & (best[near] >= at[i[open_]])
    a, b = keys[i[yes]], keys[j[yes]]
    n, none = len(a), pa.nulls(len(a), pa.int64())
    yield pa.table([repos.take(pa.array(a // size)), pa.array(np.full(n, 3, np.int32)), names.take(pa.array(a % size)), names.take(pa.array(b % size)), none, pa.nulls(n, names.type), none], ASKED)


ASKED = ["repo", "kind", "sha", "chain", "pos", "to_chain", "to_pos"]


def told_back(rows: pa.Table) -> pa.Table:
    return rows.rename_columns(ASKED)
