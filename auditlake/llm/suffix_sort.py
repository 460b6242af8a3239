"""Induced suffix sorting with common prefixes, over disk-backed queues.

A suffix is L if it is larger than the next one, else S; an S after an L (LMS) starts a piece of text. Suffixes wait in a priority queue by their first symbol, first in first
out. Taking the smallest symbol's suffixes in order and putting their left neighbours in yields all L suffixes in order from the sorted LMS ones, and then, from the largest
symbol down, all S suffixes. What a queue gets for a symbol comes in order, so it is one append-only run per symbol; runs beyond the memory allowed go to files.

An entry is a position with its common prefix: the number of symbols (up to `depth`) that it shares with the entry before it. Two left neighbours that follow each other in a
queue share one symbol more than the least common prefix of the suffixes taken between their sources, so common prefixes are induced as the order is, and no text is compared.

First the LMS pieces are sorted in that way (from LMS suffixes in any order, which share one symbol). Common prefixes tell which pieces are equal: equal ones get one name, and the
names are a text a third as long at most. Its suffixes are sorted by doubling the number of names that are compared, since a large alphabet would leave each queue a handful of
entries; the ranks of all rounds say how many names two neighbours share, hence how many symbols. Then the whole text is induced from the LMS suffixes and their common prefixes.

Positions, names, ranks and orders are arrays that are read and written in blocks. They and the queues may take `memory` bytes in memory; what does not fit, and the text, is in files (mapped, so that only
blocks in use are in memory). So a sort keeps that and a few blocks (BATCH entries) in memory, whatever the length of the text; all together it takes about 21 bytes for each symbol. Sorting stops at
`depth` symbols: suffixes that agree so far come in any order.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

#: Bytes that one sort keeps in memory: half for arrays, half for queues.
MEMORY = 64 << 20
#: Entries taken at once.
BATCH = 1 << 19
#: Symbols that a common prefix can count, at most.
DEEPEST = 250

Batch = tuple[np.ndarray, np.ndarray]  # positions, common prefixes


class Files:
    """Arrays of one sort: in memory while they fit, else in files of one folder."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.made = folder, memory, 0
        self.where: dict[int, tuple[np.ndarray, str]] = {}

    def path(self) -> str:
        self.made += 1
        return f"{self.folder}/{self.made}"

    def array(self, size: int, dtype: type) -> np.ndarray:
        n = size * np.dtype(dtype).itemsize
        if n <= self.memory:
            out, path = np.zeros(size, dtype), ""
            self.memory -= n
        else:
            path = self.path()
            out = np.asarray(np.memmap(path, dtype, "w+", shape=(size,)))  # a plain view: indexing it is faster
        self.where[id(out)] = (out, path)
        return out

    def free(self, *arrays: np.ndarray) -> None:
        for x in arrays:
            _, path = self.where.pop(id(x))
            if path:
                os.unlink(path)
            else:
                self.memory += x.nbytes


class Queues:
    """First-in-first-out runs of entries (position << 8 | common prefix), one per symbol. The longest ones move to files when all together exceed the memory allowed."""

    def __init__(self, files: Files, memory: int, entry: type):
        self.files, self.memory, self.entry = files, memory, entry
        self.held: dict[int, list[np.ndarray]] = {}
        self.size: dict[int, int] = {}
        self.total = 0
        self.paths: dict[int, str] = {}

    def put(self, c: int, positions: np.ndarray, shared: np.ndarray | int) -> None:
        self.append(c, positions.astype(self.entry) << 8 | np.asarray(shared, self.entry))

    def append(self, c: int, part: np.ndarray) -> None:
        self.held.setdefault(c, []).append(part)
        self.size[c] = self.size.get(c, 0) + part.nbytes
        self.total += part.nbytes
        if self.total > self.memory:
            for k in sorted(self.size, key=self.size.__getitem__)[-max(1, len(self.size) // 2) :]:
                path = self.paths.get(k) or self.paths.setdefault(k, self.files.path())
                with open(path, "ab") as f:
                    for x in self.held.pop(k, []):
                        x.tofile(f)
                self.total -= self.size.pop(k)

    def take(self, c: int) -> Iterator[np.ndarray]:
        """All that waits for a symbol, from the front, until nothing comes any more: what is put while taking is taken too."""
        while c in self.paths or c in self.held:
            path, rest = self.paths.pop(c, None), self.held.pop(c, [])
            self.total -= self.size.pop(c, 0)
            if path:
                with open(path, "rb") as f:
                    while len(x := np.fromfile(f, self.entry, BATCH)):
                        yield x
                os.unlink(path)
            if rest:
                yield rest[0] if len(rest) == 1 else np.concatenate(rest)

    def take_back(self, c: int) -> Iterator[np.ndarray]:
        """All that waits for a symbol, in batches from the end. Nothing is put meanwhile."""
        path = self.paths.pop(c, None)
        yield from reversed(self.held.pop(c, []))
        self.total -= self.size.pop(c, 0)
        if path:
            size = np.dtype(self.entry).itemsize
            with open(path, "rb") as f:
                for end in range(os.path.getsize(path) // size, 0, -BATCH):
                    f.seek(size * max(0, end - BATCH))
                    yield np.fromfile(f, self.entry, min(BATCH, end))
            os.unlink(path)


class Carrier:
    """Puts left neighbours into queues, with the common prefixes that follow from those of their sources."""

    def __init__(self, symbols: int, depth: int, to: Queues):
        self.depth, self.to = depth, to
        self.since = np.full(symbols, depth, np.uint8)  # least common prefix of the sources since the last entry of each symbol
        self.fresh = np.ones(symbols, bool)

    def put(self, symbol: np.ndarray, position: np.ndarray, source: np.ndarray, shared: np.ndarray) -> None:
        """symbol, position and source (its place in this batch of sources) of the left neighbours to put; shared: common prefix of each source with the one before it."""
        least = np.minimum.accumulate(shared)
        if not len(symbol):
            np.minimum(self.since, least[-1], out=self.since)
            return
        order = np.argsort(symbol.astype(np.uint16), kind="stable")  # by radix
        c, p, k = symbol[order], position[order], source[order]
        first = np.concatenate(([True], c[1:] != c[:-1]))
        at = np.flatnonzero(first)
        own = c[at]
        lcp = np.empty(len(c), np.uint8)
        lcp[at] = np.minimum(self.since[own], least[k[at]])
        rest = np.flatnonzero(~first)
        if len(rest):
            lcp[rest] = range_minimum(shared, k[rest - 1] + 1, k[rest])
        lcp = np.minimum(lcp, self.depth - 1) + np.uint8(1)
        lcp[at[self.fresh[own]]] = 0
        self.fresh[own] = False
        np.minimum(self.since, least[-1], out=self.since)
        tail = np.append(np.minimum.accumulate(shared[::-1])[::-1], np.uint8(self.depth))
        self.since[own] = tail[k[np.append(at[1:], len(c)) - 1] + 1]
        entry = p.astype(self.to.entry) << 8 | lcp
        for x, a, b in zip(own.tolist(), at.tolist(), np.append(at[1:], len(c)).tolist(), strict=True):
            self.to.append(x, entry[a:b])


def opened(batch: np.ndarray) -> Batch:
    """Positions and common prefixes of entries."""
    return (batch >> 8).astype(np.int64), (batch & 255).astype(np.uint8)


def range_minimum(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(x[lo[i] : hi[i] + 1]) for each i, lo <= hi."""
    level = np.frexp(hi - lo + 1)[1] - 1
    out = np.empty(len(lo), x.dtype)
    table = x
    for j in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == j)
        out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << j) + 1])
        table = np.minimum(table[: -(1 << j)], table[1 << j :]) if len(table) > 1 << j else table
    return out


def run_of(t: np.ndarray, at: int, depth: int) -> int:
    """How many times the symbol at a place repeats from there on, up to depth."""
    part = np.asarray(t[at : at + depth])
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(t: np.ndarray, symbols: int, seeds: Callable[[int], Iterator[Batch]], depth: int, files: Files, memory: int, entry: type, pieces: bool) -> Iterator[Batch]:
    """The suffixes from the largest down, each with what it shares with the one before; with `pieces` LMS ones only. seeds(c): the LMS suffixes that begin with c, in order, each with
    what it shares with the one before it."""
    large, done, small = (Queues(files, memory // 3, entry) for _ in range(3))
    to_large, to_small = Carrier(symbols, depth, large), Carrier(symbols, depth, small)

    def neighbours(p: np.ndarray, shared: np.ndarray, to: Carrier, good: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Puts the left neighbours that are good; returns the symbols before the positions (-1 before the text)."""
        before = np.where(p > 0, t[p - 1].astype(np.int32), -1)  # t[-1] is not looked at
        k = np.flatnonzero((before >= 0) & good(before))
        to.put(before[k], p[k] - 1, k, shared)
        return before

    n = len(t)
    large.put(int(t[n - 1]), np.array([n - 1]), 0)
    to_large.fresh[int(t[n - 1])] = False
    for c in range(symbols):
        last = -1
        for batch in large.take(c):
            done.append(c, batch)
            p, shared = opened(batch)
            neighbours(p, shared, to_large, lambda x, c=c: x >= c)
            last = int(p[-1])
        for p, shared in seeds(c):
            if last is not None:  # the first seed: beside the last L suffix
                shared = shared.copy()
                shared[0] = 0 if last < 0 else min(run_of(t, last, depth), run_of(t, int(p[0]), depth))
                last = None
            neighbours(p, shared, to_large, lambda x, c=c: x > c)
    held = depth  # pieces: least common prefix since the last LMS suffix

    def out(p: np.ndarray, shared: np.ndarray, lms: np.ndarray | None) -> Batch | None:
        nonlocal held
        if not pieces:
            return p, shared
        at = np.flatnonzero(lms) if lms is not None else np.zeros(0, np.int64)
        if not len(at):
            held = min(held, int(shared.min()))
            return None
        own = np.minimum.reduceat(shared[: at[-1] + 1], np.concatenate(([0], at[:-1] + 1)))
        own[0] = min(int(own[0]), held)
        held = int(shared[at[-1] + 1 :].min(initial=depth))
        return p[at], own

    for c in range(symbols - 1, -1, -1):
        last = -1
        for batch in small.take(c):
            p, shared = opened(batch)
            before = neighbours(p, shared, to_small, lambda x, c=c: x <= c)
            last = int(p[-1])
            if (got := out(p, shared, before > c)) is not None:
                yield got
        carry = None
        for batch in done.take_back(c):
            p, up = opened(batch[::-1])
            if carry is None:
                carry = 0 if last < 0 else min(run_of(t, last, depth), run_of(t, int(p[0]), depth))
            shared = np.concatenate((np.array([carry], np.uint8), up[:-1]))
            carry = int(up[-1])
            neighbours(p, shared, to_small, lambda x, c=c: x < c)
            if (got := out(p, shared, None)) is not None:
                yield got


def lms_blocks(t: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the LMS suffixes, each block in order, the blocks from the end of the text (the empty suffix after it is the smallest, so the last one is L)."""
    n = len(t)
    after, follows = False, -1  # type of the suffix at b, and b itself if it is an S that may be an LMS
    for b in range(n, 0, -BATCH):
        a = max(0, b - BATCH)
        part = t[a : min(n, b + 1)].astype(np.int32)
        if b == n:
            part = np.append(part, -1)
        differs = np.flatnonzero(part[1:] != part[:-1])
        is_s = np.full(b - a, after, bool)
        if len(differs):
            is_s[: differs[-1] + 1] = np.repeat(part[differs] < part[differs + 1], np.diff(np.concatenate(([-1], differs))))
        found = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1 + a
        if follows >= 0 and not is_s[-1]:
            found = np.append(found, follows)
        yield found
        after, follows = bool(is_s[0]), a if is_s[0] else -1


def lms_positions(t: np.ndarray, files: Files) -> np.ndarray:
    m = sum(map(len, lms_blocks(t)))
    out = files.array(m, np.int32 if len(t) < 1 << 31 else np.int64)
    for x in lms_blocks(t):
        out[m - len(x) : m] = x
        m -= len(x)
    return out


def blocks(n: int) -> Iterator[slice]:
    for k in range(0, n, BATCH):
        yield slice(k, min(n, k + BATCH))


def ordered(key: np.ndarray, files: Files, memory: int) -> np.ndarray:
    """Indices of the keys in their order, equal ones in any: ranges of keys that fit into the memory, one after another; a key that fills a range by itself needs no sorting."""
    n = len(key)
    out, at = files.array(n, np.int32 if n < 1 << 31 else np.int64), 0
    most = max(1024, memory // 32)
    parts = -(-n // most)
    if parts <= 1:
        out[:] = np.argsort(key[:])
        return out
    sample = np.sort(np.asarray(key[:: max(1, n // (64 * parts))]))
    cuts = np.unique(sample[:: max(1, len(sample) // (2 * parts))])
    edges = np.unique(np.concatenate((cuts, cuts + np.uint64(1))))
    for lo, hi in zip([np.uint64(0), *edges], [*edges, None], strict=True):
        single = hi is not None and hi - lo == 1
        held = []
        for s in blocks(n):
            x = np.asarray(key[s])
            own = np.flatnonzero((x >= lo) & (x < hi) if hi is not None else x >= lo) + s.start
            if single:
                out[at : at + len(own)] = own
                at += len(own)
            else:
                held.append(own)
        if held:
            own = np.concatenate(held)
            out[at : at + len(own)] = own[np.argsort(key[own])]
            at += len(own)
    return out


def doubled(names: np.ndarray, depth: int, files: Files, memory: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the suffixes of the names by as many as `depth` symbols may take (a name stands for two at least), and the ranks by 1, 2, 4, ... names."""
    n, h, ranks, order = len(names), 1, [names], None
    key = files.array(n, np.uint64)
    while True:
        rank = ranks[-1]
        for s in blocks(n):
            x = rank[s].astype(np.uint64) << np.uint64(32)
            y = rank[s.start + h : s.stop + h]
            x[: len(y)] |= y.astype(np.uint64)
            key[s] = x
        if order is not None:
            files.free(order)
        order, new, last, top = ordered(key, files, memory), files.array(n, np.int32), None, 0
        for s in blocks(n):
            at = order[s]
            k = key[at]
            step = np.concatenate(([last is None or k[0] != last], k[1:] != k[:-1]))
            new[at] = top + np.cumsum(step)
            last, top = k[-1], top + int(step.sum())
        ranks.append(new)
        h *= 2
        if top == n or 2 * h >= depth:
            files.free(key)
            return order, ranks


def shared_by(t: np.ndarray, lms: np.ndarray, a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray], depth: int) -> np.ndarray:
    """Common prefixes of pairs of LMS suffixes (by their numbers): whole names first, then the symbols of the first two pieces that differ."""
    n, k = len(lms), np.zeros(len(a), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) + k < n)
        same = inside[ranks[j][a[inside] + k[inside]] == ranks[j][b[inside] + k[inside]]]
        k[same] += 1 << j
    k -= np.maximum(a, b) + k >= n  # after the last piece of the text: that piece is compared as any that differs
    x, y = lms[a + k].astype(np.int64), lms[b + k].astype(np.int64)
    out = np.minimum(x - lms[a], depth)
    open_ = np.flatnonzero(out < depth)
    j = 0
    while len(open_):
        at, to = x[open_] + j, y[open_] + j
        ok = np.maximum(at, to) < len(t)
        ok[ok] = t[at[ok]] == t[to[ok]]
        open_ = open_[ok]
        out[open_] += 1
        open_ = open_[out[open_] < depth]
        j += 1
    return out.astype(np.uint8)


def suffixes(t: np.ndarray, depth: int, folder: str, memory: int = MEMORY) -> Iterator[Batch]:
    """Batches of (positions, common prefixes): the suffixes of t from the largest down in order of their first `depth` symbols, each with the number of symbols, up to depth, that it shares
    with the one before it. t: small integers, may be a mapped file. An empty text gives nothing."""
    if not 1 <= depth <= DEEPEST:
        raise ValueError(f"depth must be from 1 to {DEEPEST}")
    t = np.asarray(t)  # a plain view of the mapped file: indexing it is faster
    n = len(t)
    if not n:
        return
    memory //= 2
    files = Files(folder, memory)
    entry = np.uint32 if n < 1 << 24 else np.int64
    symbols = 1 + max(int(np.max(t[s])) for s in blocks(n))
    lms = lms_positions(t, files)
    m = len(lms)
    counts = np.zeros(symbols + 1, np.int64)
    unsorted = Queues(files, memory // 4, entry)
    size = files.array(n // 2 + 1, np.uint8)  # symbols of the piece at a position, its last one is the next piece's first; LMS positions are two apart at least
    for s in blocks(m):
        own = lms[s]
        follow = np.append(own[1:], lms[s.stop] if s.stop < m else n)
        size[own >> 1] = np.minimum(follow - own + 1, 255)
        c = t[own]
        counts[1:] += np.bincount(c, minlength=symbols)
        order = np.argsort(c, kind="stable")
        c, own = c[order], own[order]
        cut = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        for x, part in zip(c[cut].tolist(), np.split(own, cut[1:]), strict=True):
            unsorted.put(x, part, 1)
    begin = np.cumsum(counts)

    def in_any_order(c: int) -> Iterator[Batch]:
        yield from map(opened, unsorted.take(c))

    if not m:
        yield from induce(t, symbols, in_any_order, depth, files, memory, entry, False)
        return
    pieces, at = files.array(m, entry), m  # in order, each with what it shares with the next one
    for p, shared in induce(t, symbols, in_any_order, depth, files, memory, entry, True):
        pieces[at - len(p) : at] = (p.astype(entry) << 8 | shared)[::-1]
        at -= len(p)
    name, top, before = files.array(n // 2 + 1, np.int32), 1, None
    for s in blocks(m):
        p, shared = opened(pieces[s])
        own = np.minimum(size[p >> 1].astype(np.int64), depth)
        after = min(int(size[int(pieces[s.stop] >> 8) >> 1]), depth) if s.stop < m else 0
        equal = (shared >= own) & (own == np.append(own[1:], after))
        step = np.concatenate(([before is not None and not before], ~equal[:-1]))
        number = top + np.cumsum(step)
        name[p >> 1] = number
        top, before = int(number[-1]), bool(equal[-1])
    files.free(pieces, size)
    names = files.array(m, np.int32)
    for s in blocks(m):
        names[s] = name[lms[s] >> 1]
    files.free(name)
    order, ranks = doubled(names, depth, files, memory)
    seeds, last = files.array(m, entry), None
    for s in blocks(m):
        own = order[s].astype(np.int64)
        row = own if last is None else np.append(last, own)
        shared = shared_by(t, lms, row[:-1], row[1:], ranks, depth)
        if last is None:
            shared = np.append(np.uint8(0), shared)
        seeds[s] = lms[own].astype(entry) << 8 | shared
        last = int(own[-1])
    files.free(order, lms, *ranks)
    del order, lms, ranks, names, name, pieces, size

    def in_order(c: int) -> Iterator[Batch]:
        for k in range(int(begin[c]), int(begin[c + 1]), BATCH):
            yield opened(seeds[k : min(k + BATCH, int(begin[c + 1]))])

    yield from induce(t, symbols, in_order, depth, files, memory, entry, False)
