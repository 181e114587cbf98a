"""External induced sorting of all suffixes of a text, with common-prefix lengths carried along.

The text's suffixes are typed L (greater than their right neighbour) or S. The leftmost S of every run are sorted
first: the substrings between them are named in order, and the string of names, at most half as long, is sorted by
the same method, or by doubling once it fits the memory allowed. All L suffixes follow from these in one ascending
pass, and all S suffixes from the L in one descending pass.

A pass is a monotone priority queue of tuples (position, common prefix with the tuple before). Its key is the
suffix's first symbol, then the order of arrival; tuples beyond the memory allowed go to files. All tuples of a key
that wait when the pass comes to it leave together, so the work is done on arrays. A tuple's common prefix is one
more than the least common prefix met among the sources since the last tuple of the same key.

Order and common prefixes are exact up to cap symbols of the text; suffixes that agree further come in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

import numpy as np

Sink = Callable[[np.ndarray, np.ndarray], None]
FAR = np.int64(1) << 40


class Spool:
    """Batches of (position, prefix) kept by key, first in first out; on disk beyond the limit."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.held: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list[tuple[int, int]]] = {}  # key: (place in the file, tuples)
        self.n = 0
        handle, self.path = tempfile.mkstemp(dir=folder)
        os.close(handle)
        self.end = 0

    def put(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held.setdefault(key, []).append(np.stack([pos, lcp]))
        self.n += len(pos)
        if self.n > self.limit:
            self._spill()

    def _spill(self) -> None:
        with open(self.path, "ab") as f:
            for key, parts in self.held.items():
                both = np.ascontiguousarray(np.concatenate(parts, axis=1))
                f.write(both.tobytes())
                self.files.setdefault(key, []).append((self.end, both.shape[1]))
                self.end += both.nbytes
        self.held.clear()
        self.n = 0

    def pop(self, key: int) -> np.ndarray | None:
        """All tuples of the key, oldest first."""
        parts = []
        if key in self.files:
            with open(self.path, "rb") as f:
                for at, n in self.files.pop(key):
                    f.seek(at)
                    parts.append(np.frombuffer(f.read(16 * n), np.int64).reshape(2, n))
        for own in self.held.pop(key, ()):
            parts.append(own)
            self.n -= own.shape[1]
        return np.concatenate(parts, axis=1) if parts else None


class _Pass:
    """Induces tuples from sources given in order, and remembers least prefixes between a key's tuples."""

    def __init__(self, text, wanted, spool: Spool, cap: int):
        self.text, self.wanted, self.spool, self.cap = text, wanted, spool, cap
        self.batch = 0
        self.least = np.full(64, FAR)  # of every batch so far
        self.last: dict[int, tuple[int, int]] = {}  # key: batch of its last tuple, least prefix in that batch since

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if self.batch == len(self.least):
            self.least = np.concatenate([self.least, np.full(len(self.least), FAR)])
        self.least[self.batch] = lcp.min()
        before = pos - 1
        at = np.flatnonzero((before >= 0) & self.wanted[np.maximum(before, 0)])
        if len(at):
            keys = self.text[before[at]]
            order = np.argsort(keys, kind="stable")
            keys, at = keys[order], at[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            longer = np.append(lcp, FAR)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                key, own = int(keys[s]), at[s:e]
                parts = np.minimum.reduceat(longer, np.r_[0, own + 1])
                new = parts[:-1] + 1
                if key in self.last:
                    b, rest = self.last[key]
                    between = self.least[b + 1 : self.batch]
                    new[0] = min(new[0] - 1, rest, between.min() if len(between) else FAR) + 1
                else:
                    new[0] = 0
                self.spool.put(key, before[own], np.minimum(new, self.cap))
                self.last[key] = (self.batch, int(parts[-1]))
        self.batch += 1


def _runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place: length of the run of its symbol from there, and whether the suffix is S."""
    n = len(text)
    ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    length = np.diff(np.r_[-1, ends])
    rising = np.r_[text[ends[1:]] > text[ends[:-1]], True]
    run = np.repeat(ends, length) - np.arange(n) + 1
    return run, np.repeat(rising, length)


def _names(text: np.ndarray, small: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Order-preserving names, from 1, of the substrings between starts, types included, last symbol included."""
    n, wide = len(text), int(text.max()).bit_length() + 2
    each = max(1, 62 // wide)
    stops = np.r_[starts[1:] + 1, n]
    size = stops - starts
    name = np.zeros(len(starts), np.int64)
    for chunk in range(int((size.max() - 1) // each), -1, -1):
        own = np.flatnonzero(size > chunk * each)
        key = np.zeros(len(own), np.int64)
        for j in range(each):
            at = starts[own] + chunk * each + j
            inside = at < stops[own]
            at = np.minimum(at, n - 1)
            key = (key << wide) | np.where(inside, 2 * text[at].astype(np.int64) + small[at] + 1, 0)
        if name[own].any():
            order = np.lexsort((name[own], key))
            a, b = key[order], name[own][order]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            name[own[order]] = np.cumsum(fresh)
        else:
            name[own] = np.unique(key, return_inverse=True)[1] + 1
    return name


def _doubled(text: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes, up to cap, by doubling in memory."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    ranks, step = [rank], 1
    while step < cap and rank.max(initial=0) < n - 1:
        key = rank * (n + 1) + np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        ok = (left < n) & (right < n)
        same = ok & (ranks[k][np.minimum(left, n - 1)] == ranks[k][np.minimum(right, n - 1)])
        # a rank of 2^k symbols is shared only by places with as many symbols left, or with the same end
        left[same] += 1 << k
        right[same] += 1 << k
        lcp[1:][same] += 1 << k
    return order, np.minimum(lcp, cap)


def sort_suffixes(text: np.ndarray, cap: int, sink: Sink, folder: str, memory: int) -> None:
    """Gives sink all suffixes but the last symbol's, greatest first, with the common prefix to the one before.

    text must end in a symbol that is smaller than all others and occurs once. memory: tuples held in memory.
    """
    n = len(text)
    run, small = _runs(text)
    run = np.minimum(run, cap)
    star = np.flatnonzero(small & np.r_[False, ~small[:-1]])
    names = _names(text, small, star)
    if len(star) <= memory:
        order, common = _doubled(names, cap)
    else:
        order, common = _recursed(names, cap, folder, memory)
    del names
    # common prefixes of the names become prefixes of the text, then go on symbol by symbol within the next name
    ends = np.r_[star, n]
    a, b = star[order[:-1]], star[order[1:]]
    reach = common[1:]
    lcp = ends[np.minimum(order[:-1] + reach, len(star))] - a
    live = np.flatnonzero(lcp < cap)
    while len(live):
        x, y = a[live] + lcp[live], b[live] + lcp[live]
        live = live[(x < n) & (y < n) & (text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)])]
        lcp[live] += 1
        live = live[lcp[live] < cap]
    seeds, seed_lcp = star[order], np.r_[0, np.minimum(lcp, cap)]
    first = text[seeds]
    keys = np.unique(text)
    bounds = np.searchsorted(first, np.r_[keys, keys[-1] + 1])

    large = Spool(folder, memory)
    kept = Spool(folder, memory)
    going = _Pass(text, ~small, large, cap)
    last_l: dict[int, int] = {}
    for i, key in enumerate(keys.tolist()):
        while (got := large.pop(key)) is not None:
            kept.put(key, *got)
            last_l[key] = int(got[0, -1])
            going.feed(*got)
        own, own_lcp = seeds[bounds[i] : bounds[i + 1]], seed_lcp[bounds[i] : bounds[i + 1]].copy()
        if len(own):
            own_lcp[0] = min(run[last_l[key]], run[own[0]]) if key in last_l else 0
            going.feed(own, own_lcp)
    del seeds, seed_lcp

    coming = Spool(folder, memory)
    going = _Pass(text, small, coming, cap)
    for key in reversed(keys.tolist()):
        least = None
        while (got := coming.pop(key)) is not None:
            sink(*got)
            least = int(got[0, -1])
            going.feed(*got)
        if (got := kept.pop(key)) is not None:
            pos = got[0, ::-1]
            lcp = np.r_[0 if least is None else min(run[least], run[pos[0]]), got[1, :0:-1]]
            sink(pos, lcp)
            going.feed(pos, lcp)


def _recursed(names: np.ndarray, cap: int, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of the string of names; its last name is the smallest and occurs once."""
    order, common = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
    at = len(names)

    def take(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal at
        order[at - len(pos) : at] = pos[::-1]
        common[at - len(pos) : at] = lcp[::-1]  # with the one above it, so far
        at -= len(pos)

    sort_suffixes(names, cap, take, folder, memory)
    order[0] = len(names) - 1
    return order, np.r_[0, 0, common[1:-1]] if len(names) > 1 else np.zeros(1, np.int64)


def repeated_starts(text: np.ndarray, cap: int, memory: int, folder: str | None = None) -> np.ndarray:
    """Places whose next cap symbols also start at another place.

    Queues spill where Spark's own spills go, which it names to its Python workers, and only within this call.
    """
    folder = folder or (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None
    own = tempfile.mkdtemp(prefix="quern-sort-", dir=folder)  # holds the queues for the length of this call
    marks, last = np.zeros(len(text), bool), -1

    def mark(pos: np.ndarray, lcp: np.ndarray) -> None:
        nonlocal last
        hit = np.flatnonzero(lcp >= cap)
        marks[pos[hit]] = True
        marks[np.where(hit > 0, pos[hit - 1], last)] = True if len(hit) else False
        last = pos[-1]

    try:
        if len(text) > cap:
            sort_suffixes(text, cap, mark, own, memory)
    finally:
        shutil.rmtree(own, ignore_errors=True)
    return marks
