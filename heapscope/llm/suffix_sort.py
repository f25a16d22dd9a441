"""External induced sorting of suffixes, with their common-prefix lengths.

The recursion of induced sorting: suffixes are of type L (greater than the next one) or S; the leftmost S of each run
(LMS) cut the text into substrings, which are named in order; the string of names is sorted by recursion, and the
order of the LMS suffixes then induces that of all L suffixes in an ascending sweep, and of all S suffixes in a
descending one. A sweep pops suffixes from a priority queue in order of their first symbol and pushes each one's
predecessor, so the queue's tuples (first symbol, turn, position) carry the text's order, and with each tuple goes its
common prefix with the entry before it in the same bucket: one more than the least common prefix between the two
suffixes that induced them. The queue keeps a bucket for each symbol, first in first out; beyond its memory limit it
writes its buckets to a file in order and reads them back block by block. Sweeps run on whole blocks of a bucket at a
time with numpy. Names of an alphabet of over `wide` are written in two digits, whose order is theirs, and recursion goes
on. It ends at names that are all different, or as soon as ranks of the names, of doubled length again and again, fit in
the memory limit; then these finish the order.

Lengths are capped at `cap`, so texts that are equal over cap symbols may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

Emit = Callable[[np.ndarray, np.ndarray], None]
BIG = np.int16(32000)
#: Bytes that a name takes while ranks of doubled length are made: about 8 levels and some arrays of 8 bytes.
RANKS = 104


class DiskQueue:
    """Buckets of (position, common prefix) blocks, popped by symbol; a monotone priority queue that spills to a file."""

    def __init__(self, symbols: int, folder: str, memory: int):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.folder, self.memory, self.held, self.file = folder, memory, 0, None

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[symbol].append((pos, lcp))
        self.held += pos.nbytes + lcp.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        for bucket in self.blocks:
            for i, block in enumerate(bucket):
                if block is not None and isinstance(block[0], np.ndarray):
                    at = self.file.seek(0, os.SEEK_END)
                    self.file.write(block[0].tobytes())
                    self.file.write(block[1].tobytes())
                    bucket[i] = (at, len(block[0]))
        self.held = 0

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bucket's blocks in order, also those pushed meanwhile; small ones are joined."""
        bucket, i = self.blocks[symbol], 0
        while i < len(bucket):
            taken = []
            size = 0
            while i < len(bucket) and (not taken or size < 1 << 18):
                block = bucket[i]
                bucket[i] = None
                if block is not None and isinstance(block[0], np.ndarray):
                    self.held -= block[0].nbytes + block[1].nbytes
                else:
                    self.file.seek(block[0])
                    block = (np.frombuffer(self.file.read(4 * block[1]), np.int32), np.frombuffer(self.file.read(2 * block[1]), np.int16))
                taken.append(block)
                size += len(block[0])
                i += 1
            yield taken[0] if len(taken) == 1 else (np.concatenate([p for p, _ in taken]), np.concatenate([c for _, c in taken]))
        self.blocks[symbol] = []

    def pop_back(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The bucket's blocks from the last to the first, one in memory at a time."""
        bucket = self.blocks[symbol]
        while bucket:
            block = bucket.pop()
            if isinstance(block[0], np.ndarray):
                self.held -= block[0].nbytes + block[1].nbytes
                yield block
            else:
                self.file.seek(block[0])
                yield np.frombuffer(self.file.read(4 * block[1]), np.int32), np.frombuffer(self.file.read(2 * block[1]), np.int16)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


#: Symbols whose types are found at once.
BLOCK = 1 << 20


def _is_s(t: np.ndarray) -> np.ndarray:
    """Which suffixes are less than the next one, block by block from the end."""
    n = len(t)
    out = np.empty(n, bool)
    after, kind = None, True  # the symbol behind the block, and its suffix's type
    for a in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        x = np.asarray(t[a : a + BLOCK])
        following = np.append(x[1:], x[-1] if after is None else after)
        step = np.where(following > x, 1, np.where(following < x, -1, 0)).astype(np.int8)
        if after is None:
            step[-1] = 1  # the end mark
        m = len(x)
        at = np.where(step != 0, np.arange(m, dtype=np.int32), np.int32(m))
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[a : a + m] = np.where(at < m, step[np.minimum(at, m - 1)] > 0, kind)
        after, kind = x[0], bool(out[a])
    return out


def _names(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """Names of the LMS substrings, dense and in their order; a symbol's type is its last bit, so none is another's beginning."""
    code = t.astype(np.int32) * 2 + s
    bits = max(2, int(2 * symbols + 1).bit_length())
    each = 62 // bits
    length = np.concatenate([np.diff(lms) + 1, [1]])
    name, active, j = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(active):
        key = np.zeros(len(active), np.uint64)
        for k in range(each):
            at = j * each + k
            has = length[active] > at
            key = key << np.uint64(bits) | np.where(has, code[np.minimum(lms[active] + at, len(t) - 1)], 0).astype(np.uint64)
        order = np.lexsort((key, name[active])) if j else np.argsort(key, kind="stable")
        g, k = name[active][order], key[order]
        new_group = np.concatenate([[True], g[1:] != g[:-1]])
        new = new_group | np.concatenate([[True], k[1:] != k[:-1]])
        serial = np.cumsum(new) - 1
        first = serial[np.flatnonzero(new_group)]
        within = serial - first[np.cumsum(new_group) - 1]
        extra = np.zeros(int(name.max()) + 1, np.int64)
        np.maximum.at(extra, g, within)
        name = name + (np.cumsum(extra) - extra)[name]
        name[active[order]] += within
        j += 1
        active = active[length[active] > j * each]
        # Names that are alone need no more symbols.
        active = active[np.bincount(name)[name[active]] > 1]
    return name


def _double(r: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of r's suffixes and common prefixes of neighbours, both over cap symbols at least, by ranks of doubled length."""
    n, levels, k = len(r), [r.astype(np.int64)], 1
    while k < cap and int(levels[-1].max()) + 1 < n:
        rank = levels[-1]
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], (key[order][1:] != key[order][:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        levels.append(rank)
        k *= 2
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[j][np.minimum(a, n - 1)] == levels[j][np.minimum(b, n - 1)])
        a[same] += 1 << j
        b[same] += 1 << j
        lcp[1:][same] += 1 << j
    return order, lcp


def _lms_order(t: np.ndarray, s: np.ndarray, lms: np.ndarray, symbols: int, cap: int, wide: int, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """The LMS suffixes in order, and each one's capped common prefix with the one before."""
    name = _names(t, s, lms, symbols)
    top = int(name.max()) + 1
    # Each name but the last begins at least 2 symbols before the next.
    if top == len(lms):
        order, shared = np.argsort(name), np.zeros(len(lms), np.int64)
    elif top <= wide and len(lms) > 4 * top:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        sort_suffixes(np.concatenate([name + 1, [0]]).astype(np.int32), top + 1, lambda p, c: parts.append((p, c)), cap, wide, folder, memory)
        back = np.concatenate([p for p, _ in parts])[::-1]
        right = np.concatenate([c for _, c in parts])[::-1].astype(np.int64)
        order, shared = back[1:], np.concatenate([[0], right[1:-1]])  # without the end mark, which comes first
    elif len(lms) * RANKS <= memory or folder is None:
        order, shared = _double(name, cap // 2 + 1)
    else:
        order, shared = _by_digits(name, top, cap, wide, folder, memory)
    # Common names give common symbols; then symbols are compared one by one.
    ends = np.concatenate([lms, [len(t)]])
    lcp = np.zeros(len(lms), np.int64)
    a, b = order[:-1], order[1:]
    lcp[1:] = np.minimum(cap, ends[np.minimum(a + shared[1:], len(lms))] - lms[a])
    active = np.arange(1, len(lms))
    while len(active):
        x, y = lms[order[active - 1]] + lcp[active], lms[order[active]] + lcp[active]
        inside = (lcp[active] < cap) & (x < len(t)) & (y < len(t))
        active, x, y = active[inside], x[inside], y[inside]
        active = active[t[x] == t[y]]
        lcp[active] += 1
    return lms[order], lcp.astype(np.int16)


def _by_digits(name: np.ndarray, top: int, cap: int, wide: int, folder: str, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and common prefixes of the suffixes of names: those at even places of the string of their two digits."""
    base = int(np.ceil(np.sqrt(top)))
    digits = np.empty(2 * len(name) + 1, np.int32)
    digits[0:-1:2], digits[1::2], digits[-1] = name // base + 1, name % base + 1, 0
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    least = [BIG]  # least common prefix since the last even place

    def even(p: np.ndarray, c: np.ndarray) -> None:
        at = np.flatnonzero((p & 1) == 0)
        if not len(at):
            least[0] = min(least[0], c.min())
            return
        cuts = np.concatenate([[0], at + 1])
        rest = cuts[-1] < len(c)
        low = np.minimum.reduceat(c, cuts if rest else cuts[:-1])
        own = low[: len(at)].copy()
        own[0] = min(own[0], least[0])
        least[0] = low[-1] if rest else BIG
        parts.append((p[at] >> 1, own >> 1))

    sort_suffixes(digits, base + 2, even, cap, wide, folder, memory)
    back = np.concatenate([p for p, _ in parts])[::-1]
    right = np.concatenate([c for _, c in parts])[::-1].astype(np.int64)
    return back[1:], np.concatenate([[0], right[1:-1]])  # without the end mark, which comes first


class _Sweep:
    """Scans suffixes in order and pushes their predecessors, with common prefixes, into the queue."""

    def __init__(self, t: np.ndarray, symbols: int, cap: int, queue: DiskQueue, up: bool):
        self.t, self.cap, self.queue, self.up = t, cap, queue, up
        self.least = np.full(symbols, BIG, np.int16)  # least common prefix since the bucket's last entry
        self.begun = np.zeros(symbols, bool)

    def scan(self, c: int, pos: np.ndarray, lcp: np.ndarray, same: bool) -> None:
        t = self.t
        before = t[np.maximum(pos - 1, 0)]
        keep = (before > c) if self.up else (before < c)
        if same:
            keep |= before == c
        keep &= pos > 0
        at = np.flatnonzero(keep)
        np.minimum(self.least, lcp.min(), out=self.least) if not len(at) else self._push(at, before[at], pos, lcp)

    def _push(self, at: np.ndarray, to: np.ndarray, pos: np.ndarray, lcp: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        at, to = at[order], to[order]
        edges = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]]).tolist()
        whole = lcp.min()
        touched = []
        for a, b in zip(edges, edges[1:], strict=False):
            symbol, own = int(to[a]), at[a:b]
            cuts = np.empty(b - a + 1, np.intp)
            cuts[0] = 0
            cuts[1:] = own + 1
            rest = cuts[-1] < len(lcp)
            least = np.minimum.reduceat(lcp, cuts if rest else cuts[:-1])
            entry = np.minimum(least[: b - a] + 1, self.cap).astype(np.int16)
            entry[0] = min(self.cap, int(min(self.least[symbol], least[0])) + 1) if self.begun[symbol] else 0
            touched.append((symbol, least[-1] if rest else BIG))
            self.queue.push(symbol, (pos[own] - 1).astype(np.int32), entry)
        np.minimum(self.least, whole, out=self.least)
        for symbol, least in touched:
            self.least[symbol], self.begun[symbol] = least, True


def _run(t: np.ndarray, at: int) -> int:
    k = 1
    while at + k < len(t) and t[at + k] == t[at]:
        k += 1
    return k


def sort_suffixes(t: np.ndarray, symbols: int, emit: Emit, cap: int, wide: int = 4096, folder: str | None = None, memory: int = 64 << 20) -> None:
    """Calls emit(positions, common prefixes) for all suffixes of t in descending order, block by block.

    t ends with 0, which stands nowhere else. A common prefix is that with the suffix emitted before, 0 at first.
    """
    own = None
    if folder is None:
        own = tempfile.TemporaryDirectory()
        folder = own.name
    n = len(t)
    s = _is_s(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if n == 1:
        emit(np.zeros(1, np.int32), np.zeros(1, np.int16))
        return
    seeds, seed_lcp = _lms_order(t, s, lms, symbols, cap, wide, folder, memory)
    seed_from = np.searchsorted(t[seeds], np.arange(symbols + 1))
    # Ascending: L suffixes, each bucket before its seeds.
    queue, kept = DiskQueue(symbols, folder, memory), DiskQueue(symbols, folder, memory)
    sweep = _Sweep(t, symbols, cap, queue, up=True)
    for c in range(symbols):
        last = -1
        for pos, lcp in queue.pop(c):
            kept.push(c, pos, lcp)
            sweep.scan(c, pos, lcp, same=True)
            last = int(pos[-1])
        a, b = int(seed_from[c]), int(seed_from[c + 1])
        for i in range(a, b, 1 << 18):
            pos, lcp = seeds[i : min(b, i + (1 << 18))], seed_lcp[i : min(b, i + (1 << 18))].copy()
            if i == a:
                lcp[0] = min(cap, _run(t, last), _run(t, int(pos[0]))) if last >= 0 else 0
            sweep.scan(c, pos, lcp, same=False)
    queue.close()
    # Descending: S suffixes, each bucket before its L suffixes, which are read backwards.
    queue = DiskQueue(symbols, folder, memory)
    sweep = _Sweep(t, symbols, cap, queue, up=False)
    for c in range(symbols - 1, -1, -1):
        last = -1
        if c == 0:
            emit(np.array([n - 1], np.int32), np.zeros(1, np.int16))
            break
        for pos, lcp in queue.pop(c):
            emit(pos, lcp)
            sweep.scan(c, pos, lcp, same=True)
            last = int(pos[-1])
        seam = None
        for pos, lcp in kept.pop_back(c):
            if seam is None:
                seam = min(cap, _run(t, last), _run(t, int(pos[-1]))) if last >= 0 else 0
            pos, turned = pos[::-1], np.empty(len(lcp), np.int16)
            turned[0], turned[1:] = seam, lcp[:0:-1]
            seam = lcp[0]
            emit(pos, turned)
            sweep.scan(c, pos, turned, same=False)
    queue.close()
    kept.close()
    if own is not None:
        own.cleanup()
