"""Which scans to drop from a history: by hand, by least change, and by geometric age bands.

A plan's scans are a short list on the driver; the counts it goes by come from the versions, one aggregation for each pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heapscope.operators.history import live

Changes = Callable[[int, int], int]


class BadPlan(ValueError):
    """Scans that aren't there, are protected, or more than can go."""


def changes_of(versions: DataFrame, key: list[str], values: list[str]) -> Changes:
    """How many keys differ between two scans (their times), each pair counted once."""
    known: dict[tuple[int, int], int] = {}

    def count(a: int, b: int) -> int:
        if (a, b) not in known:
            x, y = (live(versions, t).select(*key, F.struct(*values).alias(n)) for t, n in ((a, "x"), (b, "y")))
            known[a, b] = x.join(y, key, "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).count()
        return known[a, b]

    return count


def _protected(scans: Sequence[int], pinned: Sequence[int]) -> tuple[list[int], set[int]]:
    ordered = sorted(scans)
    if len(set(ordered)) < len(ordered) or set(pinned) - set(ordered):
        raise BadPlan("scans repeat, or a pinned one isn't there")
    return ordered, {*pinned, *ordered[:1], *ordered[-1:]}


def candidates(scans: Sequence[int], changes: Changes, pinned: Sequence[int] = ()) -> list[tuple]:
    """(scan, before, after, left, right, score, protected) of every scan; None beyond the ends."""
    ordered, kept = _protected(scans, pinned)
    out = []
    for i, s in enumerate(ordered):
        a, c = ordered[i - 1] if i else None, ordered[i + 1] if i + 1 < len(ordered) else None
        left, right = changes(a, s) if a is not None else None, changes(s, c) if c is not None else None
        out.append((s, a, c, left, right, max(left, right) if None not in (left, right) else None, s in kept))
    return out


def manual(scans: Sequence[int], changes: Changes, remove: Sequence[int], pinned: Sequence[int] = ()) -> list[tuple]:
    """Steps (scan, before, after, left, right, merged, score) that take out the given scans in order of time."""
    ordered, kept = _protected(scans, pinned)
    if len(set(remove)) < len(remove) or set(remove) - set(ordered) or set(remove) & kept:
        raise BadPlan("a scan to remove repeats, isn't there, or is protected")
    steps = []
    for s in sorted(remove):
        i = ordered.index(s)
        steps.append(_step(ordered, i, changes))
        del ordered[i]
    return steps


def _step(ordered: list[int], i: int, changes: Changes) -> tuple:
    a, s, c = ordered[i - 1 : i + 2]
    left, right = changes(a, s), changes(s, c)
    return s, a, c, left, right, changes(a, c), max(left, right)


def low_change(scans: Sequence[int], changes: Changes, drop: int, pinned: Sequence[int] = ()) -> list[tuple]:
    """Steps that again and again take out the scan whose greater change to a neighbour is least; the earliest of equal ones.

    What the neighbours then differ in is counted anew, as a change may have been taken back.
    """
    ordered, kept = _protected(scans, pinned)
    if not 0 <= drop <= len(ordered) - len(kept):
        raise BadPlan(f"can't drop {drop} of {len(ordered)} scans")
    before = dict(zip(ordered[1:], ordered, strict=False))
    after = dict(zip(ordered, ordered[1:], strict=False))
    score = lambda s: max(changes(before[s], s), changes(s, after[s]))
    heap = [(score(s), s) for s in ordered if s not in kept] if drop else []
    heapq.heapify(heap)
    steps: list[tuple] = []
    gone: set[int] = set()
    while len(steps) < drop:
        n, s = heapq.heappop(heap)
        if s in gone or n != score(s):
            continue  # its neighbours have changed; its new score lies in the heap too
        a, c = before[s], after[s]
        steps.append((s, a, c, changes(a, s), changes(s, c), changes(a, c), n))
        gone.add(s)
        after[a], before[c] = c, a
        for x in (a, c):
            if x not in kept:
                heapq.heappush(heap, (score(x), x))
    return steps


def geometric(times: Sequence[int], recent: int, growth: float = 2.0, samples: int = 1, pinned: Sequence[int] = ()) -> list[int]:
    """Times to keep: all younger than `recent` before the newest; of each older band [recent * growth^k, recent * growth^(k+1)) the newest
    of each of `samples` equal parts; the first, the last and the pinned ones."""
    if recent <= 0 or growth <= 1 or samples < 1:
        raise BadPlan("recent and samples must be positive and growth over 1")
    ordered, kept = _protected(times, pinned)
    slots: dict[tuple[int, int], int] = {}
    for t in ordered:
        age = ordered[-1] - t
        if age < recent:
            kept.add(t)
            continue
        k = 0
        while age >= recent * growth ** (k + 1):
            k += 1
        low, high = recent * growth**k, recent * growth ** (k + 1)
        slots[k, min(samples - 1, int((age - low) / (high - low) * samples))] = t
    return sorted(kept | set(slots.values()))
