"""Suffix sorting by grouping, without recursive renaming.

The number of grouping steps is linear in the input; the symbols at the start, and
the members of each group, are sorted besides.

Phase 1 handles groups of suffixes with a common Lyndon prefix in descending
order. A suffix i of the group at hand is the end of a run for the suffix
before it that is smaller, found over previous-smaller pointers; those runs
become longer by the group's prefix and move to a group of their own, placed
just behind the one they leave. Once all groups are done, each holds the
suffixes with one Lyndon prefix, in order. Phase 2 fills the array in
ascending order: the suffix just emitted puts the suffix whose Lyndon prefix
ends where it starts (and those chained to it) at the next free place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of `symbols` (integers) in order; a proper prefix sorts before what it begins.

    An empty input gives an empty array.
    """
    n = len(symbols)
    if n == 0:
        return np.empty(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.flatnonzero(head)
    start_of = (start[np.cumsum(head) - 1] + 1).tolist()
    # The empty suffix is smaller than all: position n in slot 0. A group is named by its first slot.
    sa = [n, *order.tolist()]
    slot, group = [0] * (n + 1), [0] * (n + 1)
    for k, (i, g) in enumerate(zip(sa[1:], start_of), 1):
        slot[i], group[i] = k, g
    size = dict(zip((start + 1).tolist(), np.diff(np.append(start, n)).tolist()))
    smaller = [-1] * n
    last = n
    while last:
        first = group[sa[last]]
        times: dict[int, int] = {}
        for i in sorted(sa[first : last + 1]):
            p = i - 1
            while p >= 0 and group[p] >= first:  # jump over all that belongs here or higher
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        # p is followed by this group's prefix times[p] times; the more, the greater
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            moved = by_times[k]
            for p in moved:
                g = group[p]
                size[g] -= 1
                end, at = g + size[g], slot[p]
                other = sa[end]
                sa[end], sa[at], slot[p], slot[other] = p, other, end, at
            for p in moved:
                new = group[p] + size[group[p]]
                times[p] = new
            for p in moved:
                group[p] = times[p]
            for p in moved:
                size[group[p]] = size.get(group[p], 0) + 1
        last = first - 1
    # ascending: the suffixes whose Lyndon prefix ends where the emitted one starts
    free = {}
    done = [False] * (n + 1)
    for k in range(n + 1):
        i = sa[k] - 1
        while i >= 0 and not done[i]:
            g = group[i]
            at = free.get(g, g)
            sa[at], free[g], done[i] = i, at + 1, True
            i = smaller[i]
    return np.array(sa[1:], np.int64)
