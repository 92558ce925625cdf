"""Suffix sorting by linear grouping construction.

The first phase sorts suffixes into groups by their longest Lyndon prefix: groups are taken from the
greatest down, each member points to the nearest suffix before it in a lower group (its previous smaller
suffix), and the suffixes pointed to move into new groups just above their old ones, by how many members
point to them. The second phase emits the order inside the groups in one pass from the least suffix on,
each emitted suffix placing its predecessor and the chain of previous smaller suffixes before it. Nothing is renamed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text) -> np.ndarray:
    """The start of every suffix of a sequence of non-negative integers, in lexicographic order; a suffix comes before its extensions."""
    symbols = np.asarray(text, np.int64)
    n = len(symbols) + 1  # and an end that is less than all symbols
    if n == 1:
        return np.zeros(0, np.int64)
    ends = np.append(symbols + 1, 0)
    kinds, first = np.unique(ends, return_inverse=True)
    group = first.tolist()  # of each suffix
    by = np.argsort(first, kind="stable")
    members = [x.tolist() for x in np.split(by, np.cumsum(np.bincount(first))[:-1])]
    lower = list(range(-1, len(kinds) - 1))  # the next group down
    upper = [*range(1, len(kinds)), -1]
    done, before = bytearray(n), [-1] * n

    at = len(kinds) - 1
    while at > 0:  # the end's group, 0, has nothing before it that is lower
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and done[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():  # in ascending order, as members are
            moved.setdefault((group[j], k), []).append(j)
        last = top = -1
        for old, k in sorted(moved) if len(moved) > 1 else moved:
            below = top if old == last else old  # fewer pointers first, each new group above the one put in before it
            new, up = len(members), upper[below]
            members.append(moved[old, k])
            for j in moved[old, k]:
                group[j] = new
            lower.append(below)
            upper.append(up)
            upper[below] = new
            if up >= 0:
                lower[up] = new
            last, top = old, new
        at = lower[at]

    place, g, at = [0] * len(members), 0, 0  # where each group's next suffix goes
    sizes = np.bincount(np.asarray(group), minlength=len(members)).tolist()
    while g >= 0:
        place[g] = at
        at += sizes[g]
        g = upper[g]
    order, placed = [0] * n, bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[place[g]] = j
            place[g] += 1
            placed[j] = 1
            j = before[j]
    return np.asarray(order[1:], np.int64)
