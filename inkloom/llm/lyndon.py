"""Suffix array of a byte string by Lyndon grouping, in linear time and without renaming.

Phase 1 groups suffixes by their Lyndon prefix. Groups are handled in descending order; a suffix's
previous smaller pointer is the nearest earlier place in a lower group. Each such place has its
Lyndon prefix extended by the handled one, as often as it occurs there, so it moves to a new group
just above those of its old group that are not extended.

Phase 2 emits the suffixes in ascending order. Once a suffix is emitted, the suffixes whose Lyndon
prefix ends where it begins are the next of their groups: a walk along the pointers finds them.
"""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of text in ascending order; a proper prefix precedes what it begins."""
    n = len(text)
    if n == 0:
        return []
    # Groups by first byte: order holds the places by group, a group is named by its first index there.
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n
    size = [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        place[i] = k
        group[i] = start
        size[start] += 1
    smaller = [-1] * n
    high = n
    while high:
        start = group[order[high - 1]]
        own = order[start:high]
        count: dict[int, int] = {}
        own.sort()
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if len(count) == 1 or (count and max(count.values()) == 1):
            batches = [list(count)]
        else:
            by: dict[int, list[int]] = {}
            for j, m in count.items():
                by.setdefault(m, []).append(j)
            batches = [by[m] for m in sorted(by, reverse=True)]
        for batch in batches:
            touched: dict[int, int] = {}
            for j in batch:
                g = group[j]
                last = g + size[g] - 1
                size[g] -= 1
                other, at = order[last], place[j]
                order[at], place[other] = other, at
                order[last], place[j] = j, last
                touched[g] = touched.get(g, 0) + 1
            for g, moved in touched.items():
                new = g + size[g]
                size[new] = moved
                if new != g:
                    for k in range(new, new + moved):
                        group[order[k]] = new
        high = start
    # Phase 2: size is reused as the number already emitted in each group.
    filled = [0] * n
    out = [0] * n
    i = n - 1
    while i >= 0:
        g = group[i]
        out[g + filled[g]] = i
        filled[g] += 1
        i = smaller[i]
    for k in range(n):
        i = out[k] - 1
        end = smaller[out[k]]
        while i > end:
            g = group[i]
            out[g + filled[g]] = i
            filled[g] += 1
            i = smaller[i]
    return out
