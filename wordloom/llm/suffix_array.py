"""Linear grouping construction of suffix arrays, for many strings side by side.

Suffixes are grouped by their first symbol. Groups are taken from the highest to the lowest: each
member's pointer goes to the nearest place on its left in a lower group (its previous smaller suffix),
and the places pointed to leave their group for a new one right above it, those with more pointers
higher. What a group shares is then the Lyndon prefix of its suffixes, and the groups are in order. A last pass from
the smallest suffix up emits each group's order: when a suffix is emitted, the suffix one place to its
left and that one's chain of pointers take the next places of their groups. No symbol is ever renamed.

All strings advance together, one group (then one suffix) each per step, as array operations; they
should be of like length. A step costs what its groups hold, so the work is linear in the input.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def suffix_arrays(symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffix arrays of the strings ``symbols[bounds[i]:bounds[i + 1]]``, one after another.

    Entries are places in ``symbols``. Strings must not be empty; a string that ends another's suffix is
    smaller, as if every string ended in a symbol below all others.
    """
    # an end symbol below all others closes each string
    count = len(bounds) - 1
    size = np.diff(bounds) + 1
    begin = np.cumsum(size) - size
    n = int(size.sum())
    text = np.full(n, np.iinfo(np.int64).min, np.int64)
    closing = begin + size - 1
    inner = np.ones(n, bool)
    inner[closing] = False
    text[inner] = symbols
    owner = np.repeat(np.arange(count), size)

    order = np.lexsort((text, owner))
    new = np.ones(n, bool)
    new[1:] = (text[order[1:]] != text[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    starts = np.flatnonzero(new)
    group = np.empty(n, np.int64)  # of a place: where its group starts in the order
    group[order] = np.repeat(starts, np.diff(starts, append=n))
    members = np.zeros(n, np.int64)
    members[starts] = np.diff(starts, append=n)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    prev = np.arange(-1, n - 1)
    prev[begin] = -1
    moved = np.zeros(n, bool)

    top = begin + size
    active = np.arange(count)
    while True:
        low = group[order[top[active] - 1]]
        going = low > begin[active]  # the end symbol's group comes last and needs nothing
        active, low = active[going], low[going]
        if not len(active):
            break
        place = order[_ranges(low, top[active] - low)]
        top[active] = low
        own = group[place]
        pointer = prev[place]  # still one to the left
        todo = np.arange(len(place))
        while True:
            p = pointer[todo]
            todo = todo[(p >= 0) & (group[np.maximum(p, 0)] >= own[todo])]
            if not len(todo):
                break
            # places of this very group lead on to where they point so far
            pointer[todo] = prev[pointer[todo]]
            prev[place[todo]] = pointer[todo]
        # the head of a string has none on its left
        target, times = np.unique(pointer[pointer >= 0], return_counts=True)
        level = int(times.max()) if len(times) else 0
        levels = np.unique(times)[::-1] if level > 1 else (1,) if level else ()
        for l in levels:  # noqa: E741
            some = target[times == l] if level > 1 else target
            home = group[some]
            by_home = np.argsort(home, kind="stable")
            some, home = some[by_home], home[by_home]
            first = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
            h, c = home[first], np.diff(first, append=len(home))
            rest = members[h] - c
            split = rest > 0
            if split.any():
                if not split.all():
                    keep = np.repeat(split, c)
                    some, h, c, rest = some[keep], h[split], c[split], rest[split]
                tail_at = h + rest
                tail = _ranges(tail_at, c)
                moved[some] = True
                stay = tail[~moved[order[tail]]]  # slots of the tail whose places stay behind
                out = at[some]
                out = out[out < np.repeat(tail_at, c)]  # slots in front of it whose places move
                a, b = order[out], order[stay]
                order[out], order[stay] = b, a
                at[b], at[a] = out, stay
                moved[some] = False
                members[h] = rest
                members[tail_at] = c
                group[some] = np.repeat(tail_at, c)

    # emit each group's order
    final = np.full(n, -1, np.int64)
    final[begin] = closing
    placed = np.zeros(n, bool)
    placed[closing] = True
    free = np.arange(n)  # next free slot of the group that starts here
    active, step = np.arange(count), 0
    while len(active):
        here = final[begin[active] + step]
        j = here - 1
        j = j[here > begin[active]]
        while len(j):
            j = j[~placed[j]]
            if not len(j):
                break
            g = group[j]
            final[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
            j = j[j >= 0]
        step += 1
        active = active[size[active] > step]
    # without the end symbols
    back = np.cumsum(inner) - 1
    final = final[np.repeat(begin + 1, size - 1) + _ranges(np.zeros(count, np.int64), size - 1)]
    return back[final]
