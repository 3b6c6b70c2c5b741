"""Which windows of a corpus repeat: the first, coarse round that suffix operators share.

Every window belongs to an anchor (see ``anchors``); the windows of one anchor form a span. Spans are
compared whole first: where two spans are equal, all their windows repeat, and one of them stands for
both from then on. Only spans that share their anchor's gram with a different span need a closer look.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from . import kernels as K
from .anchors import anchors
from .slices import grow, shrink

#: Verdicts: the whole span repeats; the span (or a copy that stands for it) must be looked at closely; its gram
#: has too many spans for one group, so it goes there in pieces.
WHOLE, CLOSE, HEAVY = 1, 2, 4
#: Different spans of one gram beyond which they are cut by distance to the anchor before they are dealt.
HEAVY_SPANS = 4096


class Spans:
    """The spans of a slice: anchors, window starts, and the distinct (gram, span) pairs in order.

    rank: the rows' order of precedence, if it is not their own; the first stands for its pair.
    """

    def __init__(self, grams: np.ndarray, offsets: np.ndarray, length: int, gram: int, content: Callable, rank: np.ndarray | None = None):
        self.anchor, self.first, self.last = anchors(grams, offsets, length, gram)
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        g = K.mix(grams[self.anchor])  # anchors have small grams; groups need even keys
        s = content(self.first, self.last + length - self.first) ^ K.mix((self.anchor - self.first).astype(np.uint64))
        order = np.lexsort((self.row if rank is None else rank[self.row], s, g))
        new = np.ones(len(order), bool)
        new[1:] = (g[order[1:]] != g[order[:-1]]) | (s[order[1:]] != s[order[:-1]])
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        self.sample = order[new]  # of each pair, a span of the first row that holds it
        self.gram, self.span = g[self.sample], s[self.sample]
        self.times = np.bincount(self.kind, minlength=len(self.sample))

    def groups(self, number: int) -> np.ndarray:
        """The group of each pair; pairs ascend by gram, and so do groups."""
        return (self.gram >> np.uint64(32)).astype(np.int64) * number >> 32


def cut_by_group(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal, ascending groups."""
    if len(group):
        at = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(group[a]), slice(a, b)


def send_spans(spans: Spans, groups: int, ids: np.ndarray | None) -> Iterator[tuple[int, list[bytes]]]:
    """Distinct pairs with the smallest id that holds each, or with how often the slice holds it (1 or 2)."""
    aux = np.minimum(spans.times, 2).astype(np.int64) if ids is None else ids
    for group, at in cut_by_group(spans.groups(groups)):
        yield group, [shrink(spans.gram[at]), shrink(spans.span[at]), shrink(aux[at])]


def judge_spans(rows: list, earlier: bool, heavy: int = HEAVY_SPANS) -> Iterator[tuple[int, bytes]]:
    """earlier: repeats are windows that a smaller id holds; else windows found anywhere else."""
    gram, span, aux = (np.concatenate([grow(b[i], k) for _, b in rows]) for i, k in enumerate((np.uint64, np.uint64, np.int64)))
    order = np.lexsort((aux, span, gram))
    g, s, x = gram[order], span[order], aux[order]
    new_gram = np.append(True, g[1:] != g[:-1])
    new = new_gram | np.append(True, s[1:] != s[:-1])
    kind, family = np.cumsum(new) - 1, np.cumsum(new_gram) - 1
    number = np.bincount(family[new], minlength=family[-1] + 1)[family]  # of different spans on one gram
    several = number > 1
    code = np.zeros(len(order), np.uint8)
    if earlier:
        least = x[new][kind]
        code[x > least] = WHOLE
        code[several & (x == least)] = CLOSE
    else:
        total = np.bincount(kind, weights=x)[kind]
        code[total > 1] = WHOLE
        code[several & new] |= CLOSE
    code[(number > heavy) & (code & CLOSE > 0)] |= HEAVY
    verdict = np.empty(len(order), np.uint8)
    verdict[order] = code
    at = 0
    for key, blobs in rows:
        n = int.from_bytes(blobs[0][:8], "little") // 8
        yield key, shrink(verdict[at : at + n])
        at += n


def codes(spans: Spans, verdicts: dict[int, bytes]) -> np.ndarray:
    """The verdict on each distinct pair."""
    found = [grow(verdicts[g], np.uint8) for g in sorted(verdicts)]
    return np.concatenate(found) if found else np.zeros(len(spans.sample), np.uint8)


class Records:
    """What a slice sends to the second round: its close kinds whole, or in pieces where their gram has many spans.

    kind, offset, windows: the span kind, the first of its windows and their number; key: what decides the group;
    lead: symbols from the piece's start to the anchor. Pieces are cut at like distance to the anchor, and their key
    holds what all of a piece's windows have in common, so only pieces that can share a window stay together.
    """

    def __init__(self, spans: Spans, code: np.ndarray, groups: int, length: int, content: Callable, step: int):
        close = np.flatnonzero(code & CLOSE)
        heavy = code[close] & HEAVY > 0
        pick = spans.sample[close]
        lead, number = spans.anchor[pick] - spans.first[pick], spans.last[pick] - spans.first[pick] + 1
        light, cut = np.flatnonzero(~heavy), np.flatnonzero(heavy)
        low = np.floor_divide(-lead[cut], step)
        cells = np.floor_divide(-lead[cut] + number[cut] - 1, step) - low + 1
        own = np.repeat(cut, cells)
        cell = np.repeat(low, cells) + np.arange(len(own)) - np.repeat(np.cumsum(cells) - cells, cells)
        a = np.maximum(cell * step, -lead[own])
        b = np.minimum(cell * step + step, number[own] - lead[own])
        core = content(spans.anchor[pick[own]] + cell * step + step - 1, np.full(len(own), length - step + 1))
        at = np.concatenate((light, own))
        key = np.concatenate((spans.gram[close[light]], K.mix(K.mix(spans.gram[close[own]] ^ K.mix((cell + (1 << 20)).astype(np.uint64))) ^ core)))
        offset = np.concatenate((np.zeros(len(light), np.int64), a + lead[own]))
        windows = np.concatenate((number[light], b - a))
        group = (key >> np.uint64(32)).astype(np.int64) * groups >> 32
        order = np.argsort(group, kind="stable")
        at, self.group, self.key, self.offset, self.windows = at[order], group[order], key[order], offset[order], windows[order]
        self.kind, self.lead = close[at], lead[at] - self.offset
        self.start = spans.first[pick[at]] + self.offset

    def hits(self, spans: Spans, sent: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """From the groups' verdicts, bits of windows: those of all kinds one after another, and where each kind's begin."""
        number = spans.last[spans.sample] - spans.first[spans.sample] + 1
        first = np.cumsum(number) - number
        out = np.zeros(int(number.sum()), bool)
        for g, at in cut_by_group(self.group):
            windows = self.windows[at]
            bits = np.unpackbits(grow(sent[g], np.uint8), count=int(windows.sum())).astype(bool)
            place = np.repeat(first[self.kind[at]] + self.offset[at] - (np.cumsum(windows) - windows), windows) + np.arange(len(bits))
            out[place[bits]] = True
        return out, first


def by_slice(rows: list, windows: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Verdicts of each slice's records, whose windows are one after another in ``found``."""
    ends = np.concatenate(([0], np.cumsum(windows)))
    at = 0
    for key, blobs in rows:
        n = int.from_bytes(blobs[0][:8], "little") // 8
        yield key, shrink(np.packbits(found[ends[at] : ends[at + n]]))
        at += n


def covered(total: int, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Which of ``total`` places lie in a range ``start .. start + size``."""
    change = np.bincount(start, minlength=total + 1) - np.bincount(start + size, minlength=total + 1)
    return np.cumsum(change)[:total] > 0
