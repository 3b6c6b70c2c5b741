"""Content-defined anchors: each window of ``length`` symbols is given to its smallest gram.

Equal windows have equal grams, so they choose the same anchor at the same offset, wherever they are.
Repeats need therefore be looked for only among windows whose anchors have equal grams.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

#: Bits of a packed key that hold a place; longer inputs are read in overlapping chunks.
PLACE_BITS = 23
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values."""
    n = len(x)
    if n < width:
        return x[:0]
    rows = -(-n // width)
    padded = np.full(rows * width, ~np.uint64(0))
    padded[:n] = x
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(grams: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of every run of windows that share an anchor.

    grams: a hash of the ``gram`` symbols from each place on (any value near the end); offsets: the rows'
    ends in symbols. Windows never cross rows.
    """
    n, width = int(offsets[-1]), length - gram + 1
    size = np.diff(offsets)
    windows = np.maximum(size - length + 1, 0)
    total = int(windows.sum())
    if not total:
        z = np.zeros(0, np.int64)
        return z, z, z
    start = np.repeat(offsets[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(total)
    chunk = (1 << PLACE_BITS) - length
    choice = np.empty(total, np.int64)
    for a in range(0, n, chunk):
        packed = (grams[a : a + chunk + width - 1] & ~_LOW)
        packed = packed | np.arange(len(packed), dtype=np.uint64)
        least = sliding_min(packed, width)
        lo, hi = np.searchsorted(start, (a, a + chunk))
        choice[lo:hi] = (least[start[lo:hi] - a] & _LOW).astype(np.int64) + a
    new = np.ones(total, bool)
    new[1:] = (choice[1:] != choice[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], total) - 1
    return choice[at], start[at], start[last]


def byte_grams(data: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on; bytes beyond the end count as 0."""
    n = len(data)
    padded = np.zeros(n + 32, np.uint8)
    padded[:n] = data
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + 17,), (1,))
    h = eights[:n] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eights[8 : n + 8]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h += eights[16 : n + 16]
    return K.mix(h)
