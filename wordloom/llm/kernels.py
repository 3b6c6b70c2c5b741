"""Vectorised kernels over the raw buffers of Arrow string columns.

The operators of this subpackage read texts as one ``uint8`` array plus offsets, so no Python
object is made for a word, a line or a window. Null texts are empty texts everywhere.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Start values of the two independent span hashes.
STARTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: ``[\x20\x09-\x0D]``
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@lru_cache(1)
def _trim():
    """Arrow's buffers come from the C library from here on; returns what gives its free pages back."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not glibc: its allocator keeps its own counsel
        return lambda _: 0


def release() -> None:
    """Gives freed memory back: a worker is used again by other tasks, and must not keep what its largest slice took."""
    _trim()(0)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its ``n + 1`` offsets; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``target`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + target, "right")) - 1)
        yield lo, hi
        release()
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time; ``which``: one of two independent hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    mask = (np.uint64(1) << (np.arange(8, dtype=np.uint64) * np.uint64(8))) - np.uint64(1)
    mask = np.append(mask, ~np.uint64(0))
    h = length.astype(np.uint64) * STARTS[which] + STARTS[1 - which]
    h = mix(h ^ (eights[start] & mask[np.minimum(length, 8)]))
    more, k = np.flatnonzero(length > 8), 8
    while len(more):
        left = length[more] - k
        h[more] = mix(h[more] * STARTS[which] + (eights[start[more] + k] & mask[np.minimum(left, 8)]))
        k += 8
        more = more[left > 8]
    return h


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of each word ``[^\\x20\\x09-\\x0D]+``; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~IS_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    begin[cut] = word[cut]
    end = word.copy()
    end[:-1] &= ~word[1:] | begin[1:]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(end) + 1 - start
    return start, length, np.searchsorted(offsets, start, "right") - 1


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The spans, one after another."""
    total = int(length.sum())
    if not total:
        return data[:0]
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(start - (np.cumsum(length) - length), length)
    return data[at]
