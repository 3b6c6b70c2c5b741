"""Suffix-array dedup of repeated byte strings.

A first round (``repeats``) settles spans that occur whole elsewhere. What is left, one of each
distinct span whose anchor's gram also stands in a different span, goes by its gram to groups of
bounded memory. There a suffix array by linear grouping construction (``suffix_array``) sorts the
pieces' suffixes, and a window repeats if it shares its first ``length`` bytes with a neighbour.
Spans are refined first: their windows are dealt by their distance to the anchor, and pieces that agree
on all that those windows have in common stay together. Equal pieces are taken once, and a piece alone
needs nothing. Where many different pieces stay together they are cut more finely, so strings stay short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .anchors import byte_grams
from .slices import Slice, grow, judged, over, pack, shrink
from .store import Store

GRAM = 24
#: Bytes of a group of grams in the first and in the second round, and of one string of the suffix array.
GROUP_BYTES, CLOSE_BYTES, STRING_BYTES = 16 << 20, 64 << 20, 1 << 13


def byte_spans(s: Slice, length: int) -> R.Spans:
    return R.Spans(byte_grams(s.data), s.offsets, length, GRAM, lambda first, size: K.span_hash(s.data, first, size))


def repeated_windows(data: np.ndarray, start: np.ndarray, size: np.ndarray, gram: np.ndarray, lead: np.ndarray, twice: np.ndarray, length: int, string_bytes: int = STRING_BYTES) -> np.ndarray:
    """For each window of each span, one after another: does it start anywhere else?

    gram: of each span's anchor; lead: bytes before the anchor; twice: the span stands for several.
    """
    windows = size - length + 1
    first = np.cumsum(windows) - windows
    out = np.zeros(int(windows.sum()), bool)
    # pieces to compare: (family, start, windows), at first the spans themselves
    owner = np.arange(len(start))
    family = gram
    offset, width = np.zeros(len(start), np.int64), windows.copy()
    step = 22
    while len(owner):
        # cut into windows at like distance to the anchor
        low = offset - lead[owner]
        low_cell, high_cell = np.floor_divide(low, step), np.floor_divide(low + width - 1, step)
        cells = high_cell - low_cell + 1
        pick = np.repeat(np.arange(len(owner)), cells)
        cell = low_cell[pick] + np.arange(len(pick)) - np.repeat(np.cumsum(cells) - cells, cells)
        a = np.maximum(cell * step, low[pick])
        b = np.minimum(cell * step + step, low[pick] + width[pick])
        owner, family = owner[pick], family[pick]
        offset, width = a + lead[owner], b - a
        # what all windows of a cell have in common: from its last start to its first end; every piece holds it
        core = K.span_hash(data, start[owner] + lead[owner] + cell * step + step - 1, np.full(len(owner), length - step + 1))
        family = K.mix(family ^ K.mix((cell + (1 << 20)).astype(np.uint64))) ^ core
        # equal pieces are taken once: the copies repeat each other wholly
        content = K.mix(K.span_hash(data, start[owner] + offset, width + length - 1) + K.mix(width.astype(np.uint64)) * K.STARTS[0]) + K.mix(family)
        order = np.lexsort((owner, content))
        same = np.append(False, content[order[1:]] == content[order[:-1]])
        again = np.zeros(len(order), bool)
        again[order] = same | np.append(same[1:], False)
        drop = np.zeros(len(order), bool)
        drop[order] = same
        out |= R.covered(len(out), (first[owner] + offset)[again], width[again])
        owner, family, offset, width = owner[~drop], family[~drop], offset[~drop], width[~drop]
        if step == 1:
            break  # a piece is one window now, and equal windows have met
        order = np.argsort(family, kind="stable")
        owner, family, offset, width = owner[order], family[order], offset[order], width[order]
        at = np.flatnonzero(np.append(True, family[1:] != family[:-1]))[: len(family)]
        many = np.diff(at, append=len(family))
        large = np.repeat(np.add.reduceat(width + length, at) > string_bytes, many) if len(at) else np.zeros(0, bool)
        ready = np.repeat(many > 1, many) & ~large
        mark_by_suffix_array(data, start, owner[ready], offset[ready], width[ready], family[ready], length, first, out)
        owner, offset, width, family = owner[large], offset[large], width[large], family[large]
        step = max(1, step // 4)
    out[np.repeat(twice, windows)] = True
    return out


def mark_by_suffix_array(data, start, owner, offset, width, family, length, first, out) -> None:
    """Marks the windows that share ``length`` bytes with a neighbour in their family's suffix array."""
    if not len(owner):
        return
    from .suffix_array import suffix_arrays

    at = np.flatnonzero(np.append(True, family[1:] != family[:-1]))
    number = np.diff(at, append=len(family))
    piece = width + length - 1
    string = np.add.reduceat(piece + 1, at)
    # like sizes together, a megabyte at a time
    by_size = np.argsort(string, kind="stable")
    budget, run, runs = 0, [], []
    for i in by_size.tolist():
        if run and (budget > 1 << 20 or string[i] > 2 * string[run[0]] + 256):
            runs.append(run)
            budget, run = 0, []
        run.append(i)
        budget += int(string[i])
    runs.append(run)
    for run in runs:
        run = np.array(run)
        n = number[run]
        pick = np.repeat(at[run] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        size = piece[pick] + 1
        place = np.cumsum(size) - size
        symbols = np.empty(int(size.sum()), np.int64)
        end = np.zeros(len(symbols), bool)
        end[place + size - 1] = True
        symbols[~end] = K.gather(data, start[owner[pick]] + offset[pick], piece[pick]).astype(np.int64) + len(pick)
        symbols[end] = np.arange(len(pick))  # ends differ, so no match runs over one
        bounds = np.concatenate((np.cumsum(n) - n, [len(pick)]))
        bounds = np.append(place, len(symbols))[bounds]
        order = suffix_arrays(symbols, bounds)
        # windows in suffix order; neighbours of one string are equal or nothing is
        source = np.repeat(np.arange(len(pick)), size)
        inside = order - place[source[order]]
        is_window = inside < width[pick][source[order]]
        w = order[is_window]
        home = np.searchsorted(bounds, w, "right")
        pair = np.flatnonzero(home[1:] == home[:-1])
        raw = np.where(end, 0, symbols - len(pick)).astype(np.uint8)
        same = equal_bytes(raw, w[pair], w[pair + 1], length)
        pair = pair[same]
        hit = np.unique(np.concatenate((pair, pair + 1)))
        w = w[hit]
        s = source[w]
        out[first[owner[pick[s]]] + offset[pick[s]] + w - place[s]] = True


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    left = np.arange(len(a))
    for k in [*range(0, length - 7, 8), max(0, length - 8)]:
        left = left[eights[a[left] + k] == eights[b[left] + k]]
    same = np.zeros(len(a), bool)
    same[left] = True
    return same


def close_records(s: Slice, spans: R.Spans, code: np.ndarray, groups: int, length: int) -> R.Records:
    return R.Records(spans, code, groups, length, lambda at, size: K.span_hash(s.data, at, size), 22)


def send_close(s: Slice, spans: R.Spans, code: np.ndarray, groups: int, length: int) -> Iterator[tuple[int, list[bytes]]]:
    r = close_records(s, spans, code, groups, length)
    for group, at in R.cut_by_group(r.group):
        size = r.windows[at] + length - 1
        yield group, [shrink(r.key[at]), shrink(size), shrink(r.lead[at]), shrink((code[r.kind[at]] & R.WHOLE).astype(bool)), shrink(K.gather(s.data, r.start[at], size))]


def judge_close(rows: list, length: int, string_bytes: int) -> Iterator[tuple[int, bytes]]:
    key, size, lead, twice, data = (np.concatenate([grow(b[i], k) for _, b in rows]) for i, k in enumerate((np.uint64, np.int64, np.int64, bool, np.uint8)))
    found = repeated_windows(data, np.cumsum(size) - size, size, key, lead, twice, length, string_bytes)
    yield from R.by_slice(rows, size - length + 1, found)


def removed(s: Slice, length: int, close_groups: int) -> np.ndarray:
    """Which bytes of the slice lie in a repeated string, by the verdicts of both rounds."""
    spans = byte_spans(s, length)
    code = R.codes(spans, s.verdicts["verdict_spans"])
    whole = np.flatnonzero(code[spans.kind] & R.WHOLE)
    gone = R.covered(len(s.data), spans.first[whole], spans.last[whole] + length - spans.first[whole])
    if (code & R.CLOSE).any():
        hit, first = close_records(s, spans, code, close_groups, length).hits(spans, s.verdicts["verdict_close"])
        at = np.flatnonzero(hit)
        kind = np.searchsorted(first, at, "right") - 1
        gone |= R.covered(len(s.data), spans.first[spans.sample[kind]] + at - first[kind], length)
    return gone


def with_characters(gone: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``gone``, and the other bytes of every UTF-8 character that loses one."""
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][np.diff(offsets) > 0]] = True
    character = np.cumsum(lead) - 1
    return (np.bincount(character, weights=gone) > 0)[character] if len(data) else gone


def dedup_substrings(docs: DataFrame, length: int = 200, text_col: str = "text", as_text: bool = False, string_bytes: int = STRING_BYTES, heavy_spans: int = R.HEAVY_SPANS) -> DataFrame:
    """Removes every byte of a text that lies in a string of ``length`` bytes that also starts elsewhere.

    Elsewhere is any other place of any row, the same row included; overlaps count, and strings are
    judged on the input. Returns all columns of ``docs`` with the text replaced by ``kept binary`` (the
    bytes that stay), and ``n_bytes, n_removed, n_spans``; with ``as_text``, ``kept`` is a string, less the
    bytes of characters that a cut has split. Null and empty texts keep nothing. Repeated
    rows are places of their own, so rows of ``length`` bytes or more that are equal lose all. An empty
    table gives no rows. A column of ``docs`` that is named like a result is replaced by it.
    """
    store = Store(docs.sparkSession, "substrings")
    sliced = pack(docs, text_col, store)
    total = sliced.agg(F.sum("size")).first()[0] or 0
    groups, close_groups = max(1, -(-total // GROUP_BYTES)), max(8, -(-total // CLOSE_BYTES) * 4)

    def emit_spans(s: Slice):
        return R.send_spans(byte_spans(s, length), groups, None)

    def emit_close(s: Slice):
        spans = byte_spans(s, length)
        return send_close(s, spans, R.codes(spans, s.verdicts["verdict_spans"]), close_groups, length)

    once = judged(sliced, emit_spans, lambda rows: R.judge_spans(rows, False, heavy_spans), "spans", store)
    twice = judged(once, emit_close, lambda rows: judge_close(rows, length, string_bytes), "close", store)
    names = ("kept", "n_bytes", "n_removed", "n_spans")
    others = [c for c in docs.columns if c != text_col]
    kind = docs.select(F.struct(*others).alias("row")).schema["row"].dataType.simpleString()

    def apply(s: Slice) -> Iterator[pa.RecordBatch]:
        gone = removed(s, length, close_groups)
        n = len(s.offsets) - 1
        size = np.diff(s.offsets)
        kept_before = np.concatenate(([0], np.cumsum(~gone)))[s.offsets]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        heads = s.offsets[:-1][size > 0]
        begins[heads] = gone[heads]
        spans_before = np.concatenate(([0], np.cumsum(begins)))[s.offsets]
        lost = with_characters(gone, s.data, s.offsets) if as_text else gone
        raw, ends = s.data[~lost], np.concatenate(([0], np.cumsum(~lost)))[s.offsets]
        wide, narrow = (pa.large_string(), pa.string()) if as_text else (pa.large_binary(), pa.binary())
        kept = pa.Array.from_buffers(wide, n, [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(narrow)
        yield pa.RecordBatch.from_arrays([s.rest(), kept, pa.array(size), pa.array(size - np.diff(kept_before)), pa.array(np.diff(spans_before))], names=["row", *names])

    done = over(twice, apply, f"row {kind}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    return done.select(*(F.col("row").getField(c).alias(c) for c in others if c not in names), *names)
