"""Substring dedup on words by prefix-partitioned suffix trees.

A suffix is a document's words from some place on, cut at ``length`` words. Suffixes that can be equal at that
depth are brought together by content-defined anchors (``repeats``): equal windows have one anchor at one distance, and
where too many spans share an anchor's words they are dealt by what their windows have in common as well. A group's
suffixes are then split by prefixes of variable length, one word further wherever a part would not fit in
memory, and each part becomes a subtree: its suffixes in order with the common prefix lengths of neighbours, which are the
tree's inner nodes. A node as deep as ``length`` is a repeat; the smallest document below it keeps its words.

Spans that repeat whole are settled in the first round, so they enter no tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats as R
from .slices import Slice, grow, judged, over, pack, shrink
from .store import Store

#: Suffixes of a subtree; bytes of text behind a group of either round.
TREE_SUFFIXES, GROUP_BYTES = 1 << 16, 16 << 20


class Words:
    """Words of a slice, their hashes, and the hash of the next ``gram`` words from each on."""

    def __init__(self, s: Slice, length: int):
        self.start, self.size, self.row = K.word_spans(s.data, s.offsets)
        n = len(self.start)
        self.offsets = np.searchsorted(self.row, np.arange(len(s.offsets)), "left").astype(np.int64)
        self.hash = K.span_hash(s.data, self.start, self.size)
        self.gram = min(8, 1 << (length.bit_length() - 1))
        self.ahead, step, pad = self.hash, 1, np.zeros(self.gram, np.uint64)
        while step < self.gram:
            self.ahead = K.mix(self.ahead * K.STARTS[0] + np.append(self.ahead[step:], pad[: min(step, n)]))
            step *= 2

    def content(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return K.span_hash(self.hash.view(np.uint8), at * 8, size * 8)

    def spans(self, length: int, ids: np.ndarray) -> R.Spans:
        return R.Spans(self.ahead, self.offsets, length, self.gram, self.content, ids)


def prefix_parts(words: np.ndarray, at: np.ndarray, depth: int, most: int) -> Iterator[tuple[np.ndarray, int]]:
    """Splits suffixes (places ``at``) by their prefixes: ``part, shared`` with numbers of suffixes of at most ``most``.

    A part holds one or several prefixes; one that has more suffixes is split by its next word. Suffixes equal to the
    full depth are one part whatever their number (``shared`` is then the depth).
    """
    todo = [(np.arange(len(at)), 0)]
    while todo:
        part, k = todo.pop()
        if len(part) <= most or k == depth:
            yield part, k
            continue
        word = words[at[part] + k]
        order = np.argsort(word, kind="stable")
        part, word = part[order], word[order]
        cut = np.concatenate(([0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(part)]))
        begin = 0
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a > most:
                if a > begin:
                    todo.append((part[begin:a], k))
                todo.append((part[a:b], k + 1))
                begin = b
            elif b - begin > most:
                todo.append((part[begin:a], k))
                begin = a
        if begin < len(part):
            todo.append((part[begin:], k))


class Subtree:
    """The suffix tree of some suffixes, cut at ``depth`` words: leaves in order, and neighbours' common prefix lengths."""

    def __init__(self, words: np.ndarray, at: np.ndarray, depth: int):
        rows = words[at[:, None] + np.arange(depth)].astype(">u4")  # so that bytes are in order of words
        self.leaves = np.argsort(rows.view(f"V{4 * depth}").ravel(), kind="stable")
        rows = rows[self.leaves]
        differ = rows[1:] != rows[:-1]
        self.common = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)

    def deep_nodes(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last leaf of the topmost inner nodes at ``least`` words or deeper."""
        deep = np.concatenate(([False], self.common >= least, [False])).astype(np.int8)
        change = np.diff(deep)
        return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def earlier_windows(words: np.ndarray, size: np.ndarray, doc: np.ndarray, depth: int, most: int = TREE_SUFFIXES) -> np.ndarray:
    """For each window of each record (``size`` words of a document), is it in a smaller document too?"""
    _, words = np.unique(words, return_inverse=True)
    windows = size - depth + 1
    owner = np.repeat(np.arange(len(size)), windows)
    at = np.repeat(np.cumsum(size) - size - (np.cumsum(windows) - windows), windows) + np.arange(len(owner))
    mine, found = doc[owner], np.zeros(len(owner), bool)
    for part, shared in prefix_parts(words, at, depth, most):
        if shared == depth:
            found[part] = mine[part] > mine[part].min()
            continue
        tree = Subtree(words, at[part], depth)
        first, last = tree.deep_nodes(depth)
        if len(first):
            inside = np.repeat(np.arange(len(first)), last - first + 1)
            leaf = part[tree.leaves[np.repeat(first - np.concatenate(([0], np.cumsum(last - first + 1)[:-1])), last - first + 1) + np.arange(len(inside))]]
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, inside, mine[leaf])
            found[leaf] = mine[leaf] > least[inside]
    return found


def judge_trees(rows: list, depth: int, most: int) -> Iterator[tuple[int, bytes]]:
    size, doc, words = (np.concatenate([grow(b[i], k) for _, b in rows]) for i, k in enumerate((np.int64, np.int64, np.uint64)))
    yield from R.by_slice(rows, size - depth + 1, earlier_windows(words, size, doc, depth, most))


def dedup_passages(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", tree_suffixes: int = TREE_SUFFIXES, heavy_spans: int = R.HEAVY_SPANS) -> DataFrame:
    """Removes each word in a window of ``length`` words that also starts in a document of a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``; windows are judged on the input. Returns all columns of ``docs``, the
    text replaced by the words that stay, one space between them, with ``n_words`` and ``n_removed``. Null
    and empty texts have no words and stay empty. Rows of one id (or without any) are not smaller than each
    other; a missing id is larger than all. An empty table gives no rows. Columns named like a result are
    replaced by it.
    """
    store = Store(docs.sparkSession, "passages")
    sliced = pack(docs, text_col, store)
    total = sliced.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))

    def look(s: Slice):
        w, ids = Words(s, length), s.ids(id_col)
        return w, ids, w.spans(length, ids)

    def records(w: Words, spans: R.Spans, code: np.ndarray) -> R.Records:
        return R.Records(spans, code, groups, length, w.content, min(8, length))

    def emit_spans(s: Slice):
        _, ids, spans = look(s)
        return R.send_spans(spans, groups, ids[spans.row[spans.sample]])

    def emit_close(s: Slice):
        w, ids, spans = look(s)
        r = records(w, spans, R.codes(spans, s.verdicts["verdict_spans"]))
        doc = ids[spans.row[spans.sample[r.kind]]]
        for group, at in R.cut_by_group(r.group):
            size = r.windows[at] + length - 1
            yield group, [shrink(size), shrink(doc[at]), shrink(K.gather(w.hash, r.start[at], size))]

    once = judged(sliced, emit_spans, lambda rows: R.judge_spans(rows, True, heavy_spans), "spans", store)
    twice = judged(once, emit_close, lambda rows: judge_trees(rows, length, tree_suffixes), "trees", store)
    names = (text_col, "n_words", "n_removed")
    others = [c for c in docs.columns if c != text_col]
    kind = docs.select(F.struct(*others).alias("row")).schema["row"].dataType.simpleString()

    def apply(s: Slice) -> Iterator[pa.RecordBatch]:
        w, ids, spans = look(s)
        code = R.codes(spans, s.verdicts["verdict_spans"])
        later = ids[spans.row] > ids[spans.row[spans.sample]][spans.kind]
        whole = later | (code[spans.kind] & R.WHOLE > 0)
        gone = R.covered(len(w.start), spans.first[whole], spans.last[whole] + length - spans.first[whole])
        close = np.flatnonzero((code[spans.kind] & R.CLOSE > 0) & ~whole)
        if len(close):
            hit, first = records(w, spans, code).hits(spans, s.verdicts["verdict_trees"])
            number = spans.last[close] - spans.first[close] + 1
            inside = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            at = np.repeat(spans.first[close], number) + inside
            gone |= R.covered(len(w.start), at[hit[np.repeat(first[spans.kind[close]], number) + inside]], length)
        keep = np.flatnonzero(~gone)
        n = len(s.offsets) - 1
        size, row = w.size[keep], w.row[keep]
        lead = np.zeros(len(keep), np.int64)
        lead[1:] = row[1:] == row[:-1]
        total = size + lead
        text = np.full(int(total.sum()), 0x20, np.uint8)
        inside = np.ones(len(text), bool)
        inside[(np.cumsum(total) - total)[lead == 1]] = False
        text[inside] = K.gather(s.data, w.start[keep], size)
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, weights=total, minlength=n).astype(np.int64))))
        kept = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(ends), pa.py_buffer(text)]).cast(pa.string())
        n_words = np.diff(w.offsets)
        yield pa.RecordBatch.from_arrays([s.rest(), kept, pa.array(n_words), pa.array(n_words - np.bincount(row, minlength=n))], names=["row", "kept", "n_words", "n_removed"])

    done = over(twice, apply, f"row {kind}, kept string, n_words long, n_removed long")
    return done.select(*(F.col("row").getField(c).alias(c) for c in others if c not in names), F.col("kept").alias(text_col), "n_words", "n_removed")
