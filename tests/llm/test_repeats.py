"""Suffix operators against brute force."""

import hashlib
import re

import numpy as np
import pytest

from wordloom.llm import passages, substrings
from wordloom.llm.suffix_array import suffix_arrays

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cover(n, starts, length):
    out = np.zeros(n, bool)
    for a in starts:
        out[a : a + length] = True
    return out


def brute_bytes(texts, length):
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
    out = []
    for b in raw:
        gone = cover(len(b), [i for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1], length)
        runs = int((gone & ~np.append(False, gone[:-1])[: len(gone)]).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def brute_words(rows, length):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for a in range(len(w) - length + 1):
            k = tuple(w[a : a + length])
            first[k] = min(first.get(k, np.inf), np.inf if i is None else i)
    out = []
    for i, w in words:
        mine = np.inf if i is None else i
        gone = cover(len(w), [a for a in range(len(w) - length + 1) if first[tuple(w[a : a + length])] < mine], length)
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def test_suffix_arrays_equal_sorted_suffixes():
    rng = np.random.default_rng(2)
    for _ in range(400):
        strings = [rng.integers(0, rng.integers(1, 5), rng.integers(1, 40)) for _ in range(rng.integers(1, 7))]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        want = [a + i for s, a in zip(strings, bounds, strict=False) for i in sorted(range(len(s)), key=lambda i, s=s: s[i:].tolist())]
        assert suffix_arrays(np.concatenate(strings), bounds).tolist() == want


def random_texts(rng, n=120):
    base = "".join(chr(97 + x) for x in rng.integers(0, 20, 4000))
    texts = []
    for _ in range(n):
        a = rng.integers(0, 3400)
        x = list(base[a : a + rng.integers(20, 600)])
        for _ in range(rng.integers(0, 4)):
            x[rng.integers(0, len(x))] = "Zé"
        texts.append("".join(x))
    return [*texts, "ha" * 500, "ha" * 300, None, ""]


@pytest.mark.parametrize(("string_bytes", "heavy"), [(400, 1 << 20), (1 << 13, 1)])
def test_substrings(spark, string_bytes, heavy):
    texts = random_texts(np.random.default_rng(string_bytes))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(substrings.dedup_substrings(docs, 200, string_bytes=string_bytes, heavy_spans=heavy).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got] == brute_bytes(texts, 200)


def test_substrings_of_odd_texts(odd, none):
    rows = odd.collect()
    got = substrings.dedup_substrings(odd, 200)
    assert got.columns == ["doc_id", "row", "key", "score", "doc", "kept", "n_bytes", "n_removed", "n_spans"]
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got.collect()}
    assert [got[r.doc] for r in rows] == brute_bytes([r.text for r in rows], 200)
    assert substrings.dedup_substrings(none, 200).count() == 0


@pytest.mark.parametrize(("most", "heavy"), [(3, 1), (40, 1 << 20)])
def test_passages(odd, none, most, heavy):
    for length in (12, 50):
        got = passages.dedup_passages(odd, length, tree_suffixes=most, heavy_spans=heavy).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_words([(r.doc_id, r.text) for r in odd.collect()], length)
    assert passages.dedup_passages(none).count() == 0


def test_passages_of_texts_that_share_parts(spark):
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 300, 900)]
    rows = []
    for i in range(80):
        a = rng.integers(0, 700)
        w = base[a : a + rng.integers(5, 200)]
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = "new"
        rows.append((int(rng.integers(0, 60)), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.dedup_passages(docs, 20, tree_suffixes=50, heavy_spans=2).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got), key=str) == brute_words(rows, 20)


def test_prefixes_of_several_lengths_and_subtrees():
    rng = np.random.default_rng(3)
    size = np.array([60, 80, 45, 70, 90, 30])
    words = rng.integers(0, 3, int(size.sum())).astype(np.uint64)
    words[150:200] = words[10:60]
    words[260:280] = 1
    doc = np.array([5, 3, 9, 1, 3, 2])
    begin, depth = np.cumsum(size) - size, 8
    at = np.concatenate([np.arange(b, b + n - depth + 1) for b, n in zip(begin, size, strict=True)])
    owner = np.repeat(doc, size - depth + 1)
    parts = list(passages.prefix_parts(words.astype(np.int64), at, depth, 12))
    assert sorted(np.concatenate([p for p, _ in parts]).tolist()) == list(range(len(at)))
    assert len({k for _, k in parts}) > 2 and all(len(p) <= 12 or k == depth for p, k in parts)
    least = {}
    for a, d in zip(at, owner, strict=True):
        k = tuple(words[a : a + depth])
        least[k] = min(d, least.get(k, 99))
    want = [least[tuple(words[a : a + depth])] < d for a, d in zip(at, owner, strict=True)]
    for most in (2, 12, 1 << 16):
        assert passages.earlier_windows(words, size, doc, depth, most).tolist() == want
    tree = passages.Subtree(words.astype(np.int64), at, depth)
    rows = [tuple(words[a : a + depth]) for a in at]
    assert [rows[i] for i in tree.leaves] == sorted(rows)
    first, last = tree.deep_nodes(3)  # nodes of depth 3 are the prefixes of 3 words that several suffixes have
    shared = {r[:3] for r in rows if sum(x[:3] == r[:3] for x in rows) > 1}
    assert len(first) == len(shared) and all(len({rows[i][:3] for i in tree.leaves[a : b + 1]}) == 1 for a, b in zip(first, last, strict=True))
