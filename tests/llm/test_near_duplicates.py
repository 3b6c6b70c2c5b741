"""ProbMinHash near-duplicates against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import near_duplicates as N
from wordloom.llm.components import connected_components
from wordloom.llm.store import Store

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def likeness(a, b):
    keys = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in keys) for i in set(a) & set(b))


def classes(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    made = [(i, t or "", grams(t)) for i, t in rows]
    for k, (i, t, g) in enumerate(made):
        for j, u, h in made[:k]:
            if t == u or (set(g) & set(h) and likeness(g, h) >= 0.8):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in parent}


def test_odd_texts(odd, none, odd_ids):
    got = {r.doc_id: r.class_id for r in N.near_duplicates(odd).collect()}
    assert got == classes(sorted(odd_ids.items()))
    assert N.near_duplicates(none).count() == 0


@pytest.mark.parametrize("members", [8, 2048])
def test_large_groups_in_parts(spark, monkeypatch, members):
    """A text with many near copies, copies of copies, and a chain; buckets are dealt to parts of ``members``."""
    monkeypatch.setattr(N, "PART_MEMBERS", members)
    monkeypatch.setattr(N, "HUBS", 2)
    rng = np.random.default_rng(5)
    base = [f"v{x}" for x in rng.integers(0, 9999, 200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        copy = list(base)
        for _ in range(rng.integers(1, 4)):
            copy[rng.integers(0, 200)] = f"n{i}"
        rows.append((i, " ".join(copy)))
    chain = list(base[::-1])
    for i in range(100, 112):
        chain[(i - 100) * 15] = f"c{i}"
        rows.append((i, " ".join(chain)))
    rows += [(200 + i, " ".join(f"u{x}" for x in rng.integers(0, 9999, 60))) for i in range(30)]
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_bridge_between_classes_of_hubs(spark, monkeypatch):
    """Two families of near copies, each with a hub of their bucket, that only one pair in two of its parts links."""
    for name, value in {"PART_MEMBERS": 4, "HUBS": 2, "ASKED": 4, "BANDS": 1, "ROWS": 1}.items():
        monkeypatch.setattr(N, name, value)

    def edit(words, at, number, mark):
        return [f"{mark}{i}" if at <= i < at + number else w for i, w in enumerate(words)]

    a = [f"g{i}" for i in range(100)]
    x = edit(a, 10, 6, "x")
    y = edit(x, 30, 6, "y")
    b = edit(y, 50, 6, "z")
    made = {0: a, 1: b, 100: x, 101: y} | {k: edit(a if k % 2 else b, 75 + k % 20, 1, f"n{k}_") for k in range(2, 20)}
    rows = sorted((i, " ".join(w)) for i, w in made.items())
    want = classes(rows)
    assert set(want.values()) == {0} and len(set(classes([r for r in rows if r[0] != 100]).values())) > 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert N.sketch(docs, "doc_id", "text").select("bands").distinct().count() == 1
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == want


def test_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = ({int(k): int(rng.integers(1, 5)) for k in rng.integers(0, 12, 8)} for _ in range(2))
        both = sorted(set(a) & set(b))
        if both:
            x, y = np.array([a[k] for k in both]), np.array([b[k] for k in both])
            assert np.isclose(N.probability_jaccard(x, y, sum(a.values()) - x.sum(), sum(b.values()) - y.sum()), likeness(a, b))


def test_signatures_estimate_it():
    value = np.arange(1, 301, dtype=np.uint64)
    row = np.concatenate((np.zeros(200, np.int64), np.ones(200, np.int64)))
    s = N.prob_min_hash(row, np.concatenate((value[:200], value[100:])), np.ones(400), 2, 3000)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.04


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long"), Store(spark, "t")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}
