"""Toxicity, fingerprints and nearest neighbours."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import imatch, neighbours, toxicity


def labelled(spark, n=1200):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        words = [f"word{x}" for x in rng.integers(0, 4000, 60)]
        bad = i % 8 == 0
        if bad:
            for _ in range(3):
                words[rng.integers(0, 60)] = ("Vileness", "grot" + "abcdefgh"[rng.integers(0, 8)], "scorn")[rng.integers(0, 3)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out("doc_id")).collect()
    assert len(rows) > 100 and all((r.toxic_score >= 0.5) == bool(r.toxic) for r in rows)


def test_toxicity_learns_nothing_from_held_out_labels(spark):
    from pyspark.sql import functions as F

    docs, labels = labelled(spark, 400)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.voters, b.voters) and np.allclose(a.weights, b.weights)


def test_toxicity_of_odd_texts(spark, odd, none):
    docs, labels = labelled(spark, 400)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(odd, model)
    assert got.columns == [*odd.columns, "toxic_score"] and got.where("toxic_score BETWEEN 0 AND 1").count() == odd.count()
    assert toxicity.score(none, model).count() == 0
    for bare in (toxicity.fit(docs, labels.limit(0)), toxicity.fit(none, labels), toxicity.fit(docs, labels.where("toxic = 0"))):
        assert len(bare.voters) == 0 and toxicity.score(odd, bare).where("toxic_score < 0.5").count() == odd.count()


def test_label_model_counts_voters_that_repeat_each_other_once():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    vote = lambda: np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.1)
    one, two = vote(), vote()
    fired = np.column_stack((one, one, one, two))
    p, fires, parent = toxicity.label_model(fired, y.astype(int))
    assert parent[3] == -1 and (parent[:3] >= 0).sum() == 2 and set(parent[:3]) <= {-1, 0, 1, 2}
    assert abs(fires[1, 3] - 0.6) < 0.08 and ((p > 0.5) == y).mean() > 0.95
    # the copies add next to nothing to what one of them says
    alone, _, _ = toxicity.label_model(fired[:, [0, 3]], y.astype(int))
    assert np.abs(p - alone).max() < 0.1


def test_label_model_finds_wrong_labels():
    rng = np.random.default_rng(2)
    y = rng.random(6000) < 0.4
    fired = np.column_stack([np.where(y, rng.random(6000) < 0.7, rng.random(6000) < 0.05) for _ in range(12)])
    given = np.where(rng.random(6000) < 0.05, ~y, y)
    p, _, _ = toxicity.label_model(fired, given.astype(int))
    assert ((p > 0.5) == y).mean() > 0.99


def test_fingerprints(spark, odd, none):
    got = {(r.doc_id, r.n_chars): r for r in imatch.imatch(odd, min_share=0.0).collect()}
    rows = sorted({(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id is not None}, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        h, following = len(t) // 2, rows[(k + 1) % len(rows)][1]
        r = got[i, len(t)]
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + following[:h]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {r.fingerprint for r in got.values() if r.doc_id in (7, 9, 12)}
    assert len(same) == 1
    assert imatch.imatch(none).count() == 0
    alone = imatch.imatch(spark.createDataFrame([(4, "one text alone")], "doc_id long, text string")).collect()
    assert alone[0].near_next == 1.0


def test_near_copies_that_are_a_third_of_all_documents_keep_their_terms(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: [f"t{k}" for k in rng.integers(0, 4000, n)]
    base, rows = draw(120), []
    for i in range(600):
        words = list(base) if i % 3 == 0 else draw(120)
        if i % 3 == 0:
            words[rng.integers(120)] = f"edit{i}"
        rows.append((i, " ".join(["the", "of", "and", *words])))
    got = imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    hot = [r for r in got if r.doc_id % 3 == 0]
    assert len(got) == 600 and not any(r.fingerprint.startswith("=") for r in got)
    # half of a text is replaced: near copies are found again about as often as texts without copies
    again = [np.mean([r.near_edited > 0.2 for r in got if (r.doc_id % 3 == 0) == kind]) for kind in (True, False)]
    assert again[1] > 0.6 and again[0] > 0.9 * again[1]
    assert np.mean([r.near_next for r in got if r.doc_id % 3]) < 0.05
    # two near copies share most slots, and a word that all documents have is in no lexicon
    one, two = (hot[k].fingerprint for k in (0, 1))
    assert np.mean([a == b for a, b in zip(one.split("."), two.split("."), strict=True)]) > 0.8
    store = imatch.Store(spark, "test")
    kept = {r.term for r in imatch.lexicon(spark.createDataFrame(rows, "doc_id long, text string"), store).collect()}
    code = {r.w: r.h for r in spark.createDataFrame([(w,) for w in ("the", base[0])], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    assert code["the"] not in kept and code[base[0]] in kept


def slots_by_hand(rows, low, high):
    """Fingerprints of ``(id, text)`` by plain sets, with hashes given by the expressions of the module."""
    words = {i: {w for w in re.split(r"[^\w]|_", t.lower()) if w} for i, t in rows}
    df = Counter(w for ws in words.values() for w in ws)
    return {i: {w for w in ws if low <= df[w] <= high} for i, ws in words.items()}


def test_fingerprints_against_plain_sets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join([*rng.choice(["the", "of", "and", "to", "in"], 3, replace=False), *(f"w{k}" for k in rng.integers(0, 400, 8))])) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)]
    got = {r.doc_id: r for r in imatch.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    band = slots_by_hand(rows, 2, 12)
    # equal sets of band terms have equal fingerprints; a slot is equal where the subsets' terms are
    every = {i: frozenset(b) for i, b in band.items()}
    for i in every:
        for j in every:
            if every[i] and every[i] == every[j] and not got[i].fingerprint.startswith("="):
                assert got[i].fingerprint == got[j].fingerprint
    terms = sorted(set().union(*every.values()))
    table = spark.createDataFrame([(w,) for w in terms], "w string")
    where = {r.w: set(r.at) for r in table.select("w", imatch.subsets(F.xxhash64("w")).alias("at")).collect()}
    prints = {i: got[i].fingerprint.split(".") for i in every if not got[i].fingerprint.startswith("=")}
    assert len(prints) > 100
    for k in range(len(imatch.POWERS)):
        held = {i: frozenset(w for w in every[i] if k in where[w]) for i in prints}
        by_set, by_print = {}, {}
        for i in prints:
            assert (prints[i][k] == "-") == (not held[i])
            assert by_set.setdefault(held[i], prints[i][k]) == prints[i][k]
            assert by_print.setdefault(prints[i][k], held[i]) == held[i]


def brute(ids, x, query_ids, k):
    out = {}
    for i in query_ids:
        s = (x * x[ids == i][0]).sum(axis=1)
        other = np.flatnonzero(ids != i)
        best = other[np.lexsort((ids[other], -s[other]))][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in best]
    return out


@pytest.mark.parametrize("n", [15, 700])
def test_search(spark, monkeypatch, n):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 128)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((12, 16))
    x = (centre[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, 16))).astype(np.float32).astype(float)
    x[: n // 3] = x[0]  # one vector is a third of all
    ids = rng.permutation(4 * n)[:n]
    rows = [(int(i), [float(v) for v in r], "x") for i, r in zip(ids, x, strict=True)]
    bad = [(90_001, None, "x"), (90_002, [], "x"), (90_003, [0.0] * 16, "x"), (90_004, [float("nan")] * 16, "x"), (90_005, [None] * 16, "x"), (90_020, [1.0] * 3, "x"), (None, [1.0] * 16, "x")]
    vectors = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, part string").repartition(3)
    got = {}
    for r in neighbours.search(vectors, vectors.where("vec_id % 5 = 0"), k=20, part_rows=100, sample_rows=500).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(ids, x, [i for i in ids if i % 5 == 0], 20)
    assert set(got) == set(want)
    hit = sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[i]) == len(want[i]) for i in want)
    for i in want:
        exact = dict(brute(ids, x, [i], n)[i])
        assert all(abs(exact[a] - s) < 1e-9 for a, s in got[i])


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.search(empty, empty).count() == 0


def test_parts_are_balanced():
    rng = np.random.default_rng(9)
    label = neighbours.balanced_parts(neighbours.neighbour_graph(rng.standard_normal((512, 8)), 8), 6)
    size = np.bincount(label, minlength=6)
    assert size.min() >= 60 and size.max() <= 140
