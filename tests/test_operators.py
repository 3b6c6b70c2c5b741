"""Operators that SQL does not check, and the null and empty rules, on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.functions import vectors as V
from wordloom.functions.stemming import stem
from wordloom.operators import anchors as A
from wordloom.operators import graphs as G
from wordloom.operators import lexical as L
from wordloom.operators import models as M
from wordloom.operators import pairs as P
from wordloom.operators import stats as S
from wordloom.operators import suites as U


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_without_pairs_score_zero(spark):
    docs = frame(spark, [(1,), (2,), (3,)], "doc long")
    words = frame(spark, [(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a")], "doc long, pos int, w string")
    pairs = P.word_pairs(words)
    assert got(pairs) == [(1, "a", "a", 1), (1, "a", "b", 1), (1, "b", "a", 1)]
    vectors = frame(spark, [("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "w string, v array<double>")
    out = {r.doc: r for r in P.interword(docs, pairs, P.vector_scores(pairs, vectors)).collect()}
    assert math.isclose(out[1].mid, (1 + 2 / math.sqrt(2)) / 3) and out[1].hi == 1.0
    assert tuple(out[2][1:]) == tuple(out[3][1:]) == (0.0, 0.0, 0.0)


def test_missing_vectors_are_zeros_and_count(spark):
    docs = frame(spark, [(1,), (2,)], "doc long")
    words = frame(spark, [(1, 0, "a"), (1, 1, "unknown")], "doc long, pos int, w string")
    vectors = frame(spark, [("a", [2.0, 4.0])], "w string, v array<double>")
    assert got(P.average_vector(docs, words, vectors, 2)) == [(1, 0, 1.0), (1, 1, 2.0), (2, 0, 0.0), (2, 1, 0.0)]


def test_cosine_of_missing_or_zero(spark):
    rows = frame(spark, [([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], None), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_stop_words_go_before_punctuation(spark):
    rows = frame(spark, [(["The", "the!", "Cat's", "..."],)], "ws array<string>")
    assert rows.select(T.filter_tokens(F.col("ws"), F.array(F.lit("the")))).first()[0] == ["the", "cats"]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"), ("adjustable", "adjust"), ("controll", "control"), ("agreed", "agre"), ("feed", "feed"), ("as", "as")])
def test_stemmer(word, want):
    assert stem(word) == want


def test_giant_component_and_reach(spark):
    edges = frame(spark, [("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1), ("d", "e", 1), ("e", "d", 1), ("x", "x", 1)], "cue string, resp string, w int")
    assert got(G.giant_component(edges)) == [("a", 0), ("b", 1), ("c", 2)]
    assert got(G.giant_component(edges.where("cue = 'x'"))) == [("x", 0)]  # a vertex alone is a component
    assert G.giant_component(edges.limit(0)).count() == 0
    assert got(G.drop_sinks(frame(spark, [("a", "b", 1), ("b", "c", 1)], "cue string, resp string, w int")).select("cue", "resp")) == [("a", "b")]


def test_communities_beat_one_and_singletons(spark):
    clique = lambda v: [(a, b, 1) for i, a in enumerate(v) for b in v[i + 1 :]]
    edges = frame(spark, clique("abcde") + clique("vwxyz") + [("a", "v", 1)], "a string, b string, n int")
    found = G.louvain_pass(edges, 8)
    q = G.modularity(edges, found).first().q
    alone = G.modularity(edges, found.withColumn("community", F.col("v"))).first().q
    assert q > 0.3 > alone and found.count() == 10


def test_paths_keep_the_cheapest_and_identity(spark):
    e = G.normalise(frame(spark, [("a", "b", 1), ("a", "c", 9), ("c", "b", 10)], "cue string, resp string, w int"))
    best = {r.dst: 10 ** -r.cost for r in G.path_costs(frame(spark, [("a",)], "v string"), e).collect()}
    assert math.isclose(best["a"], 1) and math.isclose(best["b"], 0.9) and math.isclose(best["c"], 0.9)


def test_factors_rebuild_a_tensor_of_rank_one(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 4.0]
    cells = [(str(i), f"u{j}", f"v{k}", x * y * z) for i, x in enumerate(a) for j, y in enumerate(b) for k, z in enumerate(b)]
    f = {(r.doc, r.r): r.x for r in M.canonical_polyadic(frame(spark, cells, "doc string, w1 string, w2 string, n double"), 1, 3).collect()}
    assert math.isclose(f["1", 0] / f["0", 0], 2, rel_tol=1e-6) and math.isclose(f["2", 0] / f["0", 0], 3, rel_tol=1e-6)


def test_anchor_search_takes_the_largest_drop(spark):
    texts = frame(spark, [(1, ["aa", "bbbb", "cc", "dddd"]), (2, ["x"])], "doc long, words array<string>")
    words = [(1, i, w, "NN", i) for i, w in enumerate(["aa", "bbbb", "cc", "dddd"])]
    cands = A.candidates(frame(spark, words, "doc long, pos int, w string, tag string, phrase int"))
    length = lambda df: df.select("doc", "variant", F.aggregate("words", F.lit(0.0), lambda s, w: s + F.length(w)).alias("score"))
    out = {r.doc: (r.anchors, r.drop) for r in A.search(texts, cands, length, (2, 2)).collect()}
    assert out == {1: (["bbbb", "dddd"], 8.0), 2: (["x"], 0.0)}


def test_suite_order_defaults_and_refusal(spark):
    spine = frame(spark, [(1,), (2,)], "doc long")
    suite = U.Suite("doc", {"b": lambda: frame(spark, [(1, float("nan"))], "doc long, x double"), "a": lambda: frame(spark, [(2, 5)], "doc long, y int")})
    out = suite(spine, ["b", "a", "unheard"])
    assert out.columns == ["doc", "a_y", "b_x"] and got(out) == [(1, 0.0, 0.0), (2, 5.0, 0.0)]
    with pytest.raises(ValueError):
        suite(spine, ["unheard"])
    with pytest.raises(ValueError):
        M.pipeline("unheard", ["x"], "y")


def test_perplexity_of_unseen_words_is_finite(spark):
    words = frame(spark, [(1, 0, "new"), (1, 1, "a")], "doc long, pos int, w string")
    out = L.perplexity(words, frame(spark, [("a", 3)], "w string, n long"), frame(spark, [("a", "a", 2)], "w1 string, w2 string, n long")).first()
    assert math.isclose(out.uni_logprob, math.log10(1 / 4) + math.log10(4 / 4)) and math.isfinite(out.bi_ppl)


def test_holm_is_monotone_and_wilcoxon_drops_zeros(spark):
    p = S.holm(frame(spark, [(i, x) for i, x in enumerate([0.01, 0.04, 0.03, 0.9])], "k int, p double"), "p", "k")
    adjusted = [r.adjusted for r in p.orderBy("p").collect()]
    assert [round(x, 9) for x in adjusted] == [0.04, 0.09, 0.09, 0.9]
    w = S.wilcoxon(frame(spark, [("c", x) for x in (0.0, 1.0, -2.0, 3.0, 3.0)], "c string, d double"), ["c"]).first()
    assert (w.n, w.w) == (4, 2.0)


def test_holdout_is_the_same_for_any_layout(spark):
    rows = spark.range(500)
    a, b = (S.holdout(r, 0.2, F.col("id").cast("string"), 3).where("test").select("id") for r in (rows, rows.repartition(7)))
    assert got(a) == got(b) and 60 < a.count() < 140


def test_anchor_search_keeps_repeats_of_words_that_stay(spark):
    from pyspark.sql import functions as F

    from wordloom.operators import anchors as A

    words = frame(spark, [(1, ["the", "aa", "the", "bbbb", "the", "cc"])], "doc int, words array<string>")
    cands = frame(spark, [(1, 1, "x", ["aa"]), (1, 3, "y", ["bbbb"])], "doc int, at int, cand string, words array<string>")
    length = lambda df: df.select("doc", "variant", F.aggregate("words", F.lit(0.0), lambda s, w: s + F.length(w)).alias("score"))
    assert [(r.anchors, r.drop) for r in A.search(words, cands, length, (2, 2)).collect()] == [(["aa", "bbbb"], 6.0)]


def test_enumerated_leaves(spark):
    from wordloom.operators import anchors as A

    leaves = frame(spark, [(1, 0, 0, "a", "D"), (1, 0, 1, "b", "N"), (1, 1, 0, "c", "V"), (1, 1, 1, "b", "N")], "doc int, sent int, leaf int, w string, tag string")
    kept = frame(spark, [(1, "b", "N"), (1, "c", "V"), (2, "a", "D")], "doc int, w string, tag string")
    assert [r.label for r in A.enumerate_leaves(leaves, kept).orderBy("idx").collect()] == ["-1 0 a", "0 1 b", "1 2 c", "2 3 b"]


def test_interlace():
    assert P.interlace(list("abcdef"), list("uvwxyz")) == ["a", "b", "c", "u", "v", "w", "d", "e", "f", "x", "y", "z"]
    with pytest.raises(ValueError):
        P.interlace(["a"], ["b"])


def test_nearest_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    vectors = {i: {k: float(rng.randint(1, 3)) for k in rng.sample("abcdefgh", rng.randint(1, 2))} for i in range(30)}
    rows = frame(spark, [(i, k, x) for i, v in vectors.items() for k, x in v.items()], "id int, key string, x double")
    found = {}
    for r in P.nearest(rows.where("id < 9"), rows, 6).collect():
        found.setdefault(r.q, []).append((r["rank"], r.r))
    for q in range(9):
        d = sorted((sum((vectors[q].get(k, 0) - v.get(k, 0)) ** 2 for k in {*vectors[q], *v}), i) for i, v in vectors.items())
        assert [i for _, i in sorted(found[q])] == [i for _, i in d[:6]]


def test_strong_components_equal_mutual_reach(spark):
    import random

    rng = random.Random(5)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(45)}
    reach = {v: {v} for v in range(25)}
    for _ in range(25):
        for a, b in edges:
            for v in reach:
                if a in reach[v]:
                    reach[v].add(b)
    rows = G.strong_components(frame(spark, [(f"{a:02}", f"{b:02}") for a, b in edges], "cue string, resp string")).collect()
    part = {int(r.v): int(r.component) for r in rows}
    assert set(part) == {v for e in edges for v in e}
    assert all((part[a] == part[b]) == (b in reach[a] and a in reach[b]) for a in part for b in part)


def test_katz_equals_the_inverse(spark):
    import numpy as np

    e = G.l1(frame(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "a", 1.0)], "cue string, resp string, w double"))
    p = np.zeros((3, 3))
    for r in e.collect():
        p["abc".index(r.cue), "abc".index(r.resp)] = r.w
    want = np.linalg.inv(np.eye(3) - 0.75 * p)
    for r in G.katz(e, 0.75).collect():
        assert abs(want["abc".index(r.cue), "abc".index(r.resp)] - r.w) < 1e-8


def test_paths_go_to_the_end(spark):
    e = G.normalise(frame(spark, [(f"v{i}", f"v{i + 1}", 1) for i in range(7)] + [("v0", "far", 1)], "cue string, resp string, w int"))
    costs = {r.dst: r for r in G.path_costs(frame(spark, [("v0",)], "v string"), e).collect()}
    assert costs["v7"].hops == 7 and abs(10 ** -costs["v7"].cost - 0.5) < 1e-9
    got = {(r.s, r.t): r.strength for r in G.path_strengths(frame(spark, [("V0", "v7"), ("v7", "v0"), ("v3", "v3"), ("no", "no")], "s string, t string"), e).collect()}
    assert abs(got["V0", "V7"] - 0.5) < 1e-9 and got["V7", "V0"] == 0 and got["V3", "V3"] == 1 and got["NO", "NO"] == 0


def test_louvain_levels(spark):
    cliques = [(f"{c}{i}", f"{c}{j}", 1) for c in "abcd" for i in range(4) for j in range(i)] + [("a0", "b0", 1), ("c0", "d0", 1), ("b1", "c1", 1)]
    rows = G.louvain(frame(spark, cliques, "a string, b string, n int")).collect()
    top = max(r.level for r in rows)
    for level in range(top + 1):
        here = {r.v: r.community for r in rows if r.level == level}
        assert len(here) == 16
    assert len({r.community for r in rows if r.level == top}) <= 4


def test_suite_refuses_missing_models_and_wrong_widths(spark):
    one = lambda: frame(spark, [(1, 2.0)], "doc long, x double")
    suite = U.Suite("doc", {"a": one, "b": one}, needs={"b": ["m"]}, dims={"a": 2})
    with pytest.raises(ValueError, match="missing"):
        suite.choose(["b"])
    assert suite.choose(["a", "nope"]) == ["a"]
    with pytest.raises(ValueError, match="columns"):
        suite(frame(spark, [(1,)], "doc long"), ["a"])
