"""Small tables for the findings of the second round."""

import math

import pyarrow as pa
from pyspark.sql import functions as F

from wordloom.functions import text as T
from wordloom.operators import lexical as L
from wordloom.operators import models as M
from wordloom.operators import pairs as P
from wordloom.operators import words as W
from wordloom.plans import registry


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def put(spark, folder, **tables):
    """Writes tables of ``rows, schema`` as a folder of inputs, and returns its name."""
    for name, (rows, schema) in tables.items():
        frame(spark, rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_sense_products_meet_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(P, "TILE", 2)
    senses = frame(spark, [("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 2.0]), ("a", 3, None), ("b", 4, [3.0, 4.0]), ("b", 5, [0.0, 0.0]), ("c", 6, [1.0, 0.0, 0.0])], "w string, s long, v array<double>")
    pairs = frame(spark, [("ab", "a", "b"), ("ac", "a", "c"), ("az", "a", "z"), ("aa", "a", "a")], "pair string, stim string, resp string")
    out = {r.pair: (round(r.sim_max, 9), round(r.sim_avg, 9)) for r in P.sense_products(pairs, senses).collect()}
    assert out == {"ab": (0.8, round(1.4 / 6, 9)), "ac": (0.0, 0.0), "az": (0.0, 0.0), "aa": (1.0, round(2 / 9, 9))}


def test_sense_products_read_every_vector(spark, tmp_path):
    at = put(
        spark,
        tmp_path,
        nation=([(0, "A", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        region=([(0, "R")], "r_regionkey int, r_name string"),
        supplier=([(1, "s", 0, 0.0), (2, "t", 0, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        embeddings=([(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<float>, label int"),
    )
    assert got(registry.queries()["c36_sense_products"](spark, at)) == [("A|R", 1.0, 0.5)]
    assert "vec_id %" not in registry.oracle_sql()["c36_sense_products"]


def test_vector_file_keeps_the_sign_of_zero(spark, tmp_path):
    at = put(spark, tmp_path, embeddings=([(1, [-1e-8, 0.5, -0.25], 0)], "vec_id long, embedding array<float>, label int"))
    (row,) = registry.queries()["a17_vector_file"](spark, at).collect()
    assert row.v == [0.0, 0.5, -0.25] and math.copysign(1, row.v[0]) == -1


def exchanged(df):
    """What the plan shuffles by, before statistics change it."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]


def test_words_are_counted_where_the_text_lies(spark):
    texts = frame(spark, [(1, "b a B"), (2, ""), (3, None), (4, "x")], "id long, text string")
    counts = P.word_counts(texts, "id")
    assert got(counts) == [(1, "a", 1), (1, "b", 2), (4, "x", 1)] and not exchanged(counts)
    assert got(P.word_counts(texts.unionByName(texts), "id")) == [(1, "a", 2), (1, "b", 4), (4, "x", 2)]
    assert texts.select(T.bigrams(T.tokens(F.col("text")))).collect() == [(["b a", "a b"],), ([],), (None,), ([],)]


def test_frequent_and_rare_keys_are_both_looked_up(spark, monkeypatch):
    monkeypatch.setattr(P, "HEAD", 1)
    rows = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "a")], "doc long, w string")
    table = frame(spark, [("a", 9), ("b", 1)], "w string, n long")
    assert got(P.looked_up(rows, table, "w", "n").select("doc", "w", "n")) == [(1, "a", 9), (2, "b", 1), (5, "a", 9)]


def test_naive_bayes_looks_rare_words_up(spark, monkeypatch):
    monkeypatch.setattr(P, "HEAD", 1)
    train = frame(spark, [(1, 0, "a", 3), (2, 1, "b", 2), (2, 1, "a", 1)], "doc long, label int, w string, n long")
    test = frame(spark, [(5, "a", 2), (6, "b", 1), (7, "z", 1)], "doc long, w string, n long")
    assert got(M.naive_bayes(train, test)) == [(5, 0), (6, 1), (7, 0)]


def test_kinds_of_anchor_pairs_without_pairs(spark):
    words = [(1, a, p, w) for a, t in ((1, "x y x z"), (2, "y x"), (5, "z z")) for p, w in enumerate(t.split())] + [(2, 1, 0, "x"), (3, 1, 0, "x"), (3, 2, 0, "x")]
    rows = frame(spark, words, "doc long, anchor long, pos int, w string")
    want = [r for kind, p in zip(("intra", "inter"), P.anchor_pairs(rows), strict=True) for r in p.groupBy(F.lit(kind), "doc").agg(F.count("*"), F.countDistinct("w1", "w2")).collect()]
    assert got(P.anchor_pair_kinds(rows)) == sorted(map(tuple, want), key=str)


def test_judgements_are_averaged_line_by_line(spark, tmp_path):
    at = put(spark, tmp_path, lineitem=([(1, 1, 10.0), (1, 1, 20.0), (2, 1, None)], "l_partkey long, l_suppkey long, l_quantity double"))
    found = registry.queries()["a07_evocation_mean"](spark, at)
    assert got(found) == [(1, 1, 0.15), (2, 1, None)]


def test_an_antonym_counts_after_its_earliest_opposite(spark):
    docs, ant = frame(spark, [(1,), (2,)], "doc long"), frame(spark, [("a", "b"), ("a", "c")], "w string, opposite string")
    words = frame(spark, [(1, i, w) for i, w in enumerate("c x a b a".split())], "doc long, pos int, w string")
    found = L.antonym_count(docs, words, ant)
    assert got(found) == [(1, 3), (2, 0)]


def test_perplexity_by_a_texts_own_counts(spark):
    texts = frame(spark, [(1, "a b a b c"), (2, "b"), (3, ""), (4, None)], "id long, text string")
    found = {r.doc: r for r in L.own_perplexity(texts, "id").collect()}
    words = P.explode_tokens(texts, "id")
    two = frame(spark, [("a", "b", 2), ("b", "a", 1), ("b", "c", 1)], "w1 string, w2 string, n long")
    want = {r.doc: r for r in L.perplexity(words, words.groupBy("w").agg(F.count("*").alias("n")), two).collect()}
    assert sorted(found) == sorted(want) == [1, 2]
    assert all(math.isclose(found[d][c], want[d][c]) for d in want for c in ("uni_logprob", "bi_logprob", "uni_ppl", "bi_ppl", "closed_ppl"))


def test_words_of_texts_that_lie_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(W, "SLICE", 8)
    texts = frame(spark, [(1, "ab cd"), (2, "cd"), (3, ""), (4, None), (None, "x\u00e9x \u212aX"), (5, "abcdefghijklm abcdefghijkl")], "id long, text string")
    want = P.explode_tokens(texts, "id").groupBy("doc", "w").agg(F.count("*"))
    assert got(P.word_counts(texts, "id")) == got(want)
    assert got(L.word_totals(texts)) == got(P.explode_tokens(texts, "id").groupBy("w").agg(F.count("*")))


def test_token_perplexity_shuffles_no_row_for_a_word(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "SLICE", 64), monkeypatch.setattr(W, "MEET", 20), monkeypatch.setattr(W, "HAND", 4)
    texts = [(i, " ".join(("the", "of", "abcdefghijklm", f"w{chr(97 + i % 7)}", "The", "the")[(i * k) % 6] for k in range(1, i))) for i in range(30)] + [(30, None)]
    at = put(spark, tmp_path, documents=(texts, "doc_id long, text string"))
    found = registry.queries()["c24_token_perplexity"](spark, at)
    assert "Window" not in found._jdf.queryExecution().toString()
    words = {d: t.lower().split() for d, t in texts if t}
    uni, bi = {}, {}
    for ws in words.values():
        for b, w in zip([None, *ws], ws, strict=False):
            uni[w] = uni.get(w, 0) + 1
            bi[b, w] = bi.get((b, w), 0) + (b is not None)
    pairs, every = sum(n > 0 for n in bi.values()), sum(uni.values()) + len(uni)
    inverse = lambda b, w: every / (uni[w] + 1) if b is None else (uni[b] + pairs) / (bi[b, w] + 1)
    want = {d: (len(ws), sum(inverse(b, w) for b, w in zip([None, *ws], ws, strict=False)) / len(ws)) for d, ws in words.items()}
    out = {r.doc: (r.n, r.mean) for r in found.collect()}
    assert sorted(out) == sorted(want)
    assert all(out[d][0] == want[d][0] and math.isclose(out[d][1], want[d][1], abs_tol=0.0051) for d in want)


def test_chains_by_a_rule_are_those_of_its_table(spark, monkeypatch):
    monkeypatch.setattr(W, "SLICE", 16)
    table = {"ba": [["B", "A1"], ["B", "A2"]], "bo": [["B", "O1", "M"]], "hm": [["H", "M"]], "ma": [["M", "A1"]], "mm": [["M"], ["B", "A1"]], "zz": [], "yy": None}
    rule = lambda words: pa.array([table[w] for w in words.to_pylist()], pa.list_(pa.list_(pa.string())))
    texts = frame(spark, [(1, "ba bo hm ma, mm"), (2, "Ba ba zz yy"), (2, "ba ma"), (3, None), (4, "hm hm zz"), (5, "zz yy zz yy zz yy")], "id long, text string")
    docs, prons = frame(spark, [(i,) for i in range(7)], "doc long"), frame(spark, list(table.items()), "w string, prons array<array<string>>")
    want = got(L.chains(docs, P.explode_tokens(texts, "id"), prons))
    assert got(L.chains_by_rule(docs, texts, "id", rule)) == want and any(r[1] and r[3] for r in want)


def test_alliteration_shuffles_sums_of_keys(spark, tmp_path):
    at = put(spark, tmp_path, documents=([(1, "Peter piper picked"), (2, "hm shy sky"), (3, None), (4, "")], "doc_id long, text string"))
    found = registry.queries()["c02_alliteration_rhyme"](spark, at)
    assert got(found) == [(1, 1, 3, 1, 3), (2, 1, 2, 1, 2), (3, 0, 0, 0, 0), (4, 0, 0, 0, 0)]
    assert all("doc#" in line and " w#" not in line and "(w#" not in line for line in exchanged(found))


def test_chain_counts_shuffle_sums_of_keys(spark, tmp_path):
    at = put(spark, tmp_path, documents=([(1, "Peter piper picked"), (2, None), (3, "ab cb ad")], "doc_id long, text string"))
    found = registry.queries()["c02b_chain_counts"](spark, at)
    assert got(found) == [(1, 1, 1), (2, 0, 0), (3, 1, 1)]
    assert all("doc#" in line and " w#" not in line and "(w#" not in line for line in exchanged(found))
