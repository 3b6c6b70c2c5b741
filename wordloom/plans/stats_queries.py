"""Queries of statistics, splits and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import models as M
from ..operators import pairs as P
from ..operators import stats as S
from . import fixtures as X
from .registry import query

_r = lambda c: F.round(c, 6).alias(c)


@query("f01_mean_or_zero", "SELECT c_custkey, round(coalesce(avg(o_totalprice), 0), 6) AS mean FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def f01(spark, sf):
    o = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("mean"))
    return X.table(spark, sf, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.round(F.coalesce("mean", F.lit(0.0)), 6).alias("mean"))


@query("f02_group_summary", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, round(avg(l_discount), 6) AS mean FROM lineitem GROUP BY 1, 2")
def f02(spark, sf):
    return X.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query("f03_deviations", "SELECT event_type, round(stddev_pop(value), 6) AS population, round(stddev_samp(value), 6) AS sample FROM events GROUP BY 1")
def f03(spark, sf):
    return X.table(spark, sf, "events").groupBy("event_type").agg(F.round(F.stddev_pop("value"), 6).alias("population"), F.round(F.stddev_samp("value"), 6).alias("sample"))


@query("f04_conditional_counts", "SELECT user_id, count(*) FILTER (value >= 7 OR event_type = 'click') AS n FROM events GROUP BY 1")
def f04(spark, sf):
    return X.table(spark, sf, "events").groupBy("user_id").agg(F.count_if((F.col("value") >= 7) | (F.col("event_type") == "click")).alias("n"))


@query("f05_vocabulary", f"WITH {X.tok_sql('documents', 'doc_id')} SELECT DISTINCT w FROM tok")
def f05(spark, sf):
    return X.tok(spark, sf, "documents", "doc_id").select("w").distinct()


_SIG = "s1 AS (SELECT * FROM orders WHERE abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) <= 1.5 * (SELECT stddev_samp(o_totalprice) FROM orders)), s2 AS (SELECT * FROM s1 WHERE abs(o_custkey - (SELECT avg(o_custkey) FROM s1)) <= 1.5 * (SELECT stddev_samp(o_custkey) FROM s1))"


@query("f06_sequential_sigma", f"WITH {_SIG} SELECT o_orderkey FROM s2")
def f06(spark, sf):
    return S.sequential_sigma(X.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], 1.5).select("o_orderkey")


@query("f07_bins", "SELECT CAST(least(floor((l_discount - 0) / (0.1 / 5)), 4) AS INTEGER) AS bin, count(*) AS n, round(avg(l_discount), 6) AS mean, round(median(l_discount), 6) AS median FROM lineitem GROUP BY 1")
def f07(spark, sf):
    return S.bins(X.table(spark, sf, "lineitem"), "l_discount", 0.0, 0.1, 5).select("bin", "n", _r("mean"), _r("median"))


@query("f08_pair_signs", f"WITH {X.GAME_SQL}, p AS (SELECT a.event_type, sign(a.score - b.score) AS s FROM game a JOIN game b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.id < b.id) SELECT event_type, count(*) FILTER (s > 0) AS up, count(*) FILTER (s < 0) AS down, round(100.0 * count(*) FILTER (s > 0) / count(*), 4) AS pct FROM p GROUP BY 1")
def f08(spark, sf):
    g = X.game(spark, sf).select("user_id", "event_type", "id", "score")
    p = g.join(g.select("user_id", "event_type", F.col("id").alias("j"), F.col("score").alias("t")), ["user_id", "event_type"]).where("id < j")
    up, down = F.count_if(F.col("score") > F.col("t")), F.count_if(F.col("score") < F.col("t"))
    return p.groupBy("event_type").agg(up.alias("up"), down.alias("down"), F.round(100.0 * up / F.count("*"), 4).alias("pct"))


_WIL = "x AS (SELECT event_type, value - 5 - user_id % 7 AS d FROM events), z AS (SELECT event_type, d, rank() OVER (PARTITION BY event_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY event_type, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY event_type, abs(d)) AS t FROM x WHERE d <> 0), s AS (SELECT event_type, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus, sum(t * t - 1.0) AS ties FROM z GROUP BY 1)"


def _wilcoxon(spark, sf):
    return S.wilcoxon(X.table(spark, sf, "events").select("event_type", (F.col("value") - 5 - F.col("user_id") % 7).alias("d")), ["event_type"])


@query("f09_wilcoxon", f"WITH {_WIL} SELECT event_type, n, CAST(least(plus, minus) AS DOUBLE) AS w, round((least(plus, minus) - n * (n + 1) / 4.0) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s")
def f09(spark, sf):
    return _wilcoxon(spark, sf).select("event_type", "n", F.col("w").cast("double").alias("w"), _r("z"))


@query("f10_holm", "WITH p AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 25 + 1) / 400.0 AS p FROM nation), r AS (SELECT k, p, row_number() OVER (ORDER BY p, k) AS r, count(*) OVER () AS m FROM p) SELECT k, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY p, k ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r")
def f10(spark, sf):
    p = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), ((F.col("n_nationkey") * 7 % 25 + 1) / 400.0).alias("p"))
    return S.holm(p, "p", "k").select("k", _r("adjusted"))


@query("f11_t_statistics", "SELECT count(*) AS n, round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS paired, round((avg(l_discount) - avg(l_tax)) / sqrt((var_samp(l_discount) + var_samp(l_tax)) / 2 * 2 / count(*)), 6) AS independent FROM lineitem")
def f11(spark, sf):
    return S.t_statistics(X.table(spark, sf, "lineitem"), "l_discount", "l_tax").select("n", _r("paired"), _r("independent"))


_COR = "r AS (SELECT c_acctbal AS x, CAST(c_nationkey AS DOUBLE) * 300 AS y, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rx, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2.0 AS ry FROM customer)"


@query("f12_correlations", f"WITH {_COR} SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(1 - sum(pow(x - y, 2)) / sum(pow(x - (SELECT avg(x) FROM r), 2)), 6) AS r2 FROM r")
def f12(spark, sf):
    c = X.table(spark, sf, "customer").select(F.col("c_acctbal").alias("x"), (F.col("c_nationkey").cast("double") * 300).alias("y"))
    return S.correlations(c, "x", "y").select(_r("pearson"), _r("spearman"), _r("r2"))


_CLF = "c AS (SELECT quality AS t, CAST(1 - toxic AS INTEGER) AS g FROM labels)"


@query("f14_class_report", f"WITH {_CLF}, k AS (SELECT t AS label FROM c UNION SELECT g FROM c), n AS (SELECT label, count(*) FILTER (t = label) AS support, count(*) FILTER (g = label) AS claimed, count(*) FILTER (t = label AND g = label) AS tp FROM k CROSS JOIN c GROUP BY 1), pr AS (SELECT label, support, coalesce(tp / nullif(claimed, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM n) SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM pr")
def f14(spark, sf):
    c = X.table(spark, sf, "labels").select(F.col("quality").alias("t"), (1 - F.col("toxic")).alias("g"))
    return S.class_report(c, "t", "g").select("label", "support", _r("precision"), _r("recall"), _r("f1"))


@query("f15_weighted_accuracy", "SELECT round(sum(acc * n) / sum(n), 6) AS accuracy FROM (SELECT doc_id % 5 AS fold, avg(CAST(quality = 1 - toxic AS INTEGER)) AS acc, count(*) AS n FROM labels GROUP BY 1)")
def f15(spark, sf):
    hit = (F.col("quality") == 1 - F.col("toxic")).cast("int")
    folds = X.table(spark, sf, "labels").groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg(hit).alias("acc"), F.count("*").alias("n"))
    return folds.agg(F.round(F.sum(F.col("acc") * F.col("n")) / F.sum("n"), 6).alias("accuracy"))


@query("f16_fold_scores", "SELECT round(avg(acc), 6) AS mean, round(stddev_pop(acc), 6) AS std FROM (SELECT doc_id % 5 AS fold, avg(CAST(quality = 1 - toxic AS INTEGER)) AS acc FROM labels GROUP BY 1)")
def f16(spark, sf):
    hit = (F.col("quality") == 1 - F.col("toxic")).cast("int")
    folds = X.table(spark, sf, "labels").groupBy((F.col("doc_id") % 5).alias("fold")).agg(F.avg(hit).alias("acc"))
    return folds.agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.stddev_pop("acc"), 6).alias("std"))


@query("f17_argmax", "SELECT l_orderkey, max_by(l_partkey, (l_extendedprice, -l_linenumber)) AS part FROM lineitem GROUP BY 1")
def f17(spark, sf):
    return X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", (-F.col("l_linenumber")).alias("k"))).alias("part"))


@query("g01_context_windows", f"WITH {X.tok_sql()} SELECT doc, pos, coalesce(lag(w, 2) OVER o, '') AS l2, coalesce(lag(w, 1) OVER o, '') AS l1, coalesce(lead(w, 1) OVER o, '') AS r1, coalesce(lead(w, 2) OVER o, '') AS r2 FROM tok WINDOW o AS (PARTITION BY doc ORDER BY pos)")
def g01(spark, sf):
    o = Window.partitionBy("doc").orderBy("pos")
    return X.tok(spark, sf).select("doc", F.col("pos").cast("long").alias("pos"), F.lag("w", 2, "").over(o).alias("l2"), F.lag("w", 1, "").over(o).alias("l1"), F.lead("w", 1, "").over(o).alias("r1"), F.lead("w", 2, "").over(o).alias("r2"))


_CENT = "e AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings), m AS (SELECT i, avg(x) AS m FROM e GROUP BY i), d AS (SELECT id, sqrt(sum(pow(x - m, 2))) AS distance FROM e JOIN m USING (i) GROUP BY id)"


@query("g02_centroid_rank", f"WITH {_CENT} SELECT id, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM d")
def g02(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return S.centroid_rank(e).select("id", _r("distance"), "rank")


@query("g03_top_k_report", "SELECT c_nationkey, c_custkey, CAST(k AS INTEGER) AS rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def g03(spark, sf):
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return X.table(spark, sf, "customer").select("c_nationkey", "c_custkey", r.alias("rank")).where("rank <= 3")


@query("g04_hash_holdout")
def g04(spark, sf):
    d = X.table(spark, sf, "labels")
    return S.holdout(d, 0.1, F.col("doc_id").cast("string"), 10).select("doc_id", "test")


@query("g05_k_folds", "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM labels) SELECT doc_id, CAST(CASE WHEN i < n % 10 * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - n % 10 * (n // 10 + 1)) // greatest(n // 10, 1) END AS INTEGER) AS fold FROM x")
def g05(spark, sf):
    return S.k_folds(X.table(spark, sf, "labels"), 10, "doc_id").select("doc_id", "fold")


@query("g05_stratified_folds", "SELECT doc_id, CAST((row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels")
def g05b(spark, sf):
    return S.stratified_folds(X.table(spark, sf, "labels"), 10, "toxic", "doc_id").select("doc_id", "fold")


@query("g05_group_out", "SELECT a.source AS held, count(*) AS train FROM (SELECT DISTINCT source FROM documents) a JOIN (SELECT source, doc_id FROM documents) b ON a.source <> b.source GROUP BY 1")
def g05c(spark, sf):
    n = X.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select(F.col("source").alias("held"), (F.sum("n").over(Window.partitionBy()) - F.col("n")).alias("train"))


@query("g06_union_merge", "SELECT n_name AS name, n_regionkey AS v FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1) UNION ALL SELECT n_name, 100 FROM nation WHERE n_regionkey = 1")
def g06(spark, sf):
    from ..sources import lines as L

    n = X.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("v"))
    return L.merge_later(n, n.where("v = 1").withColumn("v", F.lit(100)), "name")


@query("g07_difference", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def g07(spark, sf):
    return X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).subtract(X.table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("g08_intersection", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def g08(spark, sf):
    return X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(X.table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


_NB = f"""WITH {X.tok_sql('documents', 'doc_id')}, c AS (SELECT doc, w, count(*) AS n FROM tok GROUP BY 1, 2), tr AS (SELECT doc, toxic AS label, w, n FROM c JOIN labels ON doc_id = doc),
 prior AS (SELECT toxic AS label, ln(count(*) / (SELECT count(*) FROM labels JOIN documents USING (doc_id))) AS p FROM labels JOIN documents USING (doc_id) GROUP BY 1),
 v AS (SELECT count(DISTINCT w) AS v FROM tr), t AS (SELECT label, sum(n) AS t FROM tr GROUP BY 1), cw AS (SELECT label, w, sum(n) AS c FROM tr GROUP BY 1, 2),
 s AS (SELECT doc, t.label, sum(n * ln((coalesce(cw.c, 0) + 1) / (t + v))) AS s FROM c CROSS JOIN t CROSS JOIN v LEFT JOIN cw ON cw.label = t.label AND cw.w = c.w WHERE c.w IN (SELECT w FROM cw) GROUP BY 1, 2)
 SELECT doc, CAST(max_by(label, (round(p + coalesce(s, 0), 9), -label)) AS INTEGER) AS label FROM (SELECT DISTINCT doc FROM c) CROSS JOIN prior LEFT JOIN s USING (doc, label) GROUP BY doc"""


@query("c05_naive_bayes", _NB)
def c05(spark, sf):
    c = X.counts(spark, sf)
    y = X.table(spark, sf, "labels").select(F.col("doc_id").alias("doc"), F.col("toxic").alias("label"))
    return M.naive_bayes(c.join(y, "doc"), c)




@query("h06_standardised", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def h06(spark, sf):
    return M.standardised(X.table(spark, sf, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", _r("c_acctbal"))


_VOTE = f"WITH {X.tok_sql()}, c AS (SELECT doc, w, count(*) AS x FROM tok GROUP BY 1, 2), s AS (SELECT doc, sum(x * x) AS s FROM c GROUP BY doc), p AS (SELECT a.doc AS q, b.doc AS r, sum(a.x * b.x) AS ab FROM c a JOIN c b USING (w) GROUP BY 1, 2), d AS (SELECT q.doc AS q, r.doc AS r, q.s + r.s - 2 * coalesce(ab, 0) AS d2 FROM s q CROSS JOIN s r LEFT JOIN p ON p.q = q.doc AND p.r = r.doc), k AS (SELECT q, r % 3 AS label FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, r) AS k FROM d) WHERE k <= 5), n AS (SELECT q, label, count(*) AS n FROM k GROUP BY 1, 2) SELECT q, max_by(label, (n, -label)) AS label FROM n GROUP BY q"


@query("h06_knn_vote", _VOTE)
def h06b(spark, sf):
    c = X.tok(spark, sf).groupBy(F.col("doc").alias("id"), F.col("w").alias("key")).agg(F.count("*").cast("double").alias("x"))
    labels = X.docs(spark, sf).select(F.col("doc").alias("r"), (F.col("doc") % 3).alias("label"))
    return M.vote(P.nearest(c, c, 5), labels)


def _rows(spark, sf):
    d, y = X.table(spark, sf, "documents"), X.table(spark, sf, "labels")
    stats = d.select("doc_id", F.ln(F.length("text") + 1.0).alias("chars"), F.regexp_count("text", F.lit(r"\n")).cast("double").alias("lines"), (F.regexp_count("text", F.lit("[.!?]")) / (F.length("text") + 1)).alias("stops"))
    return stats.join(y, "doc_id").select("doc_id", "chars", "lines", "stops", F.col("quality").cast("double").alias("label"), (F.col("quality") * 0.6 + F.col("toxic") * 0.3).alias("target"))


def _predict(spark, sf, kind, label="label"):
    rows = _rows(spark, sf)
    return M.pipeline(kind, ["chars", "lines", "stops"], label).fit(rows).transform(rows).select("doc_id", "prediction")


@query("h01_random_forest")
def h01(spark, sf):
    return _predict(spark, sf, "rf")


@query("h02_forest_regressor")
def h02(spark, sf):
    return _predict(spark, sf, "rf_regressor", "target")


@query("h04_linear_svc")
def h04(spark, sf):
    return _predict(spark, sf, "svc")


@query("h05_polynomial_svc")
def h05(spark, sf):
    return _predict(spark, sf, "poly_svc")


@query("h07_mlp_as_glm")
def h07(spark, sf):
    return _predict(spark, sf, "mlp", "target")


@query("h08_relu_regressor")
def h08(spark, sf):
    return _predict(spark, sf, "relu", "target").withColumn("prediction", F.greatest("prediction", F.lit(0.0)))


@query("d16_lda_topics")
def d16(spark, sf):
    docs = X.table(spark, sf, "benchmark").select("item_id", P.tokens(F.col("text")).alias("words"))
    from pyspark.ml.functions import vector_to_array

    return M.topics(docs, "words", k=20, rounds=20).transform(docs).select("item_id", vector_to_array("topicDistribution").alias("topics"))


@query("d17_word2vec")
def d17(spark, sf):
    docs = X.table(spark, sf, "conversations").select("conv_id", "turn", P.tokens(F.col("text")).alias("words"))
    from pyspark.ml.functions import vector_to_array

    return M.word_vectors(docs, "words").getVectors().select("word", vector_to_array("vector").alias("vector"))


@query("c52_tensor_centrality")
def c52(spark, sf):
    f = M.canonical_polyadic(G.cooccurrence(X.tok(spark, sf), 5), rank=4, rounds=2)
    v = f.groupBy(F.col("doc").alias("id")).agg(F.array_sort(F.collect_list(F.struct("r", "x"))).getField("x").alias("v"))
    return S.centroid_rank(v)
