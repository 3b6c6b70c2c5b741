"""Queries of file readers: a table is written in the file's format to the shared folder, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import lexical as L
from ..operators import pairs as P
from ..operators import stats as S
from ..sources import readers as R
from . import fixtures as X
from .registry import query

_QUOTED = "replace(p_name, ' ', chr(8217)) || ' café'"


@query("a03_one_liners", f"SELECT {_QUOTED} AS doc, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END AS label FROM part")
def a03(spark, sf):
    """Names with characters that the Windows code page has and Latin 1 has not."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("’")), F.lit(" café"))
    p, at = X.table(spark, sf, "part"), X.folder(spark)
    for i, side in enumerate(("positive", "negative")):
        lines = p.where(F.col("p_partkey") % 2 == i).select(F.translate(name, R.WINDOWS, R.LATIN).alias("line"))
        X.write_lines(lines, f"{at}/{side}.txt", "iso-8859-1")
    return R.one_liners(spark, f"{at}/positive.txt", f"{at}/negative.txt")


@query("a05_hashtag_folders", "SELECT CASE WHEN event_type IN ('click', 'view') THEN 'later' ELSE 'first' END AS body, event_type AS hashtag, CAST(event_id AS VARCHAR) AS tweet_id, CASE WHEN event_type IN ('click', 'view') THEN 2 ELSE CAST(event_id % 3 AS INTEGER) END AS label FROM events WHERE event_type NOT IN ('click', 'view') OR event_id % 2 = 0")
def a05(spark, sf):
    """A hashtag of the second folder replaces all of the first folder's rows of that hashtag."""
    e, at = X.table(spark, sf, "events"), X.folder(spark)
    kinds = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # a file for each
    tab = lambda body, label: F.concat_ws("\t", F.col("event_id").cast("string"), F.lit(body), label.cast("string")).alias("line")
    for k in kinds:
        X.write_lines(e.where(F.col("event_type") == k).select(tab("first", F.col("event_id") % 3)), f"{at}/one/{k}.tsv")
        if k in ("click", "view"):
            X.write_lines(e.where((F.col("event_type") == k) & (F.col("event_id") % 2 == 0)).select(tab("later", F.lit(2))), f"{at}/two/{k}.tsv")
    folders = [f"{at}/one"] + ([f"{at}/two"] if {"click", "view"} & set(kinds) else [])
    return R.hashtag_files(spark, folders).select("hashtag", "tweet_id", "body", "label")


@query("a09_strengths", "SELECT CAST(l_orderkey AS VARCHAR) AS cue, CAST(l_linenumber AS VARCHAR) AS resp, CAST(l_discount AS DOUBLE) AS strength FROM lineitem WHERE l_orderkey % 5 <> 0")
def a09(spark, sf):
    f = [F.when(F.col("l_orderkey") % 5 != 0, F.col("l_orderkey").cast("string")).otherwise(""), F.col("l_linenumber").cast("string"), F.lit("3"), F.lit("4"), F.col("l_discount").cast("string")]
    at = f"{X.folder(spark)}/strengths"
    X.table(spark, sf, "lineitem").select(*(c.alias(n) for c, n in zip(f, ("cue", "response", "r1", "n", "r123"), strict=True))).write.csv(at, sep="\t", header=True, emptyValue="")
    return R.strengths(spark, at)


def _stimuli(spark, sf, head, one):
    """A stimulus of each nation with its customers as responses, in XML."""
    c = X.table(spark, sf, "customer")
    rows = c.groupBy("c_nationkey").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("all"))
    lines = rows.select(F.concat(F.lit('<stimulus word="n'), F.col("c_nationkey").cast("string"), head, F.lit('">\n'), F.col("all"), F.lit("\n</stimulus>")).alias("line"))
    ends = X.rows(spark, [(0, "<stimuli>"), (2, "</stimuli>")], "n int, line string")
    return X.write_lines(lines.withColumn("n", F.lit(1)).unionByName(ends), f"{X.folder(spark)}/stimuli.xml")


def _response(*attributes):
    return F.concat(F.lit('<response word="c'), F.col("c_custkey").cast("string"), *attributes)


@query("a10_counted_xml", "SELECT 'n' || c_nationkey AS cue, 'c' || c_custkey AS resp, round((c_custkey % 9 + 1) / CAST(count(*) OVER (PARTITION BY c_nationkey) AS DOUBLE), 6) AS strength FROM customer")
def a10(spark, sf):
    at = _stimuli(spark, sf, F.concat(F.lit('" all="'), F.col("total").cast("string")), _response(F.lit('" n="'), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit('"></response>')))
    return R.association_xml(spark, at, "all", "n").select("cue", "resp", F.round("strength", 6).alias("strength"))


@query("a11_grouped_xml", "SELECT 'n' || c_nationkey AS cue, 'c' || c_custkey AS resp, round((c_custkey % 9 + 1) / CAST(c_custkey % 4 + 10 AS DOUBLE), 6) AS strength FROM customer")
def a11(spark, sf):
    at = _stimuli(spark, sf, F.lit(""), _response(F.lit('" p="'), (F.col("c_custkey") % 9 + 1).cast("string"), F.lit('" g="'), (F.col("c_custkey") % 4 + 10).cast("string"), F.lit('"></response>')))
    return R.association_xml(spark, at, "g", "p").select("cue", "resp", F.round("strength", 6).alias("strength"))


@query("a12_pajek_graph", f"WITH {X.EDGES_SQL} SELECT cue, resp, CAST(w AS DOUBLE) AS w FROM edges")
def a12(spark, sf):
    e = X.edges(spark, sf)
    v = e.select(F.col("cue").alias("name")).unionByName(e.select(F.col("resp").alias("name")))
    path = X.write_lines(R.pajek_text(v, e).withColumnRenamed("part", "n"), f"{X.folder(spark)}/graph.net")
    return R.pajek_graph(spark, path)[1]


@query("a17_vector_file", "SELECT 'w' || vec_id AS w, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 6)) AS v FROM embeddings")
def a17(spark, sf):
    """With the line of sizes that such files begin with."""
    e = X.table(spark, sf, "embeddings")
    body = e.select(F.lit(1).alias("n"), F.concat_ws(" ", F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.array_join(F.transform(V.doubles(F.col("embedding")), lambda x: x.cast("string")), " ")).alias("line"))
    head = e.agg(F.count("*").alias("c"), F.max(F.size("embedding")).alias("d")).select(F.lit(0).alias("n"), F.concat_ws(" ", F.col("c").cast("string"), F.col("d").cast("string")).alias("line"))
    path = X.write_lines(head.unionByName(body), f"{X.folder(spark)}/vectors.txt")
    return R.word_vectors(spark, path).select("w", F.transform("v", lambda x: V.rounded(x, 6)).alias("v"))


@query("a18_saved_tables", f"WITH {X.tok_sql()}, c AS (SELECT doc, w, count(*) AS tf FROM tok GROUP BY 1, 2), d AS (SELECT w, count(*) AS df FROM c GROUP BY w) SELECT doc, w, round(tf * log2((SELECT count(DISTINCT doc) FROM c) / df), 6) AS x FROM c JOIN d USING (w)")
def a18(spark, sf):
    """A dictionary with document frequencies is saved, loaded, and weighs new counts."""
    c = X.tok(spark, sf).groupBy("doc", "w").agg(F.count("*").alias("tf"))
    at = f"{X.folder(spark)}/tfidf"
    R.save_dictionary(c, at)
    return R.load_dictionary(spark, at).weigh(c).select("doc", "w", F.round("x", 6).alias("x"))


@query("a18_topic_tables", "SELECT p_brand AS w, p_size % 5 AS topic, round(count(*) / sum(count(*)) OVER (PARTITION BY p_size % 5), 6) AS x FROM part GROUP BY 1, 2")
def a18b(spark, sf):
    """Topics of words as saved by a topic model: shares by topic."""
    p = X.table(spark, sf, "part").groupBy(F.col("p_brand").alias("w"), (F.col("p_size") % 5).alias("topic")).agg(F.count("*").cast("double").alias("n"))
    at = f"{X.folder(spark)}/topics"
    R.save_topics(p, at)
    return R.load_topics(spark, at).select("w", "topic", F.round("x", 6).alias("x"))


@query("a19_gaussian_vectors", "SELECT 'w' || vec_id AS w, round(CAST(embedding[1] AS DOUBLE), 6) AS m0, round(abs(CAST(embedding[2] AS DOUBLE)) + 1, 6) AS v1, len(embedding) AS size FROM embeddings WHERE vec_id % 3 <> 0")
def a19(spark, sf):
    """The vocabulary has two thirds of the rows; rows without a word are left out."""
    e, at = X.table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v")), X.folder(spark)
    e.select("vec_id", F.col("v").alias("mu"), F.transform("v", lambda x: F.abs(x) + 1).alias("sigma")).write.parquet(f"{at}/gaussians")
    X.write_lines(e.where("vec_id % 3 <> 0").select(F.concat_ws("\t", F.col("vec_id").cast("string"), F.concat(F.lit("w"), F.col("vec_id").cast("string")), F.lit("1")).alias("line")), f"{at}/vocabulary.tsv")
    g = R.gaussian_vectors(spark, f"{at}/gaussians", f"{at}/vocabulary.tsv")
    return g.select("w", F.round(F.col("mu")[0], 6).alias("m0"), F.round(F.col("sigma")[1], 6).alias("v1"), F.size("mu").cast("long").alias("size"))


@query("a25_tagged_scan", "SELECT 't' || event_id || ' x' AS original, 2 AS n_tokens, 'N' AS first_tag, round(0.5 + 0.25, 6) AS p FROM events")
def a25(spark, sf):
    line = F.concat_ws("\t", F.concat(F.lit("t"), F.col("event_id").cast("string"), F.lit(" x")), F.lit("N V"), F.lit("0.5 0.25"), F.concat(F.lit("t"), F.col("event_id").cast("string"), F.lit(" x")))
    at = f"{X.folder(spark)}/tagged"
    X.table(spark, sf, "events").select(line.alias("line")).write.text(at)
    return R.tagged_sentences(spark, at).select("original", F.size("tokens").alias("n_tokens"), F.col("tags")[0].alias("first_tag"), F.round(F.col("probs")[0] + F.col("probs")[1], 6).alias("p"))


@query("a27_recoded", "SELECT CAST(p_partkey AS VARCHAR) AS k, 'é' || p_name AS name FROM part")
def a27(spark, sf):
    at = f"{X.folder(spark)}/latin"
    X.table(spark, sf, "part").select(F.col("p_partkey").cast("string"), F.concat(F.lit("é"), "p_name")).write.option("encoding", "iso-8859-1").csv(at)
    return R.recoded(spark, at, "iso-8859-1").toDF("k", "name")


_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query("b01_preprocess", f"""WITH sent AS (SELECT doc_id AS doc, unnest(range(len(ss))) AS sent, unnest(ss) AS s FROM (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[.!?]+') AS ss FROM documents)),
 t AS (SELECT doc, sent, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc, sent, regexp_extract_all(s, '[a-z]+') AS ws FROM sent))
 SELECT doc_id AS doc, count(w) AS n, coalesce(md5(string_agg(w || '/' || {X.TAG_SQL}, ' ' ORDER BY sent, i)), md5('')) AS h FROM documents LEFT JOIN t ON doc = doc_id AND w NOT IN ({_STOP}) GROUP BY doc_id""")
def b01(spark, sf):
    """Sentences, words, tags of the distinct words in one lookup, regrouped by document in order."""
    d = X.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    words = T.sentence_words(d).where(~F.col("w").isin(*X.STOPWORDS))
    tags = L.word_totals(d).withColumn("tag", X.tag(F.col("w")))
    got = T.regrouped(d, P.looked_up(words, tags, "w", "c"))
    spelled = F.array_join(F.transform("tokens", lambda t: F.concat_ws("/", t["w"], t["tag"])), " ")
    return got.select("doc", F.size("tokens").cast("long").alias("n"), F.md5(spelled.cast("binary")).alias("h"))


@query("f13_training_metrics", "SELECT round(1 - sum(pow(l_extendedprice - l_quantity * 1000, 2)) / (sum(pow(l_extendedprice - m, 2)) + 1e-7), 6) AS r2, round(corr(l_extendedprice, l_quantity * 1000), 6) AS pearson FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)")
def f13(spark, sf):
    rows = X.table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("double").alias("y"), (F.col("l_quantity").cast("double") * 1000).alias("g"))
    return S.regression_metrics(rows, "y", "g").select(F.round("r2", 6).alias("r2"), F.round("pearson", 6).alias("pearson"))


@query("g10_ordered_slice", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def g10(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return S.ordered_slice(o, 25, 75, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")
