"""Queries of readers' line formats and text expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lexical as L
from ..operators import pairs as P
from ..operators.ranking import numbered
from ..sources import lines as S
from . import fixtures as X
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_stop = lambda: F.array(*map(F.lit, X.STOPWORDS))


@query("a01_first_comma_lines", "SELECT o_orderkey AS id, CAST(o_orderkey % 2 AS INTEGER) AS label, array_to_string(string_split(o_orderpriority || ', ' || o_orderstatus, ' '), '|') AS words FROM orders")
def a01(spark, sf):
    o = X.table(spark, sf, "orders")
    lines = o.select(F.col("o_orderkey").alias("id"), F.concat((F.col("o_orderkey") % 2).cast("string"), F.lit(","), "o_orderpriority", F.lit(", "), "o_orderstatus").alias("line"))
    return S.first_comma(lines).withColumn("words", F.array_join("words", "|"))


@query("a02_raw_union", """SELECT kind, count(*) AS n, CAST(sum(length(doc)) AS BIGINT) AS chars, CAST(sum(label) AS BIGINT) AS label FROM (
  SELECT 'pun' AS kind, substr(p_name, 2, length(p_name) - 2) AS doc, 1 AS label FROM part
  UNION ALL SELECT 'neg', p_type, -1 FROM part
  UNION ALL SELECT 'proverb', text, -1 FROM benchmark WHERE len(list_filter(string_split_regex(trim(regexp_replace(text, '[^\\w\\s]', ' ', 'g')), '\\s+'), lambda x: x <> '')) > 5) GROUP BY kind""")
def a02(spark, sf):
    p = X.table(spark, sf, "part")
    rows = S.raw_union(p.select(F.col("p_name").alias("line")), p.select(F.col("p_type").alias("line")), X.table(spark, sf, "benchmark").select(F.col("text").alias("line")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("doc")).alias("chars"), F.sum("label").alias("label"))


@query("a04_tagged_tsv", "SELECT event_type AS hashtag, CAST(event_id AS VARCHAR) AS tweet_id, regexp_replace(props, '\"', '', 'g') AS body, CAST(user_id % 3 AS INTEGER) AS label FROM events")
def a04(spark, sf):
    e = X.table(spark, sf, "events")
    lines = e.select(F.concat("event_type", F.lit(".tsv")).alias("file"), F.concat_ws("\t", F.col("event_id").cast("string"), F.concat(F.lit("@midnight #"), "event_type", F.lit(" "), F.regexp_replace("props", '"', "")), (F.col("user_id") % 3).cast("string")).alias("line"))
    return S.hashtag_tsv(lines, drop_midnight=True, hashtags="drop")


@query("a06_rated_csv", "SELECT c_custkey AS id, CAST(CASE WHEN c_acctbal < 0 THEN 0.0 ELSE round(c_acctbal, 2) END AS DOUBLE) AS rating FROM customer")
def a06(spark, sf):
    c = X.table(spark, sf, "customer")
    return S.null_literal(c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "NULL").otherwise(F.round("c_acctbal", 2).cast("string")).alias("rating")), "rating")


@query("a07_evocation_mean", "SELECT l_partkey AS a, l_suppkey AS b, round(avg(l_quantity) / 100, 6) AS strength FROM lineitem GROUP BY 1, 2")
def a07(spark, sf):
    li = X.table(spark, sf, "lineitem")
    judged = li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_quantity").cast("string").alias("scores"))  # a line a judgement
    return S.mean_judgements(judged).select("a", "b", F.round("strength", 6).alias("strength"))


_SWOW = """, swow AS (SELECT doc, w AS cue, lead(w, 1) OVER o AS r1, lead(w, 2) OVER o AS r2, lead(w, 3) OVER o AS r3 FROM tok WINDOW o AS (PARTITION BY doc ORDER BY pos)),
 resp AS (SELECT cue, r1 AS resp FROM swow WHERE r1 IS NOT NULL AND r1 <> 'the' UNION ALL SELECT cue, r2 FROM swow WHERE r1 <> 'the' AND r2 IS NOT NULL AND r2 <> 'the' UNION ALL SELECT cue, r3 FROM swow WHERE r1 <> 'the' AND r2 <> 'the' AND r3 IS NOT NULL AND r3 <> 'the')"""


@query("a08_response_strength", "WITH " + X.tok_sql() + _SWOW + " SELECT cue, resp, round(count(*) / any_value(t), 6) AS strength FROM resp JOIN (SELECT cue, count(*) AS t FROM swow GROUP BY cue) USING (cue) GROUP BY cue, resp")
def a08(spark, sf):
    o = Window.partitionBy("doc").orderBy("pos")
    rows = X.tok(spark, sf).select(F.col("w").alias("cue"), *(F.lead("w", i).over(o).alias(f"r{i}") for i in (1, 2, 3)))
    return S.response_strengths(rows, ["r1", "r2", "r3"], sentinels=("the",)).select("cue", "resp", F.round("strength", 6).alias("strength"))


@query("a13_graph_from_tuples", "SELECT upper(n_name) AS cue, upper(r_name) AS resp, CAST(max(n_nationkey) AS DOUBLE) AS w FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def a13(spark, sf):
    n, r = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lower("n_name").alias("cue"), F.lower("r_name").alias("resp"), F.col("n_nationkey").cast("double").alias("w"), F.col("n_nationkey").alias("line"))
    return S.edge_tuples(e, upper=True)


@query("a14_lexicon_lines", "SELECT word, tag FROM (SELECT p_brand AS word, CASE WHEN p_size % 2 = 0 THEN 'strong' ELSE 'weak' END AS tag FROM part UNION SELECT p_brand, CASE WHEN p_size % 3 = 0 THEN 'positive' ELSE 'negative' END FROM part)")
def a14(spark, sf):
    line = F.concat(F.lit("type="), F.when(F.col("p_size") % 2 == 0, "strongsubj").otherwise("weaksubj"), F.lit(" len=1 word1="), "p_brand", F.lit(" pos1=noun stemmed1=n priorpolarity="), F.when(F.col("p_size") % 3 == 0, "positive").otherwise("negative"))
    return S.subjectivity(X.table(spark, sf, "part").select(line.alias("line")))


@query("a16_concept_edges", "SELECT 'RelatedTo' AS rel, lower(p_brand) AS w1, lower(p_type) AS w2 FROM part WHERE p_size % 2 = 0")
def a16(spark, sf):
    lang = F.when(F.col("p_size") % 2 == 0, "en").otherwise("fr")
    line = F.concat_ws("\t", F.lit("/a/x"), F.lit("/r/RelatedTo"), F.concat(F.lit("/c/en/"), F.lower("p_brand")), F.concat(F.lit("/c/"), lang, F.lit("/"), F.lower("p_type"), F.lit("/n")), F.lit("{}"))
    return S.concept_assertions(X.table(spark, sf, "part").select(line.alias("line")))


@query("a20_frequency_columns", "SELECT p_partkey AS id, p_name AS ngram, CAST(p_size + 2 * p_size AS BIGINT) AS n FROM part")
def a20(spark, sf):
    p = X.table(spark, sf, "part")
    line = F.concat_ws("\t", "p_name", F.col("p_size").cast("string"), F.lit("7"), (2 * F.col("p_size")).cast("string"), F.lit("9"))
    return S.frequency_sums(p.select(F.col("p_partkey").alias("id"), line.alias("line")))


@query("a21_pushed_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus IS NOT NULL AND o_orderpriority <> '5-LOW'")
def a21(spark, sf):
    return S.collection_scan(X.table(spark, sf, "orders"), {"o_totalprice": 100000}, ["o_orderstatus"], {"o_orderpriority": "5-LOW"}).select("o_orderkey", "o_totalprice")


@query("a28_feature_store_concat", "SELECT c_custkey, c_acctbal, c_nationkey, length(c_name) AS name_length FROM customer")
def a28(spark, sf):
    c = X.table(spark, sf, "customer")
    return S.concat_features("c_custkey", c.select("c_custkey", "c_acctbal", "c_nationkey"), c.select("c_custkey", F.length("c_name").cast("long").alias("name_length")))


@query("b02_token_filter", f"SELECT doc_id, CAST(len(k) AS BIGINT) AS n, md5(array_to_string(k, ' ')) AS h FROM (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(list_filter(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: x <> ''), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), lambda x: x <> '') AS k FROM documents)")
def b02(spark, sf):
    k = T.filter_tokens(T.white_tokens(F.col("text")), _stop())
    return X.table(spark, sf, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ").cast("binary")).alias("h"))


@query("b04_file_tokeniser", "SELECT doc_id, md5(array_to_string(regexp_extract_all(lower(text), '[a-z]+'), ' ')) AS h FROM documents")
def b04(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(T.tokens(F.col("text")), " ").cast("binary")).alias("h"))


@query("b06_class_replacement", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'HYPER_LINK' WHEN event_type = 'view' THEN 'AT_USERNAME' ELSE event_type END || ' ' || props AS body FROM events")
def b06(spark, sf):
    tag = F.when(F.col("event_type") == "click", "U").when(F.col("event_type") == "view", "@").otherwise("N")
    return X.table(spark, sf, "events").select("event_id", F.array_join(T.replace_by_tag(F.array("event_type", "props"), F.array(tag, F.lit("N"))), " ").alias("body"))


@query("b07_game_filter", "SELECT event_id FROM events WHERE user_id % 3 = 0 OR (user_id % 3 = 1 AND event_type = 'click')")
def b07(spark, sf):
    body = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("@Midnight #"), "event_type")).when(F.col("event_type") == "click", "no marks here").otherwise(F.concat(F.lit("@other #"), "event_type", F.lit(" #two")))
    body = F.when((F.col("user_id") % 3 == 2), "@a @b").otherwise(body)
    return X.table(spark, sf, "events").select("event_id", body.alias("body")).where(T.is_game_tweet(F.col("body"))).select("event_id")


@query("b08_strip_mentions", "SELECT event_id, props AS body FROM events")
def b08(spark, sf):
    return X.table(spark, sf, "events").select("event_id", T.strip_mentions(F.concat(F.lit("@midnight "), "props", F.lit(" #"), "event_type")).alias("body"))


@query("b09_setup_words", f"SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda x: x NOT IN ({_STOP}) AND x NOT IN ('in', 'words', '')), '|') AS words FROM part")
def b09(spark, sf):
    name = F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_In_5_Words.tsv"))
    return X.table(spark, sf, "part").select("p_partkey", F.array_join(T.setup_words(name, _stop()), "|").alias("words"))


@query("b11_ngram_counts", "WITH " + X.tok_sql("documents", "doc_id") + ", g AS (SELECT doc, w || ' ' || lead(w) OVER (PARTITION BY doc ORDER BY pos) AS ngram FROM tok) SELECT ngram, count(*) AS n, count(DISTINCT doc) AS docs FROM g WHERE ngram IS NOT NULL GROUP BY ngram")
def b11(spark, sf):
    d = X.table(spark, sf, "documents")
    g = d.select("doc_id", F.inline(T.counted(T.bigrams(T.tokens(F.col("text"))))).alias("ngram", "c"))
    if not d.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        g = g.groupBy("doc_id", "ngram").agg(F.sum("c").alias("c"))
    return g.groupBy("ngram").agg(F.sum("c").alias("n"), F.count("*").alias("docs"))


@query("b14_min_document_frequency", "WITH " + X.tok_sql("documents", "doc_id") + " SELECT doc, w, count(*) AS n FROM tok WHERE w IN (SELECT w FROM tok GROUP BY w HAVING count(DISTINCT doc) >= 5) GROUP BY doc, w")
def b14(spark, sf):
    c = X.counts(spark, sf)
    return P.looked_up(c, c.groupBy("w").agg(F.count("*").alias("d")).where("d >= 5"), "w", "d").select("doc", "w", "n")


@query("b15_length_normalise", "WITH " + X.tok_sql() + ", c AS (SELECT doc, w, count(*) AS n FROM tok GROUP BY 1, 2) SELECT doc, w, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc)), 6) AS x FROM c")
def b15(spark, sf):
    c = X.tok(spark, sf).groupBy("doc", "w").agg(F.count("*").alias("n"))
    return c.select("doc", "w", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc"))), 6).alias("x"))


@query("b16_tag_classes", "SELECT p_type, CASE upper(left(p_type, 1)) WHEN 'J' THEN 'a' WHEN 'V' THEN 'v' WHEN 'R' THEN 'r' ELSE 'n' END AS cls, count(*) AS n FROM part GROUP BY 1, 2")
def b16(spark, sf):
    return X.table(spark, sf, "part").groupBy("p_type", T.treebank_to_wordnet(F.col("p_type")).alias("cls")).agg(F.count("*").alias("n"))


@query("b19_text_stats", "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, '.', '')) AS BIGINT) AS stops FROM documents")
def b19(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), (F.length("text") - F.length(F.replace(F.col("text"), F.lit(".")))).cast("long").alias("stops"))


@query("b21_count_vectoriser", "WITH " + X.tok_sql() + ", v AS (SELECT w, dense_rank() OVER (ORDER BY w) - 1 AS idx FROM tok GROUP BY w) SELECT doc, idx, count(*) AS n FROM tok JOIN v USING (w) GROUP BY doc, idx")
def b21(spark, sf):
    t = X.tok(spark, sf)
    v = numbered(t.select("w").distinct(), "w", name="idx", first=0)
    return t.join(v, "w").groupBy("doc", "idx").agg(F.count("*").alias("n"))


@query("b23_clean_keys", "SELECT doc_id, md5(lower(trim(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g')))) AS h FROM documents")
def b23(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", F.md5(T.clean_key(F.col("text")).cast("binary")).alias("h"))


@query("b24_underscores", "SELECT p_partkey, replace(p_name, ' ', '_') AS key, string_split(p_name, ' ')[1] AS head FROM part")
def b24(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", F.replace(F.col("p_name"), F.lit(" "), F.lit("_")).alias("key"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"))


@query("b26_non_finite", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE c_acctbal END AS x FROM customer")
def b26(spark, sf):
    x = F.when(F.col("c_custkey") % 10 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    return X.table(spark, sf, "customer").select("c_custkey", T.finite(x).alias("x"))


@query("b28_tf_idf", "WITH " + X.tok_sql() + ", tf AS (SELECT doc, w, count(*) AS tf FROM tok GROUP BY 1, 2), x AS (SELECT doc, w, tf * log2((SELECT count(DISTINCT doc) FROM tok) / count(*) OVER (PARTITION BY w)) AS x FROM tf) SELECT doc, w, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc)), 6) AS x FROM x WHERE x <> 0")
def b28(spark, sf):
    return L.tf_idf(X.tok(spark, sf)).select("doc", "w", F.round("x", 6).alias("x"))
