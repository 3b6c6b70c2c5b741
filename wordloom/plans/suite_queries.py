"""Queries of further line formats, text steps, anchors and feature suites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import anchors as A
from ..operators import lexical as L
from ..operators import models as M
from ..operators import pairs as P
from ..operators import suites as U
from ..sources import lines as S
from ..sources import readers as R
from . import feature_queries as Q
from . import fixtures as X
from .registry import SQL, query
from .word_pair_queries import suite_sql

_r = lambda c: F.round(c, 6).alias(c)
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)


@query("a15_domain_lines", "SELECT p_partkey AS id, replace(p_brand, '#', '.') AS synset, p_type || '|' || p_name AS domains FROM (SELECT p_partkey, p_brand, p_type, replace(p_name, ' ', '|') AS p_name FROM part)")
def a15(spark, sf):
    p = X.table(spark, sf, "part")
    got = S.wordnet_domains(p.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_brand", "p_type", "p_name").alias("line")))
    return got.select(F.col("offset").cast("long").alias("id"), "synset", F.array_join("domains", "|").alias("domains"))


@query("a22_tagged_tweets", "SELECT CAST(event_id AS VARCHAR) AS tweet_id, 2 AS n, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS INTEGER) END AS label FROM events")
def a22(spark, sf):
    e = X.table(spark, sf, "events")
    line = F.concat_ws("\t", F.concat("event_type", F.lit(" x")), F.lit("N V"), F.lit("1 1"), F.col("event_id").cast("string"), F.lit("body"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")))
    return S.tagged_tweets(e.select(line.alias("line"))).select("tweet_id", F.size("tokens").alias("n"), "label")


@query("a24_captions", "SELECT p_partkey AS line_no, p_name AS caption FROM part WHERE p_partkey > 0")
def a24(spark, sf):
    p = X.table(spark, sf, "part")
    return S.captions(p.select(F.col("p_partkey").alias("line_no"), F.concat_ws("\t", "p_brand", "p_name", "p_type").alias("line")))


@query("a26_missing_floats", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS x, c_name AS text FROM customer")
def a26(spark, sf):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal").cast("string")).otherwise(""), F.lit("\t"), "c_name")
    return S.missing_floats(X.table(spark, sf, "customer").select(line.alias("line")), ["x"])


@query("a29_pajek_text", "WITH v AS (SELECT name, row_number() OVER (ORDER BY name) AS id FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region)) SELECT 0 AS part, '*Vertices ' || count(*) AS line FROM v UNION ALL SELECT 1, id || ' \"' || name || '\"' FROM v UNION ALL SELECT 2, '*Arcs' UNION ALL SELECT 3, a.id || ' ' || b.id || ' ' || n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN v a ON a.name = n_name JOIN v b ON b.name = r_name")
def a29(spark, sf):
    n, r = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    v = n.select(F.col("n_name").alias("name")).unionByName(r.select(F.col("r_name").alias("name")))
    arcs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("cue"), F.col("r_name").alias("resp"), F.col("n_regionkey").alias("w"))
    return R.pajek_text(v, arcs)


@query("a31_derived_columns", "SELECT s_suppkey, s_acctbal, s_acctbal * 2 AS twice FROM supplier")
def a31(spark, sf):
    return R.with_derived(X.table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), twice=F.col("s_acctbal") * 2)


@query("o13_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def o13(spark, sf):
    o = X.table(spark, sf, "orders")
    return R.resume(o, o.where("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey")


@query("b03_strip_tags", "SELECT event_id, event_type || ' ' || user_id AS words FROM events")
def b03(spark, sf):
    tagged = F.array(*(F.struct(w.alias("token"), F.lit("NN").alias("pos")) for w in (F.col("event_type"), F.col("user_id").cast("string"))))
    return X.table(spark, sf, "events").select("event_id", tagged.alias("t")).select("event_id", F.array_join(T.strip_tags(F.col("t")), " ").alias("words"))


@query("b05_sanitise", "SELECT event_id, 'TOUSER HASH_' || event_type || ' URL ' || user_id || '...' AS body FROM events")
def b05(spark, sf):
    raw = F.concat(F.lit("  @Some_One #"), "event_type", F.lit(" https://x.example/a?b=1 "), F.col("user_id").cast("string"), F.lit("..... "))
    return X.table(spark, sf, "events").select("event_id", T.sanitise(raw).alias("body"))


_TAGGED, _tag = X.TAG_SQL, X.tag


@query("b10_content_tokens", f"WITH {X.tok_sql()}, t AS (SELECT doc, w, {_TAGGED} AS tag FROM tok) SELECT doc, w, count(*) AS n FROM t WHERE tag <> 'RB' AND w NOT IN ({_STOP}) GROUP BY 1, 2")
def b10(spark, sf):
    stop = X.rows(spark, [(w,) for w in X.STOPWORDS], "w string")
    return X.tok(spark, sf).where(_tag(F.col("w")) != "RB").join(F.broadcast(stop), "w", "left_anti").groupBy("doc", "w").agg(F.count("*").alias("n"))


@query("b12_tagged_ngrams", f"WITH {X.tok_sql()}, t AS (SELECT doc, pos, w || '_' || {_TAGGED} AS w FROM tok), g AS (SELECT doc, w || ' ' || lead(w) OVER (PARTITION BY doc ORDER BY pos) AS ngram FROM t) SELECT doc, ngram, count(*) AS n FROM g WHERE ngram IS NOT NULL GROUP BY 1, 2")
def b12(spark, sf):
    words = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), F.transform(T.tokens(F.col("text")), lambda w: F.concat(w, F.lit("_"), _tag(w))).alias("ws"))
    return words.select("doc", F.explode(T.n_grams(F.col("ws"), 2)).alias("ngram")).groupBy("doc", "ngram").agg(F.count("*").alias("n"))


@query("b13_merge_kinds", f"WITH {X.tok_sql()} SELECT doc, 'word' AS kind, w AS key, count(*) AS n FROM tok GROUP BY 1, 3 UNION ALL SELECT doc, 'pos', 'POS_' || {_TAGGED}, count(*) FROM tok GROUP BY 1, 3")
def b13(spark, sf):
    t = X.tok(spark, sf)
    kind = lambda name, key: t.groupBy("doc", F.lit(name).alias("kind"), key.alias("key")).agg(F.count("*").alias("n"))
    return kind("word", F.col("w")).unionByName(kind("pos", F.concat(F.lit("POS_"), _tag(F.col("w")))))


@query("b17_noun_phrases", f"WITH {X.tok_sql()}, s AS (SELECT doc, string_agg({_TAGGED}, ' ' ORDER BY pos) AS tags FROM tok GROUP BY doc) SELECT doc, CAST(len(regexp_extract_all(tags, '((?:JJ[RS]? )*(?:NN(?:S|PS?)? ?)+)', 1)) AS INTEGER) AS chunks FROM s")
def b17(spark, sf):
    tags = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc"), F.array_join(F.transform(T.tokens(F.col("text")), _tag), " ").alias("tags"))
    return tags.select("doc", F.size(T.noun_phrases(F.col("tags"))).alias("chunks"))


@query("b18_stems")
def b18(spark, sf):
    from ..functions.stemming import stems

    return X.tok(spark, sf, "documents", "doc_id").select("w").distinct().withColumn("stem", stems("w"))


@query("b20_bag_of_words", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, 1 AS n FROM part")
def b20(spark, sf):
    return X.table(spark, sf, "part").select("p_partkey", F.explode(T.white_tokens(F.col("p_name"))).alias("w")).groupBy("p_partkey", "w").agg(F.count("*").cast("int").alias("n"))


@query("b22_dict_vectoriser", f"WITH {X.tok_sql('documents', 'doc_id')}, v AS (SELECT DISTINCT w FROM tok WHERE substring(md5(CAST(doc AS VARCHAR)), 1, 1) < 'c') SELECT doc, w AS key, count(*) AS n FROM tok WHERE w IN (SELECT w FROM v) GROUP BY 1, 2")
def b22(spark, sf):
    """Columns are those of the training fold, three quarters of all documents by a hash of the id."""
    c = X.counts(spark, sf).withColumnRenamed("w", "key")
    train = c.where(F.substring(F.md5(F.col("doc").cast("string").cast("binary")), 1, 1) < "c")
    return P.looked_up(c, train.groupBy("key").agg(F.count("*").alias("size")), "key", "size").select("doc", "key", "n")


@query("b25_absent_features", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal END, -1) AS x FROM customer")
def b25(spark, sf):
    m = F.map_filter(F.create_map(F.lit("x"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), lambda k, v: v.isNotNull())
    return X.table(spark, sf, "customer").select("c_custkey", F.coalesce(m["x"], F.lit(-1.0)).alias("x"))


@query("c18_prefixed_similarity", Q._SCORED + " SELECT item_id AS doc, round(coalesce(hi, 0), 6) AS hi FROM benchmark LEFT JOIN feat ON doc = item_id")
def c18(spark, sf):
    pre = lambda c: F.concat(F.lit("/c/en/"), c)
    t = X.tok(spark, sf).withColumn("w", pre(F.col("w")))
    pairs = P.word_pairs(t)
    return P.interword(X.docs(spark, sf), pairs, P.vector_scores(pairs, X.vectors(spark, sf).withColumn("w", pre(F.col("w"))))).select("doc", _r("hi"))


def _parsed(spark, sf):
    """Words of short texts; every two words from the fourth of ten on are a phrase."""
    t = X.tok(spark, sf)
    return t.withColumn("tag", _tag(F.col("w"))).withColumn("phrase", F.when(F.col("pos") % 10 >= 4, F.floor(F.col("pos") / 2)))


@query("c20_anchor_candidates", f"WITH {X.tok_sql()}, t AS (SELECT doc, pos, w, {_TAGGED} AS tag, CASE WHEN pos % 10 >= 4 THEN pos // 2 END AS phrase FROM tok) SELECT doc, 'p' || phrase AS cand, string_agg(w, ' ' ORDER BY pos) AS words, CAST(min(pos) AS INTEGER) AS at FROM t WHERE phrase IS NOT NULL GROUP BY doc, phrase UNION ALL SELECT doc, 'w' || pos, w, CAST(pos AS INTEGER) FROM t WHERE phrase IS NULL AND (tag LIKE 'NN%' OR tag LIKE 'VB%')")
def c20(spark, sf):
    return A.candidates(_parsed(spark, sf)).select("doc", "cand", F.array_join("words", " ").alias("words"), "at")


_CHOSEN = f"""WITH {X.tok_sql()}, cand AS (SELECT doc, 'p' || pos // 2 AS cand, min(pos) AS at, list(w ORDER BY pos) AS ws FROM tok WHERE pos % 20 >= 14 AND pos < 60 GROUP BY doc, pos // 2),
 two AS (SELECT a.doc, a.cand || '+' || b.cand AS variant, list_concat(a.ws, b.ws) AS gone FROM cand a JOIN cand b ON a.doc = b.doc AND a.at < b.at),
 three AS (SELECT a.doc, a.cand || '+' || b.cand || '+' || c.cand AS variant, list_concat(list_concat(a.ws, b.ws), c.ws) AS gone FROM cand a JOIN cand b ON a.doc = b.doc AND a.at < b.at JOIN cand c ON c.doc = a.doc AND b.at < c.at),
 sets AS (SELECT * FROM two UNION ALL SELECT * FROM three), words AS (SELECT doc, list(w ORDER BY pos) AS ws FROM tok GROUP BY doc),
 score AS (SELECT doc, ws, coalesce(list_sum(list_transform(ws, lambda w: length(w))) / len(ws), 0) AS base FROM words),
 got AS (SELECT s.doc, variant, gone, base, base - coalesce(list_sum(list_transform(list_filter(ws, lambda w: NOT list_contains(gone, w)), lambda w: length(w))) / nullif(len(list_filter(ws, lambda w: NOT list_contains(gone, w))), 0), 0) AS d FROM sets s JOIN score USING (doc)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(d, 9) DESC, variant) AS k FROM got) WHERE k = 1)"""


@query("c21_humour_anchors", _CHOSEN + " SELECT score.doc, array_to_string(coalesce(gone, ws), ' ') AS anchors, round(score.base, 6) AS baseline, round(coalesce(d, 0), 6) AS drop FROM score LEFT JOIN best ON best.doc = score.doc")
def c21(spark, sf):
    """Score: mean length of a text's words, rounded so that ties are ties; sets of two and three candidates."""
    t = X.tok(spark, sf)
    words = t.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).getField("w").alias("words"))
    parsed = t.where("pos % 20 >= 14 AND pos < 60").withColumn("tag", _tag(F.col("w"))).withColumn("phrase", F.floor(F.col("pos") / 2))
    length = lambda df: df.select("doc", "variant", F.aggregate("words", F.lit(0.0), lambda s, w: s + F.length(w)).alias("t"), F.size("words").alias("n")).select("doc", "variant", F.round(F.coalesce(F.try_divide("t", "n"), F.lit(0.0)), 10).alias("score"))
    got = A.search(words, A.candidates(parsed), length, (2, 3))
    return got.select("doc", F.array_join("anchors", " ").alias("anchors"), _r("baseline"), _r("drop"))


_LEAVES = f"WITH {X.tok_sql()}, leaf AS (SELECT doc, pos // 7 AS sent, pos % 7 AS leaf, pos, w, {X.TAG_SQL} AS tag FROM tok), n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS idx, tag <> 'RB' AND w NOT IN ({_STOP}) AS held FROM leaf), p AS (SELECT *, CASE WHEN held THEN count(*) FILTER (held) OVER (PARTITION BY doc ORDER BY pos) - 1 ELSE -1 END AS place FROM n)"


@query("c19_enumerated_leaves", _LEAVES + " SELECT doc, CAST(idx AS INTEGER) AS idx, CAST(place AS INTEGER) AS place, place || ' ' || idx || ' ' || w AS label FROM p")
def c19(spark, sf):
    t = X.tok(spark, sf).withColumn("tag", _tag(F.col("w")))
    leaves = t.select("doc", F.floor(F.col("pos") / 7).alias("sent"), (F.col("pos") % 7).alias("leaf"), "w", "tag")
    kept = t.where("tag <> 'RB'").where(~F.col("w").isin(*X.STOPWORDS))
    return A.enumerate_leaves(leaves, kept).select("doc", "idx", "place", "label")


@query("c24_token_perplexity", Q._LM + " SELECT doc, count(*) AS n, round(avg(pow(10, -bp)), 2) AS mean FROM p GROUP BY doc")
def c24(spark, sf):
    return L.token_perplexity(X.table(spark, sf, "documents"), "doc_id").select("doc", "n", F.round("mean", 2).alias("mean"))


@query("c28_nonzero_replacement", "SELECT c_custkey, CASE WHEN a = 0 AND b > 0 THEN b ELSE a END AS lo, CASE WHEN b = 0 AND a > 0 THEN a ELSE b END AS mid FROM (SELECT c_custkey, CAST(c_custkey % 3 AS DOUBLE) AS a, CAST(c_nationkey % 4 AS DOUBLE) AS b FROM customer)")
def c28(spark, sf):
    c = X.table(spark, sf, "customer").select("c_custkey", F.array((F.col("c_custkey") % 3).cast("double"), (F.col("c_nationkey") % 4).cast("double")).alias("v"))
    found = F.filter("v", lambda x: x != 0)
    fill = F.transform("v", lambda x: F.when((x == 0) & (F.size(found) > 0), F.array_min(found)).otherwise(x))
    return c.select("c_custkey", fill[0].alias("lo"), fill[1].alias("mid"))


@query("c30_punch_similarity", Q._SCORED + ", s AS (SELECT doc, w2, score FROM (SELECT DISTINCT doc, w1, w2 FROM pairs) JOIN scored USING (w1, w2) WHERE w1 = 'the') SELECT doc, round(max(score), 6) AS most, round(min(score), 6) AS least, round(avg(score), 6) AS mean FROM s GROUP BY doc")
def c30(spark, sf):
    pairs = P.word_pairs(X.tok(spark, sf))
    s = pairs.where("w1 = 'the'").join(P.vector_scores(pairs, X.vectors(spark, sf)), ["w1", "w2"])
    return s.groupBy("doc").agg(F.round(F.max("score"), 6).alias("most"), F.round(F.min("score"), 6).alias("least"), F.round(F.avg("score"), 6).alias("mean"))


_TOPIC = "t AS (SELECT o_custkey AS id, o_orderpriority AS topic, count(*) AS x FROM orders GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(x * x)) AS n FROM t GROUP BY id)"


@query("c35_topic_similarity", f"WITH {_TOPIC} SELECT c_custkey AS id, round(coalesce(sum(a.x * b.x) / any_value(na.n) / any_value(nb.n), 0), 6) AS sim FROM customer LEFT JOIN t a ON a.id = c_custkey LEFT JOIN t b ON b.id = c_custkey + 1 AND b.topic = a.topic LEFT JOIN n na ON na.id = c_custkey LEFT JOIN n nb ON nb.id = c_custkey + 1 GROUP BY 1")
def c35(spark, sf):
    t = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("topic")).agg(F.count("*").alias("x"))
    unit = t.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id"))))
    both = unit.join(unit.select((F.col("id") - 1).alias("id"), "topic", F.col("x").alias("y")), ["id", "topic"]).groupBy("id").agg(F.sum(F.col("x") * F.col("y")).alias("sim"))
    return X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(both, "id", "left").select("id", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("sim"))


_CAND = f"{X.tok_sql()}, par AS (SELECT doc, pos, w, {X.TAG_SQL} AS tag, CASE WHEN pos % 10 >= 4 THEN pos // 2 END AS phrase FROM tok), anc AS (SELECT doc, 'p' || phrase AS cand, pos, w FROM par WHERE phrase IS NOT NULL UNION ALL SELECT doc, 'w' || pos, pos, w FROM par WHERE phrase IS NULL AND (tag LIKE 'NN%' OR tag LIKE 'VB%')), intra AS (SELECT a.doc, a.w AS w1, b.w AS w2, count(*) AS times FROM anc a JOIN anc b ON a.doc = b.doc AND a.cand = b.cand AND a.pos < b.pos GROUP BY 1, 2, 3), inter AS (SELECT a.doc, a.w AS w1, b.w AS w2, count(*) AS times FROM anc a JOIN anc b ON a.doc = b.doc AND a.cand < b.cand GROUP BY 1, 2, 3)"
_EMB = "_s AS (SELECT w1, w2, {cos} AS score FROM (SELECT w1, w2 FROM intra UNION SELECT w1, w2 FROM inter) LEFT JOIN vec a ON w1 = a.w LEFT JOIN vec b ON w2 = b.w)".format(cos=Q._cos)


def _side_sql(side: str) -> str:
    return f"SELECT doc, round(coalesce(min(score), 0), 6) AS {side}_lo, round(coalesce(sum(score * times) / sum(times), 0), 6) AS {side}_mid, round(coalesce(max(score), 0), 6) AS {side}_hi FROM {side} JOIN _s USING (w1, w2) GROUP BY doc"


_ANCHOR_EMB = f"WITH {_CAND}, {X.VECTORS_SQL}, {_EMB} SELECT item_id AS doc, {', '.join(f'coalesce({s}_{n}, 0) AS {s}_{n}' for s in ('intra', 'inter') for n in ('lo', 'mid', 'hi'))} FROM benchmark LEFT JOIN ({_side_sql('intra')}) i ON i.doc = item_id LEFT JOIN ({_side_sql('inter')}) j ON j.doc = item_id"
_TW = [c.split(" AS ")[1] for c in Q._twelve]


def _assoc_sql(side: str) -> str:
    return f"SELECT item_id AS doc, {', '.join(Q._twelve)} FROM benchmark LEFT JOIN (SELECT doc, times, coalesce(f.p, 0) AS f, coalesce(b.p, 0) AS b FROM {side} LEFT JOIN strength f ON f.cue = w1 AND f.resp = w2 LEFT JOIN strength b ON b.cue = w2 AND b.resp = w1) s ON doc = item_id GROUP BY item_id"


_BOTH = P.interlace([f"intra_{c}" for c in _TW], [f"inter_{c}" for c in _TW])
_ANCHOR_ASSOC = f"WITH {_CAND}, {X.STRENGTH_SQL} SELECT i.doc, {', '.join(f'{c[:5]}.{c[6:]} AS {c}' for c in _BOTH).replace('intra.', 'i.').replace('inter.', 'j.')} FROM ({_assoc_sql('intra')}) i JOIN ({_assoc_sql('inter')}) j USING (doc)"


def _anchor_words(spark, sf):
    """``doc, anchor, pos, w``: phrases and lone content words of short texts."""
    p = _parsed(spark, sf)
    inside = p.where("phrase IS NOT NULL").select("doc", F.concat(F.lit("p"), F.col("phrase").cast("string")).alias("anchor"), "pos", "w")
    lone = p.where(F.col("phrase").isNull() & F.col("tag").rlike("^(NN|VB)")).select("doc", F.concat(F.lit("w"), F.col("pos").cast("string")).alias("anchor"), "pos", "w")
    return inside.unionByName(lone)


def _sides(spark, sf):
    return {n: p.groupBy("doc", "w1", "w2").agg(F.count("*").alias("times")) for n, p in zip(("intra", "inter"), P.anchor_pairs(_anchor_words(spark, sf)), strict=True)}


@query("c12_anchor_embedding", _ANCHOR_EMB)
def c12(spark, sf):
    """Embedding features of pairs that are made already: those within anchors and those between."""
    sides, out = _sides(spark, sf), X.docs(spark, sf)
    scores = P.vector_scores(sides["intra"].unionByName(sides["inter"]), X.vectors(spark, sf))
    for n, pairs in sides.items():
        out = out.join(P.interword(X.docs(spark, sf), pairs, scores).select("doc", *(F.round(c, 6).alias(f"{n}_{c}") for c in ("lo", "mid", "hi"))), "doc")
    return out


@query("c11_anchor_association", _ANCHOR_ASSOC)
def c11b(spark, sf):
    one, two = (P.association_vector(X.docs(spark, sf), pairs, Q._strength(spark, sf)).select("doc", *(F.round(c, 6).alias(f"{n}_{c}") for c in _TW)) for n, pairs in _sides(spark, sf).items())
    return one.join(two, "doc").select("doc", *_BOTH)


_SHORT_CHAIN = Q._CHAIN.replace(X.tok_sql("documents", "doc_id"), X.tok_sql()).replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")
_SHORT_LM = Q._LM.replace(X.tok_sql("documents", "doc_id"), X.tok_sql())
_COLS = ["negative", "positive", "weak", "strong"]


def _short_lm(spark, sf):
    t = X.tok(spark, sf)
    seq = t.select(F.lag("w").over(Window.partitionBy("doc").orderBy("pos")).alias("w1"), F.col("w").alias("w2")).where("w1 IS NOT NULL")
    got = L.perplexity(t, t.groupBy("w").agg(F.count("*").alias("n")), seq.groupBy("w1", "w2").agg(F.count("*").alias("n")))
    return got.select("doc", *(F.round(c, 4).alias(c) for c in ("uni_logprob", "bi_logprob", "uni_ppl", "bi_ppl")))


def _nearest_labels(spark, sf):
    near = Q.c10(spark, sf).select("q", "rank", (F.col("r") % 3).alias("y"))
    return near.groupBy(F.col("q").alias("doc")).agg(*(F.max(F.when(F.col("rank") == i, F.col("y"))).alias(f"y{i}") for i in range(1, 6)))


def _average(spark, sf):
    got = Q.c09(spark, sf)
    return got.groupBy("doc").agg(*(F.max(F.when(F.col("i") == i, F.col("x"))).alias(f"v{i}") for i in range(64)))


def _content(spark, sf):
    c = X.tok(spark, sf).groupBy("doc", "w").agg(F.count("*").alias("n"))
    return M.naive_bayes(c.join(X.docs(spark, sf).select("doc", (F.col("doc") % 2).alias("label")), "doc"), c)


_C05 = f"""WITH {X.tok_sql()}, c AS (SELECT doc, w, count(*) AS n FROM tok GROUP BY 1, 2), t AS (SELECT c.*, doc % 2 AS label FROM c), d AS (SELECT label, ln(count(DISTINCT doc) / (SELECT count(DISTINCT doc) FROM t)) AS prior FROM t GROUP BY 1),
 tot AS (SELECT label, sum(n) AS t FROM t GROUP BY 1), cnt AS (SELECT label, w, sum(n) AS c FROM t GROUP BY 1, 2), v AS (SELECT count(DISTINCT w) AS v FROM t),
 s AS (SELECT doc, d.label, any_value(prior) + sum(n * ln((coalesce(c, 0) + 1) / (t + v))) AS s FROM c CROSS JOIN d JOIN tot ON tot.label = d.label CROSS JOIN v LEFT JOIN cnt ON cnt.label = d.label AND cnt.w = c.w GROUP BY 1, 2)
 SELECT doc, label FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(s, 9) DESC, label) AS k FROM s) WHERE k = 1"""

#: Features of short texts: function, columns, SQL.
_PARTS = {
    "perplexity": (_short_lm, ["uni_logprob", "bi_logprob", "uni_ppl", "bi_ppl"], _SHORT_LM + " SELECT doc, round(sum(up), 4) AS uni_logprob, round(sum(bp), 4) AS bi_logprob, round(pow(10, -sum(up) / count(*)), 4) AS uni_ppl, round(pow(10, -sum(bp) / count(*)), 4) AS bi_ppl FROM p GROUP BY doc"),
    "embedding": (Q.c01, ["lo", "mid", "hi"], SQL["c01_interword_score"]),
    "association": (Q.c11, _TW, SQL["c11_association_vector"]),
    "relations": (Q.c17b, Q._ROLES, SQL["c17_relation_counts_backward"]),
    "anchor_embedding": (c12, [f"{s}_{n}" for s in ("intra", "inter") for n in ("lo", "mid", "hi")], _ANCHOR_EMB),
    "anchor_association": (c11b, _BOTH, _ANCHOR_ASSOC),
    "no_anchors": (lambda spark, sf: U.zeros(X.docs(spark, sf), "doc", 54), [f"z{i}" for i in range(54)], "SELECT item_id AS doc, " + ", ".join(f"0 AS z{i}" for i in range(54)) + " FROM benchmark"),
    "interpersonal": (lambda spark, sf: L.lexicon_counts(X.docs(spark, sf), X.tok(spark, sf), X.rows(spark, X.LEXICON, "w string, tag string"), _COLS), _COLS, f"WITH {X.tok_sql()}, l AS (SELECT w, tag FROM {X.sql_rows(X.LEXICON, 'w, tag')}), h AS (SELECT doc, tag FROM tok JOIN l USING (w)) SELECT item_id AS doc, {', '.join(f'count(*) FILTER (tag = {chr(39)}{c}{chr(39)}) AS {c}' for c in _COLS)} FROM benchmark LEFT JOIN h ON doc = item_id GROUP BY item_id"),
    "phonetic": (lambda spark, sf: L.chains(X.docs(spark, sf), X.tok(spark, sf), Q._prons(X.tok(spark, sf))), ["alliterations", "longest_alliteration", "rhymes", "longest_rhyme"], _SHORT_CHAIN),
    "incongruity": (Q.c06, ["disconnection", "repetition"], SQL["c06_incongruity"]),
    "ambiguity": (Q.c07, ["log_senses", "farthest", "closest"], SQL["c07_ambiguity"]),
    "average_vector": (_average, [f"v{i}" for i in range(64)], f"SELECT doc, {', '.join(f'max(x) FILTER (i = {i}) AS v{i}' for i in range(64))} FROM ({SQL['c09_average_vector']}) GROUP BY doc"),
    "nearest": (_nearest_labels, [f"y{i}" for i in range(1, 6)], f"SELECT q AS doc, {', '.join(f'max(r % 3) FILTER (rank = {i}) AS y{i}' for i in range(1, 6))} FROM ({SQL['c10_nearest_documents']}) GROUP BY q"),
    "alliteration": (lambda spark, sf: L.chains(X.docs(spark, sf), X.tok(spark, sf), Q._prons(X.tok(spark, sf))).select("doc", "alliterations", "rhymes"), ["alliterations", "rhymes"], _SHORT_CHAIN),
    "antonymy": (lambda spark, sf: L.antonym_count(X.docs(spark, sf), X.tok(spark, sf), X.rows(spark, X.ANTONYMS, "w string, opposite string")), ["n_antonyms"], SQL["c03_antonym_count"].replace("documents", "benchmark").replace("doc_id", "item_id")),
    "slang": (lambda spark, sf: L.slang_count(X.docs(spark, sf), X.tok(spark, sf), X.rows(spark, X.SENSES, "w string, sense string, domain string").select("w", "sense", F.array("domain").alias("domains")), "sexuality"), ["n_slang"], SQL["c04_slang_count"].replace("documents", "benchmark").replace("doc_id", "item_id")),
    "content": (_content, ["label"], _C05),
}


def _suite(spark, sf, names):
    suite = U.Suite("doc", {n: (lambda f=f: f(spark, sf)) for n, (f, _, _) in _PARTS.items()}, dims={n: len(c) for n, (_, c, _) in _PARTS.items()})
    return suite(X.docs(spark, sf), names, in_order=True)


def _suite_sql(names) -> str:
    return suite_sql("doc", "SELECT item_id AS doc FROM benchmark", {n: _PARTS[n] for n in names})


_CATTLE_MA = U.SUITES["cattle_ma"]


@query("c47_cattle_ma_suite", _suite_sql(_CATTLE_MA))
def c47(spark, sf):
    return _suite(spark, sf, _CATTLE_MA)


@query("c47_without_anchors", _suite_sql((*_CATTLE_MA[:4], "no_anchors")))
def c47b(spark, sf):
    return _suite(spark, sf, (*_CATTLE_MA[:4], "no_anchors"))


@query("c48_yang_suite", _suite_sql(U.SUITES["yang"]))
def c48(spark, sf):
    return _suite(spark, sf, U.SUITES["yang"])


@query("c49_mihalcea_suite", _suite_sql(U.SUITES["mihalcea"]))
def c49(spark, sf):
    return _suite(spark, sf, U.SUITES["mihalcea"])


@query("e01_pairs_in_group", f"WITH {X.tok_sql()} SELECT doc, count(*) * (count(*) - 1) // 2 AS n FROM tok GROUP BY doc HAVING count(*) > 1")
def e01(spark, sf):
    return P.word_pairs(X.tok(spark, sf)).groupBy("doc").agg(F.sum("times").alias("n"))


@query("e06_lookup_with_default", "SELECT c_custkey, coalesce(s_acctbal, 0) AS bal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def e06(spark, sf):
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("bal"))
    return X.table(spark, sf, "customer").select("c_custkey").join(s, "c_custkey", "left").fillna(0.0, ["bal"])


@query("e07_membership", "SELECT o_orderkey, o_custkey IN (SELECT s_suppkey FROM supplier) AS member FROM orders")
def e07(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    inside = o.join(s, "o_custkey", "left_semi").select("o_orderkey", F.lit(True).alias("member"))
    return inside.unionByName(o.join(s, "o_custkey", "left_anti").select("o_orderkey", F.lit(False).alias("member")))


@query("e09_side_cars", "SELECT o_orderkey, c_acctbal, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey")
def e09(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return R.side_cars(o, "k", c, o.groupBy("k").agg(F.count("*").alias("n"))).select("o_orderkey", "c_acctbal", "n")


@query("g09_ablation", "SELECT n_nationkey, n_name FROM nation")
def g09(spark, sf):
    n = X.table(spark, sf, "nation")
    return U.ablations(n, "n_nationkey", {"region": ["n_regionkey"]})["region"]


@query("h11_binarise", "SELECT doc_id, CASE WHEN quality > 0 THEN 1 ELSE -1 END AS y FROM labels")
def h11(spark, sf):
    return X.table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") > 0, 1).otherwise(-1).alias("y"))
