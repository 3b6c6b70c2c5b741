"""Queries of association graphs and taxonomies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import graphs as G
from ..operators import taxonomies as T
from ..operators.lineage import cut
from . import fixtures as X
from .registry import query

_r = lambda c: F.round(c, 6).alias(c)


@query("d01_edge_normalise", f"WITH {X.STRENGTH_SQL} SELECT cue, resp, round(p, 6) AS p, round(-log10(p), 6) AS cost FROM strength")
def d01(spark, sf):
    return G.normalise(X.edges(spark, sf)).select("cue", "resp", _r("p"), F.round(F.col("cost") + 0.0, 6).alias("cost"))


@query("d01b_total_degree", f"WITH {X.EDGES_SQL}, t AS (SELECT v, sum(w) AS t FROM (SELECT cue AS v, w FROM edges UNION ALL SELECT resp, w FROM edges) GROUP BY v) SELECT cue, resp, round(w / t, 6) AS p FROM edges JOIN t ON v = cue")
def d01b(spark, sf):
    return G.normalise(X.edges(spark, sf), by_total_degree=True).select("cue", "resp", _r("p"))


_SRC = ("the", "of", "and", "que", "der")
_PATH = f"""WITH RECURSIVE {X.STRENGTH_SQL}, step AS (SELECT cue, resp, -log10(p) AS c FROM strength),
 walk(src, dst, cost, hops) USING KEY (src, dst) AS (SELECT DISTINCT cue, cue, CAST(0 AS DOUBLE), 0 FROM edges WHERE cue IN {_SRC} UNION
  SELECT src, dst, m.cost, m.hops FROM (SELECT w.src, s.resp AS dst, min({{'cost': w.cost + s.c, 'hops': w.hops + 1}}) AS m FROM walk w JOIN step s ON s.cue = w.dst GROUP BY 1, 2) n
  LEFT JOIN (SELECT src, dst, cost AS old FROM recurring.walk) r USING (src, dst) WHERE old IS NULL OR m.cost < old - 1e-12)"""


@query("d02_max_product_path", _PATH + f", v AS (SELECT cue AS v FROM edges UNION SELECT resp FROM edges), s AS (SELECT unnest({[*_SRC, 'notaword']}) AS s) SELECT upper(s) AS s, upper(v) AS t, round(coalesce(pow(10, -cost), 0), 6) AS strength FROM s CROSS JOIN v LEFT JOIN walk ON src = s AND dst = v")
def d02(spark, sf):
    e = X.edges(spark, sf)
    v = e.select(F.col("cue").alias("t")).unionByName(e.select(F.col("resp").alias("t"))).distinct()
    pairs = X.rows(spark, [(w,) for w in (*_SRC, "notaword")], "s string").crossJoin(v)
    return G.path_strengths(pairs, G.normalise(e)).select("s", "t", _r("strength"))


@query("d03_path_discount", _PATH + f""", {X.tok_sql()}, known AS (SELECT DISTINCT dst AS w FROM walk), ids AS (SELECT doc FROM tok WHERE w IN (SELECT w FROM known) GROUP BY doc),
 best AS (SELECT doc, min({{'cost': round(cost, 9), 'hops': hops}}) AS m FROM (SELECT DISTINCT doc, w FROM tok) JOIN walk ON dst = w WHERE src IN ('the', 'of') GROUP BY doc)
 SELECT doc AS id, round(coalesce(pow(10, -m.cost) * CASE WHEN m.hops > 1 THEN pow(0.99, m.hops - 1) ELSE 1 END, 0), 6) AS strength FROM ids LEFT JOIN best USING (doc)""")
def d03(spark, sf):
    e = X.edges(spark, sf)
    src = e.where(F.col("cue").isin(*_SRC)).select(F.col("cue").alias("v")).distinct()
    words = X.tok(spark, sf).select(F.col("doc").alias("id"), F.lit("to").alias("side"), "w")
    sets = words.unionByName(words.select("id").distinct().select("id", F.lit("from").alias("side"), F.explode(F.array(F.lit("the"), F.lit("of"))).alias("w")))
    return G.set_strengths(sets, G.path_costs(src, G.normalise(e))).select("id", _r("strength"))


@query("d05_drop_sinks", f"WITH {X.EDGES_SQL} SELECT cue, resp, w FROM edges WHERE cue <> resp AND resp IN (SELECT cue FROM edges WHERE cue <> resp) AND cue NOT IN ('the', 'of') AND resp NOT IN ('the', 'of')")
def d05(spark, sf):
    e = G.drop_sinks(G.simplify(X.edges(spark, sf)))
    return G.drop_vertices(e, X.rows(spark, [("the",), ("of",)], "v string")).select("cue", "resp", "w")


@query("d06_giant_component", f"WITH RECURSIVE {X.EDGES_SQL}, e AS (SELECT DISTINCT cue, resp FROM edges WHERE cue <> resp), top AS (SELECT v FROM (SELECT cue AS v FROM e UNION ALL SELECT resp FROM e) GROUP BY v ORDER BY count(*) DESC, v LIMIT 1), f(v) AS (SELECT v FROM top UNION SELECT resp FROM f JOIN e ON cue = f.v), b(v) AS (SELECT v FROM top UNION SELECT cue FROM b JOIN e ON resp = b.v) SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS idx FROM f JOIN b USING (v)")
def d06(spark, sf):
    return G.giant_component(X.edges(spark, sf))


@query("d07_l1", f"WITH {X.EDGES_SQL} SELECT cue, resp, round(w / sum(w) OVER (PARTITION BY cue), 6) AS w FROM edges")
def d07(spark, sf):
    return G.l1(X.edges(spark, sf)).select("cue", "resp", _r("w"))


@query("d07_l2", f"WITH {X.EDGES_SQL} SELECT cue, resp, round(w / sqrt(sum(w * w) OVER (PARTITION BY cue)), 6) AS w FROM edges")
def d07b(spark, sf):
    return G.l2(X.edges(spark, sf)).select("cue", "resp", _r("w"))


_PPMI = f"{X.STRENGTH_SQL}, m AS (SELECT cue, resp, log2(p * (SELECT count(*) FROM (SELECT cue FROM edges UNION SELECT resp FROM edges)) / sum(p) OVER (PARTITION BY resp)) AS w FROM strength)"


def _ppmi(spark, sf):
    e = X.edges(spark, sf)
    n = e.select("cue").unionByName(e.select(F.col("resp").alias("cue"))).distinct().count()
    return G.ppmi(G.l1(e), n)


@query("d08_ppmi", f"WITH {_PPMI} SELECT cue, resp, round(w, 6) AS w FROM m WHERE w > 0")
def d08(spark, sf):
    return _ppmi(spark, sf).select("cue", "resp", _r("w"))


_TAX_W = "e AS (SELECT child AS cue, parent AS resp, 1.0 + length(child) % 3 AS w FROM tax UNION ALL SELECT parent, child, 2.0 FROM tax)"


def _steps(*names: str) -> str:
    """SQL of normalising steps, each a table after the last: n1 rows to sum 1, pp positive information."""
    out, last = [], "e"
    for i, n in enumerate(names):
        out.append(f"{n}{i} AS (SELECT cue, resp, w / sum(w) OVER (PARTITION BY cue) AS w FROM {last})" if n == "n1" else f"{n}{i} AS (SELECT * FROM (SELECT cue, resp, log2(w * (SELECT count(DISTINCT cue) FROM e) / sum(w) OVER (PARTITION BY resp)) AS w FROM {last}) WHERE w > 0)")
        last = f"{n}{i}"
    return ", ".join(out)


_KATZ = "k(cue, resp, w, n) AS (SELECT cue, cue, CAST(1 AS DOUBLE), 0 FROM (SELECT DISTINCT cue FROM {0}) UNION ALL SELECT k.cue, {0}.resp, sum(k.w * 0.75 * {0}.w), n + 1 FROM k JOIN {0} ON k.resp = {0}.cue WHERE n < 90 GROUP BY k.cue, {0}.resp, n)"


def _tax_edges(spark, sf):
    t = X.taxonomy(spark, sf)
    up = t.select(F.col("child").alias("cue"), F.col("parent").alias("resp"), (1.0 + F.length("child") % 3).alias("w"))
    return up.unionByName(t.select(F.col("parent").alias("cue"), F.col("child").alias("resp"), F.lit(2.0).alias("w")))


@query("d09_katz", f"WITH RECURSIVE {X.TAXONOMY_SQL}, {_TAX_W}, {_steps('n1')}, {_KATZ.format('n10')} SELECT cue, resp, round(sum(w), 6) AS w FROM k GROUP BY 1, 2")
def d09(spark, sf):
    return G.katz(G.l1(_tax_edges(spark, sf)), 0.75).select("cue", "resp", _r("w"))


@query("d09_katz_walk", f"WITH RECURSIVE {X.TAXONOMY_SQL}, {_TAX_W}, {_steps('n1', 'pp', 'n1')}, {_KATZ.format('n12')}, ks AS (SELECT cue, resp, sum(w) AS w FROM k GROUP BY 1, 2), "
       + _steps("pp", "n1").replace("pp0 AS (SELECT * FROM (SELECT cue, resp, log2(w * (SELECT count(DISTINCT cue) FROM e) / sum(w) OVER (PARTITION BY resp)) AS w FROM e)", "x0 AS (SELECT * FROM (SELECT cue, resp, log2(w * (SELECT count(DISTINCT cue) FROM e) / sum(w) OVER (PARTITION BY resp)) AS w FROM ks)").replace("n11 AS", "x1 AS").replace("FROM pp0", "FROM x0") + " SELECT cue, resp, round(w, 6) AS w FROM x1")
def d09b(spark, sf):
    return G.katz_walk(_tax_edges(spark, sf)).select("cue", "resp", _r("w"))


_LEX = f"""WITH {X.tok_sql()}, t AS (SELECT doc, pos, w, {X.TAG_SQL} AS tag FROM tok),
 c AS (SELECT w, unnest([{', '.join(f"coalesce({f}(w, {k}) OVER q, '{p}'), 'POS_' || coalesce({f}(tag, {k}) OVER q, '{p}')" for f, p in (('lag', '<s>'), ('lead', '</s>')) for k in (1, 2))}]) AS key FROM t WINDOW q AS (PARTITION BY doc ORDER BY pos)),
 tri AS (SELECT w, 'TRI_' || substring(w, i, 3) AS key FROM (SELECT w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT DISTINCT w FROM tok) WHERE length(w) >= 3)),
 f AS (SELECT DISTINCT w AS id, key, 1 AS x FROM c UNION ALL SELECT w, key, count(*) FROM tri GROUP BY 1, 2)"""


def _lexical(spark, sf):
    return G.lexical_features(X.tok(spark, sf).withColumn("tag", X.tag(F.col("w"))))


@query("d10_lexical_features", _LEX + " SELECT id, key, x FROM f")
def d10a(spark, sf):
    return _lexical(spark, sf)


@query("d10_similarity_graph", _LEX + ", u AS (SELECT id, key, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM f) SELECT a.id AS a, b.id AS b, round(sum(a.x * b.x), 6) AS sim FROM u a JOIN u b ON a.key = b.key AND a.id < b.id GROUP BY 1, 2")
def d10(spark, sf):
    return G.similarity_graph(_lexical(spark, sf)).select("a", "b", _r("sim"))


@query("d11_cooccurrence_graph", f"WITH {X.tok_sql()}, d AS (SELECT DISTINCT doc, w FROM tok) SELECT a.w AS a, b.w AS b, count(*) AS n FROM d a JOIN d b ON a.doc = b.doc AND a.w < b.w GROUP BY 1, 2")
def d11(spark, sf):
    d = X.tok(spark, sf).select("doc", "w").distinct()
    return d.withColumnRenamed("w", "a").join(d.withColumnRenamed("w", "b"), "doc").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("d12_louvain")
def d12(spark, sf):
    """Modularity and number of communities of the taxonomy's links by level."""
    e = G.undirected(X.taxonomy(spark, sf))
    levels = cut(G.louvain(e))
    rows = [G.modularity(e, levels.where(F.col("level") == i)).crossJoin(levels.where(F.col("level") == i).agg(F.countDistinct("community").alias("communities"))).withColumn("level", F.lit(i)) for i in range(levels.agg(F.max("level")).first()[0] + 1)]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("d13_induced_subgraph", f"WITH {X.EDGES_SQL} SELECT cue, resp, w FROM edges WHERE length(cue) > 3 AND length(resp) > 3")
def d13(spark, sf):
    e = X.edges(spark, sf)
    v = e.select(F.col("cue").alias("v")).union(e.select("resp")).distinct().where(F.length("v") > 3)
    return G.induced(e, v).select("cue", "resp", "w")


@query("d14_synset_graph", f"WITH {X.TAXONOMY_SQL}, g AS (SELECT least(child, parent) AS a, greatest(child, parent) AS b, count(*) AS n FROM tax GROUP BY 1, 2) SELECT a, b, (SELECT max(n) FROM g) - n AS n FROM g")
def d14(spark, sf):
    return G.invert_weights(G.undirected(X.taxonomy(spark, sf)))


_SIMS = f"""WITH {X.CLOSURE_SQL}, pairs AS (SELECT a.n_name AS s1, b.n_name AS s2 FROM nation a JOIN nation b ON a.n_name < b.n_name),
 dep AS (SELECT node AS anc, max(d) AS depth FROM clo GROUP BY 1),
 com AS (SELECT s1, s2, x.anc, x.d AS d1, y.d AS d2, depth FROM pairs JOIN clo x ON x.node = s1 JOIN clo y ON y.node = s2 AND x.anc = y.anc JOIN dep ON dep.anc = x.anc),
 dist AS (SELECT s1, s2, min(d1 + d2) AS dist FROM com GROUP BY 1, 2),
 lcs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY depth DESC, d1 + d2, anc) AS k FROM com) WHERE k = 1)"""


def _similarities(spark, sf):
    n = X.table(spark, sf, "nation").select("n_name")
    pairs = n.select(F.col("n_name").alias("s1")).join(n.select(F.col("n_name").alias("s2")), F.col("s1") < F.col("s2"))
    return T.similarities(pairs, T.ancestors(X.taxonomy(spark, sf)))


@query("c39_path_similarity", _SIMS + " SELECT s1, s2, dist, round(1 / (dist + 1), 6) AS path FROM dist")
def c39(spark, sf):
    return _similarities(spark, sf).select("s1", "s2", "dist", _r("path"))


@query("c40_lch_similarity", _SIMS + " SELECT s1, s2, round(-ln((dist + 1) / (2.0 * (SELECT max(depth) FROM dep))), 6) AS lch FROM dist")
def c40(spark, sf):
    return _similarities(spark, sf).select("s1", "s2", _r("lch"))


@query("c41_wup_similarity", _SIMS + " SELECT s1, s2, round(2 * (depth + 1) / (2 * (depth + 1) + d1 + d2), 6) AS wup FROM lcs")
def c41(spark, sf):
    return _similarities(spark, sf).select("s1", "s2", _r("wup"))


@query("c38_directional_relativity", f"""WITH RECURSIVE {X.TAXONOMY_SQL}, both_ AS (SELECT child AS v, parent AS t FROM tax UNION SELECT parent, child FROM tax),
 walk(centre, v, n) AS (SELECT DISTINCT v, v, 0 FROM both_ UNION SELECT centre, t, n + 1 FROM walk JOIN both_ USING (v) WHERE n < 3), near AS (SELECT DISTINCT centre, v FROM walk),
 size AS (SELECT centre, count(*) AS n FROM near GROUP BY 1)
 SELECT a.n_name AS s1, b.r_name AS s2, round(coalesce((SELECT count(*) FROM near x JOIN near y USING (v) WHERE x.centre = a.n_name AND y.centre = b.r_name) / size.n, 0), 6) AS rel FROM nation a CROSS JOIN region b JOIN size ON size.centre = a.n_name""")
def c38(spark, sf):
    pairs = X.table(spark, sf, "nation").select(F.col("n_name").alias("s1")).crossJoin(F.broadcast(X.table(spark, sf, "region").select(F.col("r_name").alias("s2"))))
    return T.directional_relativity(pairs, T.neighbourhoods(X.taxonomy(spark, sf), 3)).select("s1", "s2", _r("rel"))
