"""Queries of features of word pairs, and the suite that puts them side by side.

Stimuli are nations and responses regions; their senses are suppliers, or nodes of the taxonomy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import pairs as P
from ..operators import suites as U
from ..operators import taxonomies as T
from . import fixtures as X
from .registry import query

POS = ["a", "s", "r", "n", "v"]
LEXNAMES = [f"lex{i:02}" for i in range(45)]

_NP = "np AS (SELECT n_name AS stim, r_name AS resp, n_name || '|' || r_name AS pair FROM nation CROSS JOIN region)"
_SUP = "sup AS (SELECT n_name AS w, s_suppkey AS s FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT r_name, s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


def _pairs(spark, sf):
    n, r = X.table(spark, sf, "nation").select(F.col("n_name").alias("stim")), X.table(spark, sf, "region").select(F.col("r_name").alias("resp"))
    return n.crossJoin(F.broadcast(r)).withColumn("pair", F.concat_ws("|", "stim", "resp"))  # 25 times 5 at any size


def _suppliers(spark, sf):
    s, n, r = (X.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    of = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return of.select(F.col("n_name").alias("w"), F.col("s_suppkey").alias("s")).unionByName(of.select(F.col("r_name").alias("w"), F.col("s_suppkey").alias("s")))


def _nodes(spark, sf):
    t = X.taxonomy(spark, sf).where("parent <> 'ROOT'")
    return t.select(F.col("child").alias("w"), F.col("child").alias("s")).unionByName(t.select(F.col("child").alias("w"), F.col("parent").alias("s"))).unionByName(t.select(F.col("parent").alias("w"), F.col("child").alias("s")))


_NODES = "sen AS (SELECT child AS w, child AS s FROM tax WHERE parent <> 'ROOT' UNION ALL SELECT child, parent FROM tax WHERE parent <> 'ROOT' UNION ALL SELECT parent, child FROM tax WHERE parent <> 'ROOT')"


def _grouped(scored: str, names: list[str], digits: int = 6) -> str:
    """SQL of the largest and mean of each score of ``scored (pair, ...)``, 0 without one."""
    cells = ", ".join(f"round(coalesce({f}({n}), 0), {digits}) AS {n}_{f}" for n in names for f in ("max", "avg"))
    return f"SELECT np.pair, {cells} FROM np LEFT JOIN ({scored}) q ON q.pair = np.pair GROUP BY np.pair"


_C36 = f"WITH {_NP}, {_SUP}, v AS (SELECT vec_id AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) " + _grouped("SELECT pair, list_cosine_similarity(va.v, vb.v) AS sim FROM np JOIN sup a ON a.w = stim JOIN sup b ON b.w = resp JOIN v va ON va.s = a.s JOIN v vb ON vb.s = b.s", ["sim"])


@query("c36_sense_products", _C36)
def c36(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("s"), V.doubles(F.col("embedding")).alias("v"))
    got = P.sense_products(_pairs(spark, sf), _suppliers(spark, sf).join(e, "s"))
    return got.select("pair", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


def _central_sql(name: str, value: str) -> str:
    cells = ", ".join(f"round(coalesce({x}.{n}, 0), 4) AS {name}_{x}_{n}" for x in ("stim", "resp") for n in ("max", "avg", "total"))
    return f"WITH {_NP}, {_SUP}, cen AS (SELECT w, max(c) AS max, avg(c) AS avg, sum(c) AS total FROM (SELECT w, coalesce({value}, 0) AS c FROM sup JOIN supplier ON s_suppkey = s) GROUP BY w) SELECT pair, {cells} FROM np LEFT JOIN cen stim ON stim.w = np.stim LEFT JOIN cen resp ON resp.w = np.resp"


_BETWEEN, _LOAD = _central_sql("betweenness", "CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal END"), _central_sql("load", "CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey * 1.5 END")


def _central(spark, sf, name):
    s = X.table(spark, sf, "supplier")
    c = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("s"), F.col("s_acctbal").cast("double").alias("c")) if name == "betweenness" else s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("s"), (F.col("s_suppkey") * 1.5).alias("c"))
    got = P.centralities(_pairs(spark, sf), _suppliers(spark, sf), c, name)
    return got.select("pair", *(F.round(x, 4).alias(x) for x in got.columns if x != "pair"))


@query("c37_betweenness", _BETWEEN)
def c37(spark, sf):
    return _central(spark, sf, "betweenness")


@query("c37_load", _LOAD)
def c37b(spark, sf):
    return _central(spark, sf, "load")


_CELLS = [(f"pos_{p}", f"count(*) FILTER (s % 5 = {i})") for i, p in enumerate(POS)] + [(f"lex_{x}", f"count(*) FILTER (s % 45 = {i})") for i, x in enumerate(LEXNAMES)]
_C42 = f"WITH {_NP}, {_SUP}, c AS (SELECT w, {', '.join(f'{e} AS {n}' for n, e in _CELLS)} FROM sup GROUP BY w) SELECT pair, {', '.join(f'coalesce({x}.{n}, 0) AS {x}_{n}' for x in ('stim', 'resp') for n, _ in _CELLS)} FROM np LEFT JOIN c stim ON stim.w = np.stim LEFT JOIN c resp ON resp.w = np.resp"


@query("c42_lex_vector", _C42)
def c42(spark, sf):
    item = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("s") % len(names) + 1).cast("int"))
    senses = _suppliers(spark, sf).withColumns({"pos": item(POS), "lexname": item(LEXNAMES)})
    return P.lex_vectors(_pairs(spark, sf), senses, POS, LEXNAMES)


_SIM = f"""{X.CLOSURE_SQL}, {_NP}, {_NODES}, met AS (SELECT pair, a.s AS s1, b.s AS s2 FROM np JOIN sen a ON a.w = stim JOIN sen b ON b.w = resp), dep AS (SELECT node AS anc, max(d) AS depth FROM clo GROUP BY 1),
 com AS (SELECT s1, s2, x.anc, x.d AS d1, y.d AS d2, depth FROM (SELECT DISTINCT s1, s2 FROM met) JOIN clo x ON x.node = s1 JOIN clo y ON y.node = s2 AND y.anc = x.anc JOIN dep ON dep.anc = x.anc),
 dist AS (SELECT s1, s2, min(d1 + d2) AS dist FROM com GROUP BY 1, 2), lcs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY depth DESC, d1 + d2, anc) AS k FROM com) WHERE k = 1),
 sims AS (SELECT s1, s2, 1 / (dist + 1) AS path, -ln((dist + 1) / (2.0 * (SELECT max(depth) FROM dep))) AS lch, 2 * (depth + 1) / (2 * (depth + 1) + d1 + d2) AS wup FROM dist JOIN lcs USING (s1, s2))"""
_C43 = f"WITH {_SIM} " + _grouped("SELECT pair, path, lch, wup FROM met JOIN sims USING (s1, s2)", ["path", "lch", "wup"])


@query("c43_grouped_similarities", _C43)
def c43(spark, sf):
    pairs, closure = _pairs(spark, sf), T.ancestors(T.rooted(X.taxonomy(spark, sf).where("parent <> 'ROOT'"), "ROOT"))
    met = P.cross_senses(pairs, _nodes(spark, sf))
    sims = T.similarities(met.select("s1", "s2").distinct(), closure)
    got = P.best_and_mean(pairs, met.join(sims, ["s1", "s2"]), ["path", "lch", "wup"])
    return got.select("pair", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


_LESK = "gl AS (SELECT n_name AS s, substring(n_name, i, 2) AS g FROM nation, range(1, 30) t(i) WHERE i < length(n_name) UNION SELECT r_name, substring(r_name, i, 2) FROM region, range(1, 30) t(i) WHERE i < length(r_name))"
_C44 = f"WITH {X.TAXONOMY_SQL}, {_NP}, {_NODES}, {_LESK}, ov AS (SELECT a.s AS s1, b.s AS s2, CAST(count(*) AS DOUBLE) AS score FROM gl a JOIN gl b ON a.g = b.g GROUP BY 1, 2) " + _grouped("SELECT pair, coalesce(score, 0) AS overlap FROM np JOIN sen a ON a.w = stim JOIN sen b ON b.w = resp LEFT JOIN ov ON s1 = a.s AND s2 = b.s", ["overlap"])


@query("c44_gloss_overlap", _C44)
def c44(spark, sf):
    """The overlap table is made of letter pairs of names, which stand for words of glosses."""
    t = X.taxonomy(spark, sf).where("parent <> 'ROOT'")
    names = t.select(F.col("child").alias("s")).unionByName(t.select(F.col("parent").alias("s"))).distinct()
    g = names.select("s", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("g")).distinct()
    table = g.withColumnRenamed("s", "s1").join(g.withColumnRenamed("s", "s2"), "g").groupBy("s1", "s2").agg(F.count("*").alias("score"))
    got = P.table_scores(_pairs(spark, sf), _nodes(spark, sf), table, "overlap")
    return got.select("pair", *(F.round(c, 6).alias(c) for c in got.columns[1:]))


_TOPICS = f"WITH {_NP}, t AS (SELECT n_name AS w, c_mktsegment AS topic, count(*) AS x FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2 UNION ALL SELECT r_name, c_mktsegment, count(*) FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2), u AS (SELECT w, topic, x / sqrt(sum(x * x) OVER (PARTITION BY w)) AS x FROM t) SELECT pair, round(coalesce(sum(a.x * b.x), 0), 6) AS sim FROM np LEFT JOIN u a ON a.w = stim LEFT JOIN u b ON b.w = resp AND b.topic = a.topic GROUP BY pair"


@query("c35_pair_topics", _TOPICS)
def topics(spark, sf):
    c, n, r = (X.table(spark, sf, t) for t in ("customer", "nation", "region"))
    of = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    t = of.groupBy(F.col("n_name").alias("w"), F.col("c_mktsegment").alias("topic")).agg(F.count("*").alias("x")).unionByName(of.groupBy(F.col("r_name").alias("w"), F.col("c_mktsegment").alias("topic")).agg(F.count("*").alias("x")))
    unit = t.join(t.groupBy("w").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size")), "w").select("w", "topic", (F.col("x") / F.col("size")).alias("x"))
    pairs = _pairs(spark, sf)
    both = pairs.join(unit.select(F.col("w").alias("stim"), "topic", F.col("x").alias("a")), "stim").join(unit.select(F.col("w").alias("resp"), "topic", F.col("x").alias("b")), ["resp", "topic"])
    got = both.groupBy("pair").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    return pairs.select("pair").join(got, "pair", "left").select("pair", F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("sim"))


_VEC = f"WITH {_NP}, v AS (SELECT n_name AS w, CAST(embedding AS DOUBLE[]) AS v FROM nation JOIN embeddings ON vec_id = n_nationkey WHERE n_nationkey <> 3 UNION ALL SELECT r_name, CAST(embedding AS DOUBLE[]) FROM region JOIN embeddings ON vec_id = 30 + r_regionkey) SELECT pair, round(coalesce(list_cosine_similarity(a.v, b.v), 0), 6) AS sim, {', '.join(f'round(coalesce(a.v[{i + 1}] - b.v[{i + 1}], 0), 6) AS d{i}' for i in range(64))} FROM np LEFT JOIN v a ON a.w = stim LEFT JOIN v b ON b.w = resp"


@query("c33_pair_offsets", _VEC)
def offsets(spark, sf):
    e = X.table(spark, sf, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    n, r = X.table(spark, sf, "nation").where("n_nationkey <> 3").select(F.col("n_name").alias("w"), F.col("n_nationkey").cast("long").alias("vec_id")), X.table(spark, sf, "region").select(F.col("r_name").alias("w"), (F.col("r_regionkey") + 30).cast("long").alias("vec_id"))
    got = P.pair_offsets(_pairs(spark, sf), n.unionByName(r).join(e, "vec_id").select("w", "v"), 64)
    return got.select("pair", *(V.rounded(F.col(c), 6).alias(c) for c in got.columns[1:]))


def _relativity(spark, sf):
    near = T.neighbourhoods(X.taxonomy(spark, sf), 3)
    got = T.directional_relativity(_pairs(spark, sf).select(F.col("stim").alias("s1"), F.col("resp").alias("s2")), near)
    return got.select(F.concat_ws("|", "s1", "s2").alias("pair"), F.round("rel", 6).alias("rel"))


_REL = f"""WITH RECURSIVE {X.TAXONOMY_SQL}, {_NP}, both_ AS (SELECT child AS v, parent AS t FROM tax UNION SELECT parent, child FROM tax), walk(centre, v, n) AS (SELECT DISTINCT v, v, 0 FROM both_ UNION SELECT centre, t, n + 1 FROM walk JOIN both_ USING (v) WHERE n < 3), near AS (SELECT DISTINCT centre, v FROM walk), size AS (SELECT centre, count(*) AS n FROM near GROUP BY 1), c AS (SELECT x.centre AS a, y.centre AS b, count(*) AS c FROM near x JOIN near y USING (v) GROUP BY 1, 2)
 SELECT pair, round(coalesce(c / n, 0), 6) AS rel FROM np LEFT JOIN c ON a = stim AND b = resp LEFT JOIN size ON size.centre = stim"""

#: Features of the suite in its order, with their columns and SQL.
_PARTS = {
    "topics": (topics, ["sim"], _TOPICS),
    "vectors": (offsets, ["sim", *(f"d{i}" for i in range(64))], _VEC),
    "synsets": (c36, ["sim_max", "sim_avg"], _C36),
    "betweenness": (c37, [f"betweenness_{s}_{n}" for s in ("stim", "resp") for n in ("max", "avg", "total")], _BETWEEN),
    "load": (c37b, [f"load_{s}_{n}" for s in ("stim", "resp") for n in ("max", "avg", "total")], _LOAD),
    "relativity": (_relativity, ["rel"], _REL),
    "lexical": (c42, [f"{s}_{n}" for s in ("stim", "resp") for n, _ in _CELLS], _C42),
    "similarity": (c43, [f"{c}_{n}" for c in ("path", "lch", "wup") for n in ("max", "avg")], _C43),
}


def suite_sql(key: str, spine: str, parts: dict) -> str:
    """SQL of feature tables side by side: ``parts`` names columns and SQL, both keyed by ``key``."""
    cells = [f"coalesce(CAST(t{i}.{c} AS DOUBLE), 0) AS {name}_{c}" for i, (name, (_, columns, _)) in enumerate(parts.items()) for c in columns]
    joins = " ".join(f"LEFT JOIN ({sql}) t{i} ON t{i}.{key} = spine.{key}" for i, (_, _, sql) in enumerate(parts.values()))
    return f"SELECT spine.{key}, {', '.join(cells)} FROM ({spine}) spine {joins}"


_SPINE = "SELECT n_name || '|' || r_name AS pair FROM nation CROSS JOIN region"


def _hayashi(spark, sf):
    return U.Suite("pair", {n: (lambda f=f: f(spark, sf)) for n, (f, _, _) in _PARTS.items()}, dims={n: len(c) for n, (_, c, _) in _PARTS.items()})


@query("c46_hayashi_suite", suite_sql("pair", _SPINE, _PARTS))
def c46(spark, sf):
    return _hayashi(spark, sf)(_pairs(spark, sf), list(_PARTS), in_order=True)


@query("c45_feature_selection", suite_sql("pair", _SPINE, {n: _PARTS[n] for n in ("relativity", "synsets", "topics")}))
def c45(spark, sf):
    return _hayashi(spark, sf)(_pairs(spark, sf), ["topics", "no such feature", "synsets", "relativity", "topics"])
