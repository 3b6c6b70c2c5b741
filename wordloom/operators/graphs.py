"""Weighted association graphs as edge tables ``cue, resp, w``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .ranking import numbered


def normalise(edges: DataFrame, by_total_degree: bool = False) -> DataFrame:
    """``cue, resp, p, cost``: weights over the cue's out-strength (or its in- and out-strength), and -log10."""
    if by_total_degree:
        ends = edges.select(F.col("cue").alias("v"), "w").unionByName(edges.select(F.col("resp").alias("v"), "w")).groupBy("v").agg(F.sum("w").alias("t"))
        scaled = edges.join(ends.withColumnRenamed("v", "cue"), "cue")
    else:
        scaled = edges.withColumn("t", F.sum("w").over(Window.partitionBy("cue")))
    p = F.col("w") / F.col("t")
    return scaled.select("cue", "resp", p.alias("p"), (-F.log10(p)).alias("cost"))


def simplify(edges: DataFrame) -> DataFrame:
    """No loops, parallel edges summed."""
    return edges.where("cue <> resp").groupBy("cue", "resp").agg(F.sum("w").alias("w"))


def drop_sinks(edges: DataFrame) -> DataFrame:
    """Without edges into vertices that have none going out."""
    return edges.join(edges.select(F.col("cue").alias("resp")).distinct(), "resp", "left_semi")


def drop_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(F.col("v").alias("cue")), "cue", "left_anti").join(gone.select(F.col("v").alias("resp")), "resp", "left_anti")


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    return edges.join(kept.select(F.col("v").alias("cue")), "cue", "left_semi").join(kept.select(F.col("v").alias("resp")), "resp", "left_semi")


def path_costs(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst, cost, hops``: least sum of ``cost`` from each ``v`` in sources, to everything that it reaches.

    Frontiers start from the needed sources only; a round sends on just what the last one improved, and the
    search ends when nothing has.
    """
    best = frontier = cut(sources.select(F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0.0).alias("cost"), F.lit(0).alias("hops")).distinct())
    step = cut(edges.select(F.col("cue").alias("dst"), F.col("resp").alias("to"), F.col("cost").alias("c")))
    while True:
        on = frontier.join(step, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.min(F.struct(F.col("cost") + F.col("c"), F.col("hops") + 1)).alias("m")).select("src", "dst", F.col("m.col1").alias("cost"), F.col("m.col2").alias("hops"))
        known = best.select("src", "dst", F.col("cost").alias("old"))
        frontier = cut(on.join(known, ["src", "dst"], "left").where("old IS NULL OR cost < old - 1e-12").drop("old"))
        if not frontier.limit(1).count():
            return best
        best = cut(best.join(frontier, ["src", "dst"], "left_anti").unionByName(frontier))


def path_strengths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``s, t, strength`` of word pairs ``s, t`` in upper case: the largest product of ``p`` along any path.

    A word in the graph has strength 1 to itself; words that are not in it, and what can't be reached, have 0.
    """
    named = edges.select(F.upper("cue").alias("cue"), F.upper("resp").alias("resp"), "cost").groupBy("cue", "resp").agg(F.min("cost").alias("cost"))
    words = named.select(F.col("cue").alias("v")).unionByName(named.select(F.col("resp").alias("v"))).distinct()
    asked = pairs.select(F.upper("s").alias("s"), F.upper("t").alias("t")).distinct()
    costs = path_costs(asked.select(F.col("s").alias("v")).distinct().join(words, "v", "left_semi"), named)
    found = asked.join(costs.select(F.col("src").alias("s"), F.col("dst").alias("t"), "cost"), ["s", "t"], "left")
    return found.select("s", "t", F.coalesce(F.pow(F.lit(10.0), -F.col("cost")), F.lit(0.0)).alias("strength"))


def set_strengths(sets: DataFrame, costs: DataFrame, alpha: float = 0.99) -> DataFrame:
    """``id, strength`` of word sets ``id, side, w`` (side ``from`` or ``to``): that of their best pair.

    A path of more than two vertices is discounted by ``alpha`` for each vertex beyond; the best pair itself says
    how long it is. Ids without a word in the graph on either side have no row, unreachable ones 0.
    """
    one, two = (sets.where(F.col("side") == x).select("id", F.col("w").alias(n)).distinct() for x, n in (("from", "src"), ("to", "dst")))
    words = costs.select(F.col("dst").alias("w")).distinct()
    known = sets.join(words, "w", "left_semi").groupBy("id").agg(F.countDistinct("side").alias("n")).where("n = 2").select("id")
    best = one.join(costs, "src").join(two, ["id", "dst"]).groupBy("id").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "hops")).alias("m"))
    value = F.pow(F.lit(10.0), -F.col("m.cost")) * F.when(F.col("m.hops") > 1, F.pow(F.lit(alpha), F.col("m.hops") - 1)).otherwise(1.0)
    return known.join(best, "id", "left").select("id", F.coalesce(value, F.lit(0.0)).alias("strength"))


def l1(edges: DataFrame, x: str = "w") -> DataFrame:
    t = F.sum(F.abs(x)).over(Window.partitionBy("cue"))
    return edges.withColumn(x, F.when(t > 0, F.col(x) / t).otherwise(0.0))


def l2(edges: DataFrame, x: str = "w") -> DataFrame:
    t = F.sqrt(F.sum(F.col(x) * F.col(x)).over(Window.partitionBy("cue")))
    return edges.withColumn(x, F.when(t > 0, F.col(x) / t).otherwise(0.0))


def ppmi(edges: DataFrame, vertices: int, x: str = "w") -> DataFrame:
    """log2 of ``x`` times the number of vertices over its column's sum; negative and zero entries go."""
    t = F.sum(x).over(Window.partitionBy("resp"))
    v = F.log2(F.col(x) * vertices / t)
    return edges.where(F.col(x) > 0).withColumn(x, v).where(F.col(x) > 0)


def katz(edges: DataFrame, alpha: float, x: str = "w", rest: float = 1e-9) -> DataFrame:
    """``cue, resp, w``: the sum over k from 0 of ``alpha ** k`` times the k-th power.

    For rows that sum to at most 1 the terms left out sum to at most ``rest`` in a row; each round doubles
    the number of terms.
    """
    terms, done = math.ceil(math.log(rest * (1 - alpha)) / math.log(alpha)), 1

    def product(a: DataFrame, b: DataFrame) -> DataFrame:
        step = a.withColumnRenamed("resp", "mid").join(b.select(F.col("cue").alias("mid"), "resp", F.col(x).alias("y")), "mid")
        return step.groupBy("cue", "resp").agg(F.sum(F.col(x) * F.col("y")).alias(x))

    vertices = edges.select("cue").unionByName(edges.select(F.col("resp").alias("cue"))).distinct()
    total, power = vertices.select("cue", F.col("cue").alias("resp"), F.lit(1.0).alias(x)), cut(edges.select("cue", "resp", (F.col(x) * alpha).alias(x)))
    while True:  # total: the first ``done`` terms; power: the one after them
        total = cut(total.unionByName(product(total, power)).groupBy("cue", "resp").agg(F.sum(x).alias(x)))
        done *= 2
        if done >= terms:
            return total
        power = cut(product(power, power))


def katz_walk(edges: DataFrame, alpha: float = 0.75) -> DataFrame:
    """Rows to sum 1, positive information, rows to sum 1, Katz, positive information, rows to sum 1."""
    n = edges.select("cue").unionByName(edges.select(F.col("resp").alias("cue"))).distinct().count()
    return l1(ppmi(katz(l1(ppmi(l1(edges), n)), alpha), n))


def reachable(edges: DataFrame, start: DataFrame, backward: bool = False) -> DataFrame:
    """``v``: everything reached from ``start (v)``; the frontier grows until it adds nothing."""
    a, b = ("resp", "cue") if backward else ("cue", "resp")
    step = edges.select(F.col(a).alias("v"), F.col(b).alias("to")).distinct()
    seen = frontier = cut(start.select("v").distinct())
    while True:
        frontier = cut(frontier.join(step, "v").select(F.col("to").alias("v")).distinct().join(seen, "v", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = cut(seen.unionByName(frontier))


def strong_components(edges: DataFrame) -> DataFrame:
    """``v, component``: the largest name of each strongly connected component, for every vertex.

    Vertices without edges in or out are on their own and go first. Then every vertex takes the largest name
    that reaches it; the vertices of one colour that its name's owner can be reached from are a component. All
    colours are done at once, and what is left is coloured again.
    """
    vertices = edges.select(F.col("cue").alias("v")).unionByName(edges.select(F.col("resp").alias("v"))).distinct()
    left, done = cut(edges.select("cue", "resp").where("cue <> resp").distinct()), None
    while True:
        size, before = left.count(), -1
        while size != before:
            left = cut(left.join(left.select(F.col("resp").alias("cue")).distinct(), "cue", "left_semi").join(left.select(F.col("cue").alias("resp")).distinct(), "resp", "left_semi"))
            before, size = size, left.count()
        if not size:
            break
        colour = cut(left.select(F.col("cue").alias("v")).distinct().withColumn("colour", F.col("v")))
        while True:
            sent = left.join(colour.withColumnRenamed("v", "cue"), "cue").groupBy(F.col("resp").alias("v")).agg(F.max("colour").alias("sent"))
            new = cut(colour.join(sent, "v", "left").select("v", F.greatest("colour", "sent").alias("colour"), (F.col("sent") > F.col("colour")).alias("moved")))
            colour, moved = new.select("v", "colour"), new.where("moved").limit(1).count()
            if not moved:
                break
        inside = cut(left.join(colour.withColumnRenamed("v", "cue"), "cue").join(colour.select(F.col("v").alias("resp"), F.col("colour").alias("other")), "resp").where("colour = other").select("cue", "resp"))
        part = cut(reachable(inside, colour.where("v = colour").select("v"), backward=True).join(colour, "v").select("v", F.col("colour").alias("component")))
        done = part if done is None else done.unionByName(part)
        left = cut(left.join(part.select(F.col("v").alias("cue")), "cue", "left_anti").join(part.select(F.col("v").alias("resp")), "resp", "left_anti"))
    if done is None:
        return vertices.withColumn("component", F.col("v"))
    return vertices.join(done, "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def giant_component(edges: DataFrame) -> DataFrame:
    """``v, idx``: the largest strongly connected component in alphabetical order, ties to the one of the smallest vertex."""
    parts = cut(strong_components(edges))
    best = parts.groupBy("component").agg(F.count("*").alias("n"), F.min("v").alias("least")).orderBy(F.desc("n"), "least").limit(1)
    return numbered(parts.join(F.broadcast(best.select("component")), "component").select("v"), "v", name="idx", first=0).select("v", F.col("idx").cast("int").alias("idx"))


def lexical_features(words: DataFrame, counts: bool = False) -> DataFrame:
    """``id, key, x`` for each word of ``doc, pos, w, tag``: what stands at most two places away, its tags, and trigrams.

    Context words and tags count once (or as often as met, with ``counts``); ends are padded; a word's own letters
    in threes are counted. Spaces of names are kept apart by prefixes.
    """
    w = Window.partitionBy("doc").orderBy("pos")
    near = [(F.lag, k, "<s>") for k in (1, 2)] + [(F.lead, k, "</s>") for k in (1, 2)]
    met = words.select("w", F.array(*(x for f, k, pad in near for x in (f("w", k, pad).over(w), F.concat(F.lit("POS_"), f("tag", k, pad).over(w))))).alias("keys")).select("w", F.explode("keys").alias("key"))
    context = met.groupBy("w", "key").agg((F.count("*") if counts else F.lit(1).cast("long")).alias("x"))
    letters = words.select("w").distinct().where(F.length("w") >= 3)
    threes = letters.select("w", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.concat(F.lit("TRI_"), F.substring("w", i, F.lit(3))))).alias("key")).groupBy("w", "key").agg(F.count("*").alias("x"))
    return context.unionByName(threes).select(F.col("w").alias("id"), "key", "x")


def similarity_graph(features: DataFrame) -> DataFrame:
    """``a, b, sim``: cosine of sparse ``id, key, x`` for pairs a < b that share a key."""
    unit = features.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("id"))))
    l, r = unit.select(F.col("id").alias("a"), "key", F.col("x").alias("p")), unit.select(F.col("id").alias("b"), "key", F.col("x").alias("q"))
    return l.join(r, "key").where("a < b").groupBy("a", "b").agg(F.sum(F.col("p") * F.col("q")).alias("sim"))


def cooccurrence(words: DataFrame, window: int) -> DataFrame:
    """``doc, w1, w2, n``: symmetric counts of words at most ``window`` places apart; repeats give a diagonal."""
    steps = words.sparkSession.range(1, window + 1).select(F.col("id").cast("int").alias("d"))
    shifted = words.crossJoin(F.broadcast(steps)).select("doc", (F.col("pos") + F.col("d")).alias("pos"), F.col("w").alias("w1"))
    near = shifted.join(words.withColumnRenamed("w", "w2"), ["doc", "pos"]).select("doc", "w1", "w2")
    return near.unionByName(near.select("doc", F.col("w2").alias("w1"), F.col("w1").alias("w2"))).groupBy("doc", "w1", "w2").agg(F.count("*").alias("n"))


def undirected(edges: DataFrame) -> DataFrame:
    """``a, b, n``: how often each unordered pair is linked."""
    return edges.groupBy(F.least("child", "parent").alias("a"), F.greatest("child", "parent").alias("b")).agg(F.count("*").alias("n"))


def invert_weights(edges: DataFrame) -> DataFrame:
    return edges.crossJoin(F.broadcast(edges.agg(F.max("n").alias("top")))).withColumn("n", F.col("top") - F.col("n")).drop("top")


def louvain_pass(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``v, community``: moves of vertices to the neighbouring community of largest gain in modularity.

    Vertices of either hash parity move in turn, so two neighbours seldom swap places.
    """
    both = cut(edges.select("a", "b", "n").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")))
    degree = cut(both.groupBy("a").agg(F.sum("n").alias("k")))
    m2 = degree.agg(F.sum("k")).first()[0] or 1
    state = degree.select(F.col("a").alias("v"), F.col("a").alias("community"))
    still = 0
    for i in range(rounds):
        load = state.join(degree.withColumnRenamed("a", "v"), "v").groupBy("community").agg(F.sum("k").alias("load"))
        gain = both.where("a <> b").join(state.select(F.col("v").alias("b"), "community"), "b").groupBy("a", "community").agg(F.sum("n").alias("inside")).join(load, "community").join(degree, "a")
        own = state.select(F.col("v").alias("a"), F.col("community").alias("home"))
        gain = gain.join(own, "a").withColumn("score", F.col("inside") - F.col("k") * (F.col("load") - F.when(F.col("community") == F.col("home"), F.col("k")).otherwise(0)) / m2)
        best = gain.groupBy("a").agg(F.max(F.struct("score", "community")).alias("m"), F.max(F.when(F.col("community") == F.col("home"), F.col("score"))).alias("stay"))
        move = best.where((F.pmod(F.xxhash64("a"), F.lit(2)) == i % 2) & (F.col("m.score") > F.coalesce("stay", F.lit(0.0)) + 1e-12)).select(F.col("a").alias("v"), F.col("m.community").alias("to"))
        new = cut(state.join(move, "v", "left").select("v", F.coalesce("to", "community").alias("community"), F.col("to").isNotNull().alias("moved")))
        state, still = new.select("v", "community"), 0 if new.where("moved").limit(1).count() else still + 1
        if still == 2:  # neither parity has moved
            break
    return state


def louvain(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``level, v, community``: passes over the graph, then over the graph of its communities, until none is joined.

    Weight within a community stays as a loop of the next level's vertex.
    """
    graph, member, out, level = cut(edges.select("a", "b", "n")), None, None, 0
    while True:
        found = louvain_pass(graph, rounds)
        before = found.count()
        member = found.select("v", "community") if member is None else cut(member.join(found.select(F.col("v").alias("community"), F.col("community").alias("up")), "community").select("v", F.col("up").alias("community")))
        here = member.select(F.lit(level).alias("level"), "v", "community")
        out = here if out is None else out.unionByName(here)
        if found.select("community").distinct().count() == before:
            return out
        c, d = found.select(F.col("v").alias("a"), F.col("community").alias("ca")), found.select(F.col("v").alias("b"), F.col("community").alias("cb"))
        graph = cut(graph.join(c, "a").join(d, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("n").alias("n")))
        level += 1


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``q``: share of weight inside communities less what degrees would give by chance."""
    both = edges.select("a", "b", "n").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    c = communities.select(F.col("v").alias("a"), F.col("community").alias("ca"))
    d = communities.select(F.col("v").alias("b"), F.col("community").alias("cb"))
    joined = both.join(c, "a").join(d, "b")
    total = joined.agg(F.sum("n").alias("m2"))
    inside = joined.agg(F.coalesce(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n"))), F.lit(0)).alias("inside"))
    load = joined.groupBy("ca").agg(F.sum("n").alias("k")).agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    return inside.crossJoin(total).crossJoin(load).select((F.col("inside") / F.col("m2") - F.col("kk") / F.col("m2") / F.col("m2")).alias("q"))
