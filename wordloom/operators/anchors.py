"""Anchor candidates and the search for the words that carry a document's score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(words: DataFrame) -> DataFrame:
    """``doc, cand, words, at``: phrases of a parsed table and the content words outside any.

    words: ``doc, pos, w, tag, phrase`` where phrase is null outside noun, verb, adjective and adverb phrases.
    """
    inside = words.where("phrase IS NOT NULL").groupBy("doc", "phrase").agg(F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("ws"))
    phrase = inside.select("doc", F.concat(F.lit("p"), F.col("phrase").cast("string")).alias("cand"), F.col("ws.w").alias("words"), F.col("ws.pos")[0].alias("at"))
    lone = words.where(F.col("phrase").isNull() & F.col("tag").rlike("^(NN|VB)")).select("doc", F.concat(F.lit("w"), F.col("pos").cast("string")).alias("cand"), F.array("w").alias("words"), F.col("pos").alias("at"))
    return phrase.unionByName(lone)


def search(texts: DataFrame, cands: DataFrame, score: Callable[[DataFrame], DataFrame], sizes: tuple[int, int] = (2, 3)) -> DataFrame:
    """``doc, anchors, baseline, drop``: the set of candidates whose removal lowers the score most.

    texts: ``doc, words``; score: from ``doc, variant, words`` to ``doc, variant, score``. Sets have sizes
    in the range; a document with fewer candidates has all its words as its anchor. A word that is removed goes
    wherever it stands; repeats of the words that stay remain. Ties go to the first set.
    """
    c = cands.select("doc", F.struct("at", "cand", "words").alias("c"))
    combos, level = None, c.select("doc", F.array("c").alias("set"))
    for n in range(2, sizes[1] + 1):
        level = level.join(c, "doc").where(F.col("c.at") > F.element_at("set", -1)["at"]).select("doc", F.concat("set", F.array("c")).alias("set"))
        if n >= sizes[0]:
            combos = level if combos is None else combos.unionByName(level)
    keyed = combos.select("doc", F.array_join(F.transform("set", lambda x: x["cand"]), "+").alias("variant"), F.flatten(F.transform("set", lambda x: x["words"])).alias("gone"))
    removed = keyed.join(texts, "doc").select("doc", "variant", F.filter("words", lambda w: ~F.array_contains("gone", w)).alias("words"))
    base = score(texts.select("doc", F.lit("").alias("variant"), "words")).select("doc", F.col("score").alias("baseline"))
    scored = score(removed).join(base, "doc").withColumn("drop", F.col("baseline") - F.col("score"))
    best = scored.groupBy("doc").agg(F.min(F.struct((-F.col("drop")).alias("d"), "variant")).alias("m"))
    found = best.join(keyed, (best.doc == keyed.doc) & (F.col("m.variant") == F.col("variant"))).select(best.doc, F.col("gone").alias("anchors"), (-F.col("m.d")).alias("drop"))
    return texts.join(base, "doc").join(found, "doc", "left").select("doc", F.coalesce("anchors", "words").alias("anchors"), "baseline", F.coalesce("drop", F.lit(0.0)).alias("drop"))


def enumerate_leaves(leaves: DataFrame, kept: DataFrame) -> DataFrame:
    """Numbers the leaves of parse trees: ``doc, sent, leaf, w, tag, idx, place, label``.

    leaves: ``doc, sent, leaf, w, tag`` of parsed sentences; kept: the tokens ``doc, w, tag`` that a document has
    after its own tokenising. ``idx`` counts the document's leaves from 0 across sentences, ``place`` those that
    are kept, -1 for others; ``label`` is ``place idx w``.
    """
    held = kept.select("doc", "w", "tag").distinct().withColumn("_held", F.lit(1))
    order = Window.partitionBy("doc").orderBy("sent", "leaf")
    rows = leaves.join(held, ["doc", "w", "tag"], "left").withColumn("idx", F.row_number().over(order) - 1)
    place = F.when(F.col("_held").isNull(), -1).otherwise(F.count("_held").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")
    return rows.withColumn("place", place).select("doc", "sent", "leaf", "w", "tag", "idx", "place", F.concat_ws(" ", "place", "idx", "w").alias("label"))
