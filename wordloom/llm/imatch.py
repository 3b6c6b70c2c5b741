"""I-Match fingerprints over randomised lexicon subsets, with DataFrame functions only.

The lexicon keeps the terms whose inverse document frequency lies in a band. A document's terms in
it, distinct and sorted, are hashed once for each of several random subsets of the lexicon; small
subsets survive edits of large parts of a text, large ones tell close texts apart. Two fingerprints
are as alike as their shares of equal slots among those that either text fills.

Near copies that hold a large share of all documents would push their own terms out of the band; so
a term's documents of equal ``sketch`` count once at its upper end.

The lexicon's size does not grow with the corpus: the shares of documents of its terms sum to at most
a document's mean number of distinct terms, so it has at most that mean / ``min_share`` terms. It is
counted, and beyond ``broadcast_terms`` the lookup is a sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store

#: A term is in a subset with probability 2 ** -power; eight subsets of each power, without common terms.
EACH = 8
SIZES = (3, 4, 5, 6, 7, 8)
POWERS = tuple(p for p in SIZES for _ in range(EACH))


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def draw(term: Column, size: int) -> Column:
    """A number below ``2 ** SIZES[size]`` from eight bits of the term's hash of its own; below ``EACH`` it is a subset's."""
    return F.shiftrightunsigned(term, 8 * size).bitwiseAND((1 << SIZES[size]) - 1)


def subsets(term: Column) -> Column:
    """The numbers of the subsets that hold a term."""
    held = [F.when(draw(term, k) < EACH, draw(term, k) + EACH * k) for k in range(len(SIZES))]
    return F.filter(F.array(*held), lambda j: j.isNotNull())


def sketch(text: Column) -> Column:
    """The smallest hash of three words in a row: most near copies share one of few, unrelated texts none."""

    def smallest(word: Column) -> Column:
        tail = lambda k: F.slice(word, F.lit(k), F.greatest(F.size(word), F.lit(1)))
        two = F.zip_with(word, tail(2), lambda a, b: F.xxhash64(a, b))
        return F.array_min(F.zip_with(two, tail(3), lambda a, b: F.xxhash64(a, b)))

    # an array of one array, so that a text is split once
    once = F.array(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w)))
    return F.transform(once, smallest)[0]


def lexicon(texts: DataFrame, store: Store, min_share: float = 1 / 2000, max_share: float = 1 / 10, text_col: str = "text", broadcast_terms: int = 1_000_000) -> DataFrame:
    """``term long``: hashes of the terms in the band.

    A term needs ``min_share`` of all documents (and two at least) and ``max_share`` at most (where
    that is under two documents: two). Beyond ``max_share`` documents are counted by their distinct
    sketches (to 5 %), so copies and most near copies count once.
    """
    total = texts.count()
    low, high = max(2, int(min_share * total)), max(2, int(max_share * total))
    counts = texts.select(F.explode(terms(F.col(text_col))).alias("w")).groupBy(F.xxhash64("w").alias("term")).agg(F.count("*").alias("n"))
    counts = store.put(counts.where(F.col("n") >= low), "counts")
    often = counts.where(F.col("n") > high).select("term")
    # at most a document's mean number of distinct terms / max_share
    side = often.hint("broadcast" if often.count() <= broadcast_terms else "merge")
    # in a projection of its own the sketch is worked out once a text, not once a term
    held = texts.select(sketch(F.col(text_col)).alias("sketch"), terms(F.col(text_col)).alias("words"))
    held = held.select("sketch", F.explode("words").alias("w")).select(F.xxhash64("w").alias("term"), "sketch")
    copied = held.join(side, "term").groupBy("term").agg(F.approx_count_distinct("sketch").alias("n")).where(F.col("n") <= high).select("term")
    inside = counts.where(F.col("n") <= high).select("term").unionByName(copied)
    return inside


def slots(rows: DataFrame, keys: list[str], words: DataFrame, small: bool, texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """``keys`` and for each column of ``texts`` its slots, ``<column>_slots array<long>``, for rows with a lexicon term in any of them.

    An unfilled slot is null, and so is the array of a text without a lexicon term. Rows that are dealt by
    ``keys`` already are not shuffled while the lexicon is small.
    """
    each = rows.select(*keys, F.posexplode(F.array(*(terms(F.col(t)) for t in texts))).alias("side", "words"))
    long = each.select(*keys, "side", F.explode("words").alias("w")).select(*keys, "side", F.xxhash64("w").alias("term"))
    found = long.join(words.hint("broadcast" if small else "merge"), "term")
    sets = found.groupBy(*keys).agg(*(F.sort_array(F.collect_set(F.when(F.col("side") == i, F.col("term")))).alias(t) for i, t in enumerate(texts)))

    def of_size(held: Column, k: int) -> Column:
        def slot(some: Column, j: Column) -> Column:
            held = F.filter(some, lambda t: draw(t, k) == j)
            return F.when(F.size(held) > 0, F.xxhash64(held).bitwiseAND(0xFFFFFFFF))

        # terms of any subset of the size first, once
        some = F.array(F.filter(held, lambda t: draw(t, k) < EACH))
        return F.flatten(F.transform(some, lambda ts: F.transform(F.sequence(F.lit(0), F.lit(EACH - 1)), lambda j: slot(ts, j))))

    def of_all(held: Column) -> Column:
        return F.when(F.size(held) > 0, F.concat(*(of_size(held, k) for k in range(len(SIZES)))))

    return sets.select(*keys, *(of_all(F.col(t)).alias(f"{t}_slots") for t in texts))


def spelled(slots_col: Column, key_a: Column) -> Column:
    """The fingerprint as text: eight hexadecimal digits a slot; a text with no filled slot is spelled by its hash."""
    text = F.array_join(F.transform(slots_col, lambda s: F.when(s.isNull(), F.lit("-")).otherwise(F.lpad(F.lower(F.hex(s)), 8, "0"))), ".")
    filled = F.exists(slots_col, lambda s: s.isNotNull())
    return F.when(filled, text).otherwise(F.concat(F.lit("="), F.lpad(F.lower(F.hex(key_a)), 16, "0")))


def likeness(one: Column, two: Column) -> Column:
    """Of the subset sizes, the largest share of equal slots among those filled in either (of half a size's at least).

    Equal fingerprints are alike by 1; other fingerprints without slots are alike to none.
    """
    a, b = F.split(one, r"\."), F.split(two, r"\.")
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))

    def share(first: Column) -> Column:
        group = F.filter(F.slice(pairs, first, F.lit(EACH)), lambda p: ~((p["a"] == "-") & (p["b"] == "-")))
        return F.size(F.filter(group, lambda p: p["a"] == p["b"])) / F.greatest(F.size(group), F.lit(EACH // 2))

    best = F.array_max(F.transform(F.sequence(F.lit(1), F.lit(len(POWERS)), F.lit(EACH)), share))
    return F.when(one == two, F.lit(1.0)).when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(best).cast("double")


def followers(ids: DataFrame, store: Store) -> DataFrame:
    """``doc, next``: each id's next in descending order, the first after the last.

    Ids are dealt by range; a window runs within each range, and the ranges' ends (a row for each
    50,000 ids) are joined to it.
    """
    total = ids.count()
    ranged = ids.repartitionByRange(max(1, -(-total // 50_000)), F.desc("doc")).withColumn("part", F.spark_partition_id())
    ranged = store.put(ranged, "ranged")
    ends = ranged.groupBy("part").agg(F.max("doc").alias("top"))
    after = ends.select("part", F.coalesce(F.lead("top").over(Window.orderBy("part")), F.max("top").over(Window.partitionBy())).alias("after"))
    inside = ranged.withColumn("next", F.lead("doc").over(Window.partitionBy("part").orderBy(F.desc("doc"))))
    return inside.join(after, "part").select("doc", F.coalesce("next", "after").alias("next"))


def imatch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 1 / 2000, max_share: float = 1 / 10, broadcast_terms: int = 1_000_000) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half gives way to the next document's first.

    Returns ``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    Null texts are empty. Rows equal in id and text give one row; of rows that share an id, the next
    document is the one with the smallest text. Rows without an id are left out. One document alone is
    its own next. An empty table gives no rows; other columns are ignored.
    """
    store = Store(docs.sparkSession, "imatch")
    rows = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("doc IS NOT NULL")
    sizes = store.put(rows.select("doc", F.length("text").cast("long").alias("n_chars"), text_key(F.col("text")).alias("key")).distinct(), "sizes")
    pairs = store.put(followers(sizes.select("doc").distinct(), store), "pairs")
    words = store.put(lexicon(rows, store, min_share, max_share, "text", broadcast_terms), "lexicon")
    small = words.count() <= broadcast_terms

    # of the next document only as many code points are moved as some row before it takes
    half = F.floor(F.col("n_chars") / 2).cast("int")
    need = sizes.join(pairs, "doc").groupBy("doc", "next").agg(F.max(half).alias("need"))
    lead = rows.join(need.select(F.col("doc").alias("before"), F.col("next").alias("doc"), "need"), "doc")
    lead = lead.select(F.col("before").alias("doc"), F.substring("text", F.lit(1), F.col("need")).alias("lead")).groupBy("doc").agg(F.min("lead").alias("lead"))
    size = F.length("text")
    cut = F.floor(size / 2).cast("int")
    # rows are dealt by id from here on: both texts' terms are looked up and gathered where they are
    edited = rows.join(lead, "doc").select("doc", text_key(F.col("text")).alias("key"), "text", F.concat(F.substring("text", F.lit(1), size - cut), F.substring("lead", F.lit(1), cut)).alias("edited"))
    base = edited.select("doc", "key", F.length("text").cast("long").alias("n_chars"), F.xxhash64("edited").alias("edited_key"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")).distinct()
    both = base.join(slots(edited, ["doc", "key"], words, small, ("text", "edited")), ["doc", "key"], "left")
    prints = both.select("doc", "key", "n_chars", "edited_sha256", spelled(F.col("text_slots"), F.col("key.a")).alias("fingerprint"), spelled(F.col("edited_slots"), F.col("edited_key")).alias("edited_fingerprint"))
    prints = store.put(prints, "prints")
    following = prints.groupBy("doc").agg(F.min("fingerprint").alias("next_fingerprint")).withColumnRenamed("doc", "next")
    done = prints.join(pairs, "doc").join(following, "next")
    return done.select(
        F.col("doc").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
