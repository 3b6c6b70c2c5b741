"""Near-duplicates of word shingles by ProbMinHash, banding and exact verification.

A text's shingles are weighted by how often they occur. Each sends points of a Poisson process at the
rate of its weight to random registers; a register keeps the shingle of its first point, and a shingle
stops when its next point comes later than all registers' first ones. Two texts agree in a register with
the probability Jaccard similarity of their weights. Bands of registers put texts in buckets.

Copies are collapsed first. Buckets with the same members are looked at once. In a bucket links are
verified exactly along a search from its most shared text: only texts not yet linked are compared,
and by the triangle inequality only those that can be near. So a bucket of near copies costs about
its size, and gives links that connect what is linked, not all pairs. A bucket too large for a task is
dealt to parts that all hold its most shared texts; its texts outside the class that then has most of it
are compared with the other classes' texts in every part. That is each pair of texts of two classes, less
those that the triangle inequality rules out and those of classes that a task has joined; where a
large bucket stays in two large classes, it is the product of their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .store import Store

SHINGLE, NEAR = 5, 0.8
BANDS, ROWS = 30, 5
#: Members of a part of a bucket, texts that all parts hold, bytes of shingles of a task's group.
PART_MEMBERS, HUBS, GROUP_BYTES = 2048, 64, 16 << 20
#: Texts that a part is compared with at once, and texts whose distances rule out pairs.
ASKED, PIVOTS = 512, 8


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct shingle, by row; a text of fewer words is one shingle."""
    start, length, row = K.word_spans(data, offsets)
    h = K.span_hash(data, start, length)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    words = np.diff(first)
    number = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    at = np.repeat(first[:-1] - (np.cumsum(number) - number), number) + np.arange(int(number.sum()))
    owner = np.repeat(np.arange(n), number)
    value = np.zeros(len(at), np.uint64)
    for k in range(size):
        inside = at + k < first[owner + 1]
        value[inside] = K.mix(value[inside] * K.STARTS[0] + h[at[inside] + k])
    code, _ = pd.factorize(K.mix(owner.astype(np.uint64)) ^ value)
    sample = np.empty(int(code.max()) + 1 if len(code) else 0, np.int64)
    sample[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return owner[sample], value[sample], np.bincount(code, minlength=len(sample))


def uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def prob_min_hash(row: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """``n x registers`` signatures; rows without shingles stay 0."""
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, np.uint64)
    time = np.zeros(len(row))
    step = 0
    while len(row):
        step += 1
        seed = K.mix(value + np.uint64(step * int(K.STARTS[1]) % 2**64))
        time = time - np.log(uniform(seed)) / weight
        cell = row * registers + (K.mix(seed ^ K.STARTS[0]) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(time < first[cell])
        np.minimum.at(first, cell[early], time[early])
        won = early[time[early] == first[cell[early]]]
        kept[cell[won]] = value[won]
        last = first.reshape(n, registers).max(axis=1)
        on = time <= last[row]
        row, value, weight, time = row[on], value[on], weight[on], time[on]
    return kept.reshape(n, registers)


def probability_jaccard(a: np.ndarray, b: np.ndarray, rest_a: float, rest_b: float) -> float:
    """From the weights of common shingles and what either text has besides."""
    order = np.argsort(b / a, kind="stable")
    a, b = a[order].astype(float), b[order].astype(float)
    r = b / a
    # sum over j of max(a_j / a_i, b_j / b_i): b wins where its ratio is larger
    a_up_to, b_beyond = np.cumsum(a), b.sum() - np.cumsum(b)
    last = np.searchsorted(r, r, "right") - 1
    return float((1 / ((a_up_to[last] + rest_a) / a + (b_beyond[last] + rest_b) / b)).sum())


#: Bytes of a shingle's hash and of its weight in a blob. Of 40-bit hashes two texts of 500 words share one by
#: chance with probability 2e-7.
HASH_BYTES, WEIGHT_BYTES = 5, 4


class Texts:
    """Shingles of several texts side by side."""

    def __init__(self, blobs: list[bytes]):
        sizes = np.array([len(b) // (HASH_BYTES + WEIGHT_BYTES) for b in blobs], np.int64)
        self.size, self.begin = sizes, np.cumsum(sizes) - sizes
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, :HASH_BYTES] = np.concatenate([np.frombuffer(b, np.uint8, HASH_BYTES * n) for b, n in zip(blobs, sizes.tolist(), strict=True)]).reshape(-1, HASH_BYTES)
        self.value = wide.view(np.uint64).ravel()
        self.weight = np.concatenate([np.frombuffer(b, np.uint32, n, HASH_BYTES * n) for b, n in zip(blobs, sizes.tolist(), strict=True)]).astype(np.int64)
        self.owner = np.repeat(np.arange(len(blobs)), sizes)
        self.total = np.bincount(self.owner, weights=self.weight, minlength=len(blobs))

    def like(self, one: int, others: np.ndarray) -> np.ndarray:
        """Probability Jaccard similarity of a text to others."""
        at = slice(self.begin[one], self.begin[one] + self.size[one])
        mine, mass = self.value[at], self.weight[at]
        pick = np.repeat(self.begin[others] - (np.cumsum(self.size[others]) - self.size[others]), self.size[others]) + np.arange(int(self.size[others].sum()))
        owner = np.repeat(np.arange(len(others)), self.size[others])
        place = np.minimum(np.searchsorted(mine, self.value[pick]), len(mine) - 1)
        same = np.flatnonzero(mine[place] == self.value[pick])
        owner, a, b = owner[same], mass[place[same]], self.weight[pick[same]]
        common_a, common_b = (np.bincount(owner, weights=w, minlength=len(others)) for w in (a, b))
        # of equal weights: the common share; other texts are worked out one by one
        out = common_a / np.maximum(self.total[one] + self.total[others] - common_a, 1)
        ends = np.searchsorted(owner, np.arange(len(others) + 1))
        for i in np.unique(owner[a != b]).tolist():
            x = slice(ends[i], ends[i + 1])
            out[i] = probability_jaccard(a[x], b[x], self.total[one] - common_a[i], self.total[others[i]] - common_b[i])
        return out


def connect(texts: Texts, order: np.ndarray, near: float) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among the texts of ``order``.

    A search goes from each text not yet reached, in order; only unreached texts are compared.
    """
    links: list[tuple[int, int]] = []
    reach, slack = 1 - near, 1e-9
    left = order
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        d = 1 - texts.like(root, left)
        found = d <= reach + slack
        links += [(root, int(x)) for x in left[found]]
        queue = list(zip(left[found].tolist(), d[found].tolist(), strict=True))
        left, d = left[~found], d[~found]
        while queue and len(left):
            x, dx = queue.pop(0)
            can = np.flatnonzero(np.abs(d - dx) <= reach + slack)
            if not len(can):
                continue
            hit = can[1 - texts.like(x, left[can]) <= reach + slack]
            links += [(x, int(y)) for y in left[hit]]
            queue += list(zip(left[hit].tolist(), d[hit].tolist(), strict=True))
            stay = np.ones(len(left), bool)
            stay[hit] = False
            left, d = left[stay], d[stay]
    return links


def bridge(texts: Texts, role: np.ndarray, kind: np.ndarray, near: float) -> list[tuple[int, int]]:
    """Links between classes ``kind``: of texts of role 1 or -1 to texts of role 1 or 0, one for two classes.

    Classes that a link has joined are one from then on. Only pairs whose distances to one text of each of the
    largest classes differ by no more than a link's are compared.
    """
    links: list[tuple[int, int]] = []
    reach, slack = 1 - near, 1e-9
    _, kind = np.unique(kind, return_inverse=True)
    pivots = [int(np.argmax(kind == c)) for c in np.argsort(-np.bincount(kind), kind="stable")[:PIVOTS]]
    away = np.stack([1 - texts.like(p, np.arange(len(kind))) for p in pivots])
    members = np.flatnonzero(role >= 0)
    for s in np.flatnonzero(role).tolist():
        others = members[kind[members] != kind[s]]
        others = others[(np.abs(away[:, others] - away[:, [s]]) <= reach + slack).all(axis=0)]
        if not len(others):
            continue
        hit = others[1 - texts.like(s, others) <= reach + slack]
        found, at = np.unique(kind[hit], return_index=True)
        links += [(s, int(o)) for o in hit[at]]
        kind[np.isin(kind, found)] = kind[s]
    return links


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, a, b, bands``: a text's key and its band hashes, none for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.slices(offsets, 2 << 20):
                d, o = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                n = hi - lo
                full = np.flatnonzero(np.diff(o))
                key = np.zeros((2, n), np.uint64)
                for w in (0, 1):
                    key[w, full] = K.span_hash(d, o[:-1][full], np.diff(o)[full], w)
                row, value, weight = shingles(d, o)
                some = np.bincount(row, minlength=n) > 0
                signature = prob_min_hash(row, value, weight, n, BANDS * ROWS)
                band = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], n, axis=0)
                for k in range(ROWS):
                    band = K.mix(band * K.STARTS[0] + signature[:, k::ROWS])
                ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(band[some].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), bands], names=["doc", "a", "b", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    return rows.mapInArrow(run, "doc long, a long, b long, bands array<long>")


def gram_sets(texts: DataFrame) -> DataFrame:
    """``id, grams`` of ``id, text``: sorted shingle hashes, then their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.slices(offsets, 2 << 20):
                row, value, weight = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                value &= np.uint64((1 << 8 * HASH_BYTES) - 1)
                order = np.lexsort((value, row))
                row, value, weight = row[order], value[order], weight[order]
                ends = np.searchsorted(row, np.arange(hi - lo + 1)).tolist()
                raw, mass = np.ascontiguousarray(value.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes(), weight.astype(np.uint32).tobytes()
                grams = [raw[HASH_BYTES * x : HASH_BYTES * y] + mass[WEIGHT_BYTES * x : WEIGHT_BYTES * y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(grams, pa.binary())], names=["id", "grams"])

    return texts.mapInArrow(run, "id long, grams binary")


def verify(rows: DataFrame, near: float) -> DataFrame:
    """Links ``a, b`` within each part of a bucket; rows ``task, bucket, part, id, share, role, class, grams``.

    role 0: a member; -1: a text that the members of other classes are compared with; 1: both. Where all are
    members, all are compared.
    """

    def run(table: pa.Table) -> pa.Table:
        frame = table.select(["bucket", "part", "share", "id", "role", "class"]).to_pandas()
        blobs = table.column("grams")
        frame["at"] = np.arange(len(frame))
        frame = frame.sort_values(["bucket", "part", "share", "id"], ascending=[True, True, False, True])
        out_a, out_b = [], []
        for _, g in frame.groupby(["bucket", "part"], sort=False):
            if len(g) < 2:
                continue
            texts, ids, role = Texts([blobs[i].as_py() for i in g["at"]]), g["id"].to_numpy(), g["role"].to_numpy()
            for x, y in bridge(texts, role, g["class"].to_numpy(), near) if role.any() else connect(texts, np.arange(len(g)), near):
                out_a.append(ids[x])
                out_b.append(ids[y])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return rows.groupBy("task").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: float = NEAR) -> DataFrame:
    """The class of each document: texts that are linked, directly or along others, share one.

    Returns ``id_col, text_id, class_id``: ``text_id`` is the smallest id of the same text, ``class_id`` the
    smallest id of the class. Two texts are linked if the probability Jaccard similarity of their weighted
    five-word shingles is ``near`` or more. Null and empty texts are one text, alike to no other; a text of
    fewer words than a shingle is alike to equal word sequences only. An id that comes with several texts has a
    row for each, and they are compared as one of them; rows without an id are left out. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "near")
    sketches = store.put(sketch(docs, id_col, text_col), "sketches")
    members = sketches.select("doc", "a", "b").distinct()
    reps = members.groupBy("a", "b").agg(F.min("doc").alias("id"))
    # one row of each text: ids of repeated rows may come with several texts
    one = sketches.join(reps.hint("merge"), ["a", "b"]).where("doc = id").dropDuplicates(["a", "b"]).where(F.size("bands") > 0)
    texts = one.select("id", "bands")

    bucketed = store.put(texts.select("id", F.explode("bands").alias("bucket")), "buckets")
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "id")).alias("y")).where("n > 1")
    distinct = sizes.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    shared = store.put(bucketed.join(distinct.select("bucket", "n").hint("merge"), "bucket"), "shared")
    share = store.put(shared.groupBy("id").agg(F.sum("n").alias("share")), "share")
    # only texts that share a bucket are read again; ids that came with several texts stand for their smallest
    again = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(share.select("id").hint("merge"), "id", "left_semi")
    grams = store.put(gram_sets(again).groupBy("id").agg(F.min("grams").alias("grams")).where(F.length("grams") > 0), "grams", "lz4")
    ranked = shared.join(share.hint("merge"), "id").join(grams.hint("merge"), "id")

    # parts of large buckets all hold their most shared texts
    large = shared.where(F.col("n") > PART_MEMBERS)
    hubs = large.join(share, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    for keys in (["bucket", "salt"], ["bucket"]):  # the best of each sixty-fourth, then the best of these
        hubs = hubs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("share"), "id"))).where(F.col("place") <= HUBS)
    parts = F.ceil(F.col("n") / PART_MEMBERS).cast("int")
    marked = ranked.join(hubs.select("bucket", "id", F.lit(True).alias("hub")), ["bucket", "id"], "left")
    everywhere = F.when(F.col("hub"), F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int")))
    dealt = marked.withColumn("part", F.explode(everywhere))

    columns = ["bucket", "part", "id", "share", "role", "class", "grams"]
    volume = dealt.agg(F.sum(F.length("grams")).alias("bytes"), F.count("*").alias("rows")).first()

    def by_task(df: DataFrame, size: float) -> DataFrame:
        return df.select(F.pmod(F.xxhash64("bucket", "part"), F.lit(max(1, int(-(-size // GROUP_BYTES))))).alias("task"), *columns)

    links = store.put(verify(by_task(dealt.withColumns({"role": F.lit(0), "class": F.col("id")}), volume.bytes or 0), near), "links")
    if large.limit(1).count():
        # of two texts of different classes one at least is outside the bucket's largest class: it is compared with every part
        classes = connected_components(links, store, "hubs")
        placed = store.put(large.join(classes, "id", "left").select("bucket", "id", "n", F.coalesce("class", "id").alias("class")), "placed")
        held = placed.groupBy("bucket", "class").agg(F.count("*").alias("held"))
        main = held.groupBy("bucket").agg(F.max(F.struct("held", "class")).alias("main"), F.sum("held").alias("n"))
        main = store.put(main.select("bucket", F.col("main.class").alias("main"), (F.col("n") - F.col("main.held")).alias("others"), "n").where("others > 0"), "main")
        blocks = F.ceil(F.col("others") / ASKED).cast("int")
        rows = main.agg(F.sum(F.col("others") * parts + F.col("n") * blocks)).first()[0]
        if rows:
            block, own = F.pmod(F.xxhash64("id", F.lit(7)), blocks).cast("int"), F.pmod(F.xxhash64("id", F.lit(5)), parts).cast("int")
            within = placed.join(main.drop("n"), "bucket").withColumns({"asked": F.col("class") != F.col("main"), "own_block": block, "own": own})
            asked = within.where("asked").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"block": F.col("own_block"), "role": F.when(F.col("part") == F.col("own"), 1).otherwise(-1)})
            against = within.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).where("NOT asked OR block <> own_block").withColumns({"part": F.col("own"), "role": F.lit(0)})
            both = asked.unionByName(against).select("bucket", F.xxhash64("part", "block").alias("part"), "id", "role", "class")
            both = both.join(share.hint("merge"), "id").join(grams.hint("merge"), "id")
            links = store.put(links.unionByName(verify(by_task(both, rows * volume.bytes / volume.rows), near)), "all_links")
    classes = connected_components(links, store, "classes")

    # a class is named by its smallest text id already
    named = store.put(reps.join(classes.hint("merge"), "id", "left").select("a", "b", F.col("id").alias("text_id"), F.coalesce("class", "id").alias("class_id")), "named")
    return members.join(named.hint("merge"), ["a", "b"]).select(F.col("doc").alias(id_col), "text_id", "class_id")
