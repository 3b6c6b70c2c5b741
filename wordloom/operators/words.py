"""Words of whole texts by array operations: a slice of texts at a time, so no row is made for a word.

A word is a run of ASCII letters of the lower-case text, as ``tokens`` takes it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Bytes of text that are split at a time, words that meet in a task, and rows of what a task hands on.
SLICE, MEET, HAND = 1 << 22, 1_000_000, 1 << 18
#: What stands for the next word after a text's last word, and for its first word by itself; no word has these numbers.
LAST, FIRST = np.uint64(0), np.uint64((1 << 63) - 1)
#: Stands for an id that is null.
NO_ID = -(1 << 63)


def lowered(texts: DataFrame, id_col: str | None, text_col: str) -> DataFrame:
    ids = [F.col(id_col).alias("doc")] if id_col else []
    return texts.select(*ids, F.coalesce(F.lower(F.col(text_col)), F.lit("")).alias("t"))


def text_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0, and bytes."""
    wide = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    _, at, data = a.buffers()
    offsets = np.frombuffer(at, wide)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Of lower-case texts: each word's row and its place among the different words, and those."""
    offsets, raw = text_bytes(texts)
    letter = raw - np.uint8(97) < 26
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    held = np.diff(offsets) > 0  # texts lie side by side: their ends part words too
    for mark, at in ((first, offsets[:-1][held]), (last, offsets[1:][held] - 1)):
        mark[at] = letter[at]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, offsets)))
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(ends), pa.py_buffer(raw[letter])).dictionary_encode()
    return row, words.dictionary, words.indices.to_numpy()


def slices(batches):
    """The batches in runs of rows of ``SLICE`` bytes of text, or of one text."""
    for b in batches:
        offsets, _ = text_bytes(b.column("t"))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE, side="right")) - 1)
            yield b.slice(start, end - start)
            start = end


def _strings(words: pa.Array) -> pa.Array:
    return words.cast(pa.string())


def counts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, w, n``: a row for each different word of each row of texts."""

    def work(batches):
        for b in slices(batches):
            row, words, which = split(b.column("t"))
            key, n = np.unique(row * max(len(words), 1) + which, return_counts=True)
            row, which = np.divmod(key, max(len(words), 1))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), _strings(words.take(pa.array(which))), pa.array(n, pa.int64())], ["doc", "w", "n"])

    return lowered(texts, id_col, text_col).mapInArrow(work, f"doc {dict(texts.dtypes)[id_col]}, w string, n long")


def totals(texts: DataFrame, text_col: str) -> DataFrame:
    """``w, c``: how often each word occurs."""

    def work(batches):
        for b in slices(batches):
            _, words, which = split(b.column("t"))
            yield pa.RecordBatch.from_arrays([_strings(words), pa.array(np.bincount(which, minlength=len(words)), pa.int64())], ["w", "c"])

    return lowered(texts, None, text_col).mapInArrow(work, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


def key_sums(texts: DataFrame, id_col: str, text_col: str, keys) -> DataFrame:
    """``doc, kind, key, n``: how many words of each row of texts have a key.

    keys: from an Arrow array of different words to their rows in it, kinds and keys; a word counts once for each of its keys.
    """

    def work(batches):
        for b in slices(batches):
            row, words, which = split(b.column("t"))
            of, kind, key = keys(_strings(words))
            kind, key = kind.dictionary_encode(), key.dictionary_encode()
            kinds, names = kind.dictionary, key.dictionary
            size = max(len(kinds) * len(names), 1)
            own = np.unique(of.astype(np.int64) * size + kind.indices.to_numpy().astype(np.int64) * len(names) + key.indices.to_numpy())
            of, code = np.divmod(own, size)
            many = np.bincount(of, minlength=len(words))
            times = many[which]  # a word's keys lie side by side
            at = np.repeat((np.cumsum(many) - many)[which] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            cell, n = np.unique(np.repeat(row, times) * size + code[at], return_counts=True)
            row, code = np.divmod(cell, size)
            kind, key = np.divmod(code, max(len(names), 1))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row)), kinds.take(pa.array(kind)), names.take(pa.array(key)), pa.array(n, pa.int64())], ["doc", "kind", "key", "n"])

    return lowered(texts, id_col, text_col).mapInArrow(work, f"doc {dict(texts.dtypes)[id_col]}, kind string, key string, n long")


def numbers(words: pa.Array) -> np.ndarray:
    """A number for each word: its letters, five bits each, or over 12 letters 63 bits of a hash below a bit that is set."""
    offsets, raw = text_bytes(words)
    begin, size = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(words), np.uint64)
    for i in range(12):
        at = np.flatnonzero(size > i)
        out[at] |= (raw[begin[at] + i] - np.uint8(96)).astype(np.uint64) << np.uint64(5 * i)
    for k in np.flatnonzero(size > 12):
        out[k] = int.from_bytes(hashlib.blake2b(raw[offsets[k] : offsets[k + 1]].tobytes(), digest_size=8).digest(), "little") | 1 << 63
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _dealt(bucket: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket that is met, with its entries of the columns as bytes."""
    order = np.argsort(bucket.astype(np.uint16 if parts <= 1 << 16 else np.uint32), kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(parts + 1))
    met = np.flatnonzero(np.diff(ends))
    at = np.append(ends[met], ends[-1]).astype(np.int64)
    packed = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(met), [None, pa.py_buffer(at * c.itemsize), pa.py_buffer(c[order])]).cast(pa.binary()) for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *packed], ["bucket", *columns])


def _joined(batches, columns: dict[str, type]) -> dict[str, np.ndarray]:
    held = {c: [] for c in columns}
    for b in batches:
        for c in columns:
            held[c].append(text_bytes(b.column(c))[1].tobytes())
    return {c: np.frombuffer(b"".join(held.pop(c)), kind) for c, kind in columns.items()}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


PAIR = {"doc": np.int64, "b": np.uint64, "w": np.uint64, "n": np.int32}
SIZED = {"doc": np.int64, "n": np.int32, "c2": np.int64, "c": np.int64}
SUMS = {"doc": np.int64, "n": np.int64, "uni": np.float64, "bi": np.float64, "inverse": np.float64}


def _schema(columns: dict[str, type]) -> str:
    return ", ".join(f"{c} binary" for c in columns)


def two_in_a_row(t: pa.RecordBatch) -> dict[str, np.ndarray]:
    """``doc, b, w, n``: each text's pairs of a word and the next with their numbers; ``LAST`` and ``FIRST`` once a text."""
    row, words, which = split(t.column("t"))
    number, size, docs = numbers(words), max(len(words), 1), t.column("doc").to_numpy()
    new = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(new[1:], len(row))[: len(new)] - 1
    same = np.ones(len(row), bool)
    same[ends] = False
    i = np.flatnonzero(same)
    pair = which[i].astype(np.int64) * size + which[i + 1] if len(i) else np.zeros(0, np.int64)
    if size * size * max(t.num_rows, 1) < 1 << 62:
        key, n = np.unique(row[i] * (size * size) + pair, return_counts=True)
        r, pair = np.divmod(key, size * size)
    else:
        kinds, at = np.unique(pair, return_inverse=True)
        key, n = np.unique(row[i] * max(len(kinds), 1) + at, return_counts=True)
        r, at = np.divmod(key, max(len(kinds), 1))
        pair = kinds[at]
    b, w = np.divmod(pair, size)
    one = lambda at, mark, n: (docs[row[at]], number[which[at]], np.full(len(at), mark), np.full(len(at), n))
    parts = ((docs[r], number[b], number[w], n), one(ends, LAST, 1), one(new, FIRST, 0))
    return {c: np.concatenate([p[k] for p in parts]).astype(kind) for k, (c, kind) in enumerate(PAIR.items())}


def own_sums(texts: DataFrame, id_col: str, text_col: str, of: tuple[str, ...]) -> DataFrame:
    """``doc, n`` and those of ``uni, bi, inverse`` that are asked for: a text's words, and over them the sums of log10 of
    their add-one probabilities by one word and by two, and of 1 over the latter; counts are those of the same texts.

    Pairs of a word and the next meet by the first, packed, so its number is known where theirs are. Frequent words would
    fill a task: their numbers are taken before, and their pairs are dealt by both words.
    """
    spark, sums = texts.sparkSession, {x: SUMS[x] for x in ("doc", "n", *of)}
    if dict(texts.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"{id_col} must be a whole number")
    c = cut(totals(texts, text_col))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (c.agg(F.sum("c")).first()[0] or 0) // MEET + 1)
    often = c.crossJoin(F.broadcast(c.agg((F.sum("c") / (4 * parts)).alias("most")))).where("c > most").select("w", "c").collect()
    hot = numbers(pa.array([r["w"] for r in often], pa.large_string()))
    order = np.argsort(hot)
    hot, hot_c = hot[order], np.array([r["c"] for r in often], np.int64)[order]

    def is_hot(b):
        at = np.minimum(np.searchsorted(hot, b), max(len(hot) - 1, 0))
        return (hot[at] == b, at) if len(hot) else (np.zeros(len(b), bool), at)

    def deal(batches):
        for t in slices(batches):
            p = two_in_a_row(t)
            key = p["b"] + np.where(is_hot(p["b"])[0], _mixed(p["w"]), np.uint64(0))
            yield _dealt(_mixed(key) % np.uint64(parts), parts, p)

    def meet(batches):
        p = _joined(batches, PAIR)
        order = np.lexsort((p["w"], p["b"]))
        doc, b, w, n = (p.pop(x)[order] for x in PAIR)
        if not len(b):
            return
        first, both = _starts(b), _starts(b, w)
        held, at = is_hot(b[first])
        count = np.add.reduceat(n, first, dtype=np.int64)
        count[held] = hot_c[at[held]]
        c2 = np.add.reduceat(n, both, dtype=np.int64)
        c2[w[both] == LAST], c2[w[both] == FIRST] = -1, 0
        out = (doc, n, np.repeat(c2, np.diff(both, append=len(b))), np.repeat(count, np.diff(first, append=len(b))))
        known = [int((c2 > 0).sum()), int((~held).sum()), int(n.sum())]
        for i in range(0, len(b), HAND):
            packed = [pa.array([pa.compress(x[i : i + HAND].astype(kind).tobytes(), codec="zstd", asbytes=True)], pa.binary()) for x, kind in zip(out, SIZED.values(), strict=True)]
            rest = [min(HAND, len(b) - i), *(known if i == 0 else (0, 0, 0))]
            yield pa.RecordBatch.from_arrays([*packed, *(pa.array([x], pa.int64()) for x in rest)], [*SIZED, "size", "pairs", "kinds", "total"])

    t = lowered(texts.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))), id_col, text_col)
    dealt = t.mapInArrow(deal, f"bucket int, {_schema(PAIR)}").repartitionById(parts, "bucket")
    sized = cut(dealt.mapInArrow(meet, f"{_schema(SIZED)}, size long, pairs long, kinds long, total long"))
    pairs, kinds, total = (x or 0 for x in sized.agg(F.sum("pairs"), F.sum("kinds"), F.sum("total")).first())
    every = total + kinds + len(hot)

    def add(doc, columns):
        docs, at = np.unique(doc, return_inverse=True)
        return {"doc": docs} | {x: np.bincount(at, v, len(docs)).astype(SUMS[x]) for x, v in columns.items()}

    def weigh(batches):
        held = [r for batch in batches for r in batch.to_pylist()]
        if not held:
            return
        doc, n, c2, c = (np.concatenate([np.frombuffer(pa.decompress(r[x], r["size"] * np.dtype(kind).itemsize, "zstd"), kind) for r in held]) for x, kind in SIZED.items())
        word, two, one = c2 != 0, c2 > 0, (c + 1) / every
        p = np.where(two, (c2 + 1) / (c + max(pairs, 1)), one)
        times = np.where(two, n, c2 == 0)  # pairs and first words have a probability by two
        weights = {"n": lambda: np.where(word, n, 0), "uni": lambda: np.where(word, n * np.log10(one), 0.0), "bi": lambda: times * np.log10(p), "inverse": lambda: times / p}
        s = add(doc, {x: weights[x]() for x in list(sums)[1:]})
        yield _dealt(_mixed(s["doc"].view(np.uint64)) % np.uint64(parts), parts, s)

    def sum_up(batches):
        s = _joined(batches, sums)
        s = add(s.pop("doc"), s)
        doc = pa.array(s["doc"], pa.int64(), mask=s["doc"] == NO_ID)
        for i in range(0, len(doc), HAND):
            yield pa.RecordBatch.from_arrays([doc[i : i + HAND], *(pa.array(s[x][i : i + HAND]) for x in list(sums)[1:])], list(sums))

    weighed = sized.select(*SIZED, "size").mapInArrow(weigh, f"bucket int, {_schema(sums)}").repartitionById(parts, "bucket")
    return weighed.mapInArrow(sum_up, ", ".join(["doc long, n long", *(f"{x} double" for x in of)])).withColumn("doc", F.col("doc").cast(dict(texts.dtypes)[id_col]))
