"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference-count tables.

Three tables hold the index. ``entries`` has a row for each document and key, so a deletion can be
undone to the state before the insertion. ``refs`` has a row for each key: in how many documents it
is, and the largest id among them. ``shards`` has a row for each shard: a cuckoo filter of the keys
that are in at least ``min_docs`` documents, and those keys' exact keepers beside it. A line is first
looked up in its shard's filter, and only a hit is looked up in the exact table.

A change of documents changes the filters of the shards that it touches, by insertions and deletions of the
keys whose counts cross the threshold; undoing it restores what the filters answer.

No step gathers a key's rows: counts are summed in each task before they are shuffled, and lookups
go to a shard's row by salted groups of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Store

#: Lines of one lookup group, and keys of one shard.
GROUP_LINES, SHARD_KEYS = 1 << 18, 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key is in one of two buckets. Deletes what was inserted."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int, table: np.ndarray | None = None):
        buckets = 1 << max(1, math.ceil(math.log2(max(2, capacity) / 0.84 / self.SLOTS)))
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        print_ = (keys >> np.uint64(48)).astype(np.uint64) % np.uint64(65535) + np.uint64(1)
        first = keys & mask
        return print_.astype(np.uint16), first.astype(np.int64), ((first ^ K.mix(print_)) & mask).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return (self.table[a] == p[:, None]).any(axis=1) | (self.table[b] == p[:, None]).any(axis=1)

    def _fill(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts prints into free slots of the buckets ``at``; numbers of those that found none."""
        order = np.argsort(at, kind="stable")
        bucket = at[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
        turn = np.arange(len(bucket)) - np.repeat(first, np.diff(first, append=len(bucket)))
        taken = self.table[bucket] != 0
        fits = turn < self.SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken[fits], axis=1, kind="stable")[np.arange(int(fits.sum())), turn[fits]]
        self.table[bucket[fits], slot] = prints[order[fits]]
        return order[~fits]

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no room; the caller then builds a larger filter from the exact table."""
        table, mask = self.table, len(self.table) - 1
        prints, one, two = self._places(keys)
        left = self._fill(prints, one)
        left = left[self._fill(prints[left], two[left])]
        # only keys that found both buckets full move others on
        for kick, i in enumerate(left.tolist()):
            p, at = int(prints[i]), int(one[i])
            for n in range(self.KICKS):
                free = np.flatnonzero(table[at] == 0)
                if len(free):
                    table[at, free[0]] = p
                    break
                slot = (n + kick) % self.SLOTS
                p, table[at, slot] = int(table[at, slot]), p
                at = int((np.uint64(at) ^ K.mix(np.array([p], np.uint64))[0]) & np.uint64(mask))
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for place in (a, b):
                held = np.flatnonzero(self.table[place] == p)
                if len(held):
                    self.table[place, held[0]] = 0
                    break
            else:
                raise KeyError("the filter does not hold this key")

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(16, len(keys))
        while not (made := cls(size)).insert(keys):
            size *= 2
        return made


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """Row, start and end of every line, whether its key is long enough, and the key's two hashes (0 if not).

    A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z in lower case.
    """
    feeds = np.flatnonzero(data == 0x0A)
    n = len(offsets) - 1
    owner = np.concatenate((np.arange(n), np.searchsorted(offsets, feeds, "right") - 1))
    start = np.concatenate((offsets[:-1], feeds + 1))
    order = np.lexsort((start, owner))
    start, row = start[order], owner[order]
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end = np.where(last, offsets[row + 1], np.append(start[1:], 0) - 1)
    blank = K.IS_SPACE[data]
    solid = np.flatnonzero(~blank)
    if len(solid):
        a = np.searchsorted(solid, start)
        b = np.searchsorted(solid, end) - 1
        full = a <= b
        lo = np.where(full, solid[np.minimum(a, len(solid) - 1)], start)
        hi = np.where(full, solid[np.maximum(b, 0)] + 1, start)
    else:
        lo = hi = start
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    fits = points[hi] - points[lo] >= min_chars
    one, two = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    lowered = _LOWER[data]
    s, length = lo[fits], (hi - lo)[fits]
    one[fits], two[fits] = K.span_hash(lowered, s, length, 0), K.span_hash(lowered, s, length, 1)
    return row, start, end, fits, one, two


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def document_keys(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, one, two``: each document's distinct keys of at least ``min_chars`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.slices(offsets, 4 << 20):
                row, _, _, fits, one, two = line_keys(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], min_chars)
                row, one, two = row[fits], one[fits], two[fits]
                order = np.lexsort((two, one, row))
                row, one, two = row[order], one[order], two[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).take(pa.array(row[new])), signed(one[new]), signed(two[new])], names=["doc", "one", "two"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    return rows.mapInArrow(run, "doc long, one long, two long").distinct()


def references(entries: DataFrame) -> DataFrame:
    return entries.groupBy("one", "two").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))


def build_shard(table: pa.Table) -> pa.Table:
    """A shard's row from its repeated keys."""
    one, two, keeper = (table.column(c).to_numpy() for c in ("one", "two", "keeper"))
    order = np.lexsort((two, one))
    return shard_row(int(table.column("shard")[0].as_py()), CuckooFilter.of(one.view(np.uint64)), one[order], two[order], keeper[order])


def shard_row(shard: int, held: CuckooFilter, one: np.ndarray, two: np.ndarray, keeper: np.ndarray) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([held.table.tobytes()], pa.binary()), "keys": pa.array([one.tobytes() + two.tobytes()], pa.binary()), "keepers": pa.array([keeper.tobytes()], pa.binary())})


SHARD = "shard int, filter binary, keys binary, keepers binary"


def read_shard(shard: pa.Table) -> tuple[CuckooFilter, np.ndarray, np.ndarray]:
    """The filter, the two rows of key hashes, and the keepers of a shard's row."""
    table = np.frombuffer(shard.column("filter")[0].as_py(), np.uint16).reshape(-1, CuckooFilter.SLOTS)
    return CuckooFilter(0, table), np.frombuffer(shard.column("keys")[0].as_py(), np.int64).reshape(2, -1), np.frombuffer(shard.column("keepers")[0].as_py(), np.int64)


def change_shard(shards: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's row after keys have come (``now``), gone, or changed keepers: its filter is changed in place."""
    if not changes.num_rows:
        return shards
    number = int(changes.column("shard")[0].as_py())
    if shards.num_rows:
        held, keys, keepers = read_shard(shards)
        held = CuckooFilter(0, held.table.copy())
    else:
        held, keys, keepers = CuckooFilter(16), np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    one, two, keeper = (changes.column(c).to_numpy() for c in ("one", "two", "keeper"))
    now = changes.column("now").to_numpy(zero_copy_only=False)
    every = np.concatenate((keys, np.stack((one, two))), axis=1)
    _, code = np.unique(np.ascontiguousarray(every.T).view(np.dtype((np.void, 16))).ravel(), return_inverse=True)
    old, new = code[: keys.shape[1]], code[keys.shape[1] :]
    had = np.isin(new, old)
    held.delete(one[had & ~now].view(np.uint64))
    stay = ~np.isin(old, new)
    one, two, keeper = (np.concatenate(x) for x in ((keys[0][stay], one[now]), (keys[1][stay], two[now]), (keepers[stay], keeper[now])))
    come = changes.column("one").to_numpy()[now & ~had].view(np.uint64)
    if not held.insert(come):  # full: a larger filter from the exact keys
        held = CuckooFilter.of(one.view(np.uint64))
    order = np.lexsort((two, one))
    return shard_row(number, held, one[order], two[order], keeper[order])


class LineIndex:
    """A line index over documents; ``insert`` and ``delete`` return a new one and leave this as it is.

    A change writes only what it touches: the documents' own entries, the reference counts of their keys, and
    the shards that hold a key whose count has crossed ``min_docs`` or whose keeper is another. All else is read
    from the tables before it. ``fold`` writes one set of tables again after many changes.
    """

    def __init__(self, entries: DataFrame, refs: DataFrame, min_docs: int = 3, min_chars: int = 20, store: Store | None = None, shards: tuple[DataFrame, int] | None = None):
        self.store = store or Store(entries.sparkSession, "lines")
        self.entries, self.refs, self.min_docs, self.min_chars = entries, refs, min_docs, min_chars
        self._shards = shards
        #: Shards that the last change wrote.
        self.touched: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        store = Store(docs.sparkSession, "lines")
        entries = store.put(document_keys(docs, min_chars, id_col, text_col), "entries")
        return cls(entries, store.put(references(entries), "refs"), min_docs, min_chars, store)

    def _changed(self, entries: DataFrame, counts: DataFrame, store: Store) -> LineIndex:
        """With other entries, and other counts of the keys ``one, two, n_docs, keeper`` (0 documents: none left)."""
        counts = store.put(counts, "refs")
        keys = counts.select("one", "two").hint("merge")
        refs = self.refs.join(keys, ["one", "two"], "left_anti").unionByName(counts.where("n_docs > 0"))
        shards, number = self.shards()
        before = self.refs.join(keys, ["one", "two"], "left_semi").select("one", "two", F.col("n_docs").alias("had"), F.col("keeper").alias("kept"))
        both = counts.join(before.hint("merge"), ["one", "two"], "left").withColumns({"now": F.col("n_docs") >= self.min_docs, "was": F.coalesce(F.col("had") >= self.min_docs, F.lit(False))})
        changes = store.put(both.where("now <> was OR (now AND keeper <> kept)").select(F.pmod("one", F.lit(number)).cast("int").alias("shard"), "one", "two", "keeper", "now"), "changes")
        touched = changes.select("shard").distinct()
        some = shards.join(touched.hint("merge"), "shard", "left_semi")
        made = store.put(some.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change_shard, SHARD), "shards")
        rest = shards.join(touched.hint("merge"), "shard", "left_anti")
        index = LineIndex(entries, refs, self.min_docs, self.min_chars, store, (rest.unionByName(made), number))
        index.touched = made
        return index

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """With more documents; keys that a document already has in the index count once."""
        store = Store(docs.sparkSession, "lines")
        new = store.put(document_keys(docs, self.min_chars, id_col, text_col).join(self.entries, ["doc", "one", "two"], "left_anti"), "entries")
        added = references(new)
        old = self.refs.join(added.select("one", "two").hint("merge"), ["one", "two"], "left_semi")
        counts = old.unionByName(added).groupBy("one", "two").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
        return self._changed(self.entries.unionByName(new), counts, store)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents of these ids; keys that they kept go to the largest id that remains."""
        store = Store(ids.sparkSession, "lines")
        gone = store.put(ids.select(F.col(id_col).cast("long").alias("doc")).where("doc IS NOT NULL").distinct(), "gone").hint("merge")
        left = self.entries.join(gone, "doc", "left_anti")
        touched = store.put(self.entries.join(gone, "doc", "left_semi").select("one", "two").distinct(), "touched")
        again = references(left.join(touched.hint("merge"), ["one", "two"], "left_semi"))
        counts = touched.join(again.hint("merge"), ["one", "two"], "left").select("one", "two", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"), F.coalesce("keeper", F.lit(-1)).cast("long").alias("keeper"))
        return self._changed(left, counts, store)

    def fold(self) -> LineIndex:
        """The same index over one set of tables, so that reads no longer go through its changes."""
        store = Store(self.entries.sparkSession, "lines")
        shards, number = self.shards()
        return LineIndex(store.put(self.entries, "entries"), store.put(self.refs, "refs"), self.min_docs, self.min_chars, store, (store.put(shards, "shards"), number))

    def shards(self) -> tuple[DataFrame, int]:
        """A row per shard: its filter, and the repeated keys in order with their keepers."""
        if self._shards is None:
            repeated = self.refs.where(F.col("n_docs") >= self.min_docs)
            number = max(1, -(-repeated.count() // SHARD_KEYS))
            rows = repeated.withColumn("shard", F.pmod("one", F.lit(number)).cast("int"))
            self._shards = self.store.put(rows.groupBy("shard").applyInArrow(build_shard, SHARD), "shards"), number
        return self._shards

    def dropped(self) -> DataFrame:
        """``doc, one, two``: the keys whose lines a document loses."""
        shards, number = self.shards()
        entries = self.entries.withColumn("shard", F.pmod("one", F.lit(number)).cast("int"))
        largest = entries.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
        salts = max(1, -(-largest // GROUP_LINES))
        asked = entries.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
        copies = shards.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

        def look_up(lines: pa.Table, shard: pa.Table) -> pa.Table:
            doc, one, two = (lines.column(c).to_numpy() for c in ("doc", "one", "two"))
            drop = np.zeros(len(doc), bool)
            if shard.num_rows:
                held, keys, keepers = read_shard(shard)
                hit = np.flatnonzero(held.contains(one.view(np.uint64)))
                at = np.searchsorted(keys[0], one[hit])
                for _ in range(2 + int((np.diff(keys[0]) == 0).sum())):  # keys may share one hash, not both
                    inside = at < len(keepers)
                    same = np.zeros(len(hit), bool)
                    same[inside] = (keys[0][at[inside]] == one[hit[inside]]) & (keys[1][at[inside]] == two[hit[inside]])
                    drop[hit[same]] = keepers[at[same]] != doc[hit[same]]
                    on = inside & ~same
                    on[on] = keys[0][at[on]] == one[hit[on]]
                    if not on.any():
                        break
                    hit, at = hit[on], at[on] + 1
            return pa.table({"doc": doc[drop], "one": one[drop], "two": two[drop]})

        return asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(look_up, "doc long, one long, two long")


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", index: LineIndex | None = None) -> DataFrame:
    """Drops lines that at least ``min_docs`` documents hold, except in the largest id that holds them.

    Returns all columns of ``docs``, the text replaced by the lines that stay, and ``n_lines`` (before)
    and ``n_dropped``. Null and empty texts are one empty line, and the text returned is empty. Rows of
    one id count as one document and all lose the same keys; rows without an id count nowhere and lose
    nothing. Keys under ``min_chars`` code points are never dropped. An empty table gives no rows.
    Columns that clash with the names used here are kept: work columns stay in one struct.
    """
    index = index or LineIndex.build(docs, min_docs, min_chars, id_col, text_col)
    lost = index.dropped().groupBy("doc").agg(F.collect_list(F.struct("one", "two")).alias("lost"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.struct(*(c for c in docs.columns if c != text_col)).alias("row"), F.col(text_col).cast("string").alias("text"))
    joined = rows.join(lost, "doc", "left").select("row", "text", F.col("lost.one").alias("one"), F.col("lost.two").alias("two"))
    chars = index.min_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.slices(offsets, 4 << 20):
                part = batch.slice(lo, hi - lo)
                raw = data[offsets[lo] : offsets[hi]]
                row, start, end, fits, one, two = line_keys(raw, offsets[lo : hi + 1] - offsets[lo], chars)
                gone = np.zeros(len(row), bool)
                a, b = part.column(2), part.column(3)
                owner = np.repeat(np.arange(hi - lo), np.asarray(a.value_lengths().fill_null(0)))
                if len(owner):
                    x, y = (c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in (a, b))
                    of_row = K.mix(K.mix(owner.astype(np.uint64)) ^ x) + y
                    gone = fits & np.isin(K.mix(K.mix(row.astype(np.uint64)) ^ one) + two, of_row)
                n_lines, n_dropped = np.bincount(row, minlength=hi - lo), np.bincount(row[gone], minlength=hi - lo)
                keep = ~gone
                size, lead = (end - start)[keep], np.zeros(int(keep.sum()), np.int64)
                kept_row = row[keep]
                lead[1:] = kept_row[1:] == kept_row[:-1]  # the feed before every kept line but the first
                total = size + lead
                at = np.cumsum(total) - total
                text = np.full(int(total.sum()), 0x0A, np.uint8)
                inside = np.ones(len(text), bool)
                inside[at[lead == 1]] = False
                text[inside] = K.gather(raw, start[keep], size)
                ends = np.concatenate(([0], np.cumsum(np.bincount(kept_row, weights=total, minlength=hi - lo).astype(np.int64))))
                kept = pa.Array.from_buffers(pa.large_string(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(text)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), kept, pa.array(n_lines), pa.array(n_dropped)], names=["row", "kept", "n_lines", "n_dropped"])

    kind = joined.schema["row"].dataType.simpleString()
    done = joined.mapInArrow(run, f"row {kind}, kept string, n_lines long, n_dropped long")
    columns = [F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*columns, "n_lines", "n_dropped")
