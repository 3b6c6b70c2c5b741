"""Best-fit packing of tokenised documents: best-two-fit over a histogram of lengths.

A piece's place depends on its length alone, so the plan is made from the counts of each length (at
most ``capacity`` numbers, whatever the corpus) and states how often each fill is repeated. Pieces
then find their place from their rank among pieces of their length. Ranks need no sort: each task
counts its own pieces by length, and a running total over tasks gives the offset of its counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K
from .store import Store

PIECES = "key {}, piece int, start long, length int, ids_crc32 long, block int, nth long"


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Fills ``(lengths, times)`` that use up ``counts[length]``.

    Each fill starts with the longest length left and takes the longest that fits until none does.
    Then its smallest document goes back if two unpacked ones fit its place and the gap more tightly.
    A fill is repeated as often as the counts allow, so there are a few fills for each length.
    """
    left = counts.astype(np.int64).copy()
    sizes = np.arange(capacity + 1)
    fills = []
    longest_up_to = np.maximum.accumulate(np.where(left > 0, sizes, 0))
    while longest_up_to[capacity]:
        fill: list[int] = []
        gap = capacity

        def change(size: int, by: int) -> None:
            nonlocal longest_up_to
            left[size] += by
            if left[size] == (0 if by < 0 else 1):
                longest_up_to = np.maximum.accumulate(np.where(left > 0, sizes, 0))

        while gap and (size := int(longest_up_to[gap])):
            fill.append(size)
            gap -= size
            change(size, -1)
        while gap and fill:
            smallest = min(fill)
            room = gap + smallest
            small = np.flatnonzero(left[: room // 2 + 1] > 0)
            large = longest_up_to[room - small]
            lone = (large == small) & (left[small] < 2)  # it can't be its own partner
            large = np.where(lone, longest_up_to[np.maximum(small - 1, 0)], large)
            total = np.where(large > 0, small + large, 0)
            if not len(total) or (best := int(total.argmax())) < 0 or total[best] <= smallest:
                break
            a, b = int(small[best]), int(large[best])
            fill.remove(smallest)
            fill += [a, b]
            for size, by in ((smallest, 1), (a, -1), (b, -1)):
                change(size, by)
            gap = room - a - b
        used = np.bincount(fill, minlength=capacity + 1)
        kinds = np.flatnonzero(used)
        times = 1 + int((left[kinds] // used[kinds]).min())
        left[kinds] -= used[kinds] * (times - 1)
        longest_up_to = np.maximum.accumulate(np.where(left > 0, sizes, 0))
        fills.append((sorted(fill, reverse=True), times))
    return fills


def layout(fills: list[tuple[list[int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length in turn, runs of ranks: first rank, copies in a sequence, first sequence, first offset."""
    rows, taken, base = [], np.zeros(capacity + 1, np.int64), 0
    for fill, times in fills:
        at = 0
        for size, copies in zip(*(x.tolist() for x in np.unique(fill, return_counts=True)), strict=True):
            rows.append((size, taken[size], copies, base, at))
            taken[size] += copies * times
            at += size * copies
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return {k: table[:, i].copy() for i, k in enumerate(("size", "rank", "copies", "sequence", "offset"))} | {"first": np.searchsorted(table[:, 0], np.arange(capacity + 2))}


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = bpe.library(vocabulary)
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def parts():
            for b in batches:
                if b.num_rows:
                    yield b.column(0), *K.text_buffers(b.column(1))

        for key, lo, hi, ids, at in bpe.encode(parts(), library, added=library.vocab.added):
            total = np.diff(at) + 1
            number = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            head = total - (number - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            closed = np.full(int(total.sum()), end_id, "<u4")  # each document's ids, then the end
            keep = np.ones(len(closed), bool)
            keep[np.cumsum(total) - 1] = False
            closed[keep] = ids
            view, place = memoryview(closed).cast("B"), np.cumsum(length) - length
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(place.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            new = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
            nth += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [key.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), block), pa.int32()), pa.array(nth)],
                names=["key", "piece", "start", "length", "ids_crc32", "block", "nth"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES.format(kind))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    A document is its ids, then ``end_id``; null and empty texts are ``end_id`` alone. ``vocabulary`` is a
    tokenizer's ``.json`` file, whose added tokens are matched in plain text as that library does, or a
    ``.tiktoken`` file, which has none. A text that is not UTF-8 (a cast of other bytes to string can make
    one) is refused with a ``ValueError``. Only a longer
    document is cut, its first piece taking what full pieces leave. Returns a row per piece:
    ``id_col, piece, start, length, ids_crc32, sequence_id, offset``. Repeated rows and ids are
    documents of their own; columns besides the two named are ignored; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "packing")
    cut = store.put(pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces")
    by_block = cut.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_block = store.put(by_block.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))), "blocks")
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in by_block.groupBy("length").agg(F.sum("n")).collect():  # a row for each length at most
        counts[size] = n
    plan = layout(best_two_fit(counts, capacity), capacity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # runs ascend by length, then rank: one search finds a rank's run
        span = int(counts.max()) + 1
        run_key = plan["size"] * span + plan["rank"]
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            run = np.searchsorted(run_key, size * span + rank, "right") - 1
            rank = rank - plan["rank"][run]
            copies = plan["copies"][run]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(plan["sequence"][run] + rank // copies), pa.array(plan["offset"][run] + rank % copies * size)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = cut.join(by_block.select("length", "block", "skip").hint("merge"), ["length", "block"]).select("key", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("nth") + F.col("skip")).alias("rank"))
    placed = ranked.mapInArrow(place, f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("key", id_col)
