"""Slices: a few megabytes of documents in one row, and keyed verdicts on what slices hold.

Corpus-wide questions about small things (grams, windows, spans) would cost a row for each. A slice
instead sends one blob of sorted, distinct keys to each group of keys, and gets one blob of verdicts
in the same order. Slices are written once, so whatever is recomputed sees the same slices, and they
are split by bytes, so no key or source makes one large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .store import Store

SLICE_BYTES, SLICE_ROWS = 4 << 20, 1 << 15
SCHEMA = "slice long, n int, size long, rest binary, ends binary, data binary"
_codec = pa.Codec("zstd", compression_level=3)


def shrink(a: np.ndarray) -> bytes:
    """Array bytes, their number first."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def grow(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(_codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True), kind)


def pack(docs: DataFrame, text_col: str, store: Store) -> DataFrame:
    """Writes the slices of ``docs``: texts, and all other columns as one Arrow batch."""
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for a, b in K.slices(offsets, SLICE_BYTES):
                for lo in range(a, b, SLICE_ROWS):
                    hi = min(b, lo + SLICE_ROWS)
                    sink = pa.BufferOutputStream()
                    part = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo)], names=["row"])
                    with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(part)
                    ends, text = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                    one = lambda x, kind: pa.array([x], kind)
                    yield pa.RecordBatch.from_arrays(
                        [one(number, pa.int64()), one(hi - lo, pa.int32()), one(len(text), pa.int64()), one(sink.getvalue().to_pybytes(), pa.binary()), one(shrink(ends), pa.binary()), one(shrink(text), pa.binary())],
                        names=["slice", "n", "size", "rest", "ends", "data"],
                    )
                    number += 1

    rows = docs.select(F.struct(*(F.col(c) for c in others)).alias("row"), F.col(text_col).cast("string").alias("text"))
    return store.put(rows.mapInArrow(run, SCHEMA), "slices", "uncompressed")


class Slice:
    def __init__(self, batch: pa.RecordBatch | pa.Table, i: int):
        get = lambda c: batch.column(c)[i].as_py()
        self.id = get("slice")
        self.offsets, self.data = grow(get("ends"), np.int64), grow(get("data"), np.uint8)
        self._rest = get("rest")
        names = batch.schema.names
        #: Verdict blobs by round, in order of group.
        self.verdicts = {c: {v["group"]: v["verdict"] for v in (get(c) or [])} for c in names if c.startswith("verdict")}

    def rest(self) -> pa.StructArray:
        with pa.ipc.open_stream(self._rest) as r:
            return r.read_all().column(0).combine_chunks()

    def ids(self, id_col: str) -> np.ndarray:
        """Ids as integers; a missing one is above all others."""
        return np.asarray(self.rest().field(id_col).cast(pa.int64()).fill_null(np.iinfo(np.int64).max))


def over(slices: DataFrame, f: Callable[[Slice], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from f(Slice(batch, i))
                K.release()

    return slices.mapInArrow(run, schema)


def judged(slices: DataFrame, emit: Callable, judge: Callable, name: str, store: Store) -> DataFrame:
    """One round: slices with a further column ``verdict_<name>``.

    emit: from a slice to ``(group, blobs)`` pairs, each group once; judge: from ``[(slice, blobs)]`` of
    one group to ``(slice, verdict)`` pairs.
    """

    def send(s: Slice) -> Iterator[pa.RecordBatch]:
        found = list(emit(s))
        if found:
            blobs = pa.array([[bytes(b) for b in x[1]] for x in found], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([s.id] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), blobs], names=["slice", "group", "blobs"])

    def decide(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("slice").to_pylist(), table.column("blobs").to_pylist(), strict=True))
        group = table.column("group")[0].as_py()
        done = list(judge(rows))
        K.release()
        return pa.table({"slice": pa.array([x[0] for x in done], pa.int64()), "group": pa.array([group] * len(done), pa.int64()), "verdict": pa.array([x[1] for x in done], pa.binary())})

    sent = over(slices, send, "slice long, group long, blobs array<binary>")
    verdicts = store.put(sent.groupBy("group").applyInArrow(decide, "slice long, group long, verdict binary"), f"verdict_{name}", "uncompressed")
    column = f"verdict_{name}"
    by_slice = verdicts.groupBy("slice").agg(F.collect_list(F.struct("group", "verdict")).alias(column))
    # both sides grow with the corpus: neither is broadcast, however small it still is
    return slices.join(by_slice.hint("merge"), "slice", "left")
