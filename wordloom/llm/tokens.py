"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Pretokens are found by array operations over whole slices of text; each distinct pretoken of a
task's batch is encoded once. ``bpe.replay`` holds an inverted index from merge rank (that is, from
the token pairs that make it) to the positions in those words, applies every merge in rank order
everywhere at once, and looks up again only the pairs whose neighbours changed. Nothing is shuffled:
a task's memory is bounded by ``bpe.encode``'s batch, not by its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import kernels as K


def binary_rows(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """A large binary column from bytes and offsets."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text and decodes its ids again.

    Returns ``id_col, ids binary`` (little-endian unsigned 32-bit ids) and ``decoded binary``.
    Added tokens of a ``.json`` vocabulary are plain text here. A text that is not UTF-8 is refused with a
    ``ValueError``. Null and empty texts have no ids; repeated rows and ids give a row each; other columns are
    ignored whatever their names; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(vocabulary)

        def parts():
            for b in batches:
                if b.num_rows:
                    yield b.column(0), *K.text_buffers(b.column(1))

        for key, lo, hi, ids, at in bpe.encode(parts(), lambda d, s, n: bpe.replay(d, s, n, vocab)):
            raw = vocab.decode(ids)
            ends = np.concatenate(([0], np.cumsum(vocab.byte_len[ids])))[at]
            yield pa.RecordBatch.from_arrays([key.slice(lo, hi - lo), binary_rows(ids.astype("<u4").view(np.uint8), at * 4), binary_rows(raw, ends)], names=["key", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, ids binary, decoded binary").withColumnRenamed("key", id_col)
