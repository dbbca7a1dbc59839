"""A bitmap over keys of long columns, for a second scan that should only work on some rows.

It says "maybe" or "no"; what it lets through too much is work, never a wrong
result.  It has about 16 bits a key, but never more than MOST_BITS (16 MB), so it can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarframe.llm import textnum as N

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 27
_PIECE = 32768  # bits in one bitmap of bitmap_construct_agg


def _u64(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.uint64 else x.astype(np.int64).view(np.uint64)


def slots(columns: list[np.ndarray], bits: int) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = N.mix(h * np.uint64(3) ^ _u64(c))
    return (h & np.uint64(bits - 1)).astype(np.int64)


def build(rows: DataFrame) -> bytes:
    """The bitmap of all rows of ``rows`` (a table, read twice), whose columns are longs: built on executors, 4 KB a piece."""
    n = rows.count()
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(slots([c.to_numpy(zero_copy_only=False) for c in b.columns], bits))], ["slot"])

    out = np.zeros(bits // 8, dtype=np.uint8)
    pieces = rows.mapInArrow(run, "slot long").groupBy(F.expr(f"slot div {_PIECE}").alias("piece")).agg(F.bitmap_construct_agg(F.col("slot") % _PIECE).alias("bits"))
    for row in pieces.toLocalIterator():
        out[row.piece * (_PIECE // 8) : row.piece * (_PIECE // 8) + len(row.bits)] = np.frombuffer(row.bits, dtype=np.uint8)
    return out.tobytes()


class Filter:
    """The bitmap on an executor."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, dtype=np.uint8)

    def maybe(self, columns: list[np.ndarray]) -> np.ndarray:
        at = slots(columns, 8 * len(self.bits))
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) == 1


def _only(docs: DataFrame, bits, key: str, inside: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(bits.value)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(key)
                maybe = known.maybe([ids.fill_null(0).to_numpy(zero_copy_only=False)]) & ~ids.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(maybe == inside))

    return docs.mapInArrow(run, docs.schema)


def some(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key may be in ``keys`` (one long column): what is left to shuffle before a join with them."""
    return _only(docs, docs.sparkSession.sparkContext.broadcast(build(keys)), key, True)


def split(docs: DataFrame, keys: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``some``, and the rows whose key surely isn't in ``keys`` (a null key is in nothing)."""
    bits = docs.sparkSession.sparkContext.broadcast(build(keys))
    return _only(docs, bits, key, True), _only(docs, bits, key, False)
