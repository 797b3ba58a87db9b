"""How frequent hashed items are: counts in a fixed number of buckets, and classes made from them.

A bucket counts all items that fall into it, so it is never below an item's own count. The table has one byte per
bucket, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, small_batches

#: Power of two of the number of buckets; raise it for inputs far above a terabyte (2 ** BITS bytes are broadcast).
BITS = 21
#: Counts that travel in one row, two in each 64-bit column.
_PER_ROW = 32
_MOST = 1 << 30
#: Buckets that are classed at once.
_AT_ONCE = 1 << 16
BATCH_BYTES = 4 << 20


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, items: Callable[[list[bytes]], np.ndarray]) -> np.ndarray:
    """Count *items*(texts), 64-bit hashes, of all documents per bucket.

    Each task sends at most 2 ** BITS counts, and the sums are combined before and after the shuffle. Counts beyond
    2 ** 30 from one task or in all stay there.
    """
    columns = [f"c{i}" for i in range(_PER_ROW // 2)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            found = items(list(byte_texts(batch.column("text"))))
            total += np.bincount(bucket_of(found), minlength=1 << BITS)
        packed = np.minimum(total, _MOST).reshape(-1, _PER_ROW // 2, 2)
        packed = packed[:, :, 0] + (packed[:, :, 1] << 32)
        used = np.flatnonzero(packed.any(axis=1))
        for start in range(0, len(used), 10_000):
            rows = used[start:start + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), *[pa.array(packed[rows, i]) for i in range(_PER_ROW // 2)]], ["block", *columns])

    schema = ", ".join(["block long", *[f"{c} long" for c in columns]])
    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, schema)
    # the halves are added apart: a carry from one must not reach the other
    halves = [F.least(F.sum(half), F.lit(_MOST)).cast("int").alias(f"{c}{x}") for c in columns
              for x, half in (("a", F.col(c).bitwiseAND(F.lit((1 << 32) - 1))), ("b", F.shiftright(c, 32)))]
    table = parts.groupBy("block").agg(*halves).toArrow()
    result = np.zeros(((1 << BITS) // _PER_ROW, _PER_ROW), np.int32)
    for batch in table.to_batches():
        at = batch.column(0).to_numpy()
        for i, column in enumerate(batch.columns[1:]):
            result[at, i] = column.to_numpy()
    return result.reshape(-1)


def classes(counts: np.ndarray) -> np.ndarray:
    """0 for buckets whose excess over the mean may be chance, then one more for every doubling of it; one byte each."""
    mean = counts.mean()
    chance = 3 * np.sqrt(mean) + 1
    found = np.empty(len(counts), np.uint8)
    for start in range(0, len(counts), _AT_ONCE):  # doubles of a part only
        excess = np.maximum((counts[start:start + _AT_ONCE] - mean) / chance, 0.5)
        found[start:start + _AT_ONCE] = np.maximum(np.floor(np.log2(excess)) + 1, 0)
    return found
