"""Words, folds and Arrow batches, as several operators need them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Fixed value: the characters between words.
SPACES = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the third of the identifiers that no model learns from; a null identifier is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learned_from(doc_id: Column) -> Column:
    """True for the other two thirds; nothing is learned from a null identifier."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACES}+"), "")


def byte_texts(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of every text, null as empty. `bytes.split()` cuts them at exactly the characters in SPACES."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose texts have about *limit* bytes; a longer text makes a slice of its own."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < len(sizes):
            yield batch.slice(start)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text."""
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum())), counts


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all windows of *width* neighbouring hashes."""
    places = max(len(hashes) - width + 1, 0)
    mixed = np.full(places, width, np.uint64)
    for j in range(width):
        mixed = (mixed ^ hashes[j:j + places]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    return mixed
