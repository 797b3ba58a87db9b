"""Byte-level BPE: ranks from a local file, long texts cut at places where a token must end, decoding of raw bytes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, small_batches

#: Characters that are encoded in one call; longer texts are cut.
PIECE_CHARS = 50_000
#: Bytes of text that a task turns into one batch of ids.
BATCH_BYTES = 4 * 1024 * 1024

#: A letter that is followed by white space or punctuation ends a token, whatever stands around it.
_SAFE = regex.compile(r"\p{L}(?=[\x20-\x40\x5B-\x60\x7B-\x7E\n\r\t])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (base64 bytes and rank per line), one per Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return tiktoken.Encoding("rank-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut *text* about every *size* characters, only between a letter and a following space or punctuation mark.

    No match of the pattern goes on from a letter to such a character, and none looks back, so the ids of the
    pieces, one after the other, are the ids of the text. Where no such place follows, the rest is one piece.
    """
    start = 0
    while len(text) - start > size and (cut := _SAFE.search(text, start + size)):
        yield text[start:cut.end()]
        start = cut.end()
    yield text[start:]


def encode_text(codec: tiktoken.Encoding, text: str) -> np.ndarray:
    parts = [codec.encode_to_numpy(p, disallowed_special=()) for p in pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its id column and `ids`, the token ids of the whole text (array of int).

    Null and empty texts have no ids; special tokens are ordinary text; bytes that are no UTF-8 count as U+FFFD.
    Repeated rows and null identifiers stay as they are, other columns are left out. No shuffle; *ranks_path* is a
    file that every executor has.
    """
    def run(batches):
        codec = encoding(ranks_path, pattern)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            rows = [encode_text(codec, t.decode("utf-8", "replace")) for t in byte_texts(batch.column("text"))]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), ids], [id_col, "ids"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Add `decoded`, the bytes that the ids stand for. An id outside the rank file raises; null ids give no bytes."""
    def run(batches):
        codec = encoding(ranks_path, pattern)
        for batch in batches:
            rows = 0
            while rows < batch.num_rows:  # few ids at a time: their texts are longer than they are
                part = batch.slice(rows, _rows_within(batch.column("ids"), rows, BATCH_BYTES // 4))
                texts = [codec.decode_bytes(i or []) for i in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])
                rows += part.num_rows

    narrow = encoded.select(id_col, "ids")
    id_type = narrow.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>, decoded binary")


def _rows_within(ids: pa.ListArray, start: int, limit: int) -> int:
    lengths = np.nan_to_num(pa.compute.list_value_length(ids.slice(start)).to_numpy(zero_copy_only=False))
    return max(1, int(np.searchsorted(np.cumsum(lengths), limit, side="right")))
