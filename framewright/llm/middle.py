"""Fill-in-middle by displacement scatter.

A text is cut twice and its middle moved to the end. Three segments of a row each move as a whole, so the shift of a byte
only changes where a segment begins: differences of shifts are put there, their running sum gives every byte of a batch
its place in the output, and one scatter writes all outputs of the batch. Restoring finds the marks and gathers the
bytes back the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches

#: The marks before prefix, suffix and middle, and of 100 texts those that are changed, and with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CHANGED, SUFFIX_FIRST = 90, 20
BATCH_BYTES = 8 << 20
#: Bytes whose shifts are held at once.
BLOCK = 1 << 21

_MARKS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
_MARK = 3


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts, and their bytes one after the other; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return offsets - offsets[0], data


def _texts_of(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    return column.cast(pa.large_string()).cast(pa.string())


def _moved(size: int, starts: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Places of the bytes 0 to *size* after segments that begin at *starts*, in order, moved by *shifts*; block by block."""
    steps, carry = np.diff(shifts, prepend=0), 0
    for begin in range(0, size, BLOCK):
        end = min(begin + BLOCK, size)
        a, b = np.searchsorted(starts, (begin, end))
        change = np.zeros(end - begin, np.int64)
        np.add.at(change, starts[a:b] - begin, steps[a:b])
        change[0] += carry
        np.cumsum(change, out=change)
        carry = change[-1]
        yield slice(begin, end), change + np.arange(begin, end)


def _scatter(batch: pa.RecordBatch) -> pa.Array:
    """Outputs of a batch with `text`, `form` and the cuts `first` and `second` in code points."""
    offsets, data = _bytes_of(batch.column("text"))
    forms = np.array(batch.column("form").to_pylist())
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    before = np.searchsorted(points, offsets[:-1])
    first, second = (points[before + batch.column(c).to_numpy()] for c in ("first", "second"))
    begin, end = offsets[:-1], offsets[1:]
    sizes = np.stack([first - begin, second - first, end - second], axis=1)
    changed = forms != "plain"
    out_offsets = np.concatenate([[0], np.cumsum(end - begin + changed * 3 * _MARK)])
    out = np.empty(out_offsets[-1], np.uint8)
    # where prefix, middle and suffix go
    to = np.stack([out_offsets[:-1], first - begin + out_offsets[:-1], second - begin + out_offsets[:-1]], axis=1)
    for form, order in (("psm", (0, 2, 1)), ("spm", (2, 0, 1))):
        rows = np.flatnonzero(forms == form)
        at = out_offsets[rows]
        for segment, mark in zip(order, _MARKS[form], strict=True):
            for k, byte in enumerate(mark.encode()):
                out[at + k] = byte
            to[rows, segment] = at + _MARK
            at = at + _MARK + sizes[rows, segment]
    starts = np.stack([begin, first, second], axis=1)
    for block, places in _moved(len(data), starts.reshape(-1), (to - starts).reshape(-1)):
        out[places] = data[block]
    return _texts_of(out, out_offsets)


def _gather(batch: pa.RecordBatch) -> pa.Array:
    """Texts of a batch with `form` and `output`."""
    offsets, data = _bytes_of(batch.column("output"))
    forms = np.array(batch.column("form").to_pylist())
    first = {m.encode()[1] for m in (PREFIX, SUFFIX, MIDDLE)}
    marks = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & np.isin(data[1:-1], list(first))) if len(data) >= _MARK else np.zeros(0, np.int64)
    row = np.searchsorted(offsets, marks, side="right") - 1
    last = np.searchsorted(offsets, marks + _MARK - 1, side="right") - 1
    marks = marks[(row == last) & (forms[row] != "plain")]
    changed = np.flatnonzero(forms != "plain")
    found = marks.reshape(-1, 3) if len(marks) == 3 * len(changed) else None
    if found is None or (np.searchsorted(offsets, found, side="right") - 1 != changed[:, None]).any():
        raise ValueError("an output doesn't hold its three marks once each")
    for form in _MARKS:
        mine = found[forms[changed] == form]
        if (data[mine + 1] != [ord(m[1]) for m in _MARKS[form]]).any():
            raise ValueError(f"the marks of an output are not in the order of {form}")
    sizes = np.diff(offsets) - np.where(forms != "plain", 3 * _MARK, 0)
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    # where prefix, middle and suffix come from, and go to
    begin = np.repeat(offsets[:-1, None], 3, axis=1)
    length = np.stack([sizes, 0 * sizes, 0 * sizes], axis=1)
    for form, order in (("psm", (0, 2, 1)), ("spm", (2, 0, 1))):
        here = forms[changed] == form
        rows, mine = changed[here], found[here]
        ends = np.stack([mine[:, 1], mine[:, 2], offsets[rows + 1]], axis=1)
        for k, segment in enumerate(order):
            begin[rows, segment] = mine[:, k] + _MARK
            length[rows, segment] = ends[:, k] - mine[:, k] - _MARK
    starts = out_offsets[:-1, None] + np.cumsum(length, axis=1) - length
    out = np.empty(out_offsets[-1], np.uint8)
    for block, places in _moved(len(out), starts.reshape(-1), (begin - starts).reshape(-1)):
        out[block] = data[places]
    return _texts_of(out, out_offsets)


def _number(digest: Column, group: int) -> Column:
    """The *group*-th eight hexadecimal digits as a number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, `n` (code points), `form`, `prefix_chars`, `middle_chars` and `output`.

    Cuts and forms are drawn from the SHA-256 of *seed*, a colon and the identifier, so rows that repeat an identifier
    are cut by the same numbers. `form` is plain for empty texts, texts that hold a mark, and one in ten of the others;
    then output is the text and the lengths are null. psm puts the suffix before the middle, spm before the prefix, too.
    A null text counts as empty, a null identifier as an empty one. Other columns are left out.

    A batch holds about BATCH_BYTES of text or one longer text, the shifts of BLOCK bytes at a time.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), digest.alias("_digest"))
    n = F.char_length("text").cast("long")
    cuts = [_number(F.col("_digest"), g) % (F.col("n") + 1) for g in (1, 2)]
    held = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (F.col("n") == 0) | held[0] | held[1] | held[2] | (_number(F.col("_digest"), 3) % 100 >= CHANGED)
    form = F.when(plain, "plain").when(_number(F.col("_digest"), 4) % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    told = rows.withColumn("n", n).withColumn("form", form).select(
        "_id", "text", "n", "form",
        F.when(F.col("form") == "plain", F.col("n")).otherwise(F.least(*cuts)).alias("first"),
        F.when(F.col("form") == "plain", F.col("n")).otherwise(F.greatest(*cuts)).alias("second"))

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("_id", "n", "form", "first", "second")], _scatter(batch)],
                ["_id", "n", "form", "first", "second", "output"])

    kind = rows.schema["_id"].dataType.simpleString()
    done = told.mapInArrow(scatter, f"_id {kind}, n long, form string, first long, second long, output string")
    changed = F.col("form") != "plain"
    return done.select(
        F.col("_id").alias(id_col), "n", "form", F.when(changed, F.col("first")).alias("prefix_chars"),
        F.when(changed, F.col("second") - F.col("first")).alias("middle_chars"), "output")


def restore(done: DataFrame, restored: str = "restored") -> DataFrame:
    """Add the text that `form` and `output` stand for; an output whose marks don't fit its form raises."""
    names = [c for c in done.columns if c != restored]
    schema = done.select(*names).schema.add(restored, "string")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "output", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, _gather(batch)], [*names, restored])

    return done.select(*names).mapInArrow(gather, schema)
