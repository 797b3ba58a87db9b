"""Substring dedup by super-k-mers: every window of words that starts earlier somewhere else is removed.

The minimiser of a window is the rarest of its short word sequences, by a table of approximate frequencies, then by
hash; it depends on the window alone, so equal windows meet in the bucket of their minimiser. Consecutive windows with the
same minimiser travel as one packed string, and sorting within a bucket finds the windows that occur more than once.

Windows whose minimiser is too frequent even so travel one by one to the bucket of their own hash. Windows that occur
earlier in the same batch of documents are known at once and don't travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from framewright.session import scratch_table

from . import sketch
from .common import byte_texts, small_batches, window_hashes, word_hashes

#: Words of a window and of the sequences that minimisers are chosen from.
WINDOW, MER = 20, 3
#: A minimiser may occur this often, or this many times as often as the mean bucket; windows of others go one by one.
HOT_COUNT, HOT_MEANS = 4096, 64
#: Words of the input per bucket.
BUCKET_WORDS = 2_000_000
#: Hot windows that a task remembers, so that it sends them once.
HOT_KEPT = 100_000
BATCH_BYTES = 5 << 20

_RUNS = ["key", "doc", "start", "count", "mark"]
_KINDS = [np.uint32, np.int64, np.int32, np.int32, np.int32]
_LAST = np.iinfo(np.int64).max


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every *width* neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _mers(texts: list[bytes]) -> np.ndarray:
    """Hashes of the short sequences in all texts; those that span two texts only blur the frequencies a little."""
    return window_hashes(word_hashes(texts)[0], MER)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of every run; *breaks* is true where a new one begins."""
    starts = np.flatnonzero(breaks)
    return starts, np.diff(np.append(starts, len(breaks)))


def _ranges(places: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of runs of consecutive places in one document."""
    if not len(places):
        return places, places
    return _runs(np.concatenate([[True], (np.diff(places) != 1) | (docs[1:] != docs[:-1])]))


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(values.tobytes())


def _unpack(values: list[bytes], kind: type) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    return np.concatenate([np.frombuffer(open_.decompress(v), kind) for v in values]) if values else np.zeros(0, kind)


def _covered(docs: DataFrame, window: int) -> DataFrame:
    """Ranges of removed windows: `doc` and `mark` of the row, `start` of the first window and `count` of windows."""
    spark = docs.sparkSession
    counts = sketch.bucket_counts(docs, "text", _mers)
    limit = max(HOT_COUNT, HOT_MEANS * counts.mean())
    shared = spark.sparkContext.broadcast((sketch.classes(counts), np.packbits(counts > limit)))
    buckets = max(1, int(counts.sum()) // BUCKET_WORDS)
    fields = [*_RUNS, "packed"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, hot_bits = shared.value
        hot_bucket = np.unpackbits(hot_bits).astype(bool)
        sent: dict[bytes, tuple[int, int]] = {}
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids = batch.column("doc").fill_null(_LAST).to_numpy()
            order = np.lexsort((batch.column("mark").to_numpy(), ids))
            texts = list(byte_texts(batch.column("text")))
            texts = [texts[i].split() for i in order]
            flat = [w for t in texts for w in t]
            sizes = np.array([len(t) for t in texts], np.int64)
            if len(flat) < window:
                continue
            text, words_here = b" ".join(flat), len(flat)
            offsets = np.zeros(words_here + 1, np.int64)
            np.cumsum(np.fromiter(map(len, flat), np.int64, words_here) + 1, out=offsets[1:])
            del flat, texts
            row = np.repeat(np.arange(len(sizes)), sizes)
            doc, mark = ids[order][row], batch.column("mark").to_numpy()[order][row]
            place = (np.arange(words_here) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            hashes, _ = word_hashes([text])
            mers = window_hashes(hashes, MER)
            where = sketch.bucket_of(mers)
            rank = _least_of((classes[where].astype(np.uint64) << np.uint64(58)) | (mers >> np.uint64(6)), window - MER + 1)
            hot_mer = hot_bucket[where]
            # a window is hot if all of its sequences are
            hot = _least_of(hot_mer, window - MER + 1)
            whole = window_hashes(hashes, window)
            valid = np.flatnonzero(row[:len(whole)] == row[window - 1:])

            def piece(i: int, n: int = 1) -> bytes:
                return text[offsets[i]:offsets[i + n + window - 1] - 1]  # noqa: B023

            # equal windows of this batch: the first in order stands for the others
            by_hash = valid[np.lexsort((place[valid], doc[valid], whole[valid]))]
            again = np.flatnonzero(whole[by_hash[1:]] == whole[by_hash[:-1]]) + 1
            known = np.zeros(len(whole), bool)
            first, before = -1, -2
            for k in again:
                if k != before + 1:
                    first = by_hash[k - 1]
                before, i = k, by_hash[k]
                if (doc[i], place[i]) != (doc[first], place[first]) and piece(i) == piece(first):
                    known[i] = True
            for i in valid[hot[valid] & ~known[valid]]:
                w, at = piece(i), (doc[i], place[i])
                if w in sent and sent[w] < at:
                    known[i] = True
                elif w in sent or len(sent) < HOT_KEPT:
                    sent[w] = at
            done = valid[known[valid]]
            starts, lengths = _ranges(done, row[done])
            starts = done[starts] if len(done) else starts
            yield _row(int(hashes[0] % np.uint64(buckets)), [np.zeros(len(starts), np.uint32), doc[starts], place[starts], lengths, mark[starts]], b"")
            open_ = valid[~known[valid]]
            if not len(open_):
                continue
            key = np.where(hot[open_], whole[open_], rank[open_] * np.uint64(0x9E3779B97F4A7C15))
            key ^= key >> np.uint64(31)
            breaks = np.concatenate([[True], (np.diff(open_) != 1) | (key[1:] != key[:-1]) | hot[open_[1:]] | (row[open_[1:]] != row[open_[:-1]])])
            starts, lengths = _runs(breaks)
            bucket = (key[starts] % np.uint64(buckets)).astype(np.int64)
            short = (key[starts] >> np.uint64(32)).astype(np.uint32)
            firsts = open_[starts]
            by_bucket = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(by_bucket)), strict=True):
                mine = by_bucket[a:b]
                f = firsts[mine]
                packed = b"\n".join([piece(i, n) for i, n in zip(f.tolist(), lengths[mine].tolist(), strict=True)])
                yield _row(int(bucket[mine[0]]), [short[mine], doc[f], place[f], lengths[mine], mark[f]], packed)

    def _row(bucket: int, runs: list[np.ndarray], packed: bytes) -> pa.RecordBatch:
        values = [_pack(r.astype(k)) for r, k in zip(runs, _KINDS, strict=True)]
        values.append(zstandard.ZstdCompressor(3).compress(packed) if packed else None)
        return pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], ["bucket", *fields])

    def count(table: pa.Table) -> pa.Table:
        given = table.column("packed").is_valid().to_pylist()
        runs = {name: [v for v, g in zip(table.column(name).to_pylist(), given, strict=True) if g] for name in fields}
        known = {name: _unpack([v for v, g in zip(table.column(name).to_pylist(), given, strict=True) if not g], k)
                 for name, k in zip(_RUNS, _KINDS, strict=True)}
        out = [[known[x]] for x in ("doc", "mark", "start", "count")]
        if runs["packed"]:
            key, doc, start, number, mark = (_unpack(runs[x], k) for x, k in zip(_RUNS, _KINDS, strict=True))
            open_ = zstandard.ZstdDecompressor()
            strings = [s for p in runs["packed"] for s in open_.decompress(p).split(b"\n")]
            order = np.lexsort((start, doc, key))
            same = key[order[1:]] == key[order[:-1]]
            several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            found = []

            def settle(windows: list[tuple[bytes, int, int, int]]) -> None:
                """Sort the windows of one key: of equal ones, all after the first place are repeated."""
                windows.sort()
                first, twice = (None, 0, 0, 0), []
                for w in windows:
                    if w[0] != first[0]:
                        first = w
                    elif w[1:3] != first[1:3]:
                        twice.append((w[3], w[2]))
                if not twice:
                    return
                twice.sort()
                run, place = (np.array(x) for x in zip(*twice, strict=True))
                f, n = _ranges(place, run)
                found.append((doc[run[f]], mark[run[f]], place[f], n))

            current, windows = None, []
            for r in order[several].tolist():
                if key[r] != current:
                    settle(windows)
                    current, windows = key[r], []
                words, at, d = strings[r].split(b" "), int(start[r]), int(doc[r])
                windows += [(b" ".join(words[j:j + window]), d, at + j, r) for j in range(len(words) - window + 1)]
            settle(windows)
            for column, parts in zip(out, zip(*found, strict=True), strict=False):
                column.extend(parts)
        names = ["doc", "mark", "start", "count"]
        kinds = [np.int64, np.int32, np.int32, np.int32]
        return pa.table({x: np.concatenate(c).astype(k) for x, c, k in zip(names, out, kinds, strict=True)})

    schema = "bucket long, " + ", ".join(f"{f} binary" for f in fields)
    return docs.mapInArrow(cut, schema).groupBy("bucket").applyInArrow(count, "doc long, mark int, start int, count int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, `n_words`, `n_removed` and `kept`, the remaining words joined by a space.

    A word goes if it lies in a window of *window* words that also starts earlier: in a document with a smaller
    identifier, or further to the front of the same one. Windows are judged on the whole input texts, not on what is
    left. Texts with fewer words lose nothing; null and empty ones have no words and keep an empty text. Null identifiers
    come after all others and count as one document, as do rows that repeat an identifier: of those the earlier place wins
    whatever its row, none is earlier at the same place, and each keeps a row of its own. Other columns are left out.

    Buckets have about BUCKET_WORDS words each: a minimiser belongs to a bounded number of windows, all others are
    spread by their own hash and sent once per task. Equal windows are compared word by word.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"),
                       F.hash(F.col(text_col)).alias("mark"))
    ranges = scratch_table(_covered(rows, window), "ranges")
    by_row = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(byte_texts(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int32)
                for r in ranges or ():
                    gone[r["start"]] += 1
                    gone[r["start"] + r["count"] + window - 1] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g] if n_removed[-1] else words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                [id_col, "n_words", "n_removed", "kept"])

    keyed = rows.withColumn("doc", F.coalesce("doc", F.lit(_LAST)))
    told = keyed.join(by_row, ["doc", "mark"], "left").select(F.nullif("doc", F.lit(_LAST)).alias("id"), "text", "ranges")
    return told.mapInArrow(keep, f"`{id_col}` long, n_words long, n_removed long, kept string")
