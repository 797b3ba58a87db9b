"""Substring dedup on bytes by suffix arrays built with a difference cover.

Windows that may be equal share the least hash of their short byte sequences, so consecutive windows with the same least
hash travel as one string to the bucket of that hash. Every bucket sorts the suffixes of its strings by the difference
cover modulo 3: triples at two thirds of the places are sorted and named, the names are a shorter text that is sorted in
turn until they are unique or stand for a whole window, the remaining third is merged in by its first symbol and the rank
behind it. Neighbours in that order whose first bytes agree over a window are occurrences of one window.

Nothing but strings that equal another one byte for byte, and strings whose least hash nothing else has, stays out of
the sorting: the former are known to start earlier, the latter to be alone.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from framewright.session import scratch_table

from . import sketch
from .common import byte_texts, small_batches

#: Bytes of a window, and of the sequences whose least hash deals it out (eight at three places).
WINDOW, MER = 100, 20
#: A least hash may be that of this many runs, or this many times as many as the mean; windows of others go one by one.
HOT_COUNT, HOT_MEANS = 4096, 64
#: Windows of the input per bucket.
BUCKET_WINDOWS = 8_000_000
#: Strings that a task remembers, so that it sends copies once.
KEPT = 200_000
#: Bytes of strings that a task collects before they are sent, and that are sorted at once.
SEND_BYTES, SORT_BYTES = 24 << 20, 1 << 20
BATCH_BYTES = 2 << 20

_COLUMNS = {"key": np.uint32, "doc": np.int64, "mark": np.int64, "start": np.int32, "count": np.int32, "inner": np.int8}
_LAST = np.iinfo(np.int64).max
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; places too near to the end are left out."""
    places = max(len(data) - 7, 0)
    return np.ndarray((places,), "<u8", data, strides=(1,)).astype(np.uint64) if places else np.zeros(0, np.uint64)


def _mers(eights: np.ndarray) -> np.ndarray:
    """64-bit hashes of all sequences of MER bytes."""
    places = max(len(eights) - MER + 8, 0)
    mixed = np.zeros(places, np.uint64)
    for at, factor in zip((0, 8, MER - 8), _MIX, strict=True):
        mixed ^= eights[at:at + places]
        mixed *= factor
        mixed ^= mixed >> np.uint64(31)
    return mixed


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every *width* neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def _near_repeats(eights: np.ndarray, reach: int) -> np.ndarray:
    """Per block of 32 places, whether the eight bytes at its begin return within *reach* places: text that repeats itself."""
    at = np.arange(0, len(eights), 32)
    here, found = eights[at], np.zeros(len(at), bool)
    for d in range(1, reach + 1):
        there = at + d
        n = np.searchsorted(there, len(eights))
        found[:n] |= eights[there[:n]] == here[:n]
    return found


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[list[bytes], list[int]]]:
    """All texts at once with zeros, or a long text piece by piece with the places where they begin; no window is cut."""
    if sum(map(len, texts)) <= 2 * BATCH_BYTES:
        yield texts, [0] * len(texts)
        return
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 1), BATCH_BYTES):
            yield [b""] * number + [text[at:at + BATCH_BYTES + window - 1]], [0] * number + [at]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, and the number of the text that each belongs to."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _runs_of(data: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one least hash: first place, number, that hash, and the eight-byte numbers of the data."""
    eights = _eights(data)
    none = np.zeros(0, np.int64)
    if len(data) < window:
        return none, none, np.zeros(0, np.uint64), eights
    least = _least_of(_mers(eights), window - MER + 1)
    valid = row[:len(least)] == row[window - 1:]
    breaks = np.flatnonzero((least[1:] != least[:-1]) | (row[1:len(least)] != row[:len(least) - 1])) + 1
    starts = np.concatenate([[0], breaks])
    ends = np.append(breaks, len(least))
    # windows that reach into the next text are the last ones of a text, but may share a run with its others
    counts = np.concatenate([[0], np.cumsum(valid)])
    counts = counts[ends] - counts[starts]
    some = counts > 0
    # least hashes are small numbers: mixed once more, they spread over all buckets
    keys = least[starts[some]] * _MIX[0]
    return starts[some], counts[some], keys ^ keys >> np.uint64(32), eights


def _together(*columns: np.ndarray) -> np.ndarray:
    """One number per row that orders rows by all columns of natural numbers."""
    result = columns[0]
    for column in columns[1:]:
        bits = max(int(column.max(initial=0)).bit_length(), 1)
        if int(result.max(initial=0)).bit_length() + bits > 63:
            result = np.unique(result, return_inverse=True)[1]
        result = result << bits | column
    return result


def _below(ids: np.ndarray, count: int) -> np.ndarray:
    """For every id below *count*, how many *ids* are smaller."""
    return np.cumsum(np.bincount(ids, minlength=count)) - np.bincount(ids, minlength=count)


def _merged(zeros: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many zeros are smaller than each zero, how many others than each zero, and how many zeros than each other."""
    distinct, ids = np.unique(np.concatenate([zeros, others]), return_inverse=True)
    zero, other = ids[:len(zeros)], ids[len(zeros):]
    zeros_below = _below(zero, len(distinct))
    return zeros_below[zero], _below(other, len(distinct))[zero], zeros_below[other]


def difference_cover_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """How many suffixes are smaller than each, for suffixes told apart by *depth* symbols at least.

    Suffixes with unequal beginnings of *depth* symbols have different ranks in their order; of all others it is left open.
    Symbols are positive.
    """
    n = len(symbols)
    # the last triples at places 1 modulo 3 must end the first half of the names: they hold a zero
    size = n + (2 if n % 3 == 1 else 0)
    s = np.zeros(size + 3, np.int64)
    s[:n] = symbols
    zeros, ones, twos = (np.arange(k, size, 3) for k in range(3))
    cover = np.concatenate([ones, twos])
    distinct, names = np.unique(_together(s[cover], s[cover + 1], s[cover + 2]), return_inverse=True)
    if len(distinct) < len(cover) and depth > 3:
        names = difference_cover_ranks(names + 1, -(-depth // 3))
    rank = np.zeros(size + 3, np.int64)
    rank[cover] = names + 1
    # a suffix of the remaining third against the two others: by one symbol or two, then by the rank behind them
    at = np.concatenate([zeros, ones])
    among, below_one, over_one = _merged(*np.split(_together(s[at], rank[at + 1]), [len(zeros)]))
    at = np.concatenate([zeros, twos])
    _, below_two, over_two = _merged(*np.split(_together(s[at], s[at + 1], rank[at + 2]), [len(zeros)]))
    result = np.empty(size, np.int64)
    result[cover] = _below(names, int(names.max(initial=0)) + 1)[names] + np.concatenate([over_one, over_two])
    result[zeros] = among + below_one + below_two
    return result[:n]


def _equal_to_next(data: np.ndarray, order: np.ndarray, rank: np.ndarray, window: int) -> np.ndarray:
    """For neighbours in the order, whether their first *window* bytes agree."""
    a, b = order[:-1], order[1:]
    same = rank[a] == rank[b]
    eights = _eights(data)
    steps = sorted({*range(0, window - 8, 8), window - 8})
    open_ = np.flatnonzero(~same)
    for step in steps:
        open_ = open_[eights[a[open_] + step] == eights[b[open_] + step]]
    same[open_] = True
    return same


def repeated_windows(strings: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that also start earlier: number of the string and place in it.

    *docs* and *starts* say where a string begins; earlier means a smaller document, or a smaller place in the same one.
    """
    lengths = np.array([len(t) for t in strings], np.int64)
    data = np.frombuffer(b"\0".join(strings) + bytes(9), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    symbols = data.astype(np.int64) + 2
    symbols[begins + lengths] = 1
    rank = difference_cover_ranks(symbols[:begins[-1] + lengths[-1] + 1], window)
    owner = np.repeat(np.arange(len(strings)), lengths - window + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths - window + 1) - (lengths - window + 1), lengths - window + 1)
    at = begins[owner] + place
    order = np.argsort(rank[at], kind="stable")
    same = _equal_to_next(data, at[order], rank, window)
    group = np.concatenate([[0], np.cumsum(~same)])
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    order, group = order[several], group[several]
    if not len(order):
        return order, order
    doc, start = docs[owner[order]], starts[owner[order]] + place[order]
    by = np.lexsort((start, doc, group))
    order, group, doc, start = order[by], group[by], doc[by], start[by]
    first = np.concatenate([[True], group[1:] != group[:-1]])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (doc != doc[lead]) | (start != start[lead])
    return owner[order[later]], place[order[later]]


def _ranges(owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first place and number of all runs of consecutive places."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    begins = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])) if len(place) else np.zeros(0, np.int64)
    return owner[begins], place[begins], np.diff(np.append(begins, len(place)))


def _pack(values: np.ndarray) -> bytes:
    """Compressed numbers, first all their first bytes, then all second ones and so on: most of them agree."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return zstandard.ZstdCompressor(3).compress(planes.T.tobytes())


def _unpack(values: list[bytes], kind: type) -> np.ndarray:
    open_, size = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    planes = [np.frombuffer(open_.decompress(v), np.uint8).reshape(size, -1) for v in values]
    return np.concatenate([np.ascontiguousarray(p.T).view(kind).reshape(-1) for p in planes]) if planes else np.zeros(0, kind)


class _Outbox:
    """Strings of a task by bucket, and ranges that are known to be repeated, until they are sent."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.size = buckets, 0
        self.runs: dict[int, list[tuple]] = defaultdict(list)
        self.known: list[tuple] = []

    def add(self, run: tuple, string: bytes) -> None:
        self.runs[run[0] % self.buckets].append((run[0] >> 32, *run[1:], string))
        self.size += len(string) + 100

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.known:
            runs = [np.array(c, k) for c, k in zip(zip(*self.known, strict=True), _COLUMNS.values(), strict=True)]
            yield self._row(self.known[0][1] % self.buckets, runs, None)
        for bucket, rows in self.runs.items():
            rows.sort(key=itemgetter(0))
            *runs, strings = zip(*rows, strict=True)
            yield self._row(bucket, [np.array(c, k) for c, k in zip(runs, _COLUMNS.values(), strict=True)], b"".join(strings))
        self.__init__(self.buckets)

    @staticmethod
    def _row(bucket: int, runs: list[np.ndarray], packed: bytes | None) -> pa.RecordBatch:
        values = [_pack(r) for r in runs] + [None if packed is None else zstandard.ZstdCompressor(3).compress(packed)]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), *[pa.array([v], pa.binary()) for v in values]], ["bucket", *_COLUMNS, "packed"])


def _sorted_out(table: pa.Table, window: int) -> pa.Table:
    """All repeated ranges of a bucket."""
    given = table.column("packed").is_valid().to_pylist()
    column = {c: table.column(c).to_pylist() for c in [*_COLUMNS, "packed"]}
    known = {c: _unpack([v for v, g in zip(column[c], given, strict=True) if not g], k) for c, k in _COLUMNS.items()}
    out = [[known[c]] for c in ("doc", "mark", "start", "count")]
    key, doc, mark, start, count, inner = (_unpack([v for v, g in zip(column[c], given, strict=True) if g], k) for c, k in _COLUMNS.items())
    open_, strings = zstandard.ZstdDecompressor(), []
    for packed, counts in zip(column["packed"], column["count"], strict=True):
        if packed is not None:
            text, ends = open_.decompress(packed), np.cumsum(_unpack([counts], np.int32) + (window - 1)).tolist()
            strings += [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    order = np.lexsort((start, doc, key))
    same = key[order[1:]] == key[order[:-1]]
    several = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (inner[order] > 0)
    order = order[several] if len(order) else order

    def found(rows: np.ndarray, places: np.ndarray, counts: np.ndarray) -> None:
        for values, new in zip(out, (doc[rows], mark[rows], start[rows] + places, counts), strict=True):
            values.append(new)

    # of equal strings the first goes on; others that start later are repeated as a whole
    group: list[int] = []
    group_bytes, current, firsts = 0, None, {}
    twins: dict[int, list[int]] = {}
    whole: list[int] = []

    def sort_group() -> None:
        rows = np.array(group, np.int64)
        owner, place = repeated_windows([strings[i] for i in group], doc[rows], start[rows], window)
        owner, place, counts = _ranges(owner, place)
        found(rows[owner], place, counts)
        for i, others in twins.items():
            mine = rows[owner] == i
            for other in others:
                found(np.full(mine.sum(), other), place[mine], counts[mine])

    keys, inners = key[order].tolist(), inner[order].tolist()
    ends = np.append(np.flatnonzero(np.diff(key[order])) + 1, len(order)) if len(order) else np.zeros(0, np.int64)
    begin = 0
    for end in ends.tolist():
        firsts = {}
        for i in order[begin:end].tolist():
            first = firsts.setdefault(strings[i], i)
            if first != i:
                if (doc[first], start[first]) == (doc[i], start[i]):
                    twins.setdefault(first, []).append(i)
                else:
                    whole.append(i)
        if len(firsts) > 1 or any(inners[begin:end]):
            group += firsts.values()
            group_bytes += sum(map(len, firsts))
            if group_bytes > SORT_BYTES:
                sort_group()
                group, group_bytes, twins = [], 0, {}
        begin = end
    if group:
        sort_group()
    if whole:
        rows = np.array(whole)
        found(rows, np.zeros(len(rows), np.int64), count[rows])
    kinds = [np.int64, np.int64, np.int32, np.int32]
    return pa.table({x: np.concatenate(c).astype(k) for x, c, k in zip(("doc", "mark", "start", "count"), out, kinds, strict=True)})


def _repeated(docs: DataFrame, window: int) -> DataFrame:
    """Ranges of repeated windows: `doc` and `mark` of the row, `start` of the first window and `count` of windows."""
    spark = docs.sparkSession

    def keys(texts: list[bytes]) -> np.ndarray:
        return np.concatenate([_runs_of(*_joined(part), window)[2] for part, _ in _pieces(texts, window)])

    counts = sketch.bucket_counts(docs, "text", keys)
    shared = spark.sparkContext.broadcast(np.packbits(counts > max(HOT_COUNT, HOT_MEANS * counts.mean())))
    windows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = windows // BUCKET_WINDOWS + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_bucket = np.unpackbits(shared.value).astype(bool)
        remembered: dict[bytes, tuple[int, int, int]] = {}
        outbox = _Outbox(buckets)

        def take(key: int, doc: int, mark: int, start: int, count: int, inner: int, string: bytes) -> None:
            before = remembered.get(string)
            if before is not None and before[:2] < (doc, start):
                outbox.known.append((0, doc, mark, start, count, 0))
                return
            if before == (doc, start, mark):
                return
            if before is not None or len(remembered) < KEPT:
                remembered[string] = (doc, start, mark)
            outbox.add((key, doc, mark, start, count, inner), string)

        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids, marks = batch.column("doc").fill_null(_LAST).to_numpy(), batch.column("mark").to_numpy()
            order = np.lexsort((marks, ids))
            texts = list(byte_texts(batch.column("text")))
            texts = [texts[i] for i in order]
            for part, origins in _pieces(texts, window):
                data, row = _joined(part)
                firsts, numbers, key, eights = _runs_of(data, row, window)
                if not len(firsts):
                    continue
                # runs that may hold one window twice: longer than one least sequence allows, or near to a repeat
                repeats = np.concatenate([[0], np.cumsum(_near_repeats(eights, window - MER))])
                inner = repeats[np.minimum((firsts + numbers + window) // 32, len(repeats) - 1)] > repeats[firsts // 32]
                inner |= numbers > window - MER + 1
                owner = row[firsts]
                begins = np.concatenate([[0], np.cumsum([len(t) for t in part])]) - np.array([*origins, 0])
                hot, text = hot_bucket[sketch.bucket_of(key)], data.tobytes()
                columns = (key, ids[order][owner], marks[order][owner], firsts - begins[owner], numbers, inner, firsts, hot)
                for number, doc, mark, start, count, within, at, single in zip(*[c.tolist() for c in columns], strict=True):
                    if not single:
                        take(number, doc, mark, start, count, int(within), text[at:at + count + window - 1])
                        continue
                    for k in range(count):
                        string = text[at + k:at + k + window]
                        take(xxhash.xxh3_64_intdigest(string), doc, mark, start + k, 1, 0, string)
            if outbox.size > SEND_BYTES or len(outbox.known) > KEPT:
                yield from outbox.sent()
        yield from outbox.sent()

    schema = "bucket long, " + ", ".join(f"{c} binary" for c in [*_COLUMNS, "packed"])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)
    return docs.mapInArrow(cut, schema).repartition(parts, "bucket").groupBy("bucket").applyInArrow(
        lambda table: _sorted_out(table, window), "doc long, mark long, start int, count int")


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, `n_bytes`, `n_removed`, `n_spans` and `kept`, the remaining bytes.

    A byte goes if it lies in a string of *window* bytes that also starts earlier: in a document with a smaller
    identifier, or further to the front of the same one; occurrences may overlap. Strings are judged on the whole input
    texts in UTF-8, not on what is left, so `kept` is binary: a character may lose a part of its bytes. `n_spans` counts
    the maximal runs of removed bytes. Shorter texts lose nothing; null ones count as empty. Identifiers are whole numbers of 64
    bits; null ones come after all others and count as one document, as do rows that repeat an identifier: of those the
    earlier place wins whatever its row, and none is earlier at the same place. Other columns are left out.

    Texts meet their ranges compressed. A bucket has about BUCKET_WINDOWS windows, and one least hash a bounded number of runs in it; windows beyond that go
    to the buckets of their own hashes. Equal strings leave a task once, and SORT_BYTES of strings, or those of one
    least hash, are sorted at a time.
    """
    # rows without identifier, which may be many, are told apart by more bits than rows that share one
    mark = F.when(F.col(id_col).isNull(), F.xxhash64(F.col(text_col))).otherwise(F.hash(F.col(text_col)).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), mark.alias("mark"))
    ranges = scratch_table(_repeated(rows, window), "repeated-bytes")
    by_row = ranges.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "count")).alias("ranges"))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            texts = pa.array([press.compress(t) for t in byte_texts(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc").fill_null(_LAST), batch.column("mark"), texts], ["doc", "mark", "text"])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in small_batches(batches, "text", BATCH_BYTES // 4):
            sizes, removed, spans, kept = [], [], [], []
            for text, ranges in zip(byte_texts(batch.column("text")), batch.column("ranges"), strict=True):
                text = open_.decompress(text)
                sizes.append(len(text))
                if not ranges.is_valid or not len(ranges.values):
                    removed.append(0), spans.append(0), kept.append(text)
                    continue
                change = np.zeros(len(text) + 1, np.int32)
                begin, number = (ranges.values.field(c).to_numpy() for c in ("start", "count"))
                np.add.at(change, begin, 1)
                np.add.at(change, begin + number + window - 1, -1)
                gone = np.cumsum(change[:-1], dtype=np.int32) > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(c, pa.int64()) for c in (sizes, removed, spans)], pa.array(kept, pa.binary())],
                [id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    keyed = rows.mapInArrow(pressed, "doc long, mark long, text binary")
    told = keyed.join(by_row, ["doc", "mark"], "left").select(F.nullif("doc", F.lit(_LAST)).alias("id"), "text", "ranges")
    return told.mapInArrow(keep, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept binary")
