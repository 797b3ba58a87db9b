"""Stupid-backoff scores of documents under a trigram model of the whole corpus, computed by joins.

Units are the tokens of a byte-level BPE rank file, word by word, written once. The vocabulary is bounded: unigram counts are
broadcast, and a token has a bounded number of neighbours. Trigrams are exploded from the documents and dealt by their
middle token, where both bigrams that a backoff may need are at hand; a frequent middle token has several buckets, dealt
by a hash of the trigram. Scores of trigrams are summed per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from framewright.session import scratch_table

from .bpe import encoding
from .common import byte_texts, small_batches

#: Factor per step of backing off.
BACKOFF = 0.4
#: Bigrams and trigrams that occur less often are no evidence: their probability backs off.
LEAST_COUNT = 2
#: Tokens of the corpus per bucket of trigrams.
BUCKET_TOKENS = 4_000_000
BATCH_BYTES = 4 << 20
#: Pairs that a task gathers before it adds them up.
MERGE_PAIRS = 2_000_000
#: Words whose tokens a task remembers.
WORDS_KEPT = 300_000
#: A rank file must be smaller: two starts of a text take the next number, and tokens have 16 bits.
MOST_TOKENS = 1 << 16

#: Columns of a bucket's share of a batch. `at` numbers the documents of the batch; their list goes along with one share.
_RUNS = {"u": np.uint16, "v": np.uint16, "w": np.uint16, "at": np.uint16, "n": np.uint32}
_DOCS = {"doc": np.int64, "mark": np.int32, "size": np.int64}


class _Tokens:
    """Token numbers of texts, words separately; remembers those of words it has met."""

    def __init__(self, ranks_path: str, pattern: str):
        self.codec = encoding(ranks_path, pattern)
        self.start = self.codec.max_token_value + 1
        if self.start >= MOST_TOKENS:
            raise ValueError(f"the rank file has {self.start} tokens or more, not below {MOST_TOKENS - 1}")
        self.known: dict[bytes, list[int]] = {}

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """The tokens of every text."""
        if len(self.known) > WORDS_KEPT:
            self.known = {}
        known, parts = self.known, []
        for text in texts:
            words = text.split()
            for w in words:
                if w not in known:
                    known[w] = self.codec.encode_ordinary(" " + w.decode("utf-8", "replace"))
            own = list(chain.from_iterable(map(known.__getitem__, words)))
            parts.append(np.array(own, np.uint16))
        return parts


def token_table(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """`doc`, `mark` and `ids` (16-bit numbers) of rows with `doc`, `mark` and `text`, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(ranks_path, pattern)
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids = [x.tobytes() for x in tokens(list(byte_texts(batch.column("text"))))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("mark"), pa.array(ids, pa.binary())], ["doc", "mark", "ids"])

    return scratch_table(docs.select("doc", "mark", "text").mapInArrow(run, "doc long, mark int, ids binary"), "tokens")


def _with_starts(column: pa.Array, start: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a batch, two starts before each text, and the number of tokens per text, starts not counted."""
    own = [np.frombuffer(x.as_buffer(), np.uint16) for x in column]
    starts = np.full(2, start, np.uint16)
    return np.concatenate([x for ids in own for x in (starts, ids)]).astype(np.uint64), np.array([len(x) for x in own], np.int64)


def bigram_counts(tokens: DataFrame, start: int) -> DataFrame:
    """`a`, `b`, `n`: how often token b follows a in all texts of a token table, each after two starts. Tasks send sums."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, sums = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0))
            unique, where = np.unique(keys, return_inverse=True)
            return unique, np.bincount(where, sums, len(unique)).astype(np.int64)

        for batch in small_batches(batches, "ids", BATCH_BYTES // 2):
            ids, sizes = _with_starts(batch.column("ids"), start)
            pairs = (ids[:-1] << np.uint64(16)) | ids[1:]
            inside = np.ones(len(pairs), bool)
            inside[(np.cumsum(sizes + 2) - 1)[:-1]] = False  # from the end of a text to the start of the next
            found.append(np.unique(pairs[inside], return_counts=True))
            if sum(len(k) for k, _ in found) > MERGE_PAIRS + 2 * len(found[0][0]):
                found = [merged()]
        keys, sums = merged()
        for begin in range(0, len(keys), 100_000):
            k, n = keys[begin:begin + 100_000], sums[begin:begin + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array((k >> np.uint64(16)).astype(np.int32)), pa.array((k & np.uint64(0xFFFF)).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    return tokens.select("ids").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, `n_tokens`, `log_score` (natural logarithm, summed) and `mean_log_score`.

    S(w | u v) = c(u v w) / c(u v) where the trigram occurs LEAST_COUNT times or more, else BACKOFF * S(w | v);
    S(w | v) = c(v w) / c(v) likewise, else BACKOFF * c(w) / N. Counts are those of all documents of the input, this one
    included; every text begins after two starts. Null, empty and blank texts have no tokens, a sum of 0 and a null
    mean. Repeated rows count as often as they occur and get equal rows; null identifiers stay. Other columns are left
    out. Identifiers are whole numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.hash(F.col(text_col)).alias("mark"))
    start_token = encoding(ranks_path, pattern).max_token_value + 1
    told = token_table(rows, ranks_path, pattern)
    pairs = scratch_table(bigram_counts(told, start_token), "bigrams")
    single = pairs.groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # a row per token of the rank file at most
    counts = np.zeros(MOST_TOKENS, np.int64)
    if single.num_rows:
        counts[single.column("b").to_numpy()] = single.column("n").to_numpy()
    total = int(counts.sum() - counts[start_token])
    counts[start_token] *= 2  # the first of the two starts follows nothing

    # buckets: neighbouring tokens share one, a frequent token has several
    parts = np.maximum(1, -(-counts // BUCKET_TOKENS))
    light = np.where(parts == 1, counts, 0)
    shared = np.cumsum(light) // BUCKET_TOKENS
    first = np.where(parts == 1, shared, shared[-1] + 1 + np.cumsum(np.where(parts > 1, parts, 0)) - parts)
    known = spark.sparkContext.broadcast((counts, parts, first))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, parts, first = known.value
        pack, number = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, "ids", BATCH_BYTES // 2):
            ids, sizes = _with_starts(batch.column("ids"), start_token)
            doc, mark = batch.column("doc").fill_null(-1 << 63).to_numpy(), batch.column("mark").to_numpy()
            at = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes + 2)
            third = np.concatenate([np.zeros(0, np.int64), *[np.arange(e - n, e) for n, e in zip(sizes, np.cumsum(sizes + 2), strict=True)]])
            u, v, w = ids[third - 2], ids[third - 1], ids[third]
            for low in range(0, len(sizes), 1 << 16):  # rows of a batch are told apart by 16 bits
                number += 1
                here = (at[third] >= low) & (at[third] < low + (1 << 16))
                keys = (v[here] << np.uint64(48)) | (u[here] << np.uint64(32)) | (w[here] << np.uint64(16)) | (at[third][here] - np.uint64(low))
                keys, n = np.unique(keys, return_counts=True)
                middle = (keys >> np.uint64(48)).astype(np.int64)
                mixed = (keys >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
                bucket = first[middle] + ((mixed >> np.uint64(40)) % parts[middle].astype(np.uint64)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                own = slice(low, low + (1 << 16))
                for a, b in zip(edges, np.append(edges[1:], len(order)), strict=True):
                    mine = order[a:b]
                    k = keys[mine]
                    columns = {"u": k >> np.uint64(32), "v": k >> np.uint64(48), "w": k >> np.uint64(16), "at": k, "n": n[mine]}
                    told = {"doc": doc[own], "mark": mark[own], "size": sizes[own]} if a == 0 else {}
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(bucket[mine[0]])], pa.int64()), pa.array([number], pa.int64()),
                         *[pa.array([pack.compress(columns[x].astype(kind).tobytes())], pa.binary()) for x, kind in _RUNS.items()],
                         *[pa.array([pack.compress(told[x].astype(kind).tobytes()) if told else None], pa.binary()) for x, kind in _DOCS.items()]],
                        ["bucket", "batch", *_RUNS, *_DOCS])

    def weigh(trigrams: pa.Table, bigrams: pa.Table) -> pa.Table:
        counts, open_ = known.value[0], zstandard.ZstdDecompressor()
        parts: dict[str, list[np.ndarray]] = {x: [] for x in _RUNS}
        docs_before, edges = 0, [0]
        for row in trigrams.select(list(_RUNS)).to_pylist():
            for x, kind in _RUNS.items():
                values = np.frombuffer(open_.decompress(row[x]), kind)
                parts[x].append(values.astype(np.int64) + docs_before if x == "at" else values)
            docs_before = int(parts["at"][-1].max()) + 1
            edges.append(docs_before)
        if not docs_before:
            return empty
        u, v, w, at, n = (np.concatenate(parts.pop(x)) for x in _RUNS)
        keys, where = np.unique((v.astype(np.uint64) << np.uint64(32)) | (u.astype(np.uint64) << np.uint64(16)) | w, return_inverse=True)
        c3 = np.bincount(where, n, len(keys))
        u, v, w = (((keys >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64) for s in (16, 32, 0))
        held = (bigrams.column("a").to_numpy().astype(np.int64) << 16) | bigrams.column("b").to_numpy()
        held, places = np.unique(held, return_index=True)
        times = bigrams.column("n").to_numpy()[places]
        c_uv, c_vw = (times[np.searchsorted(held, (a << 16) | b)].astype(float) for a, b in ((u, v), (v, w)))
        lowest = math.log(BACKOFF * BACKOFF) + np.log(counts[w] / total)
        middle = math.log(BACKOFF) + np.log(c_vw / counts[v])
        s = np.where(c3 >= LEAST_COUNT, np.log(c3 / c_uv), np.where(c_vw >= LEAST_COUNT, middle, lowest))
        # a row for each batch of documents, not for each document: one number for each of them, in their order
        sums = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.bincount(at, n * s[where], docs_before)))
        return pa.table({"batch": trigrams.column("batch").combine_chunks(), "log": sums, **{x: trigrams.column(x) for x in _DOCS}})

    def add(parts: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        told = {x: next(np.frombuffer(open_.decompress(v), kind) for v in parts.column(x).to_pylist() if v) for x, kind in _DOCS.items()}
        total = np.zeros(len(told["doc"]))
        for sums in parts.column("log").combine_chunks():
            values = sums.values.to_numpy()
            total[:len(values)] += values
        return pa.table({"doc": told["doc"], "mark": told["mark"], "n": told["size"], "log": total})

    empty = pa.table({"batch": pa.array([], pa.int64()), "log": pa.array([], pa.list_(pa.float64())), **{x: pa.array([], pa.binary()) for x in _DOCS}})
    schema = "bucket long, batch long, " + ", ".join(f"{x} binary" for x in (*_RUNS, *_DOCS))
    exploded = told.mapInArrow(explode, schema)
    # a bigram goes to all buckets of both its tokens
    table = spark.createDataFrame(pa.table({"token": np.flatnonzero(counts).astype(np.int32), "first": first[counts > 0], "parts": parts[counts > 0].astype(np.int64)}))
    dealt = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("token"), "a", "b", "n").join(F.broadcast(table), "token")
    dealt = dealt.select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("bucket"), "a", "b", "n")
    weighed = exploded.groupBy("bucket").cogroup(dealt.groupBy("bucket")).applyInArrow(
        weigh, "batch long, log array<double>, " + ", ".join(f"{x} binary" for x in _DOCS))
    # the sums of a batch meet again: no more numbers than it has trigrams
    weighed = weighed.groupBy("batch").applyInArrow(add, "doc long, mark int, n long, log double")
    sums = weighed.groupBy("doc", "mark").agg(F.sum("n").alias("n"), F.sum("log").alias("log"))
    # rows that are repeated were added up: every copy has its share
    every = rows.select(F.coalesce("doc", F.lit(-1 << 63)).alias("doc"), "mark")
    copies = every.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("copies"))
    shares = copies.join(sums, ["doc", "mark"], "left").select(
        F.nullif("doc", F.lit(-1 << 63)).alias(id_col), F.coalesce((F.col("n") / F.col("copies")).cast("long"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.col("log") / F.col("copies"), F.lit(0.0)).alias("log_score"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return shares.select(id_col, "n_tokens", "log_score", F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"))
