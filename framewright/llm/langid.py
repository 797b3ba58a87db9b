"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is a Spark aggregation of (language, bucket) counts over all labelled documents. The matrix of log
probabilities has languages x buckets numbers, whatever the input, and is broadcast; documents are scored in batches of
sparse rows in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import byte_texts, small_batches

#: Buckets of the hashed n-grams, a power of two.
BUCKETS = 1 << 15
#: Lengths of the character n-grams.
ORDERS = (1, 2, 3)
#: Added to every count.
SMOOTHING = 0.5
#: Largest number of languages times buckets; the matrix on the driver and in each worker has four bytes for each.
MOST_WEIGHTS = 1 << 25
#: Bytes of text that are scored at once.
BATCH_BYTES = 1 << 20

UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # languages x buckets, log probabilities
    priors: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else a space."""
    table = np.arange(0x110000, dtype=np.uint32)
    table[[not chr(c).isalpha() for c in range(0x110000)]] = 32
    return table


def sparse_rows(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For every order the buckets of all n-grams and the row each belongs to, and the number of letters per row.

    Texts are lower-cased and every run of other characters counts as one space, at both ends as well.
    """
    plain = [" " + t.decode("utf-8", "replace").lower() + " " for t in texts]
    ends = np.cumsum([len(p) for p in plain])
    codes = _letters()[np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)]
    rows = np.repeat(np.arange(len(plain)), np.diff(ends, prepend=0))
    letters = np.bincount(rows[codes != 32], minlength=len(plain))
    stays = np.ones(len(codes), bool)
    stays[1:] = (codes[1:] != 32) | (codes[:-1] != 32) | (rows[1:] != rows[:-1])
    codes, rows = codes[stays], rows[stays]
    found, mixed = [], np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        mixed = mixed[: len(codes) - order + 1] * np.uint32(0x01000193) ^ codes[order - 1:] * np.uint32(0x9E3779B1)
        if order in ORDERS:
            inside = rows[: len(mixed)] == rows[order - 1:]
            scrambled = (mixed[inside] + np.uint32(order)) * np.uint32(0x85EBCA6B)
            found.append(((scrambled >> np.uint32(9)) & np.uint32(BUCKETS - 1), rows[: len(mixed)][inside]))
    return found, letters


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from all rows whose language is not null. Null and empty texts add nothing but their share of the prior.

    The counts come from one aggregation over the whole table, combined in each task before they are shuffled. More
    languages than fit into the documented matrix size raise an error.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, "text", BATCH_BYTES):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            rows, _ = sparse_rows(list(byte_texts(batch.column("text"))))
            for lang in set(langs):
                mine, total = langs == lang, totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += mine.sum()
                for buckets, row in rows:
                    total[:BUCKETS] += np.bincount(buckets[mine[row]], minlength=BUCKETS)
        for lang, total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([lang] * len(used), pa.string()), "bucket": pa.array(used.astype(np.int32)),
                "n": pa.array(total[used])})

    labelled = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")
    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row per language: at most `buckets` numbers in each
    per_lang = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    learned: dict[str, np.ndarray] = {}
    for row in per_lang.toLocalIterator():
        if (len(learned) + 1) * BUCKETS > MOST_WEIGHTS:
            raise ValueError(f"more languages than {MOST_WEIGHTS // BUCKETS}: raise MOST_WEIGHTS or lower BUCKETS")
        learned[row.lang] = np.zeros(BUCKETS + 1)
        for bucket, n in row.counts:
            learned[row.lang][bucket] = n
    languages = sorted(learned)
    matrix = np.array([learned[x] for x in languages]).reshape(len(languages), BUCKETS + 1)
    grams = matrix[:, :BUCKETS] + SMOOTHING
    return Model(languages, np.log(grams / grams.sum(1, keepdims=True)), np.log(matrix[:, BUCKETS] / max(matrix[:, BUCKETS].sum(), 1)))


def score(texts: list[bytes], model: Model) -> tuple[list[str], np.ndarray]:
    """Most probable language and its posterior probability for every text."""
    rows, letters = sparse_rows(texts)
    totals = np.tile(model.priors, (len(texts), 1))
    for k in range(len(model.languages)):
        for buckets, row in rows:
            totals[:, k] += np.bincount(row, model.weights[k][buckets], len(texts))
    if not model.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    best = totals.argmax(1)  # the first of equals, in alphabetical order
    posterior = 1 / np.exp(totals - totals.max(1, keepdims=True)).sum(1)
    known = letters > 0
    return [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id column, `lang_pred` and `score`, the posterior probability of that language.

    Whole texts are scored. Null texts and texts without a letter get `und` and 0, and so does every text if nothing was
    learned. Equal probabilities go to the language that is first in the alphabet. Other columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            langs, scores = score(list(byte_texts(batch.column("text"))), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema['id'].dataType.simpleString()}, lang_pred string, score double")

