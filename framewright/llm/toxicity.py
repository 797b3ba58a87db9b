"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as numbers: how much more often it, and its character n-grams, occur in toxic than in clean training
documents, its length and whether it is known. The network reads windows of words in both directions, attention pools
its states, and a document scores as its most toxic window; all overlapping windows of a text are scored.

The model is trained in numpy in one task, on a bounded sample of labelled documents, and broadcast; its size is fixed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import byte_texts, small_batches

#: Labelled documents of each class in the training sample, those whose hashed identifiers are smallest.
SAMPLE_ROWS = 2000
#: Characters of a document that enter the sample.
SAMPLE_CHARS = 20_000
#: Parts that a longer text is sampled by.
SAMPLE_PARTS = 10
#: Words of a window and from one window to the next.
WINDOW, STRIDE = 64, 32
#: Buckets of hashed words and n-grams, and the lengths of n-grams in bytes, word ends included.
BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6)
#: Units in each direction, and of the attention.
HIDDEN, ATTENTION = 8, 8
ROUNDS, STEPS, BATCH, RATE, SEED = 6, 60, 256, 0.01, 7
BATCH_BYTES = 1 << 20
#: Words and windows that are worked on at a time, so that what is between them and the results stays small.
WORDS_AT_ONCE, WINDOWS_AT_ONCE = 1 << 14, 512

_INPUTS = len(GRAMS) + 4
_EDGES = b".,;:!?\"'()[]{}<>|#*$%&-_/\\=+~^`"


@dataclass
class Model:
    word_odds: np.ndarray
    gram_odds: np.ndarray  # a row per n-gram length
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def words_in(text: bytes) -> list[bytes]:
    """Lower-case words without punctuation at either end."""
    return [w for w in (x.strip(_EDGES) for x in text.decode("utf-8", "replace").lower().encode().split()) if w]


def _hash_words(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Bucket of every word, and for every n-gram length the buckets of all n-grams and the word of each."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    codes = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), sizes)
    multiplier = np.uint64(0x9E3779B97F4A7C15)
    mixed, grams = np.zeros(len(codes), np.uint64), []
    for n in range(1, max(GRAMS) + 1):
        length = max(len(codes) - n + 1, 0)
        mixed = (mixed[:length] ^ codes[n - 1:n - 1 + length]) * multiplier
        mixed ^= mixed >> np.uint64(29)
        if n in GRAMS:
            inside = owner[:length] == owner[n - 1:n - 1 + length]
            grams.append(((mixed[inside] >> np.uint64(40)).astype(np.int64) % BUCKETS, owner[:length][inside]))
    # a whole word is hashed by its bytes and their places
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
    spread = (codes + place * np.uint64(0x100000001B3)) * multiplier
    spread ^= spread >> np.uint64(31)
    whole = np.add.reduceat(spread * multiplier, starts) if len(words) else np.zeros(0, np.uint64)
    return (whole >> np.uint64(40)).astype(np.int64) % BUCKETS, grams


def inputs(words: list[bytes], model: Model) -> np.ndarray:
    """A row of numbers for every word and one of zeros at the end, for places behind a text."""
    rows = np.zeros((len(words) + 1, _INPUTS), np.float32)
    for first in range(0, len(words), WORDS_AT_ONCE):
        some = words[first:first + WORDS_AT_ONCE]
        part = rows[first:first + len(some)]
        whole, grams = _hash_words(some)
        part[:, 0] = model.word_odds[whole]
        for k, (buckets, owner) in enumerate(grams):
            values = model.gram_odds[k][buckets]
            if len(owner):
                starts = np.flatnonzero(np.diff(owner, prepend=-1))
                part[owner[starts], 1 + k] = np.maximum.reduceat(values, starts)
                if GRAMS[k] == 4:
                    part[owner[starts], -3] = np.add.reduceat(values, starts) / np.diff(np.append(starts, len(owner)))
        part[:, -2] = np.minimum([len(w) for w in some], 20) / 10
        part[:, -1] = 1
    return rows


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of every window of texts with these numbers of words; the last ends with its text."""
    steps = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    owner = np.repeat(np.arange(len(counts)), steps)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(steps) - steps, steps)
    first = np.minimum(number * STRIDE, np.maximum(counts[owner] - WINDOW, 0))
    return first + (np.cumsum(counts) - counts)[owner], owner


def _word_of(first: np.ndarray, ends: np.ndarray, ids: np.ndarray, behind: int) -> np.ndarray:
    """Numbers of the words of windows that begin at *first*; *behind* for places behind the ends of their texts."""
    places = first[:, None] + np.arange(WINDOW)
    return np.where(places < ends[:, None], ids[np.minimum(places, len(ids) - 1)], behind)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _read(weights: dict[str, np.ndarray], side: str, given: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction, in the order read; *given* holds the inputs' share of the gates (steps, rows, 3H)."""
    recurrent, h = weights["U" + side], np.zeros((given.shape[1], HIDDEN), np.float32)
    states, trace = np.empty((*given.shape[:2], HIDDEN), np.float32), []
    for t in range(len(given)):
        own = h @ recurrent
        gates = _sigmoid(given[t, :, :2 * HIDDEN] + own[:, :2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        n = np.tanh(given[t, :, 2 * HIDDEN:] + r * own[:, 2 * HIDDEN:])
        if keep:
            trace.append((h, r, z, n, own[:, 2 * HIDDEN:]))
        h = n + z * (h - n)
        states[t] = h
    return states, trace


def _pool(weights: dict[str, np.ndarray], states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Log-odds of windows from states (steps, rows, 2H); *there* is false behind the end of a text."""
    seen = np.tanh(states @ weights["A"] + weights["a"])
    power = np.where(there, seen @ weights["v"], -1e9)
    share = np.exp(power - power.max(0))
    share /= share.sum(0)
    pooled = (share[:, :, None] * states).sum(0)
    return pooled @ weights["o"] + weights["c"], (seen, share, pooled)


def logits(model: Model, rows: np.ndarray, index: np.ndarray, chunk: int = WINDOWS_AT_ONCE) -> np.ndarray:
    """Log-odds of windows; *index* (windows, words) points into *rows*, whose last one stands behind every text."""
    w = model.weights
    given = {s: rows @ w["W" + s] + w["b" + s] for s in "fb"}
    out = np.zeros(len(index), np.float32)
    for start in range(0, len(index), chunk):
        part = index[start:start + chunk].T
        forward, _ = _read(w, "f", given["f"][part], False)
        back, _ = _read(w, "b", given["b"][part[::-1]], False)
        out[start:start + chunk] = _pool(w, np.concatenate([forward, back[::-1]], 2), part != len(rows) - 1)[0]
    return out


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, there: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted cross-entropy; *x* has (steps, rows, inputs)."""
    sides = {"f": x, "b": x[::-1]}
    read = {s: _read(w, s, given @ w["W" + s] + w["b" + s], True) for s, given in sides.items()}
    states = np.concatenate([read["f"][0], read["b"][0][::-1]], 2)
    out, (seen, share, pooled) = _pool(w, states, there)
    d_out = ((_sigmoid(out) - label) * weight / weight.sum()).astype(np.float32)
    g = {"o": pooled.T @ d_out, "c": d_out.sum(keepdims=True)}
    d_pooled = d_out[:, None] * w["o"]
    d_states = share[:, :, None] * d_pooled
    d_share = (states * d_pooled).sum(2)
    d_power = share * (d_share - (share * d_share).sum(0))
    g["v"] = np.einsum("tb,tba->a", d_power, seen)
    d_seen = d_power[:, :, None] * w["v"] * (1 - seen * seen)
    g["A"], g["a"] = np.einsum("tbh,tba->ha", states, d_seen), d_seen.sum((0, 1))
    d_states = d_states + d_seen @ w["A"].T
    for s, own in (("f", d_states[:, :, :HIDDEN]), ("b", d_states[::-1, :, HIDDEN:])):
        d_given = np.empty((*own.shape[:2], 3 * HIDDEN), np.float32)
        d_h, d_u = np.zeros(own.shape[1:], np.float32), np.zeros_like(w["U" + s])
        for t in range(len(own) - 1, -1, -1):
            h, r, z, n, own_n = read[s][1][t]
            d_h = d_h + own[t]
            d_n = d_h * (1 - z) * (1 - n * n)
            d_given[t] = np.concatenate([d_n * own_n * r * (1 - r), d_h * (h - n) * z * (1 - z), d_n], 1)
            d_own = np.concatenate([d_given[t, :, :2 * HIDDEN], d_n * r], 1)
            d_u += h.T @ d_own
            d_h = d_h * z + d_own @ w["U" + s].T
        g["U" + s], g["b" + s] = d_u, d_given.sum((0, 1))
        g["W" + s] = np.einsum("tbi,tbg->ig", sides[s], d_given)
    return g


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """`text` and `label` of at most SAMPLE_ROWS documents of either class; rows without text or label stay out.

    A text above SAMPLE_CHARS stands in the sample with SAMPLE_PARTS evenly spread parts that are as long together.
    """
    ids = None
    for label in (0, 1):
        own = labels.where((F.col(label_col) == label) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_wanted")).distinct()
        own = own.orderBy(F.xxhash64("_wanted"), "_wanted").limit(SAMPLE_ROWS).withColumn("_label", F.lit(label))
        ids = own if ids is None else ids.unionByName(own)
    chosen = docs.join(F.broadcast(ids), F.col(id_col) == F.col("_wanted"))
    chosen = chosen.where(F.char_length(text_col) > 0).select(F.col(text_col).alias("text"), F.col("_label").alias("label"))
    size = SAMPLE_CHARS // SAMPLE_PARTS
    step = (F.char_length("text") - size) / F.lit(float(SAMPLE_PARTS - 1))
    parts = [F.substring(F.col("text"), (F.floor(step * k) + 1).cast("int"), F.lit(size)) for k in range(SAMPLE_PARTS)]
    return chosen.withColumn("text", F.when(F.char_length("text") > SAMPLE_CHARS, F.concat_ws("\n", *parts)).otherwise(F.col("text"))).distinct()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on a sample of the labelled documents, in one task: the sample is bounded, and a lost task runs again.

    Raises if documents with words are labelled with either class but the sample has words of one class only.
    """
    def run(table: pa.Table) -> pa.Table:
        examples = sorted(zip(byte_texts(table.column("text")), table.column("label").to_pylist(), strict=True))
        del table
        return pa.table({"model": pa.array([pickle.dumps(train(examples))], pa.binary())})

    trained = sample(docs, labels, id_col, text_col, label_col).groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary")
    found = trained.first()
    model = pickle.loads(bytes(found["model"])) if found else train([])
    if not model.weights:
        known = docs.where(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).join(labels.where(F.col(label_col).isin(0, 1)).select(id_col, label_col), id_col)
        if known.select(label_col).distinct().count() == 2:
            raise ValueError("the sample of labelled documents has words of one class only: raise SAMPLE_ROWS")
    return model


def _odds(counts: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Log-odds of toxic for every bucket, from the numbers of clean and toxic documents in which it occurs, with
    classes brought to the smaller's size and rare buckets shrunk towards 0."""
    both = np.bincount(label, minlength=2)[:, None]
    scaled = np.log(counts * (both.min() / both) + 2)
    return ((scaled[1] - scaled[0]) / 3).astype(np.float32)


def train(examples: list[tuple[bytes, int]]) -> Model:
    """Fit the model. Without examples of both classes it has no weights, and every document scores 0.

    A toxic document teaches by the window that the model finds worst so far, a clean one by its worst and some others.
    """
    vocabulary: dict[bytes, int] = {}
    parts = [(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_in(t)], np.int32), y) for t, y in examples]
    label = np.array([y for x, y in parts if len(x)], np.int64)
    zero = np.zeros(BUCKETS, np.float32)
    model = Model(zero, np.zeros((len(GRAMS), BUCKETS), np.float32))
    if len(set(label)) < 2:
        return model
    counts = np.array([len(x) for x, _ in parts if len(x)])
    ids, words = np.concatenate([x for x, _ in parts]), list(vocabulary)
    del parts, vocabulary
    found = np.zeros((1 + len(GRAMS), 2, BUCKETS), np.int32)
    for x, y in zip(np.split(ids, np.cumsum(counts)[:-1]), label, strict=True):
        whole, grams = _hash_words([words[i] for i in np.unique(x)])
        for k, buckets in enumerate([whole, *(b for b, _ in grams)]):
            found[k, y, np.unique(buckets)] += 1
    model.word_odds = _odds(found[0], label)
    for k in range(len(GRAMS)):
        model.gram_odds[k] = _odds(found[1 + k], label)
    rows, size = inputs(words, model), len(words)
    del words, found

    first, owner = windows_of(counts)
    ends = np.cumsum(counts)[owner]
    index = np.empty((len(first), WINDOW), np.int32)
    suspicion = np.empty(len(first), np.float32)
    for start in range(0, len(first), WINDOWS_AT_ONCE):
        part = slice(start, start + WINDOWS_AT_ONCE)
        index[part] = _word_of(first[part], ends[part], ids, size)
        suspicion[part] = np.sort(rows[:, 0][index[part]], 1)[:, -2:].sum(1) + rows[:, 2][index[part]].max(1)

    rng = np.random.default_rng(SEED)
    shapes = {"A": (2 * HIDDEN, ATTENTION), "a": (ATTENTION,), "v": (ATTENTION,), "o": (2 * HIDDEN,), "c": (1,)}
    for s in "fb":
        shapes |= {"W" + s: (_INPUTS, 3 * HIDDEN), "U" + s: (HIDDEN, 3 * HIDDEN), "b" + s: (3 * HIDDEN,)}
    w = model.weights = {k: (rng.normal(0, 0.4, d) if len(d) > 1 or k in "vo" else np.zeros(d)).astype(np.float32) for k, d in shapes.items()}
    moment, square, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    toxic = label[owner] == 1
    for turn in range(ROUNDS):
        if turn:
            suspicion = logits(model, rows, index)
        order = np.lexsort((-suspicion, owner))
        worst = order[np.flatnonzero(np.diff(owner[order], prepend=-1))]
        others = np.flatnonzero(~toxic)
        chosen = np.concatenate([worst, rng.choice(others, min(len(others), 2 * len(worst)), replace=False)])
        deck = np.concatenate([rng.permutation(chosen) for _ in range(-(-STEPS * BATCH // len(chosen)))])
        for start in range(0, STEPS * BATCH, BATCH):
            part = deck[start:start + BATCH]
            there = index[part].T != size
            g = _gradients(w, rows[index[part].T], there, toxic[part].astype(np.float32), np.where(toxic[part], 2.0, 1.0).astype(np.float32))
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k, x in g.items():
                x = x * min(1.0, 1.0 / max(norm, 1e-9))
                moment[k] = 0.9 * moment[k] + 0.1 * x
                square[k] = 0.99 * square[k] + 0.01 * x * x
                w[k] -= (RATE * 0.6 ** turn * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return model


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    """Probability that a text is toxic: that of its worst window; 0 for texts without words."""
    words = [words_in(t) for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    scores = np.zeros(len(texts))
    if not counts.sum() or not model.weights:
        return scores
    vocabulary: dict[bytes, int] = {}
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for text in words for w in text), np.int32, int(counts.sum()))
    rows = inputs(list(vocabulary), model)
    first, owner = windows_of(counts)
    ends = np.cumsum(counts)
    for start in range(0, len(first), 1 << 14):
        mine = owner[start:start + (1 << 14)]
        index = _word_of(first[start:start + (1 << 14)], ends[mine], ids, len(vocabulary))
        np.maximum.at(scores, mine, _sigmoid(logits(model, rows, index).astype(float)))
    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All input columns and `score`, the probability (0 to 1) that the document is toxic; one row per input row.

    Whole texts are scored, in overlapping windows. Null texts, and texts without words, score 0, as does everything
    when nothing was learned. Labels and other columns play no part; an input column named `score` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop("score")
    names, place = plain.columns, plain.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col, BATCH_BYTES):
            scores = score_texts(list(byte_texts(batch.column(place))), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, "score"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
