"""Substring dedup on bytes, and the suffix ranks it sorts by, against plain loops."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from framewright.llm import sketch, suffixes

from .cases import SCHEMA, frame, texts


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=50), st.sampled_from([1, 2, 3, 4, 9, 10, 100]))
def test_ranks_tell_beginnings_apart(symbols, depth):
    rank = suffixes.difference_cover_ranks(np.array(symbols), depth)
    by_beginning = {}
    for i in range(len(symbols)):
        by_beginning.setdefault(tuple(symbols[i:i + depth]), []).append(rank[i])
    ordered = [by_beginning[b] for b in sorted(by_beginning)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:], strict=False))


def test_ranks_of_numbers_too_large_to_pack():
    r = random.Random(2)
    symbols = [r.choice([1, 5, 2**40, 2**40 + 1]) for _ in range(300)]
    rank = suffixes.difference_cover_ranks(np.array(symbols), 1000)
    assert sorted(range(300), key=lambda i: symbols[i:]) == np.argsort(rank).tolist()


def _expected(rows, window):
    """One row per input row, windows compared as they are."""
    last, first = float("inf"), {}
    data = [(last if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for p in range(len(t) - window + 1):
            w = t[p:p + window]
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = Counter()
    for (i, t), (doc, _) in zip(data, rows, strict=True):
        gone = [False] * len(t)
        for p in range(len(t) - window + 1):
            if first[t[p:p + window]] < (i, p):
                gone[p:p + window] = [True] * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[doc, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)] += 1
    return out


def _rows(seed):
    r = random.Random(seed)
    letters = lambda n, a="abcdefgh ": "".join(r.choice(a) for _ in range(n))
    passage, base = letters(170), letters(700)
    rows = [(500 + k, letters(r.randrange(0, 90)) + passage[r.randrange(0, 60):] + letters(r.randrange(0, 90))) for k in range(12)]
    for k in range(10):  # near copies
        at = r.randrange(700)
        rows.append((600 + k, base[:at] + "#" * r.randrange(3) + base[at + 1:]))
    rows += [(700, "a" * 400), (701, "ab" * 130 + "x" + "ab" * 130), (702, letters(77, "xy") * 5), (703, passage[:99]), (704, passage[:100]),
             (705, "ü" * 120 + passage), (706, ("0123456789" * 9 + "!") * 4), (707, "z" * 101), (708, "z" * 100)]
    # one identifier, the same window at different places in rows of their own
    rows += [(800, "12345" + passage), (800, passage + "6789"), (800, "1234567" + passage), (801, passage), (801, passage), (None, passage), (None, "9" + passage)]
    return rows


@pytest.fixture
def tight(monkeypatch):
    """Small batches, memories and sorts, and hot sequences."""
    for name, value in (("BATCH_BYTES", 300), ("KEPT", 3), ("SEND_BYTES", 2000), ("SORT_BYTES", 500), ("BUCKET_WINDOWS", 3000), ("HOT_COUNT", 5), ("HOT_MEANS", 0)):
        monkeypatch.setattr(suffixes, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_remove_repeated_bytes(spark, small, request):
    if small:
        request.getfixturevalue("tight")
    rows = [(i, t) for i, t in texts() if i != 82] + _rows(3)
    done = suffixes.remove_repeated_bytes(frame(spark, rows).withColumnRenamed("row", "doc").withColumnRenamed("kept", "mark"))
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in done.collect()) == _expected(rows, 100)


@pytest.mark.parametrize("parts", [1, 5])
def test_any_partitioning_gives_the_same(spark, parts):
    rows = _rows(4)
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    done = suffixes.remove_repeated_bytes(df, window=64).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in done) == _expected(rows, 64)


def test_nothing(spark):
    done = suffixes.remove_repeated_bytes(spark.createDataFrame([], SCHEMA))
    assert done.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"] and done.count() == 0


def test_copies_leave_a_task_once(spark):
    rows = [(i, "".join(random.Random(7).choices("abcdef", k=1000))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    told = suffixes.remove_repeated_bytes(df).agg({"n_removed": "sum"}).first()[0]
    assert told == 199 * 1000


def test_least_hashes_fill_the_table():
    """Keys are spread evenly, though a least hash is a small number."""
    data, row = suffixes._joined([bytes(random.Random(1).choices(b"abcdefghij", k=200_000))])
    buckets = np.bincount(sketch.bucket_of(suffixes._runs_of(data, row, 100)[2]) >> (sketch.BITS - 4), minlength=16)
    assert buckets.min() > 0.7 * buckets.mean()
