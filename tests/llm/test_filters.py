"""Filter audit and fill-in-middle against plain loops."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import audit, middle

from .cases import SCHEMA, frame, texts


def _mask(text, doc, firsts):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
           bool(re.search(r"[#$%&*|]", t)), doc is not None and firsts.get(t, doc) < doc]
    return sum(1 << k for k, b in enumerate(bad) if b)


def _firsts(rows):
    found = {}
    for i, t in rows:
        if i is not None:
            found[t or ""] = min(i, found.get(t or "", i))
    return found


def _expected(rows, labels):
    """Rows (id, part, mask) walked through every order one document at a time."""
    out = Counter()
    parts = {p for _, p, _ in rows}
    for p in parts:
        mine = [(m, *labels.get(i, (0, 0))) for i, q, m in rows if q == p]
        for order in map("".join, permutations("ABCDE")):
            gone = [False] * len(mine)
            for k, f in enumerate(order):
                bit = 1 << "ABCDE".index(f)
                row = Counter()
                for j, (m, good, bad) in enumerate(mine):
                    if m & bit:
                        row["unique_fails"] += m == bit
                        if gone[j]:
                            row["redundant"] += 1
                        else:
                            gone[j] = True
                            row["removed"] += 1
                            row["good_lost"] += good
                            row["toxic_lost"] += bad
                            out[p, "shapley", f] += 1
                    row["kept"] += not gone[j]
                out[p, order, k + 1] = tuple(row[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))
    return out


@pytest.fixture
def tight(monkeypatch):
    """Short prefixes and small tries, so that small inputs are split and emptied."""
    monkeypatch.setattr(audit, "PREFIX_CHARS", 1)
    monkeypatch.setattr(audit, "TASK_BYTES", 2000)
    monkeypatch.setattr(audit, "SHARE", 50)


@pytest.mark.parametrize("small", [False, True])
def test_masks_and_orders(spark, small, request):
    if small:
        request.getfixturevalue("tight")
    r = random.Random(4)
    rows = texts() + [(200 + i, "the same long beginning of many texts " * 30 + str(i % 7)) for i in range(40)]
    rows += [(300, "CAPITALS ONLY"), (301, "#"), (302, " ".join(f"W{i}" for i in range(150))), (302, "#"), (2, None), (303, "aé"), (304, "aè"), (305, "a")]
    masks = audit.failure_masks(frame(spark, rows).drop("lang").withColumnRenamed("row", "mask").withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("l"), F.col("doc_id") % 3))))
    got = [tuple(x) for x in masks.collect()]
    firsts = _firsts(rows)
    part = lambda i: "" if i is None or i % 3 == 0 else f"l{i % 3 if i >= 0 else -(-i % 3)}"
    want = [(i, part(i), _mask(t, i, firsts)) for i, t in rows]
    assert Counter(got) == Counter(want)
    labels = [(i, r.randrange(2), r.choice([0, 1, None])) for i, _ in rows if i is not None and r.random() < 0.7]
    told = audit.interactions(masks, spark.createDataFrame([*labels, (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    best = {}
    for i, q, x in labels:
        best[i] = (max(q, best.get(i, (0, 0))[0]), max(x or 0, best.get(i, (0, 0))[1]))
    expected = _expected(want, best)
    assert len(told) == 600 * len({p for _, p, _ in want})
    for x in told:
        f = x["filter_order"][x["step"] - 1]
        assert tuple(x[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == expected[x["part"], x["filter_order"], x["step"]]
        assert x["shapley"] == expected[x["part"], "shapley", f]


def test_audit_of_nothing(spark):
    masks = audit.failure_masks(spark.createDataFrame([], SCHEMA))
    assert audit.interactions(masks, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_copies_travel_once_and_prefixes_get_longer(spark, tight):
    rows = [(i, "x" * 500) for i in range(300)] + [(1000 + i, "common beginning " * 20 + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    told = df.selectExpr("doc_id AS doc", "text", "'' AS part").mapInArrow(audit._entries, audit._ROWS)
    entries = told.where("text is not null").select("entry", "least", F.col("text").cast("string").alias("text")).cache()
    assert entries.where("text like 'x%'").count() <= 12
    nodes = audit._by_prefix(entries).groupBy("node").agg(F.countDistinct("text").alias("n")).agg(F.max("n")).first()[0]
    assert nodes <= 111


def test_trie_holds_what_was_put_in():
    r, trie, plain = random.Random(3), audit.Trie(), Counter()
    for _ in range(2000):
        text = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12)))
        trie.terminal(text).append(1)
        plain[text] += 1
    assert {t: len(v) for t, v in trie.terminals()} == plain


def _filled(doc, text):
    t, h = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, t, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}", t
    return doc, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}", t


@pytest.mark.parametrize("block", [7, 1 << 21])
def test_fill_in_middle(spark, monkeypatch, block):
    monkeypatch.setattr(middle, "BLOCK", block)
    r = random.Random(5)
    odd = ["<P>", "a<S>b", "<M", "<", "P>", "<<", "あ\U0001F600<P", "\x00", "é" * 50, "<p>", "S>M>P>", "\U0001F600"]
    rows = texts() + [(1000 + i, "".join(r.choice(odd[2:] if i % 3 else odd) for _ in range(r.randrange(1, 9)))) for i in range(200)]
    rows += [(5000, "long é " * 300_000)]
    done = middle.restore(middle.fill_in_middle(frame(spark, rows)))
    assert done.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = Counter(tuple(x) for x in done.collect())
    assert got == Counter(_filled(i, t) for i, t in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_text_ids_and_nothing(spark):
    df = spark.createDataFrame([("a", "some text", "x"), (None, None, "y")], "id string, body string, output string")
    assert {x["id"] for x in middle.fill_in_middle(df, id_col="id", text_col="body").collect()} == {"a", None}
    assert middle.restore(middle.fill_in_middle(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("output", ["<P>a<S>b", "<P>a<M>b<S>c", "no marks", "<P>a<S>b<M>c<M>"])
def test_damaged_outputs_raise(spark, output):
    with pytest.raises(Exception, match="marks"):
        middle.restore(spark.createDataFrame([("psm", output), ("plain", "<P>")], "form string, output string").coalesce(1)).collect()


def test_moved_is_the_same_block_by_block(monkeypatch):
    starts, shifts = np.array([0, 0, 3, 3, 3, 9]), np.array([5, 1, 7, -2, 4, 0])
    want = [i + shifts[np.searchsorted(starts, i, side="right") - 1] for i in range(12)]
    for block in (1, 2, 5, 100):
        monkeypatch.setattr(middle, "BLOCK", block)
        assert np.concatenate([p for _, p in middle._moved(12, starts, shifts)]).tolist() == want
