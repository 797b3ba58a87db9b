"""Exact dedup, the Jaccard join and substring dedup against plain loops."""

import random
import re
from collections import Counter, defaultdict

import pytest

from framewright.llm import components, exact, jaccard, sketch, substring

from .cases import frame, texts


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact_groups(spark):
    rows = texts()
    got = exact.exact_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((i, t))
    best = {k: min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0] for k, g in groups.items()}
    expected = Counter((i, best[plain(t)], len(groups[plain(t)])) for i, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == expected
    # one row of each group stays, repeated rows or not
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert {"lang", "_text", "row"} <= set(got[0].asDict())


def test_exact_groups_of_nothing(spark):
    empty = exact.exact_groups(frame(spark, texts()).where("false"))
    assert empty.count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def tasks_of(spark, group, run):
    """Tasks that *run* takes with 40 shuffle partitions that are not coalesced."""
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    context = spark.sparkContext
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        context.setJobGroup(group, group)
        run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))


def test_components_take_few_tasks(spark):
    # every task passes through the driver: stars, as the second round of the join has them, need one shuffle, and a
    # round has three
    stars = spark.createDataFrame([(i, 100 * (i // 100)) for i in range(1, 400)] + [(7, 0)], "a long, b long").coalesce(1)
    assert 40 <= tasks_of(spark, "stars", lambda: components.components(stars).collect()) < 2 * 40
    path = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long").coalesce(1)
    got = []
    assert tasks_of(spark, "path", lambda: got.extend(components.components(path).collect())) < 12 * 40
    assert {(r.node, r.component) for r in got} == {(i, 1) for i in range(1, 5)}


def test_components_of_many_nodes_shuffle(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (101, 103)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 103: 100}
    nothing = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components.components(nothing).collect() == []


def shingles(text, width):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize(("width", "least"), [(4, 85), (5, 80), (2, 60)])
def test_similar_documents(spark, width, least):
    rows = texts(2)
    got = Counter(tuple(r) for r in jaccard.similar_documents(frame(spark, rows), width, least).collect())
    sets = [(i, shingles(t, width)) for i, t in rows]
    known = [k for k, (i, s) in enumerate(sets) if i is not None and s]
    parent = {k: k for k in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in known:
        for y in known:
            a, b = sets[x][1], sets[y][1]
            if x < y and 100 * len(a & b) >= least * len(a | b):
                parent[find(x)] = find(y)
    smallest = defaultdict(list)
    for k in known:
        smallest[find(k)].append(sets[k][0])
    expected = Counter(
        (i, len(s), min(smallest[find(k)]) if k in parent else i) for k, (i, s) in enumerate(sets))
    assert got == expected


def test_similar_documents_in_a_dense_group(spark):
    """Neighbours alone don't link everything here: the second round must."""
    r = random.Random(5)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(6)):
            w[r.randrange(120)] = f"n{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    sets = [shingles(t, 4) for _, t in rows]
    label = list(range(60))
    for x in range(60):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                a, b = sorted((label[x], label[y]))
                label = [a if v == b else v for v in label]
    got = {r.doc_id: r.component_id for r in jaccard.similar_documents(frame(spark, rows), 4, 85).collect()}
    assert got == dict(enumerate(label)) and 1 < len(set(label)) < 60


@pytest.mark.parametrize("block", [256, 7])
def test_numbers_of_links(spark, monkeypatch, block):
    """Every link counts, in a dense group and between blocks of it, and every document of a class."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "BLOCK_COLUMNS", 50)
    r = random.Random(6)
    rows = texts(2)
    base = [f"t{i}" for i in range(120)]
    for i in range(40):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = f"n{r.randrange(10 ** 6)}"
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000, " ".join(base)), (2000, " ".join([*base, "end"]))]
    documents = {(i, frozenset(shingles(t, 4))) for i, t in rows if i is not None and shingles(t, 4)}
    expected = Counter(
        (i, sum(100 * len(s & x) >= 85 * len(s | x) for _, x in documents) - 1 if i is not None and s else 0)
        for i, s in ((i, shingles(t, 4)) for i, t in rows))
    got = jaccard.similar_documents(frame(spark, rows), 4, 85, links=True).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == expected and max(n for _, n in expected) > 20


def test_similar_documents_of_nothing(spark):
    assert jaccard.similar_documents(frame(spark, texts()).where("false")).count() == 0


def removed(rows, window):
    """Words left and removed, by the rule as it is stated; documents are those with equal identifiers."""
    last = 1 << 70
    first = {}
    split = [(last if i is None else i, [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, (last + 1, 0)), (i, k))
    out = []
    for (i, _), (j, w) in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (j, k):
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize(("window", "hot"), [(20, 4096), (8, 4096), (8, 1)])
def test_remove_repeats(spark, monkeypatch, window, hot):
    monkeypatch.setattr(substring, "HOT_COUNT", hot)
    monkeypatch.setattr(substring, "HOT_MEANS", 0)
    monkeypatch.setattr(substring, "BUCKET_WORDS", 3000)
    rows = texts(4)
    got = Counter(tuple(r) for r in substring.remove_repeats(frame(spark, rows), window).collect())
    expected = removed(rows, window)
    assert got == expected and sum(x[2] for x in expected) > 100


def test_remove_repeats_of_nothing(spark):
    assert substring.remove_repeats(frame(spark, texts()).where("false")).count() == 0


def test_sketch_is_never_below_a_count(spark):
    docs = frame(spark, texts())
    counts = sketch.bucket_counts(docs, "text", substring._mers)
    exact_counts = Counter(x for _, t in texts() for x in sketch.bucket_of(substring._mers([(t or "").encode()])).tolist())
    # sequences that span two texts of a batch only add
    assert all(counts[b] >= n for b, n in exact_counts.items()) and counts.sum() < 2 * sum(exact_counts.values())


def _windows_removed(rows, width):
    """Removed words per row; rows of one identifier are one document, whose earlier place wins."""
    first, data = {}, [(i, (t or "").split()) for i, t in rows]
    for i, w in data:
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            first[k] = min(first.get(k, (i, p)), (i, p))
    out = Counter()
    for i, w in data:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p:p + width])] < (i, p):
                gone[p:p + width] = [True] * width
        out[i, len(w), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    return out


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_the_earlier_place_wins_among_rows_of_one_id(spark, parts):
    r = random.Random(parts)
    words = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    x, lead = words(30), words(40)
    rows = [(7, " ".join(lead + words(4) + x)), (7, " ".join(words(12) + x + words(3))), (7, " ".join(lead[10:] + words(2) + x)),
            (3, " ".join(words(9) + x[:25])), (9, " ".join(x)), (7, " ".join(words(12) + x + words(5)))]
    for k in range(6):
        cut = r.randrange(40)
        rows.append((20 + k % 2, " ".join(words(r.randrange(15)) + lead[cut:] + x[:r.randrange(31)])))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = Counter((g.doc_id, g.n_words, g.kept) for g in substring.remove_repeats(df).collect())
    assert got == _windows_removed(rows, 20)


def test_wide_sketches_never_exceed_the_difference():
    import numpy as np

    r = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(r.integers(0, 2**63, r.integers(0, 600)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < r.random()], r.integers(0, 2**63, r.integers(0, 300)).astype(np.uint64)]))
        difference = len(np.setxor1d(a, b))
        assert jaccard._apart_by(jaccard._wide_parity(a), jaccard._wide_parity(b)) <= difference
    assert jaccard._apart_by(jaccard._wide_parity(a), jaccard._wide_parity(a)) == 0


def test_pairs_are_met_about_once(spark, monkeypatch):
    """Rows of the join grow with the pairs that may link, not with the shingles that these share."""
    r = random.Random(1)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for k in range(30):  # more than half in common, and too far from each other to link
        w = list(base)
        for at in r.sample(range(400), 16):
            w[at] = f"n{k}-{at}"
        rows.append((k, " ".join(w)))
    seen = []
    real = jaccard._not_too_far
    monkeypatch.setattr(jaccard, "_not_too_far", lambda pairs, *args: (seen.append(pairs), real(pairs, *args))[1])
    got = jaccard.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.component_id for x in got.collect()} == set(range(30))
    joined = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "e1#" in joined and seen[0].count() <= 30 * 29 // 2
