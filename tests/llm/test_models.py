"""Language identification and toxicity: held-out accuracy, gradients, odd rows; the pipeline against plain loops."""

import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import jaccard, langid, queries, toxicity
from framewright.llm.common import held_out, learned_from, read

from .cases import frame, texts
from .test_pairs import plain, shingles

ROOT = "/root/testdata/sf0.01"


def test_language_is_found_in_held_out_documents(spark):
    got = queries.op1_language_id(spark, ROOT).toPandas().set_index("doc_id")
    truth = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang", "text").toPandas().set_index("doc_id")
    joined = got.join(truth)
    letters = joined.text.str.contains(r"[^\W\d_]", na=False)
    tested = joined[joined.held_out & letters & joined.lang.notna()]
    assert len(joined) == len(truth) and len(tested) > 200 and (tested.lang_pred == tested.lang).mean() > 0.97
    assert (joined.lang_pred[~letters] == "und").all() and joined.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    rows = texts()
    docs = frame(spark, rows)
    model = langid.fit(read(spark, ROOT, "documents").where(learned_from(queries.F.col("doc_id"))))
    got = langid.predict(docs, model).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    one = langid.score([b"", b"12 34 !?", "der die das Straße und nicht".encode()], model)
    assert one[0][:2] == ["und", "und"] and list(one[1][:2]) == [0, 0] and one[0][2] == "de"
    nothing = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.where("false"), model).count() == 0


def test_language_counts_are_those_of_a_loop(spark):
    docs = read(spark, ROOT, "documents").limit(150)
    rows = docs.collect()
    model = langid.fit(spark.createDataFrame(rows, docs.schema).repartition(5))
    for k, lang in enumerate(model.languages):
        counts = np.zeros(langid.BUCKETS)
        for r in rows:
            if r["lang"] == lang:
                for buckets, _ in langid.sparse_rows([(r["text"] or "").encode()])[0]:
                    counts += np.bincount(buckets, minlength=langid.BUCKETS)
        expected = np.log((counts + langid.SMOOTHING) / (counts + langid.SMOOTHING).sum())
        assert np.allclose(model.weights[k], expected)


def planted(n, seed):
    r = random.Random(seed)
    clean = [f"{a}{b}" for a in ("er", "th", "on", "in", "st") for b in ("ing", "ly", "ou", "nd", "tion", "ha")]
    bad = [f"vequ{b}" for b in ("a", "ing", "ou", "tion", "ha", "le", "re", "ment")]
    out = []
    for i in range(n):
        label = i % 4 == 0
        words = [r.choice(clean) for _ in range(r.randrange(3, 400))]
        if label:
            for _ in range(1 + len(words) // 60):
                words[r.randrange(len(words))] = r.choice(bad)
        out.append((" ".join(words).encode(), int(label)))
    return out


def test_toxicity_learns_word_families():
    model = toxicity.train(planted(500, 1))
    test = planted(300, 2)
    scores, label = toxicity.score_texts([t for t, _ in test], model), np.array([y for _, y in test])
    assert ((scores >= 0.7) == label).mean() > 0.97
    # words never seen, with a known beginning, inside a long text: every window is scored
    long_ = " ".join(["string", "erly", "thou"] * 3000).encode()
    unseen = long_ + b" vequxyz vequzzz " + long_
    assert toxicity.score_texts([long_], model)[0] < 0.7 <= toxicity.score_texts([unseen], model)[0]
    assert list(toxicity.score_texts([b"", b" !! "], model)) == [0, 0]


def test_gradients_are_those_of_differences(monkeypatch):
    rng = np.random.default_rng(0)
    shapes = {"A": (16, 8), "a": (8,), "v": (8,), "o": (16,), "c": (1,)} | {k + s: d for s in "fb" for k, d in (("W", (toxicity._INPUTS, 24)), ("U", (8, 24)), ("b", (24,)))}
    w = {k: rng.normal(0, 0.3, d) for k, d in shapes.items()}
    x, there = rng.normal(size=(7, 5, toxicity._INPUTS)), np.arange(7)[:, None] < np.array([7, 3, 1, 5, 7])
    label, weight = np.array([1.0, 0, 1, 0, 1]), np.array([2.0, 1, 2, 1, 2])

    def loss():
        read = [toxicity._read(w, s, given @ w["W" + s] + w["b" + s], False)[0] for s, given in (("f", x), ("b", x[::-1]))]
        out = toxicity._pool(w, np.concatenate([read[0], read[1][::-1]], 2), there)[0]
        return float((weight * (np.logaddexp(0, out) - label * out)).sum() / weight.sum())

    gradients = toxicity._gradients(w, x, there, label, weight)
    assert set(gradients) == set(w)
    for name, value in w.items():
        for place in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(4)]:
            old, step = value[place], 0.02
            value[place] = old + step
            up = loss()
            value[place] = old - step
            slope = (up - loss()) / (2 * step)
            value[place] = old
            assert abs(slope - gradients[name][place]) < 2e-3 + 0.03 * abs(slope), name


def test_windows_cover_every_word():
    counts = np.array([0, 1, 63, 64, 65, 200, 1000])
    first, owner = toxicity.windows_of(counts)
    starts = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        seen = {f - starts[d] + j for f in first[owner == d] for j in range(toxicity.WINDOW)}
        assert set(range(n)) <= seen and (n < toxicity.WINDOW or max(seen) == n - 1)
        assert not n or min(seen) == 0


def test_toxicity_of_odd_rows(spark):
    rows = texts()
    docs = frame(spark, rows)
    got = toxicity.score(docs, toxicity.train(planted(200, 1))).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in got) and "keep_id" in got[0].asDict()
    assert all(r["score"] == 0 for r in got if not plain(r["text"]))
    nothing = toxicity.train([])
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0}
    labels = spark.createDataFrame([(i, 1, k % 2) for k, (i, _) in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert {r["label"] for r in toxicity.sample(docs, labels).collect()} == {0, 1}
    assert toxicity.fit(docs, labels.where("false")).weights == {} and toxicity.fit(docs, labels).weights


def test_toxicity_of_held_out_documents(spark):
    root = "/root/testdata/sf0.1"
    got = queries.op2_toxicity(spark, root).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{root}/labels.parquet").toPandas().set_index("doc_id")
    tested = got[got.held_out].join(labels, how="inner")
    order = tested.score.rank()
    toxic = tested.toxic == 1
    area = (order[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert len(got) == 10_000 and area > 0.9 and (tested.predicted[~toxic]).mean() < 0.05


def test_stages_of_the_pipeline(spark):
    root = "/root/testdata/sf0.001"
    docs = read(spark, root, "documents")
    rows = docs.collect()
    toxic, exact, near, mix, encode = [f for _, f in corpus_pipeline.STAGES]
    calm = toxic(spark, docs, root)
    assert calm.columns == docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in read(spark, root, "labels").collect()}
    kept = {r["doc_id"] for r in calm.collect()}
    clean = [i for i, y in labels.items() if not y]
    assert len(kept & set(clean)) > 0.85 * len(clean)

    best = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        best.setdefault(plain(r["text"]), r)
    single = exact(spark, docs, root)
    assert single.columns == docs.columns and sorted(single.collect()) == sorted(best.values())

    sets = {r["doc_id"]: shingles(r["text"], 5) for r in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    apart = near(spark, docs, root)
    assert apart.columns == docs.columns and jaccard.LEAST == 80
    assert sorted(apart.collect()) == sorted(r for r in rows if label[r["doc_id"]] == r["doc_id"])

    mixed = mix(spark, docs, root)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(rows)
    done = encode(spark, docs, root).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in done} == {r["doc_id"]: len(r["ids"]) for r in done} and len(done) == len(rows)


def test_pipeline_bears_odd_rows(spark):
    docs = frame(spark, texts())
    for table in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = spark.createDataFrame(stage(spark, table, "/root/testdata/sf0.001").collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, table, "/root/testdata/sf0.001").count() == table.count()


def test_queries_equal_their_sql(spark):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{ROOT}/{table}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, ROOT)
        columns = sorted(got.columns)
        expected = db.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(expected), name


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (None, *range(300))], "doc_id long")
    rows = df.select("doc_id", held_out(df.doc_id).alias("h"), learned_from(df.doc_id).alias("l")).collect()
    assert all(r["h"] != r["l"] for r in rows if r["doc_id"] is not None) and not (rows[0]["h"] or rows[0]["l"])


def test_long_labelled_texts_teach_too(spark):
    """Toxic labels on long texts only: they are sampled by parts; with nothing to learn from, fitting says so."""
    r = random.Random(2)
    clean = [f"good{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices([*clean, "vile", "nasty"], k=5000))) for i in range(20)] + [(100 + i, " ".join(r.choices(clean, k=50))) for i in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in docs], "doc_id long, toxic int")
    found = toxicity.sample(df, labels).collect()
    assert len(found) == 40 and max(len(x.text) for x in found) <= toxicity.SAMPLE_CHARS + toxicity.SAMPLE_PARTS
    model = toxicity.fit(df, labels)
    assert model.weights
    scores = toxicity.score_texts([b"vile nasty good1 vile nasty", b"good1 good2 good3"], model)
    assert scores[0] > scores[1]
    with pytest.raises(ValueError, match="one class"):
        _one_class(spark)


def _one_class(spark):
    """Both classes are labelled, but the only sampled toxic identifier has an empty text beside one with words."""
    docs = spark.createDataFrame([(1, ""), (2, "vile words"), (3, "good words")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    before, toxicity.SAMPLE_ROWS = toxicity.SAMPLE_ROWS, 1
    try:
        first = labels.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").first().doc_id
        texts = docs.withColumn("text", F.when(F.col("doc_id") == first, F.lit("")).when(F.col("doc_id") < 3, F.lit("vile words")).otherwise(F.col("text")))
        toxicity.fit(texts, labels)
    finally:
        toxicity.SAMPLE_ROWS = before


def test_training_needs_little_memory(monkeypatch):
    """Many different words: what training holds beside its inputs stays a small multiple of the texts."""
    r = random.Random(3)
    examples = [(" ".join("".join(r.choices("abcdefghijkl", k=9)) for _ in range(400)).encode(), i % 2) for i in range(400)]
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    monkeypatch.setattr(toxicity, "STEPS", 1)
    toxicity.train(examples[:4])
    tracemalloc.start()
    try:
        model = toxicity.train(examples)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.weights and peak < 40 * sum(len(t) for t, _ in examples)


def test_blocks_of_words_change_no_input(monkeypatch):
    model = toxicity.train(planted(200, 1))
    words = sorted({w for t, _ in planted(200, 2) for w in toxicity.words_in(t)})
    whole = toxicity.inputs(words, model)
    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 7)
    assert len(words) > 7 and np.array_equal(toxicity.inputs(words, model), whole)


def test_toxicity_stage_takes_the_text_once(spark, monkeypatch):
    """The text goes to Python in one column only; all columns and odd rows come back in order as they were."""
    docs = frame(spark, texts())
    seen, score = [], toxicity.score
    monkeypatch.setattr(toxicity, "fit", lambda *_: toxicity.train([]))
    monkeypatch.setattr(toxicity, "score", lambda df, model: (seen.append(df.schema), score(df, model))[1])
    calm = corpus_pipeline.drop_toxic(spark, docs, ROOT)
    assert calm.columns == docs.columns and calm.dtypes == docs.dtypes
    assert "text" in seen[0].names and "text" not in seen[0]["row"].dataType.names
    assert sorted(map(repr, calm.collect())) == sorted(map(repr, docs.collect()))
