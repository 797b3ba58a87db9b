"""Encoding, archive, quality rules, mixing and language-model scores against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from framewright.llm import bpe, lm, mixing, quality, queries, warc
from framewright.llm.common import held_out, learned_from, read
from framewright.session import scratch_path

from .cases import frame, texts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def words(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]


def test_encode_and_decode(spark):
    codec = bpe.encoding(RANKS, PATTERN)
    rows = texts() + [(100, "<|endoftext|> it's 'sure' 12a²b  \n\n x")]
    both = bpe.decode(bpe.encode(frame(spark, rows), RANKS, PATTERN), RANKS, PATTERN).collect()
    expected = Counter((i, tuple(codec.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert Counter((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in both) == expected


def test_pieces_don_t_change_ids():
    codec, r = bpe.encoding(RANKS, PATTERN), random.Random(2)
    marks = ["a", "Z", "é", "9", "²", " ", "  ", "\n", "\t", "'s", "'ll", "'", "-", "_", " ", "あ", "\U0001F600", "\x1c", "word", "</"]
    for _ in range(300):
        text = "".join(r.choice(marks) for _ in range(r.randrange(1, 60)))
        for size in (1, 2, 7, 20):
            parts = list(bpe.pieces(text, size))
            assert "".join(parts) == text
            assert [x for p in parts for x in codec.encode_ordinary(p)] == codec.encode_ordinary(text)
    assert len(list(bpe.pieces("word " * 50_000))) > 3
    assert isinstance(codec, tiktoken.Encoding)


def test_archive(spark):
    long_, longer = "<p>" + "é" * 600, "<p>" + "x" * 5000
    pages = [(1, "http://a", long_), (2, "http://b\r\nX: y", long_), (3, None, long_), (4, "http://c", "short"), (5, "http://d", "short"),
             (6, "u", None), (7, "u", ""), (8, "u", longer), (8, "u", longer), (9, "u", "a\r\nWARC-Type: revisit\r\n"), (None, "u", longer), (None, None, longer)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, sha256 string, record string").repartition(3)
    path = scratch_path(spark, "archive-test")
    warc.write_archive(df, path, "2024-01-01T00:00:00Z")
    got = warc.read_archive(spark, path).collect()
    bodies = [(p, (h or "").encode()) for p, _, h in pages]
    most = {b: max((p for p, x in bodies if x == b and p is not None), default=None) for _, b in bodies}
    expected = Counter()
    for p, b in bodies:
        again = len(b) >= 1000 and most[b] is not None and p != most[b]
        expected[(p, b, "revisit" if again else "response", f"<urn:page:{most[b]}>" if again else None)] += 1
    assert Counter((r["page_id"], bytes(r["payload"]), r["record_type"], r["refers_to"]) for r in got) == expected
    for r in got:
        head, _, block = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert int(fields["Content-Length"]) == len(block) - 4
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r["payload"])).hexdigest()
        assert (bytes(r["payload"]) in block) or r["record_type"] == "revisit"
    assert spark.read.parquet(f"{path}/payloads").count() == len(most)


def test_archive_notices_damage(spark):
    path = scratch_path(spark, "archive-test")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path, "d")
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "encode('other', 'UTF-8') AS payload").write.parquet(f"{path}-2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}-2/headers")
    with pytest.raises(Exception, match="doesn't match its digest"):
        warc.read_archive(spark, f"{path}-2").collect()


def test_archive_of_nothing(spark):
    path = scratch_path(spark, "archive-test")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path, "d")
    assert warc.read_archive(spark, path).count() == 0


def base(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    three = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if three[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_quality_rules(spark):
    rows = texts() + [(200, "a b\na b\n \n\t\nc\r\nc\r\n"), (201, "x y z x y z " * 20), (202, "<b> #1 *$%&|")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, quality.bucket_weights(docs, quality.trusted_ids(labels)), threshold=-0.05).collect()

    def buckets(text):
        w = [x.encode() for x in words(text)]

        def h(*parts):
            seed = 42
            for p in parts:
                seed = xxhash.xxh64_intdigest(p, seed)
            return (seed - (1 << 64) if seed >> 63 else seed) % quality.BUCKETS

        return [h(x) for x in w] + [h(x, y) for x, y in zip(w, w[1:], strict=False)]

    raw, good = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i is not None and i % 2 == 0:
            good.update(buckets(t))
    weight = lambda b: (math.log((good[b] + 1) / (good.total() + quality.BUCKETS)) - math.log((raw[b] + 1) / (raw.total() + quality.BUCKETS)))
    expected = Counter()
    for i, t in rows:
        counts, b = base(t), buckets(t)
        ratio = sum(map(weight, b)) / len(b) if b else None
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        expected[(i, *counts, failed, not failed and ratio >= -0.05, None if ratio is None else round(ratio, 8))] += 1
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert Counter((*[r[x] for x in names], None if r["ratio"] is None else round(r["ratio"], 8)) for r in got) == expected
    assert 0 < sum(r["kept"] for r in got) < len(got)


def test_quality_verdict_on_labels(spark):
    """Bad documents go and good ones stay, but for a few; on labels that nothing was learned from, too."""
    def wrong(judged, labels):
        false = F.avg((F.col("kept") != (F.col("quality") == 1)).cast("int"))
        return judged.where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(false.alias("share"))

    root = "/root/testdata/sf0.01"
    found = {r.quality: r.share for r in wrong(queries.op5_quality_rules(spark, root), read(spark, root, "labels")).collect()}
    assert found == {0: 0, 1: 0}
    root = "/root/testdata/sf0.1"
    docs, labels = read(spark, root, "documents"), read(spark, root, "labels")
    trusted = quality.trusted_ids(labels.where(learned_from(F.col("doc_id"))))
    unseen = {r.quality: r.share for r in wrong(quality.judge_by_trusted(docs, trusted), labels.where(held_out(F.col("doc_id")))).collect()}
    assert unseen[0] < 0.02 and unseen[1] < 0.002


def test_quality_rules_of_nothing(spark):
    docs = frame(spark, texts()).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs, quality.bucket_weights(docs, quality.trusted_ids(labels))).count() == 0


def test_every_good_label_is_trusted(spark, monkeypatch):
    """More good documents than any sample had; ids that are broadcast and ids that are shuffled weigh the same."""
    labels = spark.range(30_000).selectExpr("id AS doc_id", "1 AS quality")
    assert quality.trusted_ids(labels.unionByName(labels)).count() == 30_000
    docs = frame(spark, texts())
    both = []
    for most in (quality.BROADCAST_IDS, 1):
        monkeypatch.setattr(quality, "BROADCAST_IDS", most)
        both.append({r.bucket: r.weight for r in quality.bucket_weights(docs, quality.trusted_ids(labels)).collect()})
    assert both[0] == both[1] and any(both[0].values())


def test_threshold_is_the_exact_quantile(spark):
    r = random.Random(7)
    ratios = [r.choice([r.random(), 0.25]) for _ in range(1234)]
    measured = spark.createDataFrame([(i, x, i % 5 == 0) for i, x in enumerate(ratios)], "doc_id long, ratio double, base_failed boolean")
    ids = spark.range(1000).withColumnRenamed("id", "doc_id")
    used = sorted(x for i, x in enumerate(ratios) if i < 1000 and i % 5)
    at = (len(used) - 1) * quality.TRUSTED_QUANTILE
    want = used[int(at)] + (at - int(at)) * (used[int(at) + 1] - used[int(at)]) - quality.MARGIN
    for chunk_rows in (100, 10_000):
        got = spark.range(1).select(quality.learned_threshold(measured, ids, chunk_rows)).first()[0]
        assert math.isclose(got, want, rel_tol=1e-12)
    assert spark.range(1).select(quality.learned_threshold(measured, ids.where("false"))).first()[0] == quality.THRESHOLD


def test_mixing(spark):
    rows = texts()
    docs = frame(spark, rows)
    weights = {"src0": 3.0, "src1": 0.0, "absent": 5.0}
    got = mixing.mix(docs, weights, other=1.0, epochs=2.0, seed="s", id_col="doc_id").collect()
    named = [(i, r["source"] if r["source"] in weights else None) for r in docs.collect() for i in [r["doc_id"]]]
    n = Counter(s for _, s in named)
    target = {"src0": 0.75, "src1": 0.0, None: 0.25}
    expected = Counter()
    for i, s in named:
        u = (int(hashlib.md5(f"s:{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 16 ** 13
        rate, k, below = 2 * len(rows) * target[s] / n[s], 0, 0.0
        while u > (below := below + (math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate else 1.0)):
            expected[(i, k)] += 1
            k += 1
    assert Counter((r["doc_id"], r["copy"]) for r in got) == expected
    keys = [hashlib.md5(f"s:order:{'' if r['doc_id'] is None else r['doc_id']}:{r['copy']}".encode()).hexdigest() for r in got]
    assert keys == sorted(keys) and "keep_id" in got[0].asDict()


def test_mixing_meets_its_shares(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "CASE WHEN id % 10 < 7 THEN 'big' ELSE 'small' END AS source")
    got = {r["source"]: r["count"] for r in mixing.mix(docs, {"big": 0.2, "small": 0.8}, 0.0).groupBy("source").count().collect()}
    assert abs(got["big"] - 4000) < 300 and abs(got["small"] - 16_000) < 600


def test_mixing_of_nothing(spark):
    assert mixing.mix(frame(spark, texts()).where("false"), {"src0": 1.0}, 1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, texts()), {"src0": -1.0}, 1.0)


@pytest.mark.parametrize("bucket", [4_000_000, 300])
def test_lm_scores(spark, monkeypatch, bucket):
    monkeypatch.setattr(lm, "BUCKET_TOKENS", bucket)
    codec, rows = bpe.encoding(RANKS, PATTERN), texts()
    sequences = [[t for w in words(x) for t in codec.encode_ordinary(" " + w)] for _, x in rows]
    ones, twos, threes = Counter(), Counter(), Counter()
    for s in sequences:
        s = [-1, -1, *s]
        ones.update(s)
        twos.update(zip(s, s[1:], strict=False))
        threes.update(zip(s, s[1:], s[2:], strict=False))
    total = sum(map(len, sequences))

    def log_score(s):
        s, out = [-1, -1, *s], 0.0
        for u, v, w in zip(s, s[1:], s[2:], strict=False):
            if threes[u, v, w] >= 2:
                out += math.log(threes[u, v, w] / twos[u, v])
            elif twos[v, w] >= 2:
                out += math.log(0.4 * twos[v, w] / ones[v])
            else:
                out += math.log(0.16 * ones[w] / total)
        return out

    expected = Counter((i, len(s), round(log_score(s), 5)) for (i, _), s in zip(rows, sequences, strict=True))
    got = lm.score(frame(spark, rows), RANKS, PATTERN).collect()
    assert Counter((r["doc_id"], r["n_tokens"], round(r["log_score"], 5)) for r in got) == expected
    assert all((r["mean_log_score"] is None) == (r["n_tokens"] == 0) for r in got)


def test_lm_scores_of_nothing(spark):
    assert lm.score(frame(spark, texts()).where("false"), RANKS, PATTERN).count() == 0
    assert lm.score(frame(spark, [(1, None), (2, "")]), RANKS, PATTERN).count() == 2


def test_a_rare_source_with_a_high_rate(spark):
    """The plan stays small, copies are numbered from 0, and their number is near the mean."""
    import time

    rows = [(1, "rare", "a", "b", "c")] + [(i, "common", "a", "b", "c") for i in range(2, 400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, _draw string, _times string, row string")
    start = time.time()
    out = mixing.mix(df, {"rare": 0.5}, 0.5, epochs=300.0)
    assert mixing.rates(df, {"rare": 0.5}, 0.5, 300.0)["rare"] > 50_000 and time.time() - start < 30
    assert out.columns == ["doc_id", "source", "_draw", "_times", "row", "copy"]
    copies = [r["copy"] for r in out.where("source = 'rare'").select("copy").collect()]
    assert sorted(copies) == list(range(len(copies))) and abs(len(copies) - 59_850) < 1500


@pytest.mark.parametrize("mean", [0.3, 49.0, 51.0, 400.0])
def test_draws_have_the_mean(spark, mean):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    n = mixing.mix(df, {"s": 1.0}, 0.0, epochs=mean).count() / 400
    assert abs(n - mean) < 5 * math.sqrt(mean / 400)
