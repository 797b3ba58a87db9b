"""One query per operator over its whole table, with the same result in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.session import scratch_path

from . import audit, bpe, exact, jaccard, langid, lm, middle, mixing, quality, substring, suffixes, toxicity, warc
from .common import held_out, learned_from, read

#: Target weights of the sources; all others share OTHER_SOURCES.
SOURCE_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05}
OTHER_SOURCES = 0.55
MIX_SEED = "mix-2"

#: Score from which a document counts as toxic.
TOXIC = 0.7

#: Date in the records of the archive.
ARCHIVE_DATE = "2024-01-01T00:00:00Z"


def op1_language_id(spark: SparkSession, root: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    docs = read(spark, root, "documents")
    model = langid.fit(docs.where(learned_from(F.col("doc_id"))))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_toxicity(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity of every document, learned from a bounded sample of the labels of two thirds of them."""
    docs, labels = read(spark, root, "documents"), read(spark, root, "labels")
    model = toxicity.fit(docs, labels.where(learned_from(F.col("doc_id"))))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op3_source_mix(spark: SparkSession, root: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a global random order."""
    return mixing.mix(read(spark, root, "documents"), SOURCE_WEIGHTS, OTHER_SOURCES, seed=MIX_SEED)


OP3_SQL = f"""
WITH named(s, w) AS (VALUES {", ".join(f"('{s}', {w})" for s, w in SOURCE_WEIGHTS.items())}, (NULL, {OTHER_SOURCES})),
d AS (
  SELECT documents.*, named.s,
         (('0x' || substr(md5('{MIX_SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5) / 16.0::DOUBLE ** 13 AS u
  FROM documents LEFT JOIN named ON source = named.s
), c AS (SELECT s, count(*) AS n FROM d GROUP BY s),
r AS (
  SELECT c.s, sum(n) OVER () * w / sum(w) OVER () / n AS rate
  FROM c JOIN named ON c.s IS NOT DISTINCT FROM named.s WHERE w > 0
), p AS (
  SELECT s, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS below
  FROM r, range(0, 200) AS t(k)
), steps AS (SELECT s, list(below ORDER BY k) AS steps FROM p GROUP BY s)
SELECT doc_id, text, lang, source, n_chars, unnest(range(len(list_filter(steps, lambda x: x < u)))::INT[]) AS copy
FROM d JOIN steps ON d.s IS NOT DISTINCT FROM steps.s
"""


def op4_archive(spark: SparkSession, root: str) -> DataFrame:
    """A record per page, written to an archive and read back."""
    path = scratch_path(spark, "archive")
    warc.write_archive(read(spark, root, "pages"), path, ARCHIVE_DATE)
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    back = warc.read_archive(spark, path)
    return back.select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
        F.sha2("record", 256).alias("record_sha256"), F.col("payload_digest").alias("stored_digest"))


OP4_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
g AS (
  SELECT *, octet_length(body) AS payload_bytes,
         CASE WHEN octet_length(body) >= {warc.LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY body) END AS first_id,
         CASE WHEN octet_length(body) >= {warc.LEAST_BYTES} THEN max_by(url, page_id) OVER (PARTITION BY body) END AS first_url
  FROM p
), t AS (SELECT *, coalesce(page_id < first_id, false) AS again FROM g),
h AS (
  SELECT *, '{warc.VERSION}' || chr(13) || chr(10)
    || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Date: {ARCHIVE_DATE}' || chr(13) || chr(10)
    || coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), '')
    || 'WARC-Payload-Digest: sha1:' || sha1(body) || chr(13) || chr(10)
    || CASE WHEN again THEN 'WARC-Profile: {warc.REVISIT_PROFILE}' || chr(13) || chr(10)
         || 'WARC-Refers-To: <urn:page:' || first_id || '>' || chr(13) || chr(10)
         || coalesce('WARC-Refers-To-Target-URI: ' || first_url || chr(13) || chr(10), '') ELSE '' END
    || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
    || 'Content-Length: ' || CASE WHEN again THEN 59 ELSE 59 + payload_bytes END || chr(13) || chr(10) || chr(13) || chr(10)
    || 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
    || chr(13) || chr(10) AS header
  FROM t
)
SELECT page_id, payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to,
       sha256(encode(header) || CASE WHEN again THEN ''::BLOB ELSE body END || encode(chr(13) || chr(10) || chr(13) || chr(10))) AS record_sha256,
       'sha1:' || sha1(body) AS stored_digest
FROM h
"""


def op5_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    """Base counts and verdict of every document; good labels say what is trusted, and from which ratio texts are kept."""
    docs = read(spark, root, "documents")
    return quality.judge_by_trusted(docs, quality.trusted_ids(read(spark, root, "labels"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op6_lm_score(spark: SparkSession, root: str) -> DataFrame:
    """Stupid-backoff score of every document under the trigrams of all of them."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    scores = lm.score(read(spark, root, "documents"), ranks, public_tokenizers.PATTERN)
    return scores.select("doc_id", "n_tokens", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_jaccard_join(spark: SparkSession, root: str) -> DataFrame:
    """Links of documents whose sets of four-word shingles have a similarity of 0.85 at least: their numbers and components."""
    return jaccard.similar_documents(read(spark, root, "documents"), width=4, least=85, links=True)


def op8_bpe(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document, and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(read(spark, root, "documents"), ranks, public_tokenizers.PATTERN)
    both = bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.concat_ws(" ", F.col("ids").cast("array<string>")), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Documents without the passages of twenty words or more that stand earlier somewhere."""
    done = substring.remove_repeats(read(spark, root, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    docs = read(spark, root, "documents").select(
        "doc_id", "text", F.sha2(F.encode(exact.normalised(F.col("text")), "UTF-8"), 256).alias("text_sha256"))
    return exact.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS plain
  FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY plain) AS group_size,
         first_value(doc_id) OVER (PARTITION BY plain ORDER BY points DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(plain) AS text_sha256 FROM g
"""


def op11_filter_audit(spark: SparkSession, root: str) -> DataFrame:
    """What five filters remove at every step of all their orders, per language."""
    return audit.interactions(audit.failure_masks(read(spark, root, "documents")), read(spark, root, "labels"))


OP11_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), fails AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) THEN 16 ELSE 0 END AS mask
  FROM words
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels GROUP BY doc_id
), masks AS (
  SELECT part, mask, count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad
  FROM fails LEFT JOIN l USING (doc_id) GROUP BY part, mask
), f(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON a.bit <> b.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit)
  JOIN f e ON a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) AS s(step)
), told AS (
  SELECT part, filter_order, step, own, docs, good, bad, mask, (mask & own) > 0 AS fails, (mask & earlier) = 0 AS here FROM masks, steps
), sums AS (
  SELECT part, filter_order, step, own,
         sum(CASE WHEN here AND NOT fails THEN docs ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN here AND fails THEN docs ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN NOT here AND fails THEN docs ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN mask = own THEN docs ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN here AND fails THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN here AND fails THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM sums
"""


def op12_fill_in_middle(spark: SparkSession, root: str) -> DataFrame:
    """Documents with their middle moved to the end, and what is restored from them, as digests."""
    done = middle.restore(middle.fill_in_middle(read(spark, root, "documents")))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), e AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM e
), p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def op13_suffix_array_dedup(spark: SparkSession, root: str) -> DataFrame:
    """Documents without the byte strings of a hundred bytes or more that stand earlier somewhere."""
    done = suffixes.remove_repeated_bytes(read(spark, root, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_source_mix": op3_source_mix,
    "op4_archive": op4_archive,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_score": op6_lm_score,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLES: dict[str, str] = {
    "op3_source_mix": OP3_SQL,
    "op4_archive": OP4_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
