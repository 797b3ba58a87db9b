"""Quality rules: counts of words, symbols and repeats, and a hashed n-gram log-likelihood ratio, in built-in expressions.

The ratio is that of two multinomials over hash buckets of one- and two-word n-grams, one counted over trusted texts,
one over the raw corpus. Its mean per n-gram is compared with a threshold learned from the trusted documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framewright.operators.ordered import N, order_rows
from framewright.session import scratch_table

from .common import words_of

#: Hash buckets of the n-grams.
BUCKETS = 10_000
#: Added to every count.
SMOOTHING = 1.0
#: Identifiers that are broadcast to the texts; more of them meet the texts in a shuffle.
BROADCAST_IDS = 1_000_000
#: Ratios that one task numbers.
CHUNK_RATIOS = 20_000
#: A document is kept if its mean log-likelihood ratio is at least this quantile of the trusted documents', less a margin.
TRUSTED_QUANTILE, MARGIN = 0.01, 0.03
#: Threshold where no trusted document says more.
THRESHOLD = -0.12

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50


def _buckets(words: Column, buckets: int) -> Column:
    """Bucket of every word and of every pair of neighbours."""
    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    singles = F.transform(words, lambda w: bucket(w))
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: bucket(F.get(words, i), w))
    return F.concat(singles, pairs)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts of every document: `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`.

    Null and empty texts count as no words and fail. Repeated rows stay; other columns are left out, but `_words` holds
    the words for what follows.
    """
    narrow = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    words, n = F.col("_words"), F.size("_words")
    # hash and place of every window of three words, sorted so that equal windows are neighbours
    windows = F.sort_array(F.transform(
        F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("at"))))

    def same(x: Column, y: Column) -> Column:
        equal = x.h == y.h
        for k in range(3):
            equal = equal & (F.get(words, x.at + k) == F.get(words, y.at + k))
        return F.coalesce(equal, F.lit(False))

    sorted_windows = F.col("_windows")
    repeated = F.sort_array(F.transform(
        F.filter(sorted_windows, lambda x, j: same(x, F.get(sorted_windows, j - 1)) | same(x, F.get(sorted_windows, j + 1))), lambda x: x.at))
    places = F.col("_repeated")
    # a repeated window covers three words, or as many as lie before the next one starts
    covered = F.aggregate(places, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")), lambda acc, at: F.struct(
        (acc.sum + F.least(F.lit(3), at - acc.last)).alias("sum"), at.alias("last"))).sum
    counted = (narrow.withColumn("_words", words_of(F.col("_text")))
               .withColumn("_windows", windows).withColumn("_repeated", repeated))
    result = counted.select(
        "doc_id", "_words", n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"))
    return result.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Identifiers of all documents labelled as good, null ones left out, each once."""
    return labels.where((F.col("quality") == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct()


def _chosen(trusted: DataFrame) -> DataFrame:
    """The trusted identifiers as `_trusted`, broadcast if there are at most BROADCAST_IDS."""
    chosen = trusted.select(F.col("doc_id").alias("_trusted"))
    return F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen


def bucket_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """`bucket` and `weight`, the log-likelihood ratio of trusted against raw texts, for all buckets.

    One aggregation over all documents counts both; it has at most *buckets* rows from each task. Buckets that occur
    nowhere, and those of an empty table, weigh as much as smoothing alone says.
    """
    spark = docs.sparkSession
    # words are cut behind the join, so that a shuffle has the texts alone
    marked = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(_chosen(trusted), F.col("_id") == F.col("_trusted"), "left")
    grams = marked.select(F.col("_trusted").isNotNull().alias("good"), words_of(F.col("_text")).alias("_words")).select(
        "good", F.explode(_buckets(F.col("_words"), buckets)).alias("bucket"))
    # written once, a row per bucket: totals and weights then read it, not the documents
    found = scratch_table(grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("good")), "buckets")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(found, "bucket", "left").fillna(0)
    sums = every.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    share = lambda c: (F.col(c) + SMOOTHING) / (sums.select(c).scalar() + SMOOTHING * buckets)
    return every.select("bucket", (F.log(share("good")) - F.log(share("raw"))).alias("weight"))


def measure(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Base counts and `ratio` of every document, the mean weight of its n-grams (null without words).

    *weights* has one row per bucket; it reaches the documents as one array of fixed length.
    """
    table = weights.agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).weight.alias("w")).scalar()
    counted = base_counts(docs, id_col, text_col).withColumn("_table", table)
    # added up in the order of the n-grams, so that the sum is the same in every run
    total = F.aggregate(_buckets(F.col("_words"), buckets), F.lit(0.0), lambda acc, b: acc + F.get("_table", b))
    return counted.withColumn("ratio", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words") - 1))).drop("_words", "_table")


def learned_threshold(measured: DataFrame, trusted: DataFrame, chunk_rows: int = CHUNK_RATIOS) -> Column:
    """Ratio below which a document is not kept, from the trusted ones that pass the base rules; THRESHOLD without any.

    The quantile is exact, between neighbours in proportion. Ratios are numbered in order, no more than *chunk_rows* by a
    task, and the two neighbours are picked by their numbers.
    """
    good = measured.where(~F.col("base_failed")).join(_chosen(trusted), F.col("doc_id") == F.col("_trusted")).select("ratio")
    ordered = order_rows(good, [], ["ratio"], chunk_rows=chunk_rows, strategy="chunked").df
    place = (ordered.agg(F.count(F.lit(1))).scalar() - 1) * F.lit(TRUSTED_QUANTILE)
    below = F.floor(place)
    value = lambda at: F.max(F.when(F.col(N) == at + 1, F.col("ratio")))
    least = (below + 1 - place) * value(below) + (place - below) * F.coalesce(value(below + 1), value(below)) - MARGIN
    return F.coalesce(ordered.agg(least.alias("least")).scalar(), F.lit(THRESHOLD))


def verdict(measured: DataFrame, threshold: float | Column = THRESHOLD) -> DataFrame:
    """Add `kept`: false where the base rules fail, else whether the ratio reaches the threshold."""
    return measured.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("ratio") >= threshold, F.lit(False)))


def judge(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | Column = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """Base counts, `ratio` and `kept` of every document, at a threshold of the caller's."""
    return verdict(measure(docs, weights, id_col, text_col, buckets), threshold)


def judge_by_trusted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, `ratio` and `kept` of every document; weights and threshold are learned from the trusted ones.

    What was measured is written once, a few numbers per document: the threshold reads it, not the texts.
    """
    trusted = scratch_table(trusted, "trusted")
    measured = scratch_table(measure(docs, bucket_weights(docs, trusted, id_col, text_col), id_col, text_col), "measured")
    return verdict(measured, learned_threshold(measured, trusted))
