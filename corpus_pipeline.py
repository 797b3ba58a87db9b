"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Toxic documents go, then exact copies, then near copies; what is left is repeated to the target weights of its sources in
a global random order, and encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from framewright.llm import bpe, exact, jaccard, mixing, toxicity
from framewright.llm.common import learned_from, read
from framewright.session import broadcast_if_small, scratch_path, scratch_table

#: Documents with this toxicity or more go.
TOXIC = 0.7
#: Target weights of the sources; all others, and null, share OTHER_SOURCES. One copy per document on average.
SOURCE_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05}
OTHER_SOURCES = 0.55
MIX_SEED = "pipeline"
RANKS = "byte_bpe_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, with all their columns; those without words stay."""
    labels = read(spark, sf_dir, "labels").where(learned_from(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    others = F.struct(*[docs[c] for c in docs.columns if c != "text"])  # the text goes to Python and back only once
    judged = toxicity.score(docs.select("text", others.alias("row")), model).where(F.col("score") < TOXIC)
    return judged.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, the longest, then the one with the smallest doc_id."""
    marked = exact.exact_groups(docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row")))
    return marked.where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (five-word shingles, similarity 0.8), the document with the smallest doc_id.

    Documents without words or without doc_id stay; rows that repeat a doc_id stay or go together.
    """
    near = jaccard.similar_documents(docs, width=jaccard.WIDTH, least=jaccard.LEAST)
    gone = near.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(broadcast_if_small(scratch_table(gone, "near-copies")), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weight of its source asks for, shuffled globally."""
    rows = docs.select("doc_id", "source", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return mixing.mix(rows, SOURCE_WEIGHTS, OTHER_SOURCES, seed=MIX_SEED).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`doc_id`, `n_tokens` and `ids` of every copy, in the order of the mix."""
    ids = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: SQL expresses neither the network nor the encoding; the tests compare the stages with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents below *sf_dir*."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
