"""Exact dedup by progressive refinement: length, then prefix hash, then full hash, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framewright.session import scratch_table

from .common import SPACES

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACES}+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Mark one row of every group of equal normalised texts: `keep_id`, `group_size` and `kept` for each row.

    Lengths that occur once drop out first, then (length, prefix hash) pairs that occur once; only rows that survive
    both have their full content hashed (SHA-256). Of a group stays the row with the most characters in the original
    text, then the smallest identifier; a null identifier loses against any other, and of rows that tie in all that any
    one stays. Null and empty texts, and texts of white space only, form one group. Columns of the input besides the text stay, except those
    named like a result; the output has one row per input row.

    Copies only meet as counts, which are combined before they are shuffled, and in joins with one row per key on
    the other side, whose skewed partitions adaptive execution splits. Texts move once, to meet the surviving keys.
    """
    results = {"keep_id", "group_size", "kept"}
    extra = [c for c in docs.columns if c not in {id_col, text_col} | results]
    plain = normalised(F.col("_text"))
    keyed = docs.select(
        F.struct(*[docs[c] for c in extra]).alias("_extra") if extra else F.lit(None).cast("string").alias("_extra"),
        docs[id_col].alias("_id"), docs[text_col].alias("_text"),
    ).withColumns({
        "_points": F.char_length(F.coalesce("_text", F.lit(""))),
        "_len": F.char_length(plain),
        "_prefix": F.xxhash64(F.substring(plain, 1, prefix_chars)),
    })
    # lengths, and below them prefixes, that two rows or more share
    counts = keyed.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_rows"))
    lengths = counts.groupBy("_len").agg(F.sum("_rows").alias("_n")).where("_n > 1").select("_len")
    shared = counts.where("_rows > 1").join(lengths, "_len", "left_semi").select("_len", "_prefix", F.lit(True).alias("_shared"))
    hashed = keyed.join(shared, ["_len", "_prefix"], "left").select(
        "_extra", "_id", "_points", "_len", F.monotonically_increasing_id().alias("_row"),
        F.when(F.col("_shared"), F.sha2(F.encode(normalised(F.col("_text")), "UTF-8"), 256)).alias("_full"))
    # written once: row numbers are stable from here on, and lost executors repeat no shuffle of texts
    rows = scratch_table(hashed, "exact-dedup")
    # one row per group: counts and the best row are combined on the map side
    order = F.struct("_points", F.col("_id").isNotNull().alias("_given"), (-F.col("_id")).alias("_least"), "_row")
    groups = rows.where("_full is not null").groupBy("_len", "_full").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(order).alias("_best"))
    groups = groups.select("_len", "_full", "group_size", (-F.col("_best._least")).alias("keep_id"), F.col("_best._row").alias("_stays"))
    alone = rows.where("_full is null").select(
        "_extra", "_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    copies = rows.where("_full is not null").join(groups, ["_len", "_full"]).select(
        "_extra", "_id", "keep_id", "group_size",
        (F.col("_row") == F.col("_stays")).alias("kept"))
    both = alone.unionByName(copies)
    return both.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept",
                       *[F.col(f"_extra.`{c}`").alias(c) for c in extra])
