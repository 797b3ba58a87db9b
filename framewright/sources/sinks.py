"""Decoded lines and frame metrics on storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import compression_ratio


def write_topic_jsonl(lines: DataFrame, path: str, order: list[str] | None = None, msg: str = "msg") -> None:
    """Append messages as text files, one directory per topic (path/topic=NAME/).

    The rebalance groups rows by topic so that a task writes few files, and splits a topic that is too large for one
    task. Within a file, lines follow *order* if given.
    """
    columns = [F.col(c) for c in order or []]
    rows = lines.hint("rebalance", F.col("topic"))
    rows = rows.sortWithinPartitions(F.col("topic"), *columns)
    rows.select("topic", F.col(msg).alias("value")).write.mode("append").partitionBy("topic").text(path)


def frame_metrics(frames: DataFrame, at: Column | None = None) -> DataFrame:
    """One row per frame: timestamp (seconds), topic, count, raw and compressed bytes, ratio, dict_id."""
    at = F.unix_micros(F.current_timestamp()) / F.lit(1e6) if at is None else at
    return frames.select(
        at.cast("double").alias("timestamp"), "topic", "count", F.col("raw_len").alias("raw_bytes"),
        F.col("comp_len").alias("compressed_bytes"),
        compression_ratio(F.col("raw_len"), F.col("comp_len")).alias("ratio"), "dict_id")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append frame metrics as CSV files with a header line."""
    metrics.write.mode("append").option("header", True).csv(path)
