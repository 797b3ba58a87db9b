"""Per-topic and overall metrics of flushed batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import broadcast_if_small, join_null_safe
from .ordered import CHUNK_ROWS, N, order_rows, running_sums

MIB = 1024 * 1024


def _guarded(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _totals() -> list[Column]:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return [
        zero(F.sum("count")).alias("messages_processed"),
        zero(F.sum("raw_len")).alias("bytes_in"),
        zero(F.sum("comp_len")).alias("bytes_out"),
        F.count(F.lit(1)).alias("flush_count"),
        zero(F.sum("flush_ms")).cast("double").alias("_flush_ms"),
    ]


def _derived() -> dict[str, Column]:
    return {
        "compression_ratio": _guarded(F.col("bytes_out"), F.col("bytes_in")),
        "avg_flush_duration_ms": _guarded(F.col("_flush_ms"), F.col("flush_count")),
    }


def _flush_throughput() -> Column:
    return _guarded(F.col("bytes_in") / MIB, F.col("_flush_ms") / 1000)


def topic_metrics(batches: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per topic: messages, bytes, ratio, flushes, throughput over flush time (MiB/s) and the last flush.

    *batches* has topic, ts, count, raw_len, comp_len and flush_ms. With *errors* (see ``error_counts``) the error
    counts of the topic are added.
    """
    out = (
        batches.groupBy("topic").agg(*_totals(), F.max("ts").alias("last_flush_timestamp"))
        .withColumns({**_derived(), "throughput_mbps": _flush_throughput()}).drop("_flush_ms")
    )
    if errors is None:
        return out
    counted = error_counts(errors, batches).filter(~F.col("overall")).drop("overall")
    return join_null_safe(out, counted, ["topic"], "left").fillna(0, ["compression_errors", "network_errors"])


def overall_metrics(
    batches: DataFrame, start: float | Column, now: float | Column, errors: DataFrame | None = None
) -> DataFrame:
    """One row over all topics; throughput and message rate are per second of uptime, from *start* to *now*."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    uptime = F.col("uptime_seconds")
    out = (
        batches.agg(*_totals()).withColumn("uptime_seconds", as_col(now) - as_col(start))
        .withColumns({
            **_derived(),
            "throughput_mbps": _guarded(F.col("bytes_in") / MIB, uptime),
            "messages_per_second": _guarded(F.col("messages_processed"), uptime),
        }).drop("_flush_ms")
    )
    if errors is None:
        return out
    counts = error_counts(errors, batches).filter("overall")
    pick = lambda name: F.coalesce(counts.agg(F.max(name).alias("n")).scalar(), F.lit(0)).alias(name)
    return out.select("*", pick("compression_errors"), pick("network_errors"))


def metrics_report(batches: DataFrame) -> DataFrame:
    """Per-topic rows and one overall row (topic null, overall true), from one rollup.

    The rollup doubles only what is left after the map-side combine. topic_count is the number of topic rows.
    """
    report = (
        batches.rollup("topic").agg(
            (F.grouping("topic") == 1).alias("overall"), *_totals(), F.max("ts").alias("last_flush_timestamp"))
        .withColumns({**_derived(), "throughput_mbps": _flush_throughput()}).drop("_flush_ms")
    )
    topics = batches.agg(F.count_distinct("topic").alias("n")).scalar()
    return report.withColumn("topic_count", topics)


def error_counts(errors: DataFrame, batches: DataFrame) -> DataFrame:
    """Compression and network errors per topic, and overall (topic null, overall true).

    *errors* has topic, ts and kind (``compression`` or ``network``). A topic counts an error only from its first batch
    on; the overall row counts every error.
    """
    first = batches.groupBy("topic").agg(F.min("ts").alias("_first"))
    joined = join_null_safe(errors.select("topic", "ts", "kind"), broadcast_if_small(first), ["topic"], "left")
    counted = F.coalesce(F.col("ts") >= F.col("_first"), F.lit(False))
    per_topic = joined.groupBy("topic").agg(
        F.count_if((F.col("kind") == "compression") & counted).alias("compression_errors"),
        F.count_if((F.col("kind") == "network") & counted).alias("network_errors"),
        F.count_if(F.col("kind") == "compression").alias("_c"),
        F.count_if(F.col("kind") == "network").alias("_n"),
        F.max(F.col("_first").isNotNull()).alias("_seen"),
    )
    overall = per_topic.agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("compression_errors"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("network_errors"))
    topics = per_topic.filter("_seen").select("topic", F.lit(False).alias("overall"), "compression_errors", "network_errors")
    total = overall.select(
        F.lit(None).cast("string").alias("topic"), F.lit(True).alias("overall"), "compression_errors", "network_errors")
    return topics.unionByName(total)


def metrics_csv(metrics: DataFrame) -> DataFrame:
    """One text row per topic: topic, messages, in, out, ratio (4 digits), flushes, average flush time (2 digits)."""
    return metrics.select(F.format_string(
        "%s,%d,%d,%d,%.4f,%d,%.2f", "topic", "messages_processed", "bytes_in", "bytes_out", "compression_ratio",
        "flush_count", "avg_flush_duration_ms").alias("csv"))


def running_metrics(
    batches: DataFrame, order: Sequence[str] = ("ts", "seq"), *, by_topic: bool = True, chunk_rows: int = CHUNK_ROWS,
    strategy: str = "auto",
) -> DataFrame:
    """Add the cumulative messages, bytes, batch count and ratio after each batch, per topic or over all topics.

    Over all topics there is no key to divide the rows by, so they always run in chunks unless *strategy* says otherwise.
    """
    if not by_topic and strategy == "auto":
        strategy = "chunked"
    rows = order_rows(batches, ["topic"] if by_topic else [], order, chunk_rows=chunk_rows, strategy=strategy)
    rows = running_sums(rows, cum_messages="count", cum_bytes_in="raw_len", cum_bytes_out="comp_len")
    return rows.add(
        cum_batches=F.col(N), cum_ratio=_guarded(F.col("cum_bytes_out"), F.col("cum_bytes_in"))).result()


def health_snapshot(
    batches: DataFrame, breaker: DataFrame | None = None, queue: DataFrame | None = None,
    pending: DataFrame | None = None, registry: DataFrame | None = None,
) -> DataFrame:
    """One row: status, compression totals, queue depth, buffered frames and active dictionaries, also as JSON.

    *breaker* has the latest state per target (column state), *queue* the current depth per queue (column queued),
    *pending* one row per buffered frame. Each figure is a scalar subquery of one row.
    """
    one = lambda df, c: df.agg(c.alias("x")).scalar()
    zero = F.lit(0).cast("long")
    opened = one(breaker, F.count_if(F.upper("state") == "OPEN")) if breaker is not None else zero
    depth = one(queue, F.coalesce(F.sum("queued"), F.lit(0))) if queue is not None else zero
    frames = one(pending, F.count(F.lit(1))) if pending is not None else zero
    live = registry.filter(F.col("retired_at").isNull()) if registry is not None else None
    dicts = one(live, F.count_distinct("topic")) if live is not None else zero
    row = batches.agg(*_totals()).select(
        "*", opened.alias("open_circuits"), depth.cast("long").alias("queue_depth"),
        frames.alias("buffered_frames"), dicts.alias("active_dicts")).withColumns(_derived())
    row = row.select(
        F.when(F.col("open_circuits") > 0, "degraded").otherwise("healthy").alias("status"),
        F.col("compression_ratio").alias("ratio"), "bytes_in", "bytes_out",
        (F.col("bytes_in") - F.col("bytes_out")).alias("bytes_saved"), "messages_processed",
        F.col("flush_count").alias("batch_count"), "active_dicts", "queue_depth", "buffered_frames", "open_circuits")
    return row.withColumn("json", F.to_json(F.struct(*row.columns)))


def batch_latency(timings: DataFrame, *, chunk_rows: int = CHUNK_ROWS, strategy: str = "auto") -> DataFrame:
    """Per batch size: runs, median time, messages and megabytes (10^6 bytes) per second of it.

    *timings* has batch_max, seconds and raw_bytes. The exact median is the middle of the runs in order of time, found by
    position, so a batch size with very many runs does not have to fit one task.
    """
    rows = order_rows(
        timings.select("batch_max", "seconds"), ["batch_max"], ["seconds"], chunk_rows=chunk_rows, strategy=strategy)
    runs = timings.groupBy("batch_max").agg(F.count(F.lit(1)).alias("reps"), F.max("raw_bytes").alias("_bytes"))
    middle = join_null_safe(rows.df, broadcast_if_small(runs), ["batch_max"]).filter(
        F.col(N).between(F.expr("(reps + 1) div 2"), F.expr("(reps + 2) div 2")))
    median = F.col("_median")
    return middle.groupBy("batch_max", "reps", "_bytes").agg(F.avg("seconds").alias("_median")).select(
        "batch_max", "reps", F.round(median * 1000, 3).alias("median_batch_ms"),
        F.round(F.col("batch_max") / median).cast("long").alias("msg_per_sec"),
        F.round(F.col("_bytes") / median / 1e6, 2).alias("raw_mb_per_sec"))
