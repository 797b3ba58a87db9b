"""Streams from messages to batches and from frames to lines, metrics and quarantine."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import size_error, topic_error
from ..functions.normalize import VOLATILE, normalize
from ..operators.codec import DICT_SIZE, decode_frames, train_dicts
from ..operators.metrics import _derived, _flush_throughput, _totals
from ..operators.registry import publish_versions, retrain_candidates, sample_window, training_readiness
from ..session import SETTINGS, broadcast_if_small, scratch_path, scratch_table
from ..sources.registry_store import change_registry, current_registry
from ..sources.sinks import frame_metrics


def ingest(
    messages: DataFrame, drop: tuple[str, ...] = VOLATILE, schema: str | None = None, msg: str = "msg"
) -> DataFrame:
    """Validate topic and size, then normalize; works on tables and streams. ``error`` is null for valid messages."""
    too_large = F.when(size_error(F.col(msg)).isNotNull(), "message_too_large")
    checked = messages.withColumn("error", F.coalesce(topic_error(F.col("topic")), too_large))
    # what was rejected is not parsed
    guarded = checked.withColumn("_original", F.col(msg)).withColumn(msg, F.when(F.col("error").isNull(), F.col(msg)))
    clean = normalize(guarded, drop, schema, msg=msg)
    broken = F.when(F.col(msg).isNull(), "not_an_object")
    return clean.withColumn("error", F.coalesce("error", broken)).withColumn(
        msg, F.coalesce(F.col(msg), F.col("_original"))).drop("_original")


_PARTS = ("count", "raw_len", "comp_len", "flush_ms")


def _shown(windows: DataFrame) -> DataFrame:
    """Derived columns of window totals, and the ends of the window as columns."""
    rows = windows.withColumns({**_derived(), "throughput_mbps": _flush_throughput()}).drop("_flush_ms")
    return rows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def stream_metrics(batches: DataFrame, period: str = "60 seconds", *, delay: str) -> DataFrame:
    """Topic metrics per tumbling window of a stream of batches (topic, ts, count, raw_len, comp_len, flush_ms).

    A window is final, and in append mode given out, once the watermark has passed its end. Rows that are more than
    *delay* late are lost to it: where that may not be, use ``metrics_sink``.
    """
    return _shown(batches.withWatermark("ts", delay).groupBy(F.window("ts", period), "topic").agg(*_totals()))


def metrics_sink(root: str, run: str, period: str = "60 seconds") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes the sums of each micro-batch per window and topic below *root*.

    However late a row is, it counts; ``window_metrics`` adds the parts up. A repeated micro-batch overwrites its own
    part. *run* names the checkpoint: give the same one after a restart from it, another one otherwise.
    """
    def write(batches: DataFrame, batch: int) -> None:
        sums = batches.groupBy(F.window("ts", period).alias("window"), "topic").agg(
            *[F.sum(c).alias(c) for c in _PARTS], F.count(F.lit(1)).alias("flushes"))
        sums.write.mode("overwrite").parquet(f"{root}/run={run}/batch={batch}")

    return write


def window_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Topic metrics per window, as ``stream_metrics`` has them, from all parts that ``metrics_sink`` has written."""
    parts = spark.read.option("basePath", root).parquet(f"{root}/run=*/batch=*")
    sums = parts.groupBy("window", "topic").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
          for c, name in (("count", "messages_processed"), ("raw_len", "bytes_in"), ("comp_len", "bytes_out"))],
        F.sum("flushes").alias("flush_count"), F.coalesce(F.sum("flush_ms"), F.lit(0)).cast("double").alias("_flush_ms"))
    return _shown(sums)


def decode_sink(
    root: str, registry: Callable[[SparkSession], DataFrame], key: str | None = None, algo: str = "sha256", *, run: str
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes lines, metrics and rejected frames below *root*.

    *registry* is asked once per micro-batch, so new dictionaries are used without a restart while retired ones still
    decode. Each output of a micro-batch has its own directory that a repeated attempt overwrites. *run* names the
    checkpoint, whose micro-batches are numbered from 0: give the same one after a restart from it, another one otherwise.
    """

    def write(frames: DataFrame, batch: int) -> None:
        kept: list[DataFrame] = []

        def keep(decoded: DataFrame) -> DataFrame:
            kept.append(decoded.persist())
            return kept[0]

        known = registry(frames.sparkSession)
        broken = frames.filter(F.col("error").isNotNull()) if "error" in frames.columns else None
        usable = frames.filter(F.col("error").isNull()).drop("error") if broken is not None else frames
        decoded = decode_frames(usable, known, key, algo, keep=keep)
        rejected = decoded.rejected
        if broken is not None:
            rejected = rejected.unionByName(broken, allowMissingColumns=True)
        try:
            lines = decoded.lines.select("topic", F.col("msg").alias("value")).hint("rebalance", F.col("topic"))
            lines.write.mode("overwrite").partitionBy("topic").text(f"{root}/lines/run={run}/batch={batch}")
            frame_metrics(decoded.frames).write.mode("overwrite").option("header", True).csv(f"{root}/metrics/run={run}/batch={batch}")
            rejected.write.mode("overwrite").parquet(f"{root}/rejected/run={run}/batch={batch}")
        finally:
            for df in kept:
                df.unpersist()

    return write


def retrain_step(
    messages: Callable[[SparkSession], DataFrame], registry_root: str, now: Callable[[], float],
    size: int = DICT_SIZE, on_retrained: Callable[[DataFrame], None] | None = None,
    running: Callable[[SparkSession], DataFrame] | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for monitor events: train drifted topics and publish a new registry snapshot.

    *messages* gives the message table to sample from. *on_retrained* gets the new versions, for whoever has to know.
    """

    def step(events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        drifted = events.filter(F.col("event_type") == "drift_detected").select("topic", "event_type").persist()
        try:
            if drifted.isEmpty():
                return
            topics = broadcast_if_small(drifted.select("topic").distinct())
            wanted = messages(spark).join(topics, "topic", "left_semi")
            # written once: readiness and training both read it
            samples = scratch_table(sample_window(wanted), "samples")
            ready = training_readiness(samples, size)
            chosen = retrain_candidates(drifted, ready, running(spark) if running else None)
            chosen = chosen.filter(F.col("decision") == "retrain").select("topic")
            trained = train_dicts(samples.join(chosen, "topic", "left_semi"), size).filter(F.col("error").isNull())
            trained = trained.select("topic", "dict_bytes").persist()
            if not trained.isEmpty():
                at = now()
                change_registry(spark, registry_root, lambda known: publish_versions(known, trained, at))
                if on_retrained is not None:
                    on_retrained(current_registry(spark, registry_root).filter(F.col("created_at") == at))
            trained.unpersist()
        finally:
            drifted.unpersist()

    return step


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Start queries with the RocksDB state store, which state with timers and lists needs."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, SETTINGS[STATE_STORE])
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


def run_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run a stream over what is there now, write it as Parquet and return the table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-checkpoint")
            .option("path", path).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_each(stream: DataFrame, label: str, function: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> None:
    """Run a stream over what is there now through a ``foreachBatch`` function, from *checkpoint* on or in a new one."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, label) + "-checkpoint"
    with rocksdb_state(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(function).trigger(availableNow=True)
            .option("checkpointLocation", checkpoint).start()
        )
        query.awaitTermination()
