"""Store and forward: frames waiting for delivery as a table (id, topic, payload, timestamp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ordered import CHUNK_ROWS, N, order_rows, running_sums

# Defaults of the pending store.
MAX_PENDING_BYTES = 50 * 1024 * 1024
POP_LIMIT = 10


def oldest_pending(pending: DataFrame, n: int = POP_LIMIT) -> DataFrame:
    """The *n* oldest frames, first in first out; the id settles ties."""
    return pending.orderBy("timestamp", "id").limit(n)


def evict_pending(
    pending: DataFrame, max_bytes: int = MAX_PENDING_BYTES, *, exact: bool = False, payload: str = "payload",
    size: Column | None = None, chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """What is left once the store is over its cap: a tenth of the frames, at least one, are dropped, oldest first.

    With *exact* just as many of the oldest are dropped as it takes to fit the cap. A store within the cap is returned
    whole. *size* overrides the bytes of a frame, by default the length of its payload.

    Only time, id and size are put in order, to find the newest frame that goes; the store itself is filtered by it.
    """
    size = (F.octet_length(payload) if size is None else size).cast("long")
    narrow = pending.select("timestamp", "id", size.alias("_size"))
    count, total = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    if total <= max_bytes:
        return pending
    if exact:
        newest_first = [F.col("timestamp").desc(), F.col("id").desc()]
        rows = order_rows(narrow, [], newest_first, chunk_rows=chunk_rows, strategy=strategy)
        gone = running_sums(rows, _total="_size").result().filter(F.col("_total") > max_bytes)
        last = gone.agg(F.max(F.struct("timestamp", "id")).alias("x")).first().x
    else:
        rows = order_rows(narrow, [], ["timestamp", "id"], chunk_rows=chunk_rows, strategy=strategy)
        last = rows.df.filter(F.col(N) == max(1, count // 10)).select("timestamp", "id").first()
    # a frame without a time counts as older than all others
    same = F.col("timestamp").eqNullSafe(F.lit(last.timestamp)) & (F.col("id") > last.id)
    younger = F.col("timestamp").isNotNull() if last.timestamp is None else F.col("timestamp") > F.lit(last.timestamp)
    return pending.filter(younger | same)


def pending_stats(pending: DataFrame, now: float | Column, payload: str = "payload") -> DataFrame:
    """Per topic and overall (topic null): frames, bytes and the age of the oldest one."""
    now = now if isinstance(now, Column) else F.lit(float(now))
    return pending.rollup("topic").agg(
        (F.grouping("topic") == 1).alias("overall"), F.count(F.lit(1)).alias("frames"),
        F.coalesce(F.sum(F.octet_length(payload).cast("long")), F.lit(0)).alias("bytes"),
        F.min("timestamp").alias("_oldest")).withColumn("oldest_age", now - F.col("_oldest")).drop("_oldest")


def settle(pending: DataFrame, delivered: DataFrame, requeued: DataFrame | None = None) -> DataFrame:
    """Frames still waiting: those not in *delivered* (by id), plus *requeued* ones. Their order does not change.

    An id delivered many times is reduced map-side, so it does not pile up in one task.
    """
    left = pending.join(delivered.select("id").distinct(), "id", "left_anti")
    return left if requeued is None else left.unionByName(requeued)


def merge_delivery(live: DataFrame, recovered: DataFrame, key: list[str] | None = None) -> DataFrame:
    """All delivered frames, each once, with a flag for those that came only from the pending store."""
    key = key or ["topic", "batch_id"]
    both = live.withColumn("recovered", F.lit(False)).unionByName(recovered.withColumn("recovered", F.lit(True)))
    fields = [c for c in both.columns if c not in key and c != "recovered"]
    # a live copy wins; the partial aggregation removes copies before the shuffle
    best = F.min_by(F.struct(*fields), "recovered")
    merged = both.groupBy(*key).agg(F.min("recovered").alias("recovered"), best.alias("_row"))
    return merged.select(*key, *[F.col(f"_row.{c}").alias(c) for c in fields], "recovered")
