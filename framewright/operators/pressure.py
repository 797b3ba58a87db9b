"""Queue depth and pressure from a log of acquired and released slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import pressure
from .ordered import CHUNK_ROWS, N, order_rows

ACQUIRE, RELEASE = "acquire", "release"


def _change(op: Column, n: Column) -> Column:
    """Slots a log row adds; amounts of zero or less and other operations change nothing."""
    return F.when(n <= 0, 0).when(op == ACQUIRE, n).when(op == RELEASE, -n).otherwise(0).cast("long")


def queue_depth(
    log: DataFrame, queue: str | None = None, order: Sequence[str] = ("ts", "seq"), *, chunk_rows: int = CHUNK_ROWS,
    strategy: str = "auto",
) -> DataFrame:
    """Add the depth after each row, never below zero, and the highest depth so far.

    *log* has op (``acquire`` for accepted ones, ``release``) and n. With S the running sum of changes, the depth is
    S less the smallest S so far if that is negative. A chunk entered at depth d with sums s and their running minimum
    m has the depth max(d + s, s - m), so four numbers per chunk are enough to carry the depth and the peak.
    """
    keys = [queue] if queue else []
    rows = order_rows(log.withColumn("_d", _change(F.col("op"), F.col("n"))), keys, order, chunk_rows=chunk_rows, strategy=strategy)
    rows = rows.add(_s=F.sum("_d").over(rows.window()))
    rows = rows.add(_m=F.min("_s").over(rows.window()))

    def entry(s: DataFrame, before, upto) -> DataFrame:
        s = s.withColumn("_off", F.coalesce(F.sum("total").over(before), F.lit(0)))
        s = s.withColumn("_low", F.least(F.lit(0), F.min(F.col("_off") + F.col("low")).over(before)))
        s = s.withColumn("_depth", F.col("_off") - F.coalesce("_low", F.lit(0)))
        peak = F.greatest(F.col("_depth") + F.col("high"), F.col("rise"))
        return s.withColumn("_peak", F.max(peak).over(before))

    rows = rows.carry(
        {"total": F.sum("_d"), "low": F.min("_s"), "high": F.max("_s"), "rise": F.max(F.col("_s") - F.col("_m"))},
        entry, {"_depth": F.lit(0).cast("long"), "_peak": F.lit(0).cast("long")})
    depth = F.greatest(F.col("_depth") + F.col("_s"), F.col("_s") - F.col("_m"))
    rows = rows.add(depth=depth)
    rows = rows.add(peak=F.greatest(F.max("depth").over(rows.window()), F.col("_peak")))
    return rows.result().drop("_d", "_s", "_m", "_depth", "_peak")


def queue_stats(
    log: DataFrame, queue: str | None = None, order: Sequence[str] = ("ts", "seq"), *, soft: int = 1_000,
    hard: int = 5_000, chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """Totals of a gate log: acquired, released, delayed, dropped, blocked, timed out, peak, current and pressure.

    Operations: acquire and release (n slots), drop (n messages), and delay (with delay_ms, if that column exists),
    block and timeout, which count calls.
    """
    if soft < 0 or hard < 1 or soft >= hard:
        raise ValueError("limits must satisfy 0 <= soft < hard")
    keys = [queue] if queue else []
    rows = queue_depth(log, queue, order, chunk_rows=chunk_rows, strategy=strategy)
    op = F.col("op")
    amount = lambda name: F.coalesce(F.sum(F.when((op == name) & (F.col("n") > 0), F.col("n"))), F.lit(0)).cast("long")
    delay = F.col("delay_ms") if "delay_ms" in log.columns else F.lit(0.0)
    latest_row = F.struct(*order)
    stats = rows.groupBy(*keys).agg(
        amount(ACQUIRE).alias("total_acquired"), amount(RELEASE).alias("total_released"),
        F.count_if(op == "delay").alias("total_delayed"),
        F.round(F.coalesce(F.sum(F.when(op == "delay", delay)), F.lit(0.0)), 2).alias("total_delay_ms"),
        amount("drop").alias("total_dropped"), F.count_if(op == "block").alias("total_blocked"),
        F.count_if(op == "timeout").alias("total_timeouts"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("peak_queued"),
        F.coalesce(F.max_by("depth", latest_row), F.lit(0)).alias("current_queued"))
    q = F.col("current_queued")
    return stats.withColumns({
        "pressure": F.round(pressure(q, soft, hard), 4), "queue_pct": F.round(q / hard * 100, 1)})
