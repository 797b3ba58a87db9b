"""Analytics of health samples over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small
from .ordered import CHUNK_ROWS, N, order_rows, previous, running_sums

# How a breaker state is drawn.
STATE_LEVEL = {"CLOSED": 0.0, "OPEN": 1.0, "HALF_OPEN": 0.5}


def state_level(state: Column) -> Column:
    level = F.lit(None).cast("double")
    for name, value in STATE_LEVEL.items():
        level = F.when(state == name, F.lit(value)).otherwise(level)
    return level


def timeline_curves(timeline: DataFrame) -> DataFrame:
    """Add seconds since the first sample, bytes saved and the breaker state as a number."""
    start = timeline.agg(F.min("timestamp").alias("t")).scalar()
    return timeline.withColumns({
        "seconds": F.col("timestamp") - start,
        "bytes_saved": F.col("bytes_in") - F.col("bytes_out"),
        "state_level": state_level(F.col("breaker_state")),
    })


def phase_summary(timeline: DataFrame) -> DataFrame:
    """Per step: samples, mean ratio, reduction (1 - mean ratio), largest buffer and time span."""
    return timeline.groupBy("step").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("ratio").alias("mean_ratio"), (1 - F.avg("ratio")).alias("reduction"),
        F.max("buffer_count").alias("max_buffer"), F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"))


def state_intervals(
    timeline: DataFrame, series: list[str] | None = None, order: list[str] | None = None, *,
    chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """Runs of one breaker state: state, from_ts, to_ts (first sample of the next run, else the last one), samples."""
    series = series or []
    rows = order_rows(timeline, series, order or ["timestamp"], chunk_rows=chunk_rows, strategy=strategy)
    rows = previous(rows, _state=F.col("breaker_state"))
    changed = (F.col(N) == 1) | ~F.col("breaker_state").eqNullSafe(F.col("_state"))
    rows = running_sums(rows.on(rows.df.withColumn("_new", changed.cast("int"))), island="_new")
    islands = rows.result().groupBy(*series, "island").agg(
        F.first("breaker_state").alias("state"), F.min("timestamp").alias("from_ts"),
        F.max("timestamp").alias("last_ts"), F.count(F.lit(1)).alias("samples"))
    # the islands of one series are few next to its samples, but may still be many: number and chunk them as well
    islands = order_rows(islands, series, [F.col("island").desc()], chunk_rows=chunk_rows, strategy=strategy)
    following = previous(islands, _next=F.col("from_ts")).result()
    return following.withColumn("to_ts", F.coalesce("_next", "last_ts")).drop("_next", "last_ts")


def outage_latency(
    timeline: DataFrame, incidents: DataFrame | None = None, *, at: str = "timestamp", state: str = "breaker_state",
    incident: str = "incident", slice_seconds: float = 3600.0,
) -> DataFrame:
    """Per incident: seconds from the start of the outage to the first OPEN, and from that to the next CLOSED.

    *timeline* has the incident id on each row, and *incidents* (incident, outage_start) tells when the outage began;
    without it the first sample of the incident is taken.

    The samples are read once and dealt out by incident and slice of time, so a long incident is not one task. A slice
    tells its first OPEN, its first CLOSED and its first CLOSED from the former on; the slices of an incident then
    tell the rest: that of its first OPEN the last of these, later ones their first CLOSED.
    """
    samples = timeline.select(incident, F.col(at).alias("_at"), F.col(state).alias("_state"))
    if incidents is not None:
        starts = incidents.select(incident, "outage_start")
        samples = samples.join(broadcast_if_small(starts), incident).filter(F.col("_at") >= F.col("outage_start")).drop("outage_start")
    first = lambda name, since=None: F.min(F.when(
        F.col("_state") == name if since is None else (F.col("_state") == name) & (F.col("_at") >= F.col(since)), F.col("_at")))
    sliced = samples.withColumn("_slice", F.floor(F.col("_at") / slice_seconds))
    sliced = sliced.withColumn("_open", first("OPEN").over(Window.partitionBy(incident, "_slice")))
    told = sliced.groupBy(incident, "_slice").agg(
        F.min("_at").alias("_first"), F.min("_open").alias("_open"), first("CLOSED").alias("_closed"), first("CLOSED", "_open").alias("_after"))
    told = told.withColumn("_opened", F.min("_open").over(Window.partitionBy(incident)))
    closed = F.coalesce(F.when(F.col("_closed") >= F.col("_opened"), F.col("_closed")), F.when(F.col("_after") >= F.col("_opened"), F.col("_after")))
    out = told.groupBy(incident).agg(F.min("_first").alias("outage_start"), F.min("_opened").alias("opened_at"), F.min(closed).alias("closed_at"))
    if incidents is not None:
        out = starts.join(out.drop("outage_start"), incident, "left")
    return out.withColumns({
        "detection_seconds": F.col("opened_at") - F.col("outage_start"),
        "recovery_seconds": F.col("closed_at") - F.col("opened_at"),
    })


def rates(
    timeline: DataFrame, series: list[str] | None = None, order: list[str] | None = None, *,
    chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """Add, per sample, messages and bytes per second and the ratio since the sample before; null on the first."""
    counters = ["timestamp", "msgs_processed", "bytes_in", "bytes_out"]
    rows = order_rows(timeline, series or [], order or ["timestamp"], chunk_rows=chunk_rows, strategy=strategy)
    rows = previous(rows, _before=F.struct(*counters))
    delta = {c: F.col(c) - F.col(f"_before.{c}") for c in counters}
    per_second = lambda c: F.when(delta["timestamp"] > 0, delta[c] / delta["timestamp"])
    return rows.add(
        msgs_per_sec=per_second("msgs_processed"),
        bytes_in_per_sec=per_second("bytes_in"),
        bytes_out_per_sec=per_second("bytes_out"),
        interval_ratio=F.when(delta["bytes_in"] > 0, delta["bytes_out"] / delta["bytes_in"]),
    ).result().drop("_before")
