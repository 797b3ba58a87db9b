"""Compression-ratio monitoring per topic: moving average, baseline, drift and recovery."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import join_null_safe, scratch_table
from .ordered import CHUNK, CHUNK_ROWS, N, Ordered, latest, order_rows, running_sums

#: The moving average forgets: older input than this many decades of decay is below the precision of a double.
DECADES = 40.0


def _decay_rows(alpha: float) -> float:
    """Rows after which the weight (1 - alpha)^rows falls below 10^-DECADES."""
    return DECADES * math.log(10) / -math.log1p(-alpha)


def moving_average(rows: Ordered, value: Column, alpha: float, name: str = "ema") -> Ordered:
    """Add the exponential moving average e1 = r1, e(t) = e(t-1) + alpha * (r(t) - e(t-1)).

    With q = 1 - alpha a block of rows entered at e0 has e(j) = q^j * (e0 + sum of alpha * r(i) * q^-i), a plain window
    sum. Blocks are as long as q^-j stays well inside a double. What enters a block is the total of the one before plus
    q^block of the one before that; everything older weighs less than 10^-80. Chunks pass their state the same way.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    if alpha == 1:
        return rows.add(**{name: value})
    q = 1.0 - alpha
    limit = math.ceil(_decay_rows(alpha))
    # inside a chunk a block may be shorter than the memory reaches, as the chunks before pass their state on
    block = min(limit, rows.chunk_rows) if rows.cut else limit
    p = rows.position()
    j = (p - 1) % block + 1
    step = F.pow(F.lit(q), j.cast("double"))
    rows = rows.together().add(_block=F.floor((p - 1) / block), _r=value)
    rows = rows.add(_s=F.sum(alpha * F.col("_r") / step).over(rows.window("_block")))
    total = F.when(j == block, step * F.col("_s"))
    before = rows.before()
    rows = rows.add(_prev=F.coalesce(F.last(total, ignorenulls=True).over(before), F.lit(0.0)))
    rows = rows.add(_in=F.coalesce(F.last(total + (q ** block) * F.col("_prev"), ignorenulls=True).over(before), F.lit(0.0)))
    rows = rows.add(_z=step * (F.col("_s") + F.col("_in")), _first=F.first("_r").over(rows.window()))

    whole = q ** rows.chunk_rows
    reach = math.ceil(limit / rows.chunk_rows) + 1

    def entry(s: DataFrame, before_w, upto) -> DataFrame:
        chunks = Window.partitionBy(*rows.keys).orderBy(CHUNK)
        first = F.when(F.col(CHUNK) == 0, whole * F.col("start")).otherwise(F.lit(0.0))
        s = s.withColumn("end", F.col("end") + first)
        seen = F.collect_list("end").over(chunks.rowsBetween(-reach, -1))
        folded = F.aggregate(seen, F.lit(0.0), lambda acc, b: acc * whole + b)
        return s.withColumn("_e0", F.when(F.size(seen) > 0, folded))

    rows = rows.carry({"end": F.max_by("_z", N), "start": F.min_by("_r", N)}, entry, {"_e0": F.col("_first")})
    out = rows.df.withColumn(name, F.col("_z") + F.pow(F.lit(q), p.cast("double")) * F.col("_e0"))
    return rows.on(out.drop("_block", "_r", "_s", "_prev", "_in", "_z", "_first", "_e0"))


def ratio_events(
    batches: DataFrame,
    order: Sequence[str] = ("ts", "seq"),
    *,
    topic: str = "topic",
    raw: str = "raw_len",
    comp: str = "comp_len",
    alpha: float = 0.10,
    warmup: int = 20,
    drift: float = 0.20,
    consecutive: int = 3,
    recovery: float = 0.05,
    retrains: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
    strategy: str = "auto",
) -> DataFrame:
    """One event per batch: ratio, moving average, baseline and what the monitor says about it.

    The baseline is the average at batch *warmup*. From then on rel = (ema - baseline) / baseline; *consecutive* batches
    in a row above *drift* give ``drift_detected``, and falling to *recovery* or below gives ``recovered``. A row of
    *retrains* (topic and the first column of *order*) makes the current average the baseline and the state normal;
    it takes effect before a batch of the same time.

    Adds batch_count, ratio, ema, baseline, drift_magnitude, event_type, state and consecutive_drift.
    """
    warmup, consecutive = max(warmup, 1), max(consecutive, 1)
    order = list(order)
    ratio = F.col(comp) / F.greatest(F.col(raw), F.lit(1))
    rows = order_rows(batches.withColumn("ratio", ratio), [topic], order, chunk_rows=chunk_rows, strategy=strategy)
    rows = moving_average(rows, F.col("ratio"), alpha)
    rows = rows.add(batch_count=F.col(N), _retrain=F.lit(False), _count=F.lit(0))
    if retrains is None:
        rows = _settled(rows)
        mark = F.when(F.col(N) == warmup, F.struct(F.col("ema").alias("v")))
    else:
        rows = _with_retrains(rows, retrains, topic, order, chunk_rows, "chunked" if rows.cut else "window")
        at_warmup = (F.col("batch_count") == warmup) & (F.col("_count") == 0) & ~F.col("_retrain")
        mark = F.when(F.col("_retrain"), F.struct(F.col("_seen").alias("v"))).when(
            at_warmup, F.struct(F.col("ema").alias("v")))
    rows = latest(rows.add(_mark=mark), _base=F.col("_mark"))
    rows = rows.add(baseline=F.col("_base.v"), _bound=F.col("_mark").isNotNull())
    rel = (F.col("ema") - F.col("baseline")) / F.greatest(F.col("baseline"), F.lit(1e-9))
    judged = ~F.col("_bound") & F.col("baseline").isNotNull() & ~F.col("_retrain")
    rows = rows.add(
        _over=F.coalesce(judged & (rel > drift), F.lit(False)),
        _back=F.coalesce(judged & (rel <= recovery), F.lit(False)),
        drift_magnitude=F.coalesce(F.col("ema") - F.col("baseline"), F.lit(0.0)),
    )
    rows = _settled(rows)
    if recovery < drift:
        rows = _states_by_runs(rows, consecutive)
    else:
        rows = _states_by_fold(rows, consecutive)
    kept = rows.df.filter(~F.col("_retrain"))
    return kept.withColumn(
        "event_type",
        F.when(F.col("_bound"), F.lit("warmup_complete"))
        .when((F.col("state") == "drifted") & (F.col("_was") == "normal"), F.lit("drift_detected"))
        .when((F.col("state") == "normal") & (F.col("_was") == "drifted"), F.lit("recovered"))
        .otherwise(F.lit("ratio_update")),
    ).drop(N, CHUNK, "_retrain", "_count", "_seen", "_mark", "_base", "_bound", "_over", "_back", "_was", "_batch")


def _settled(rows: Ordered) -> Ordered:
    """In chunked mode, write the rows so that the passes that follow do not repeat the ones before."""
    return rows.on(scratch_table(rows.df, "monitor")) if rows.cut else rows


def _with_retrains(
    rows: Ordered, retrains: DataFrame, topic: str, order: list[str], chunk_rows: int, strategy: str
) -> Ordered:
    at = order[0]
    marks = retrains.select(F.col(topic), F.col(at)).withColumn("_retrain", F.lit(True))
    series = rows.df.drop(N, CHUNK, "_count").withColumn("_batch", F.lit(1))
    both = series.unionByName(marks.withColumn("_batch", F.lit(0)), allowMissingColumns=True)
    # retrains of one topic at one time are told apart by a row id; they all have the same effect
    both = both.withColumn("_tie", F.when(F.col("_retrain"), F.monotonically_increasing_id()))
    mixed = order_rows(
        both, [topic], [at, "_batch", *order[1:], "_tie"], chunk_rows=chunk_rows, strategy=strategy)
    mixed = latest(mixed, _seen=F.col("ema"))
    mixed = running_sums(mixed, _count=F.col("_retrain").cast("int"))
    return _settled(mixed.on(mixed.df.drop("_tie")))


def _states_by_runs(rows: Ordered, consecutive: int) -> Ordered:
    """Drift state from run lengths; right while recovery < drift, as a recovered row then ends any run."""
    broken = F.when(~F.col("_over"), F.col(N))
    rows = rows.add(_local=F.max(broken).over(rows.window()))
    rows = rows.add(_localmark=F.when(
        F.col("_over") & (F.col(N) - F.col("_local") >= consecutive), F.lit("drifted")).when(
        F.col("_bound") | F.col("_back"), F.lit("normal")))

    def entry(s: DataFrame, before, upto) -> DataFrame:
        s = s.withColumn("_break", F.coalesce(F.max("last_break").over(before), F.lit(0)))
        lead = F.coalesce(F.col("first_break"), F.col("last_n") + 1) - F.col("first_n")
        led = (lead > 0) & (F.col("first_n") - 1 - F.col("_break") + lead >= consecutive)
        s = s.withColumn("mark", F.coalesce(F.col("mark"), F.when(led, F.lit("drifted"))))
        return s.withColumn("_state", F.last("mark", ignorenulls=True).over(before))

    rows = rows.carry(
        {
            "first_n": F.min(N), "last_n": F.max(N), "first_break": F.min(broken), "last_break": F.max(broken),
            "mark": F.max_by("_localmark", F.when(F.col("_localmark").isNotNull(), F.col(N))),
        },
        entry,
        {"_break": F.lit(0).cast("long"), "_state": F.lit("warmup")},
    )
    rows = rows.add(_run=F.col(N) - F.coalesce(F.col("_local"), F.col("_break")))
    mark = F.when(F.col("_over") & (F.col("_run") >= consecutive), F.lit("drifted")).when(
        F.col("_bound") | F.col("_back"), F.lit("normal"))
    rows = rows.add(state=F.coalesce(F.last(mark, ignorenulls=True).over(rows.window()), F.col("_state")))
    lag = Window.partitionBy(*rows.part).orderBy(N)
    rows = rows.add(
        _was=F.coalesce(F.lag("state").over(lag), F.col("_state")),
        consecutive_drift=F.when(F.col("state") == "drifted", F.lit(consecutive).cast("long")).otherwise(F.col("_run")),
    )
    return rows.on(rows.df.drop("_local", "_localmark", "_break", "_state", "_run"))


def _states_by_fold(rows: Ordered, consecutive: int) -> Ordered:
    """Drift state for recovery >= drift, where an over-the-limit row can also be a recovered one.

    The state is a number: 0 to consecutive - 1 counts drifted rows while normal, consecutive means drifted, -1 warm-up.
    """
    from .fold import fold_automaton

    # symbols: 0 neither, 1 over, 2 back, 3 reset, 4 over and back
    code = (
        F.when(F.col("_bound"), 3)
        .when(F.col("_over") & F.col("_back"), 4)
        .when(F.col("_back"), 2)
        .when(F.col("_over"), 1)
        .otherwise(0)
    )
    rows = rows.add(_code=code)
    table = {}
    for state in range(-1, consecutive + 1):
        drifted = state == consecutive
        up = state if state < 0 else min(max(state, 0) + 1, consecutive)
        calm = state if state < 0 else 0
        table[state] = [
            state if drifted else calm,
            state if drifted else up,
            0 if drifted else calm,
            0,
            0 if drifted else up,
        ]
    rows = fold_automaton(rows, "_code", table, -1, "_step", "_from")
    name = lambda c: F.when(c < 0, F.lit("warmup")).when(c >= consecutive, F.lit("drifted")).otherwise(F.lit("normal"))
    rows = rows.add(
        state=name(F.col("_step")), _was=name(F.col("_from")),
        consecutive_drift=F.greatest(F.col("_step"), F.lit(0)).cast("long"),
    )
    return rows.on(rows.df.drop("_code", "_step", "_from"))


def ratio_baseline(
    batches: DataFrame, order: Sequence[str] = ("ts", "seq"), *, topic: str = "topic", raw: str = "raw_len",
    comp: str = "comp_len", alpha: float = 0.10, warmup: int = 20, chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """Add ratio, ema and baseline: the average at batch *warmup*, null before it."""
    ratio = F.col(comp) / F.greatest(F.col(raw), F.lit(1))
    rows = order_rows(batches.withColumn("ratio", ratio), [topic], order, chunk_rows=chunk_rows, strategy=strategy)
    rows = _settled(moving_average(rows, F.col("ratio"), alpha).add(batch_count=F.col(N)))
    return latest(rows, baseline=F.when(F.col(N) == max(warmup, 1), F.col("ema"))).result()


def ema(
    df: DataFrame, value: str, order: Sequence[str] = ("ts", "seq"), *, topic: str = "topic", alpha: float = 0.10,
    chunk_rows: int = CHUNK_ROWS, strategy: str = "auto",
) -> DataFrame:
    """Add the exponential moving average of *value* per topic as ``ema``."""
    rows = order_rows(df, [topic], order, chunk_rows=chunk_rows, strategy=strategy)
    return moving_average(rows, F.col(value), alpha).result()


def monitor_stats(events: DataFrame, retrains: DataFrame | None = None, topic: str = "topic") -> DataFrame:
    """Latest monitor state per topic from ``ratio_events``, rounded to six digits."""
    last = lambda c: F.max_by(c, "batch_count")
    stats = events.groupBy(topic).agg(
        last("state").alias("state"),
        F.round(last("ema"), 6).alias("ema"),
        F.round(last("baseline"), 6).alias("baseline"),
        F.round(last("ratio"), 6).alias("last_ratio"),
        F.round(F.greatest(F.max("ratio"), F.lit(0.0)), 6).alias("peak_ratio"),
        F.round(last("drift_magnitude"), 6).alias("drift_magnitude"),
        F.max("batch_count").alias("batch_count"),
        last("consecutive_drift").alias("consecutive_drift"),
    )
    if retrains is None:
        return stats.withColumn("retrain_count", F.lit(0).cast("long"))
    counts = retrains.groupBy(topic).agg(F.count(F.lit(1)).alias("retrain_count"))
    return join_null_safe(stats, counts, [topic], "left").fillna(0, ["retrain_count"])
