"""State kept per topic across micro-batches. State on one key is bounded: an open batch or a handful of numbers."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.breaker import VARIANTS, Rules, _Machine


_NEVER, _ALWAYS = -(1 << 62), 1 << 62
_ROWS = pa.schema([("at", pa.int64()), ("us", pa.int64()), ("seq", pa.int64()), ("msg", pa.large_string())])
#: Slots of time that the age of a batch and the delay span at most, and the least length of one in microseconds.
SLOTS, DELAY_SLOTS, LEAST_SLOT = 8, 64, 1000


#: Rows of a key that are walked, and given out, at a time.
BLOCK_ROWS = 20_000


def _in_order(parts: Iterator[pd.DataFrame], names: list[str]) -> Iterator[list[list]]:
    """The rows of one key in one micro-batch by time and sequence, in blocks, as one list per column of *names*.

    All that is held of a micro-batch is one array of numbers per column; *names* begin with us and seq.
    """
    held: list[list[np.ndarray]] = [[] for _ in names]
    for part in parts:
        for values, name in zip(held, names, strict=True):
            values.append(part[name].to_numpy(copy=True))
    columns = []
    while held:
        columns.append(np.concatenate(held.pop(0)))
    order = np.lexsort((columns[1], columns[0]))
    for first in range(0, len(order), BLOCK_ROWS):
        block = order[first:first + BLOCK_ROWS]
        yield [c[block].tolist() for c in columns]


def _packed(rows: pa.Table) -> tuple[bytes]:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _ROWS) as stream:
        stream.write_table(rows)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(value: tuple[bytes]) -> pa.Table:
    return pa.ipc.open_stream(bytes(value[0])).read_all()


class _Batcher(StatefulProcessor):
    """Rows by slot of time until their slot is final, and the rows of the open batch.

    A slot is final once a row of its key is *delay* younger than its end. Rows that come for a final slot go to the front
    of the first one that isn't. A batch closes by its number of rows, or when its deadline lies in a final slot. The rows
    that a micro-batch has for a slot are a part of it: written once, read once when the slot becomes final, and not
    touched in between. Final slots are walked one after the other. Parts are kept as Arrow batches: as arrays, every number
    and text of them would pass between Python and the state store by itself.
    """

    def __init__(self, keys: list[str], batch_max: int, span_us: int, delay_us: int, idle_ms: int | None):
        self.keys, self.batch_max, self.span, self.delay, self.idle = keys, batch_max, span_us, delay_us, idle_ms
        self.width = max(span_us // SLOTS, delay_us // DELAY_SLOTS, LEAST_SLOT)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot BIGINT", "parts BIGINT")
        self.parts = handle.getMapState("parts", "slot BIGINT, part BIGINT", "rows BINARY")
        self.open = handle.getValueState("open", "rows BINARY")
        self.place = handle.getValueState("place", "newest BIGINT, final BIGINT, lowest BIGINT, position BIGINT, timer BIGINT")

    def _placed(self) -> tuple:
        """Newest time, first time that isn't final, lowest slot with rows, rows given out, timer."""
        return tuple(self.place.get()) if self.place.exists() else (_NEVER, _NEVER, _ALWAYS, 0, -1)

    def _store(self, rows: pa.Table) -> int:
        """Add rows, which are in order, to their slots; the lowest of these."""
        slots, first = np.unique(rows["at"].to_numpy() // self.width, return_index=True)
        slots, first = slots.tolist(), [*first.tolist(), rows.num_rows]
        for k, slot in enumerate(slots):
            parts = self.slots.getValue((slot,))[0] if self.slots.containsKey((slot,)) else 0
            self.parts.updateValue((slot, parts), _packed(rows.slice(first[k], first[k + 1] - first[k])))
            self.slots.updateValue((slot,), (parts + 1,))
        return min(slots, default=_ALWAYS)

    def _taken(self, slot: int) -> Iterator[pa.Table]:
        """The parts of a slot, which is removed."""
        for part in range(self.slots.getValue((slot,))[0]):
            yield _unpacked(self.parts.getValue((slot, part)))
            self.parts.removeKey((slot, part))
        self.slots.removeKey((slot,))

    def _closed(self, key: Any, parts: list[pa.Table], position: int, final: int) -> tuple[list[dict], pa.Table]:
        """The batches that are closed when no row below *final* can come any more, and the rows that stay open."""
        rows = pa.concat_tables([_ROWS.empty_table(), *parts])
        rows = rows.take(np.lexsort([rows[c].to_numpy() for c in ("seq", "us", "at")]))
        at, us, msg = (rows[c].to_numpy().tolist() for c in ("at", "us", "msg"))
        done, start = [], 0
        while start < len(at):
            late = bisect_left(at, at[start] + self.span, start, min(start + self.batch_max, len(at)))
            end = max(late, start + 1)
            if end - start < self.batch_max and end == len(at) and final < at[start] + self.span:
                break
            done.append(self._batch(key, position + start + 1, us[start], us[end - 1], msg[start:end]))
            start = end
        return done, rows.slice(start)

    def _advanced(self, key: Any, new: pd.DataFrame, place: tuple, until: int) -> Iterator[pd.DataFrame]:
        """Everything below the time *until* is final from now on; *new* rows at or above it are stored."""
        newest, final, lowest, position, timer = place
        rows = pa.Table.from_pandas(new, _ROWS, preserve_index=False)
        rows = rows.take(np.argsort(rows["at"].to_numpy(), kind="stable"))
        at, stored = rows["at"].to_numpy(), []
        due = int(np.searchsorted(at, until))
        lowest = min(lowest, self._store(rows.slice(due)))
        if lowest < until // self.width:
            held = sorted(int(k[0]) for k in self.slots.keys())
            stored = held[:bisect_left(held, until // self.width)]
            lowest = min(held[len(stored):], default=_ALWAYS)
        if due or stored or until > final:
            parts, size, first = [_unpacked(self.open.get())] if self.open.exists() else [], 0, 0
            for slot in stored:
                for part in self._taken(slot):
                    parts.append(part)
                    size += part.num_rows
                if size >= BLOCK_ROWS:
                    end = (slot + 1) * self.width
                    last = min(int(np.searchsorted(at, end)), due)
                    done, rest = self._closed(key, [*parts, rows.slice(first, last - first)], position, end)
                    position += sum(b["count"] for b in done)
                    parts, size, first = [rest], 0, last
                    if done:
                        yield pd.DataFrame(done)
            done, rest = self._closed(key, [*parts, rows.slice(first, due - first)], position, until)
            position += sum(b["count"] for b in done)
            if rest.num_rows:
                self.open.update(_packed(rest))
            elif self.open.exists():
                self.open.clear()
            if done:
                yield pd.DataFrame(done)
        # what ended may go on: times then count from the last one seen
        final = until if until < _ALWAYS else max(final, (newest // self.width + 1) * self.width)
        self.place.update((newest, final, lowest, position, timer))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        newest, final, lowest, position, timer = self._placed()
        data = pd.concat(list(rows), ignore_index=True)
        ended = bool(data["ends"].any())
        data = data[data["msg"].notna() & data["us"].notna()]
        if len(data):
            newest = max(newest, int(data["us"].max()))
        data = data.assign(at=data["us"].clip(lower=final))[_ROWS.names]
        if self.idle is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(timer)
        until = _ALWAYS if ended else max(final, (newest - self.delay + 1) // self.width * self.width)
        yield from self._advanced(key, data, (newest, final, lowest, position, timer), until)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        place = self._placed()
        if place[-1] == expiredTimerInfo.getExpiryTimeInMs():
            yield from self._advanced(key, pd.DataFrame(columns=_ROWS.names), (*place[:-1], -1), _ALWAYS)

    def _batch(self, key: tuple, position: int, first: int, last: int, lines: list[str]) -> dict:
        text = "".join(f"{m}\n" for m in lines).encode()
        return {
            **dict(zip(self.keys, key)), "batch_id": position, "count": len(lines), "raw_len": len(text),
            "t0": first / 1e6, "t1": last / 1e6, "payload": text}

    def close(self) -> None:
        pass


def stream_batches(
    messages: DataFrame, batch_max: int = 100, batch_ms: float = 250, *, delay_ms: float, idle_ms: int | None = None,
    shard: str | None = None, end: str | None = None,
) -> DataFrame:
    """Count-or-age batches of a stream (topic, ts, seq, msg), as ``assign_batches`` in mode ``timer`` forms them.

    No message is dropped. Those that are up to *delay_ms* older than the newest of their topic are put in order, so the
    batches equal those of the whole table; older ones still join the batches that are open when they come. A row whose
    msg is null is no message and changes nothing. State is the open batch and the messages of the last *delay_ms* of a
    key, in slots of time: a micro-batch writes its own rows and reads the slots that become final, however long the delay is.

    A row whose boolean column *end* is true ends the input of its key: all that is held comes out. So it does when no
    message has arrived for *idle_ms* of processing time; what comes afterwards opens a new batch. A topic that is too
    much for one task needs a *shard* column: each shard then forms batches of its own.
    """
    keys = ["topic", *([shard] if shard else [])]
    ends = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = messages.select(*keys, F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), "msg", ends.alias("ends"))
    out = T.StructType([
        *[rows.schema[k] for k in keys],
        *T.StructType.fromDDL(
            "batch_id BIGINT, count BIGINT, raw_len BIGINT, t0 DOUBLE, t1 DOUBLE, payload BINARY").fields])
    processor = _Batcher(keys, batch_max, int(round(batch_ms * 1000)), int(round(delay_ms * 1000)), idle_ms)
    mode = "None" if idle_ms is None else "ProcessingTime"
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", mode)


class _Monitor(StatefulProcessor):
    def __init__(self, alpha: float, warmup: int, drift: float, consecutive: int, recovery: float):
        self.alpha, self.warmup, self.drift = alpha, max(warmup, 1), drift
        self.consecutive, self.recovery = max(consecutive, 1), recovery

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("monitor", "ema DOUBLE, base DOUBLE, n BIGINT, state STRING, run BIGINT")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ema, base, n, state, run = self.state.get() if self.state.exists() else (None, None, 0, "warmup", 0)
        for block in _in_order(rows, ["us", "seq", "retrain", "ratio"]):
            out = []
            for us, seq, retrain, ratio in zip(*block, strict=True):
                if retrain:
                    base, state, run = ema, "normal", 0
                    continue
                n += 1
                ema = ratio if ema is None else ema + self.alpha * (ratio - ema)
                event = "ratio_update"
                rel = None if base is None else (ema - base) / max(base, 1e-9)
                if state == "warmup" and n >= self.warmup:
                    base, state, event = ema, "normal", "warmup_complete"
                elif state == "normal":
                    run = run + 1 if rel is not None and rel > self.drift else 0
                    if run >= self.consecutive:
                        state, event = "drifted", "drift_detected"
                elif state == "drifted" and rel is not None and rel <= self.recovery:
                    state, event, run = "normal", "recovered", 0
                out.append((key[0], us, seq, ratio, ema, base, 0.0 if base is None else ema - base, event, n, state, run))
            if out:
                yield pd.DataFrame(out, columns=[
                    "topic", "us", "seq", "ratio", "ema", "baseline", "drift_magnitude", "event_type", "batch_count",
                    "state", "consecutive_drift"])
        self.state.update((ema, base, n, state, run))

    def close(self) -> None:
        pass


def stream_monitor(
    batches: DataFrame, alpha: float = 0.10, warmup: int = 20, drift: float = 0.20, consecutive: int = 3,
    recovery: float = 0.05,
) -> DataFrame:
    """Ratio events of a stream of batches (topic, ts, seq, raw_len, comp_len), as ``ratio_events`` gives them.

    A row whose optional column ``retrain`` is true stands for a retrain instead of a batch.
    """
    retrain = F.coalesce(F.col("retrain"), F.lit(False)) if "retrain" in batches.columns else F.lit(False)
    rows = batches.select(
        "topic", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"), retrain.alias("retrain"),
        (F.col("comp_len") / F.greatest(F.col("raw_len"), F.lit(1))).alias("ratio"))
    out = (
        "topic STRING, us BIGINT, seq BIGINT, ratio DOUBLE, ema DOUBLE, baseline DOUBLE, drift_magnitude DOUBLE, "
        "event_type STRING, batch_count BIGINT, state STRING, consecutive_drift BIGINT")
    events = rows.groupBy("topic").transformWithStateInPandas(
        _Monitor(alpha, warmup, drift, consecutive, recovery), out, "Append", "None")
    return events.withColumn("ts", F.timestamp_micros("us")).drop("us")


class _Breaker(StatefulProcessor):
    def __init__(self, rules: Rules):
        self.machine = _Machine(rules)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "code INT, since DOUBLE")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        code, since = self.state.get() if self.state.exists() else (0, math.nan)
        for block in _in_order(rows, ["us", "seq", "ok"]):
            out = []
            for us, seq, ok in zip(*block, strict=True):
                now = us / 1e6
                if code < 0 and self.machine.ready(since, now):
                    code = self.machine.half
                met = code
                if code >= 0:
                    code = self.machine.after(code, ok)
                    since = now if code < 0 else since
                out.append((key[0], us, seq, ok, self.machine.name(met), met >= 0, self.machine.name(code)))
            yield pd.DataFrame(out, columns=["target", "us", "seq", "ok", "state_before", "allowed", "state_after"])
        self.state.update((code, since))

    def close(self) -> None:
        pass


def stream_breaker(attempts: DataFrame, variant: str = "first", rules: Rules | None = None) -> DataFrame:
    """Breaker states of a stream of attempts (target, ts, seq, ok), as ``breaker_states`` gives them."""
    rows = attempts.select(
        "target", F.unix_micros("ts").alias("us"), F.col("seq").cast("long").alias("seq"),
        F.coalesce("ok", F.lit(False)).alias("ok"))
    out = (
        "target STRING, us BIGINT, seq BIGINT, ok BOOLEAN, state_before STRING, allowed BOOLEAN, state_after STRING")
    return rows.groupBy("target").transformWithStateInPandas(
        _Breaker(rules or VARIANTS[variant]), out, "Append", "None")
