"""Count-or-age batches per topic."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .fold import Entry, fold_rows
from .ordered import N, order_rows

#: Messages of one topic that one task walks.
CHUNK_MESSAGES = 200_000


def successors(times: np.ndarray, batch_max: int, span: int, mode: str) -> np.ndarray:
    """For each message, the index of the message that would open the next batch if it opened one.

    timer: the first message at or after the deadline opens the next batch.
    arrival: that message still joins and closes the old one.
    """
    late = np.searchsorted(times, times + span, side="left")
    late = np.maximum(late, np.arange(len(times)) + (1 if mode == "timer" else 0))
    if mode == "arrival":
        late = late + 1
    return np.minimum(late, np.arange(len(times)) + batch_max)


def _reach(times: np.ndarray, since: int, room: int, own: int, span: int, mode: str) -> tuple[int, bool]:
    """How many messages join the batch opened at *since*, which has *room* for more, and whether it is closed then.

    *own* is 1 if the first message is the one that opens the batch.
    """
    late = int(np.searchsorted(times, since + span, side="left"))
    if mode == "timer":
        late = max(late, own)
    closed = late < len(times) or room <= len(times)
    return min(late + (mode == "arrival"), room, len(times)), closed


def assign_batches(
    messages: DataFrame,
    batch_max: int = 100,
    batch_ms: float = 250,
    mode: str = "timer",
    *,
    topic: str = "topic",
    ts: str = "ts",
    seq: str = "seq",
    chunk_rows: int = CHUNK_MESSAGES,
    strategy: str = "auto",
) -> DataFrame:
    """Add ``batch_id``: the position in its topic of the message that opened the batch.

    A batch opens at its first message and closes once it holds *batch_max* messages or is *batch_ms* old. In mode
    ``timer`` a message arriving at the deadline or later starts the next batch; in mode ``arrival`` the age is only
    looked at when a message arrives, so that message is the last of the old batch. *ts* is a timestamp and with *seq*
    orders the messages of a topic.

    Only times and positions are walked in Python; texts stay where they are. The position of the next opener depends on
    the opener alone, and lies at most *batch_max* messages ahead. A chunk of a hot topic is therefore summarized as a map over its first *batch_max* messages: if that message opens a batch,
    which message of the next chunk opens one.
    """
    if mode not in ("timer", "arrival"):
        raise ValueError(f"unknown mode {mode!r}")
    if batch_max < 1 or batch_ms < 0:
        raise ValueError("batch_max must be at least 1 and batch_ms at least 0")
    span = int(round(batch_ms * 1000))
    chunk_rows = max(chunk_rows, batch_max)
    rows = order_rows(messages, [topic], [ts, seq], chunk_rows=chunk_rows, strategy=strategy)
    # messages without a time come first and count as very old
    rows = rows.add(_us=F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2 ** 62))))

    def scan(columns: list[pa.Array], state: Entry) -> tuple[list[pa.Array], Entry]:
        numbers, times = (c.to_numpy() for c in columns)
        size, opener, since = len(times), state["opener"], state["since"]
        ids = np.full(size, opener, dtype=np.int64)
        if since is None:  # so many messages belong to it, then another batch opens
            at = min(state["offset"], size)
            if at == size:
                return [pa.array(ids)], {**state, "offset": state["offset"] - size}
        else:
            at, closed = _reach(times, since, batch_max - state["count"], 0, span, mode)
            if not closed:
                return [pa.array(ids)], {**state, "count": state["count"] + size}
        if at < size:
            openers, following = [], successors(times, batch_max, span, mode).tolist()
            while at < size:
                openers.append(at)
                at = following[at]
            starts = np.array(openers)
            ids[starts[0]:] = np.repeat(numbers[starts], np.diff(np.append(starts, size)))
            last = openers[-1]
            opener, since = int(numbers[last]), int(times[last])
            _, closed = _reach(times[last:], since, batch_max, 1, span, mode)
        if closed:
            since = None
        return [pa.array(ids)], {"offset": 0, "opener": opener, "since": since, "count": size - last if since is not None else 0}

    def summarize(table: pa.Table) -> Entry:
        positions = table.column(N).to_numpy()
        first = int(positions[0])
        size = min(chunk_rows, len(positions))
        following = successors(table.column("_us").to_numpy(), batch_max, span, mode)
        # jump along the openers, doubling the stride, until each one has left the chunk
        at = np.arange(min(batch_max, size))
        opener = at.copy()
        jump, last = following.copy(), np.arange(len(following))
        inside = jump[:size] < size
        while inside.any():
            i = np.flatnonzero(inside)
            target = jump[i]
            last[i] = last[target]
            jump[i] = jump[target]
            inside = jump[:size] < size
        return {"exits": (jump[at] - size).tolist(), "openers": (first + last[opener]).tolist()}

    def compose(a: Entry, b: Entry) -> Entry:
        led = [step({"offset": x, "opener": o}, b) for x, o in zip(a["exits"], a["openers"], strict=True)]
        return {"exits": [e["offset"] for e in led], "openers": [e["opener"] for e in led]}

    def step(state: Entry, s: Entry) -> Entry:
        at = state["offset"]
        # only the last chunk of a topic is shorter than an offset
        out = (s["exits"][at], s["openers"][at]) if at < len(s["exits"]) else (at, state["opener"])
        return {"offset": out[0], "opener": out[1], "since": None, "count": 0}

    rows = fold_rows(
        rows, [N, "_us"], [T.StructField("batch_id", T.LongType())], scan, {"offset": 0, "opener": 1, "since": None, "count": 0},
        [T.StructField("exits", T.ArrayType(T.LongType())), T.StructField("openers", T.ArrayType(T.LongType()))],
        summarize,
        [T.StructField("offset", T.LongType()), T.StructField("opener", T.LongType()), T.StructField("since", T.LongType()),
         T.StructField("count", T.LongType())],
        step, compose, overlap=batch_max,
    )
    return rows.on(rows.df.drop("_us")).result()


def build_batches(
    messages: DataFrame, *, topic: str = "topic", ts: str = "ts", seq: str = "seq", msg: str = "msg",
    schema_id: str = "s1",
) -> DataFrame:
    """One row per batch: payload (messages in order, one per line, with a final line break) and its counts.

    A group is one batch, so its size is bounded by batch_max; first_ts and last_ts are those of its messages. Rows
    without text, such as messages that normalization refused, are no messages and do not count.
    """
    line = F.struct(F.col(ts), F.col(seq), F.col(msg).alias("msg"))
    lines = F.transform(F.array_sort(F.collect_list(line)), lambda x: x["msg"])
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)
    return (
        messages.filter(F.col(msg).isNotNull()).groupBy(topic, "batch_id")
        .agg(
            lines.alias("_lines"),
            F.count(F.lit(1)).alias("count"),
            F.sum(F.octet_length(msg).cast("long") + 1).alias("raw_len"),
            F.min(ts).alias("first_ts"),
            F.max(ts).alias("last_ts"),
        )
        .select(
            F.col(topic), "batch_id", "count", "raw_len", "first_ts", "last_ts",
            F.encode(F.concat(F.array_join("_lines", "\n"), F.lit("\n")), "utf-8").alias("payload"),
            F.lit(schema_id).alias("schema_id"),
            seconds(F.col("first_ts")).alias("t0"),
            seconds(F.col("last_ts")).alias("t1"),
        )
    )


def payload_size(messages: DataFrame, msg: str = "msg") -> DataFrame:
    """Add msg_bytes, the UTF-8 length of a message; a batch counts one byte more per message for its line break."""
    return messages.withColumn("msg_bytes", F.octet_length(msg).cast("long"))
