"""The given tables as messages, batches, attempts, registries and timelines, each with the same thing in SQL.

Everything here is one pass over whole tables; what a query needs beyond that is left to the operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import dict_id
from ..operators.ordered import order_rows, running_sums


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds of a timestamp with or without zone, whatever the session zone is."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column}::TIMESTAMP_NTZ)")


def events(spark: SparkSession, root: str) -> DataFrame:
    """Events with us (microseconds), ts (an instant) and seq."""
    rows = table(spark, root, "events").withColumn("us", micros("ts"))
    return rows.withColumn("ts", F.timestamp_micros("us")).withColumnRenamed("event_id", "seq")


def _json(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _body(kind: Column, props: Column) -> list[str | Column]:
    cents = F.round(F.col("value") * 100).cast("long")
    return ['{"event_id":', F.col("seq"), ',"user_id":', F.col("user_id"), ',"kind":"', kind, '","cents":', cents,
            ',"props":', props]


EVENT_SCHEMA = (
    "event_id BIGINT, user_id BIGINT, kind STRING, cents BIGINT, props STRUCT<k: BIGINT>, headers MAP<STRING, STRING>")


def raw_messages(spark: SparkSession, root: str) -> DataFrame:
    """One JSON message per event, with blanks and a volatile header: topic, ts, seq, msg."""
    kind = F.col("event_type")
    msg = _json(*_body(kind, F.col("props")), ',"headers":{"Accept":"*/*", "X-Amzn-Trace-Id":"Root=', F.col("seq"), '"}}')
    return events(spark, root).select(
        F.concat(F.lit("events."), kind).alias("topic"), "us", "ts", "seq", msg.alias("msg"))


def messages(spark: SparkSession, root: str) -> DataFrame:
    """The same messages in normal form."""
    kind = F.col("event_type")
    msg = _json(*_body(kind, F.translate("props", " ", "")), ',"headers":{"Accept":"*/*"}}')
    return events(spark, root).select(
        F.concat(F.lit("events."), kind).alias("topic"), "us", "ts", "seq", msg.alias("msg"))


MESSAGES = """
m AS (
  SELECT 'events.' || event_type AS topic, epoch_us(ts) AS us, event_id AS seq,
    '{"event_id":' || event_id || ',"user_id":' || user_id || ',"kind":"' || event_type || '","cents":'
      || CAST(round(value * 100) AS BIGINT) || ',"props":' || replace(props, ' ', '')
      || ',"headers":{"Accept":"*/*"}}' AS msg,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n
  FROM events)
"""


def batched(batch_max: int, span_us: int, mode: str = "timer") -> str:
    """Common table expressions that end in b: messages with their batch_id."""
    after = 1 if mode == "arrival" else 0
    return f"""
RECURSIVE {MESSAGES},
nx AS (
  SELECT a.topic, a.n, least(a.n + {batch_max}, coalesce(b.n + {after}, 9223372036854775807)) AS nxt
  FROM m a ASOF LEFT JOIN m b ON a.topic = b.topic AND a.us + {span_us} <= b.us),
op AS (
  SELECT topic, CAST(1 AS BIGINT) AS n FROM m GROUP BY topic
  UNION ALL
  SELECT nx.topic, nx.nxt FROM op JOIN nx ON op.topic = nx.topic AND op.n = nx.n
  WHERE EXISTS (SELECT 1 FROM nx z WHERE z.topic = nx.topic AND z.n = nx.nxt)),
b AS (
  SELECT m.*, max(op.n) OVER (PARTITION BY m.topic ORDER BY m.n) AS batch_id
  FROM m LEFT JOIN op ON m.topic = op.topic AND m.n = op.n)
"""


def ratio_series(spark: SparkSession, root: str) -> DataFrame:
    """A series of batch sizes per event type: topic, ts, seq, raw_len, comp_len."""
    return events(spark, root).select(
        F.col("event_type").alias("topic"), "us", "ts", "seq", F.lit(1000).cast("long").alias("raw_len"),
        F.floor(50 + F.col("value")).alias("comp_len"))


SERIES = """
s AS (
  SELECT event_type AS topic, event_id AS seq, epoch_us(ts) AS us, floor(50 + value) / 1000.0 AS r,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n
  FROM events)
"""


def flushed(spark: SparkSession, root: str) -> DataFrame:
    """Each event as a flushed batch: topic, ts, seq, count, raw_len, comp_len, flush_ms."""
    return events(spark, root).select(
        F.col("event_type").alias("topic"), "us", "ts", "seq", (F.col("user_id") % 7 + 1).alias("count"),
        (F.col("user_id") % 7 * 100 + 200).alias("raw_len"), F.floor("value").alias("comp_len"),
        F.col("value").alias("flush_ms"))


FLUSHED = """
f AS (
  SELECT event_type AS topic, epoch_us(ts) AS us, event_id AS seq, user_id % 7 + 1 AS count,
    user_id % 7 * 100 + 200 AS raw_len, CAST(floor(value) AS BIGINT) AS comp_len, value AS flush_ms
  FROM events)
"""


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """Delivery attempts per user group: target, at (seconds), seq, ok. Errors and purchases fail."""
    return events(spark, root).select(
        F.concat(F.lit("u"), (F.col("user_id") % 8).cast("string")).alias("target"), "ts",
        (F.col("us") / 1e6).alias("at"), "seq", (~F.col("event_type").isin("error", "purchase", "view")).alias("ok"))


def gate_log(spark: SparkSession, root: str) -> DataFrame:
    """Queue operations per user group: queue, ts, seq, op, n, delay_ms."""
    kind = F.col("event_type")
    op = (F.when(kind == "click", "acquire").when(kind == "view", "release").when(kind == "error", "drop")
          .when(kind == "signup", "delay").otherwise("block"))
    return events(spark, root).select(
        F.concat(F.lit("q"), (F.col("user_id") % 5).cast("string")).alias("queue"), "ts", "seq", op.alias("op"),
        (F.floor(F.col("value") / 10) - 1).alias("n"), F.col("value").alias("delay_ms"))


GATE = """
g AS (
  SELECT 'q' || (user_id % 5) AS queue, ts, event_id AS seq,
    CASE event_type WHEN 'click' THEN 'acquire' WHEN 'view' THEN 'release' WHEN 'error' THEN 'drop'
      WHEN 'signup' THEN 'delay' ELSE 'block' END AS op,
    CAST(floor(value / 10) - 1 AS BIGINT) AS n, value AS delay_ms
  FROM events)
"""


def document_registry(spark: SparkSession, root: str) -> DataFrame:
    """Every document as a dictionary version of its source."""
    docs = table(spark, root, "documents")
    doc = F.col("doc_id")
    created = (doc * 60).cast("double")
    return docs.select(
        F.col("source").alias("topic"), doc.cast("int").alias("version"),
        dict_id(F.col("source"), doc, F.encode("text", "utf-8")).alias("dict_id"),
        F.encode("text", "utf-8").alias("dict_bytes"), created.alias("created_at"),
        F.when(doc % 5 != 0, created + 6000.0).alias("retired_at"))


REGISTRY = """
v AS (
  SELECT source AS topic, doc_id AS version, replace(replace(source, '.', '_'), '-', '_') AS safe,
    'd:' || replace(replace(source, '.', '_'), '-', '_') || ':v' || doc_id || ':' || substr(sha256(text), 1, 12) AS dict_id,
    strlen(text) AS size, CAST(doc_id * 60 AS DOUBLE) AS created_at,
    CASE WHEN doc_id % 5 <> 0 THEN doc_id * 60 + 6000.0 END AS retired_at
  FROM documents)
"""


def document_messages(spark: SparkSession, root: str) -> DataFrame:
    """Whole documents as messages of their source: topic, ts, seq, msg."""
    return table(spark, root, "documents").select(
        F.col("source").alias("topic"), F.col("doc_id").alias("ts"), F.col("doc_id").alias("seq"), F.col("text").alias("msg"))


def pending(spark: SparkSession, root: str) -> DataFrame:
    """Orders as frames waiting for delivery: id, topic, payload, timestamp."""
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("topic"),
        F.encode(F.concat(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")), "utf-8").alias("payload"),
        (micros("o_orderdate") / 1e6).alias("timestamp"))


PENDING = """
p AS (
  SELECT o_orderkey AS id, o_orderpriority AS topic, strlen(o_orderstatus || o_orderkey) AS size,
    epoch_us(o_orderdate) / 1e6 AS timestamp
  FROM orders)
"""


def timeline(spark: SparkSession, root: str) -> DataFrame:
    """Hourly health samples per event type, with counters that grow."""
    hour = F.floor(F.col("us") / 3_600_000_000) * 3600
    hourly = events(spark, root).groupBy(F.col("event_type").alias("series"), hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("msgs"), F.sum(F.floor("value")).alias("out"))
    rows = order_rows(hourly, ["series"], ["hour"])
    rows = running_sums(rows, msgs_processed="msgs", bytes_out="out").result()
    day = F.col("hour") / 86400 % 30
    level = F.col("msgs")
    return rows.select(
        "series", F.col("hour").cast("double").alias("timestamp"),
        F.when(day < 10, "Normal").when(day < 20, "Outage").otherwise("Recovery").alias("step"),
        F.col("msgs").alias("buffer_count"),
        F.when(level >= 4, "OPEN").when(level == 3, "HALF_OPEN").otherwise("CLOSED").alias("breaker_state"),
        "msgs_processed", (F.col("msgs_processed") * 100).alias("bytes_in"), "bytes_out",
        (F.col("bytes_out") / (F.col("msgs_processed") * 100)).alias("ratio"))


TIMELINE = """
h AS (
  SELECT event_type AS series, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS hour, count(*) AS msgs,
    sum(CAST(floor(value) AS BIGINT)) AS out
  FROM events GROUP BY ALL),
t AS (
  SELECT series, CAST(hour AS DOUBLE) AS timestamp,
    CASE WHEN hour / 86400 % 30 < 10 THEN 'Normal' WHEN hour / 86400 % 30 < 20 THEN 'Outage' ELSE 'Recovery' END AS step,
    msgs AS buffer_count, CASE WHEN msgs >= 4 THEN 'OPEN' WHEN msgs = 3 THEN 'HALF_OPEN' ELSE 'CLOSED' END AS breaker_state,
    CAST(sum(msgs) OVER w AS BIGINT) AS msgs_processed, CAST(sum(msgs) OVER w * 100 AS BIGINT) AS bytes_in,
    CAST(sum(out) OVER w AS BIGINT) AS bytes_out
  FROM h WINDOW w AS (PARTITION BY series ORDER BY hour))
"""
