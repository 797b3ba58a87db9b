"""One query per operator over the given tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.auth import sign_frames, verify_frames
from ..functions.checks import (
    TOPIC_ERRORS, observe_outcomes, outcome_counts, quarantine, validate_dict_id, validate_header, validate_sizes, validate_topic)
from ..functions.normalize import normalize
from ..functions.scalars import dict_id, pressure_cols, ratio_cols, trained_dict_id
from ..operators.batching import assign_batches, build_batches, payload_size
from ..operators.breaker import Rules, breaker_health, breaker_states, breaker_stats
from ..operators.codec import (
    compress_batches, compression_report, decode_frames, reconcile, train_dicts, train_global_dict)
from ..operators.delivery import evict_pending, merge_delivery, oldest_pending, pending_stats, settle
from ..operators.drift import ema, monitor_stats, ratio_baseline, ratio_events
from ..operators.metrics import (
    batch_latency, error_counts, health_snapshot, metrics_csv, metrics_report, overall_metrics, running_metrics,
    topic_metrics)
from ..operators.pressure import queue_depth, queue_stats
from ..operators.registry import (
    active_versions, attach_active_dict, attach_dict_by_id, budget_prefix, dict_as_of, gc_report, publish_versions,
    registry_stats, registry_totals, retrain_candidates, sample_stats, sample_window, training_readiness)
from ..operators.timeline import outage_latency, phase_summary, rates, state_intervals, timeline_curves
from ..schemas import REGISTRY as REGISTRY_SCHEMA, SENSOR
from ..session import scratch_path, scratch_table
from ..sources.files import log_events, read_messages, read_samples, read_timeline
from ..sources.frames import encode_frames, read_frame_table, read_frames, split_frames
from ..sources.registry_store import current_registry, index_entries, index_json, publish_snapshot, write_dict_files
from ..sources.sinks import frame_metrics, write_metrics, write_topic_jsonl
from ..streaming.flows import decode_sink, ingest, metrics_sink, retrain_step, run_available, run_each, window_metrics
from ..streaming.stateful import stream_batches, stream_breaker, stream_monitor
from . import inputs as i

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

HOUR_US = 3_600_000_000
KEY = "000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def small_chunks(spark: SparkSession, root: str, name: str) -> dict:
    """Arguments that make an operator cut keys into chunks at any scale: some twenty chunks over the table."""
    return {"strategy": "chunked", "chunk_rows": max(20, i.table(spark, root, name).count() // 20)}


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


# Batches

BATCH_COLUMNS = "topic, batch_id, count(*) AS count, CAST(sum(strlen(msg) + 1) AS BIGINT) AS raw_len, min(us) AS first_us, max(us) AS last_us"


def _batches(spark: SparkSession, root: str, **kw) -> DataFrame:
    rows = assign_batches(i.messages(spark, root), 100, 6 * 3_600_000, **kw)
    return build_batches(rows)


@query(f"WITH {i.batched(20, 6 * HOUR_US)} SELECT topic, seq, batch_id FROM b")
def batches_by_timer(spark, root):
    return assign_batches(i.messages(spark, root), 20, 6 * 3_600_000).select("topic", "seq", "batch_id")


@query(f"WITH {i.batched(20, 6 * HOUR_US)} SELECT topic, seq, batch_id FROM b")
def batches_by_timer_chunked(spark, root):
    rows = assign_batches(i.messages(spark, root), 20, 6 * 3_600_000, **small_chunks(spark, root, "events"))
    return rows.select("topic", "seq", "batch_id")


@query(f"WITH {i.batched(20, 6 * HOUR_US, 'arrival')} SELECT topic, seq, batch_id FROM b")
def batches_by_arrival(spark, root):
    return assign_batches(i.messages(spark, root), 20, 6 * 3_600_000, "arrival").select("topic", "seq", "batch_id")


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}
SELECT {BATCH_COLUMNS}, sha256(string_agg(msg || chr(10), '' ORDER BY n)) AS payload_sha,
  min(us) / 1000000.0 AS t0, max(us) / 1000000.0 AS t1
FROM b GROUP BY topic, batch_id""")
def batch_payloads(spark, root):
    return _batches(spark, root).select(
        "topic", "batch_id", "count", "raw_len", F.unix_micros("first_ts").alias("first_us"),
        F.unix_micros("last_ts").alias("last_us"), F.sha2("payload", 256).alias("payload_sha"), "t0", "t1")


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}, x AS (SELECT {BATCH_COLUMNS} FROM b GROUP BY topic, batch_id)
SELECT topic, count(*) AS flush_count, CAST(sum(count) AS BIGINT) AS messages_processed,
  CAST(sum(raw_len) AS BIGINT) AS bytes_in, max(last_us) AS last_us
FROM x GROUP BY topic""")
def batch_flow(spark, root):
    """From messages to per-topic metrics: validate, batch, build, aggregate."""
    valid, _ = quarantine(validate_topic(i.messages(spark, root)))
    batches = build_batches(assign_batches(valid, 100, 6 * 3_600_000)).select(
        "topic", "count", "raw_len", F.col("raw_len").alias("comp_len"), F.lit(0.0).alias("flush_ms"),
        F.col("last_ts").alias("ts"))
    return topic_metrics(batches).select(
        "topic", "flush_count", "messages_processed", "bytes_in", F.unix_micros("last_flush_timestamp").alias("last_us"))


# Messages, scalars and checks

@query(f"WITH {i.MESSAGES} SELECT seq, msg FROM m")
def normalize_any_json(spark, root):
    return normalize(i.raw_messages(spark, root).select("seq", "msg"))


@query(f"WITH {i.MESSAGES} SELECT seq, msg FROM m")
def normalize_typed(spark, root):
    return normalize(i.raw_messages(spark, root), schema=i.EVENT_SCHEMA).select("seq", "msg")


@query("""SELECT event_id AS seq, '{"cents":' || CAST(round(value * 100) AS BIGINT) || ',"event_id":' || event_id
  || ',"headers":{"Accept":"*/*"},"kind":"' || event_type || '","props":' || replace(props, ' ', '')
  || ',"user_id":' || user_id || '}' AS msg FROM events""")
def normalize_sorted_keys(spark, root):
    return normalize(i.raw_messages(spark, root).select("seq", "msg"), sort_keys=True)


@query("SELECT source AS topic, count(*) AS messages, CAST(sum(strlen(text) + 1) AS BIGINT) AS raw_len FROM documents GROUP BY 1")
def message_bytes(spark, root):
    sized = payload_size(i.document_messages(spark, root))
    return sized.groupBy("topic").agg(
        F.count(F.lit(1)).alias("messages"), F.sum(F.col("msg_bytes") + 1).alias("raw_len"))


@query(f"""WITH {i.FLUSHED}
SELECT seq, round(comp_len / greatest(raw_len, 1), 6) AS ratio, raw_len - comp_len AS bytes_saved,
  round((1 - comp_len / greatest(raw_len, 1)) * 100, 1) AS savings_pct, round(comp_len / count, 6) AS bytes_per_msg
FROM f""")
def batch_ratios(spark, root):
    rows = ratio_cols(i.flushed(spark, root))
    return rows.select("seq", r6("ratio").alias("ratio"), "bytes_saved", "savings_pct", r6("bytes_per_msg").alias("bytes_per_msg"))


@query(f"""WITH {i.REGISTRY}
SELECT version, v.dict_id, 'd:' || source || ':' || substr(sha256(text), 1, 16) AS trained_id
FROM v JOIN documents ON doc_id = version""")
def dictionary_ids(spark, root):
    rows = i.document_registry(spark, root)
    return rows.select(
        F.col("version").cast("long").alias("version"),
        dict_id(F.col("topic"), F.col("version"), F.col("dict_bytes")).alias("dict_id"),
        trained_dict_id(F.col("topic"), F.col("dict_bytes")).alias("trained_id"))


_PADS = [bytes(b ^ pad for b in bytes.fromhex(KEY).ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"""SELECT doc_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(text)))) AS hmac,
  doc_id % 3 <> 0 AS verified FROM documents""")
def payload_signatures(spark, root):
    docs = i.table(spark, root, "documents").select("doc_id", F.encode("text", "utf-8").alias("payload"))
    signed = sign_frames(docs, KEY)
    sent = signed.withColumn("hmac", F.when(F.col("doc_id") % 3 != 0, F.col("hmac")).otherwise(F.reverse("hmac")))
    back = verify_frames(sent, KEY).drop("payload")
    return back.select(
        "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("hmac")).otherwise(F.reverse("hmac")).alias("hmac"), "verified")


@query("""WITH q AS (SELECT event_id AS seq, CAST(floor(value) AS BIGINT) AS queued FROM events)
SELECT seq, round(CASE WHEN queued <= 20 THEN 0.0 ELSE least(1.0, (queued - 20) / 80.0) END, 4) AS pressure,
  round(CASE WHEN queued <= 20 THEN 0.0 ELSE least(50.0, 50.0 * (queued - 20) / 80.0) END, 6) AS delay_ms,
  round(queued / 100 * 100, 1) AS queue_pct FROM q""")
def queue_pressure(spark, root):
    rows = i.events(spark, root).select("seq", F.floor("value").alias("queued"))
    return pressure_cols(rows, 20, 100, 50.0).select("seq", "pressure", r6("delay_ms").alias("delay_ms"), "queue_pct")


TOPIC_RULES = """CASE WHEN topic IS NULL OR topic = '' THEN 'empty' WHEN length(topic) > 255 THEN 'too_long'
  WHEN contains(topic, '..') THEN 'path_traversal' WHEN topic LIKE '/%' OR starts_with(topic, chr(92)) THEN 'leading_separator'
  WHEN NOT regexp_full_match(topic, '[a-zA-Z0-9._-]+') THEN 'bad_character'
  WHEN topic LIKE '%.' THEN 'trailing_dot' ELSE 'valid' END"""

CANDIDATES = """c AS (
  SELECT page_id AS id, CASE page_id % 7 WHEN 0 THEN url WHEN 1 THEN replace(split_part(url, '/', 3), '/', '')
    WHEN 2 THEN '/' || split_part(url, '/', 3) WHEN 3 THEN '../' || split_part(url, '/', 3)
    WHEN 4 THEN split_part(url, '/', 3) || '.' WHEN 5 THEN repeat(split_part(url, '/', 3), 20) ELSE '' END AS topic
  FROM pages)"""


def _candidates(spark: SparkSession, root: str) -> DataFrame:
    """Topic names, good and bad, from page addresses."""
    host, kind = F.split_part("url", F.lit("/"), F.lit(3)), F.col("page_id") % 7
    topic = (F.when(kind == 0, F.col("url")).when(kind == 1, host).when(kind == 2, F.concat(F.lit("/"), host))
             .when(kind == 3, F.concat(F.lit("../"), host)).when(kind == 4, F.concat(host, F.lit(".")))
             .when(kind == 5, F.repeat(host, F.lit(20))).otherwise(""))
    return i.table(spark, root, "pages").select(F.col("page_id").alias("id"), topic.alias("topic"))


@query(f"WITH {CANDIDATES} SELECT id, {TOPIC_RULES} AS outcome FROM c")
def topic_checks(spark, root):
    return validate_topic(_candidates(spark, root)).select("id", F.coalesce("error", F.lit("valid")).alias("outcome"))


@query(f"WITH {CANDIDATES} SELECT {TOPIC_RULES} AS outcome, count(*) AS frames FROM c GROUP BY 1")
def topic_quarantine(spark, root):
    """Valid and rejected rows written in one pass over the input, which counts them as well."""
    rows, seen = observe_outcomes(validate_topic(_candidates(spark, root)), TOPIC_ERRORS)
    path = scratch_path(spark, "judged")
    rows.withColumn("usable", F.col("error").isNull()).write.partitionBy("usable").parquet(path)
    return outcome_counts(spark, seen)


@query(f"""WITH {CANDIDATES} SELECT id, CASE WHEN topic = '' THEN 'valid' WHEN length(topic) > 128 THEN 'too_long'
  WHEN NOT regexp_full_match(topic, '[a-zA-Z0-9.:_-]+') THEN 'bad_character' ELSE 'valid' END AS outcome FROM c""")
def dict_id_checks(spark, root):
    checked = validate_dict_id(_candidates(spark, root), "topic")
    return checked.select("id", F.coalesce("error", F.lit("valid")).alias("outcome"))


@query("""SELECT count(*) AS messages, count(*) FILTER (strlen(text) > 10485760) AS too_large,
  count(*) FILTER (strlen(text) > 1500) AS above_lower FROM documents""")
def message_size_checks(spark, root):
    checked = validate_sizes(i.document_messages(spark, root))
    checked = validate_sizes(checked, error="lower", msg_bytes=1500)
    return checked.agg(F.count(F.lit(1)).alias("messages"), F.count("error").alias("too_large"), F.count("lower").alias("above_lower"))


def _headers(spark: SparkSession, root: str) -> DataFrame:
    """Frame headers from events, most of them broken in one way each."""
    kind = F.col("seq") % 12
    part = lambda name, good, *bad: F.concat(F.lit(f'"{name}":'), _choose(kind, good, bad))
    fields = F.concat_ws(
        ",",
        part("v", F.lit("1"), (1, F.lit("2")), (2, F.lit('"1"'))),
        F.when(kind != 3, part("topic", _quoted(F.concat(F.lit("events."), F.col("event_type"))), (4, F.lit('"a b"')), (5, F.lit("7")))),
        F.lit('"codec":"zstd"'),
        part("count", (F.col("user_id") + 1).cast("string"), (6, F.lit("0")), (7, F.lit("5.0"))),
        part("raw_len", F.floor("value").cast("string"), (8, F.lit("-1"))),
        F.when(kind != 9, part("comp_len", F.lit("10"))),
        part("dict_id", F.lit('""'), (10, F.lit('"a b"'))),
    )
    return i.events(spark, root).select("seq", F.concat(F.lit("{"), fields, F.lit("}")).alias("header"))


def _quoted(column: Column) -> Column:
    return F.concat(F.lit('"'), column, F.lit('"'))


def _choose(kind: Column, good: Column, bad: tuple) -> Column:
    value = good
    for number, text in bad:
        value = F.when(kind == number, text).otherwise(value)
    return value


@query("""SELECT event_id AS seq, CASE event_id % 12 WHEN 1 THEN 'version' WHEN 2 THEN 'version' WHEN 3 THEN 'missing:topic'
  WHEN 4 THEN 'topic_bad_character' WHEN 5 THEN 'topic_type' WHEN 6 THEN 'count' WHEN 7 THEN 'count' WHEN 8 THEN 'raw_len'
  WHEN 9 THEN 'missing:comp_len' WHEN 10 THEN 'dict_id_bad_character' ELSE 'valid' END AS outcome FROM events""")
def header_checks(spark, root):
    return validate_header(_headers(spark, root)).select("seq", F.coalesce("error", F.lit("valid")).alias("outcome"))


@query(f"""WITH {i.MESSAGES}
SELECT seq, topic, CASE WHEN seq % 10 = 0 THEN 'bad_character' ELSE 'valid' END AS outcome,
  CASE WHEN seq % 10 = 0 THEN 'x' ELSE msg END AS msg FROM m WHERE seq % 10 <> 0
UNION ALL SELECT seq, topic || ' ', 'bad_character', 'x' FROM m WHERE seq % 10 = 0""")
def ingested_messages(spark, root):
    rows = i.raw_messages(spark, root)
    rows = rows.withColumn("topic", F.when(F.col("seq") % 10 == 0, F.concat("topic", F.lit(" "))).otherwise(F.col("topic")))
    done = ingest(rows)
    return done.select(
        "seq", "topic", F.coalesce("error", F.lit("valid")).alias("outcome"),
        F.when(F.col("error").isNull(), F.col("msg")).otherwise(F.lit("x")).alias("msg"))


# Compression and frames


def _trained(spark: SparkSession, root: str, size: int = 512) -> DataFrame:
    """A registry with one dictionary per event topic, trained on its newest messages."""
    samples = sample_window(i.messages(spark, root), 2_000, 256 * 1024)
    trained = train_dicts(samples, size).filter(F.col("error").isNull())
    return scratch_table(publish_versions(spark.createDataFrame([], REGISTRY_SCHEMA), trained, 1.0), "registry")


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}
SELECT topic, batch_id, row_number() OVER (PARTITION BY topic, batch_id ORDER BY n) - 1 AS pos, msg FROM b""")
def frames_round_trip(spark, root):
    """Batch, compress, sign, verify, decode: the lines are the messages."""
    registry = _trained(spark, root)
    frames = sign_frames(compress_batches(_batches(spark, root), registry), KEY)
    lines = decode_frames(frames, registry, KEY).lines
    return lines.select("topic", "batch_id", F.col("pos").cast("long").alias("pos"), "msg")


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}, x AS (SELECT {BATCH_COLUMNS} FROM b GROUP BY topic, batch_id)
SELECT topic, batch_id, count AS header_count, raw_len AS header_bytes, count AS decoded_count, raw_len AS decoded_bytes,
  true AS agrees FROM x""")
def frames_reconciled(spark, root):
    registry = _trained(spark, root)
    frames = scratch_table(compress_batches(_batches(spark, root), registry, "zlib"), "frames")
    lines = decode_frames(frames, registry).lines
    return reconcile(frames, lines, ["topic", "batch_id"])


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}, x AS (SELECT {BATCH_COLUMNS} FROM b GROUP BY topic, batch_id)
SELECT topic, true AS all_smaller, count(*) AS frames, CAST(sum(raw_len) AS BIGINT) AS raw_len, 'zstd' AS codec
FROM x GROUP BY topic""")
def frames_compressed(spark, root):
    frames = compress_batches(_batches(spark, root), _trained(spark, root))
    return frames.groupBy("topic").agg(
        F.bool_and(F.col("comp_len") < F.col("raw_len")).alias("all_smaller"), F.count(F.lit(1)).alias("frames"),
        F.sum("raw_len").alias("raw_len"), F.max("codec").alias("codec"))


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}, x AS (SELECT {BATCH_COLUMNS} FROM b GROUP BY topic, batch_id),
y AS (SELECT CASE WHEN grouping(topic) = 1 THEN '*' ELSE topic END AS topic, CAST(sum(count) AS BIGINT) AS messages,
  CAST(sum(raw_len) AS BIGINT) AS raw_total FROM x GROUP BY ROLLUP (topic))
SELECT topic, method, messages, raw_total, round(raw_total / messages, 6) AS raw_avg, method <> 'raw' AS smaller
FROM y CROSS JOIN (VALUES ('raw'), ('no_dict'), ('global_dict'), ('topic_dict')) AS k(method)""")
def compression_methods(spark, root):
    messages = i.messages(spark, root)
    trained = scratch_table(train_dicts(sample_window(messages, 2_000, 256 * 1024), 512), "trained")
    shared = scratch_table(train_global_dict(messages, 512, max_samples=2_000), "shared")
    report = compression_report(_batches(spark, root), trained, shared)
    return report.select(
        "topic", "method", "messages", "raw_total", r6("raw_avg").alias("raw_avg"),
        (F.col("comp_total") < F.col("raw_total")).alias("smaller"))


WIRE = f"""WITH {i.batched(100, 6 * HOUR_US)}
SELECT topic, batch_id, count(*) AS count, CAST(sum(strlen(msg) + 1) AS BIGINT) AS raw_len, min(us) / 1000000.0 AS t0,
  max(us) / 1000000.0 AS t1, sha256(string_agg(msg || chr(10), '' ORDER BY n)) AS payload_sha
FROM b GROUP BY topic, batch_id"""


def _plain_frames(spark: SparkSession, root: str) -> DataFrame:
    frames = _batches(spark, root).withColumns({
        "v": F.lit(1), "codec": F.lit("none"), "level": F.lit(7), "dict_id": F.lit(""), "comp_len": F.col("raw_len")})
    # the batch number travels as the schema id, so that the result can name its batch
    return encode_frames(frames.withColumn("schema_id", F.col("batch_id").cast("string")))


def _read_back(frames: DataFrame) -> DataFrame:
    return frames.filter(F.col("error").isNull()).select(
        "topic", F.col("schema_id").cast("long").alias("batch_id"), "count", "raw_len", "t0", "t1",
        F.sha2("payload", 256).alias("payload_sha"))


@query(WIRE)
def wire_blobs(spark, root):
    """Several frames in a row in one binary value, split again."""
    frames = _plain_frames(spark, root).withColumn("part", F.floor(F.col("batch_id") / 400))
    ordered = F.array_sort(F.collect_list(F.struct("batch_id", F.hex("frame").alias("frame"))))
    blobs = frames.groupBy("topic", "part").agg(
        F.unhex(F.array_join(F.transform(ordered, lambda x: x["frame"]), "")).alias("content"))
    return _read_back(split_frames(blobs.withColumn("path", F.col("topic"))))


@query(f"""WITH {i.batched(100, 6 * HOUR_US)} SELECT topic, n AS pos, msg FROM (
  SELECT topic, msg, row_number() OVER (PARTITION BY topic ORDER BY n) - 1 AS n FROM b)""")
def wire_files_round_trip(spark, root, file_messages=40_000):
    """Batches compressed and signed, written as wire files, read, verified and decoded again to all their lines."""
    registry, path = _trained(spark, root), scratch_path(spark, "wire")
    frames = encode_frames(sign_frames(compress_batches(_batches(spark, root), registry), KEY).withColumn("schema_id", F.col("batch_id").cast("string")))
    # opening and naming a file costs far more than a few frames do
    frames = frames.withColumn("part", F.floor(F.col("batch_id") / file_messages))
    ordered = F.array_sort(F.collect_list(F.struct("batch_id", F.hex("frame").alias("frame"))))
    blobs = frames.groupBy("topic", "part").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["frame"]), "")).alias("content"))
    # one value per file; what ends a line ends the file with a byte that is no frame
    blobs.select("topic", "part", F.col("content").cast("string").alias("value")).write.partitionBy("topic", "part").option("lineSep", "\0").text(path)
    read = read_frames(spark, path)
    lines = decode_frames(read.filter(F.col("error").isNull()).drop("error", "path", "pos", "bytes_left", "header"), registry, KEY).lines
    return lines.select("topic", (F.col("schema_id").cast("long") - 1 + F.col("pos")).alias("pos"), "msg")


@query(WIRE)
def wire_table(spark, root):
    path = scratch_path(spark, "frames")
    _plain_frames(spark, root).select("frame").write.parquet(path)
    return _read_back(read_frame_table(spark, path))


@query(f"""WITH {i.batched(100, 6 * HOUR_US)}
SELECT CAST(batch_id AS DOUBLE) AS timestamp, topic, count(*) AS count, CAST(sum(strlen(msg) + 1) AS BIGINT) AS raw_bytes,
  CAST(sum(strlen(msg) + 1) AS BIGINT) AS compressed_bytes, CAST(1 AS DOUBLE) AS ratio, '' AS dict_id FROM b GROUP BY topic, batch_id""")
def frame_metric_rows(spark, root):
    path = scratch_path(spark, "metrics")
    write_metrics(frame_metrics(_plain_frames(spark, root), F.col("batch_id").cast("double")), path)
    rows = spark.read.schema(
        "timestamp DOUBLE, topic STRING, count BIGINT, raw_bytes BIGINT, compressed_bytes BIGINT, ratio DOUBLE, "
        "dict_id STRING").option("header", True).csv(path)
    return rows.fillna("", ["dict_id"])


# Files


@query(f"WITH {i.MESSAGES} SELECT topic, msg FROM m")
def topic_files(spark, root):
    path = scratch_path(spark, "lines")
    write_topic_jsonl(i.messages(spark, root), path, ["seq"])
    return read_samples(spark, path, "*.txt").select("topic", "msg")


@query("""SELECT 's' || (user_id % 20) AS sensor_id, event_type AS type, value, 'C' AS unit, event_id AS timestamp,
  event_id % 50 = 0 AS corrupt FROM events WHERE event_id % 50 <> 0
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, true FROM events WHERE event_id % 50 = 0""")
def typed_messages(spark, root):
    path = scratch_path(spark, "sensors")
    rows = i.events(spark, root)
    text = F.to_json(F.struct(
        F.concat(F.lit("s"), (F.col("user_id") % 20).cast("string")).alias("sensor_id"), F.col("event_type").alias("type"),
        "value", F.lit("C").alias("unit"), F.col("seq").alias("timestamp")))
    rows.select(F.when(F.col("seq") % 50 == 0, F.substring(text, 1, 20)).otherwise(text)).write.text(path)
    read = read_messages(spark, path, SENSOR)
    broken = F.col("corrupt").isNotNull()
    # a broken line may still give its first fields; only its raw text counts
    clean = [F.when(~broken, F.col(c)).alias(c) for c in ("sensor_id", "type", "value", "unit", "timestamp")]
    return read.select(*clean, broken.alias("corrupt"))


@query(f"""WITH {i.TIMELINE} SELECT step, count(*) AS samples, round(avg(bytes_out / bytes_in), 6) AS mean_ratio,
  round(1 - avg(bytes_out / bytes_in), 6) AS reduction, max(buffer_count) AS max_buffer, min(timestamp) AS first_seen,
  max(timestamp) AS last_seen FROM t GROUP BY step""")
def timeline_phases(spark, root):
    path = scratch_path(spark, "timeline")
    i.timeline(spark, root).drop("series").write.option("header", True).csv(path)
    rows = phase_summary(read_timeline(spark, path))
    return rows.withColumns({"mean_ratio": r6("mean_ratio"), "reduction": r6("reduction")})


@query("""SELECT event_id AS seq, epoch_us(ts) AS us, upper(event_type) AS level, 'user ' || user_id AS event,
  CASE WHEN event_id % 2 = 0 THEN 'agent' ELSE 'collector' END AS service, CAST(user_id AS VARCHAR) AS user FROM events""")
def log_lines(spark, root):
    even = F.col("seq") % 2 == 0
    at = F.expr("translate(timestampadd(MICROSECOND, us, TIMESTAMP_NTZ '1970-01-01 00:00:00')::STRING, ' ', 'T')")
    line = F.concat(
        F.lit('{"timestamp":"'), at, F.when(even, F.lit("")).otherwise(F.lit("+00:00")), F.lit('","level":"'), F.col("event_type"),
        F.when(even, F.lit('","event":"user ')).otherwise(F.lit('","message":"user ')), F.col("user_id").cast("string"),
        F.when(even, F.lit('","service":"agent"')).otherwise(F.lit('","logger":"collector"')),
        F.lit(',"seq":'), F.col("seq").cast("string"), F.lit(',"user":'), F.col("user_id").cast("string"), F.lit("}"))
    rows = log_events(i.events(spark, root).select(line.alias("value")))
    return rows.select(
        F.element_at("extras", "seq").cast("long").alias("seq"), F.unix_micros("ts").alias("us"), "level", "event",
        "service", F.element_at("extras", "user").alias("user"))


# Registry


@query(f"""WITH {i.REGISTRY} SELECT topic, version, dict_id, created_at, size FROM v WHERE retired_at IS NULL
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY version DESC) = 1""")
def active_dictionaries(spark, root):
    return active_versions(i.document_registry(spark, root)).select(
        "topic", F.col("version").cast("long").alias("version"), "dict_id", "created_at",
        F.octet_length("dict_bytes").cast("long").alias("size"))


@query(f"""WITH {i.REGISTRY}, a AS (SELECT topic, dict_id FROM v WHERE retired_at IS NULL
QUALIFY row_number() OVER (PARTITION BY topic ORDER BY version DESC) = 1)
SELECT e.event_id AS seq, coalesce(a.dict_id, '') AS dict_id FROM events e LEFT JOIN a ON a.topic = 'src' || (e.user_id % 25)""")
def active_dictionary_lookup(spark, root):
    batches = i.events(spark, root).select("seq", F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("topic"))
    return attach_active_dict(batches, i.document_registry(spark, root), with_bytes=False).select("seq", "dict_id")


@query(f"""WITH {i.REGISTRY}, e AS (SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'd:gone' ELSE d.dict_id END AS id
  FROM events LEFT JOIN v d ON d.version = event_id % 100)
SELECT seq, id AS dict_id, id = '' OR v.dict_id IS NOT NULL AS dict_known, coalesce(v.size, 0) AS size
FROM e LEFT JOIN v ON v.dict_id = e.id""")
def dictionary_by_id(spark, root):
    registry = scratch_table(i.document_registry(spark, root), "registry")
    named = registry.select(F.col("version").cast("long").alias("doc"), "dict_id")
    kind = F.col("seq") % 4
    used = i.events(spark, root).select("seq", (F.col("seq") % 100).alias("doc")).join(named, "doc", "left")
    frames = used.select("seq", F.when(kind == 0, "").when(kind == 1, "d:gone").otherwise(F.col("dict_id")).alias("dict_id"))
    found = attach_dict_by_id(frames, registry)
    return found.select(
        "seq", "dict_id", "dict_known", F.coalesce(F.octet_length("dict_bytes"), F.lit(0)).cast("long").alias("size"))


AS_OF = f"""WITH {i.REGISTRY},
w AS (SELECT *, least(retired_at, lead(created_at) OVER (PARTITION BY topic ORDER BY created_at)) AS ended FROM v),
e AS (SELECT event_id AS seq, 'src' || (user_id % 25) AS topic, CAST(event_id * 7 AS DOUBLE) AS t0 FROM events)
SELECT seq, CASE WHEN w.topic IS NOT NULL AND (ended IS NULL OR t0 < ended) THEN dict_id ELSE '' END AS dict_id
FROM e ASOF LEFT JOIN w ON e.topic = w.topic AND e.t0 >= w.created_at"""


def _dated(spark: SparkSession, root: str) -> DataFrame:
    return i.events(spark, root).select(
        "seq", F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("topic"),
        (F.col("seq") * 7).cast("double").alias("t0"))


@query(AS_OF)
def dictionary_as_of(spark, root):
    return dict_as_of(_dated(spark, root), i.document_registry(spark, root), seq="seq").select("seq", "dict_id")


@query(AS_OF)
def dictionary_as_of_scan(spark, root):
    rows = dict_as_of(_dated(spark, root), i.document_registry(spark, root), seq="seq", strategy="scan")
    return rows.select("seq", "dict_id")


SAMPLES = """d AS (SELECT source AS topic, doc_id AS seq, strlen(text) AS size FROM documents WHERE strlen(text) > 0),
k AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS total FROM d
  WINDOW w AS (PARTITION BY topic ORDER BY seq DESC)),
kept AS (SELECT * FROM k WHERE rank <= 30 AND total <= 40000)"""


@query(f"WITH {SAMPLES} SELECT topic, seq FROM kept")
def newest_samples(spark, root):
    return sample_window(i.document_messages(spark, root), 30, 40_000).select("topic", "seq")


@query(f"""WITH {SAMPLES}, x AS (SELECT topic, count(*) AS sample_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM kept GROUP BY 1),
y AS (SELECT topic, count(*) AS push_count FROM d GROUP BY 1)
SELECT y.topic, coalesce(sample_count, 0) AS sample_count, coalesce(total_bytes, 0) AS total_bytes, push_count,
  push_count - coalesce(sample_count, 0) AS eviction_count, round(coalesce(total_bytes, 0) / (64 * 200), 3) AS ready_ratio
FROM y LEFT JOIN x USING (topic)""")
def sample_buffer_stats(spark, root):
    docs = i.document_messages(spark, root)
    return sample_stats(docs, sample_window(docs, 30, 40_000), 64)


@query("""SELECT role AS topic, count(*) AS sample_count, CAST(sum(strlen(text)) AS BIGINT) AS total_bytes,
  round(sum(strlen(text)) / (512 * 200), 3) AS ready_ratio, sum(strlen(text)) >= 512 * 200 AS enough_bytes,
  count(*) >= 10 AS enough_samples FROM conversations GROUP BY role""")
def training_ready(spark, root):
    rows = i.table(spark, root, "conversations").select(F.col("role").alias("topic"), F.col("text").alias("msg"))
    return training_readiness(rows, 512)


BUDGET = """WITH x AS (SELECT source AS topic, doc_id, strlen(text) AS length, coalesce(sum(strlen(text) + 1) OVER
  (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT topic, doc_id, CAST(before + length + 1 AS BIGINT) AS budget_bytes FROM x WHERE before < 20000"""


def _document_files(spark: SparkSession, root: str) -> DataFrame:
    return i.table(spark, root, "documents").select(
        F.col("source").alias("topic"), "doc_id", F.octet_length("text").cast("long").alias("length"))


@query(BUDGET)
def training_budget(spark, root):
    return budget_prefix(_document_files(spark, root), 20_000, name="doc_id").select("topic", "doc_id", "budget_bytes")


@query(BUDGET)
def training_budget_chunked(spark, root):
    rows = budget_prefix(_document_files(spark, root), 20_000, name="doc_id", **small_chunks(spark, root, "documents"))
    return rows.select("topic", "doc_id", "budget_bytes")


@query("""WITH x AS (SELECT role AS topic, conv_id, turn, strlen(text) AS size FROM conversations WHERE strlen(text) > 0),
k AS (SELECT *, row_number() OVER w AS rank, sum(size) OVER w AS total FROM x
  WINDOW w AS (PARTITION BY topic ORDER BY conv_id DESC, turn DESC))
SELECT topic, count(*) AS sample_count, CAST(sum(size) AS BIGINT) AS sample_bytes, count(*) >= 10 AS trained
FROM k WHERE rank <= 2000 AND total <= 524288 GROUP BY topic""")
def trained_dictionaries(spark, root):
    rows = i.table(spark, root, "conversations").select(
        F.col("role").alias("topic"), F.col("conv_id").alias("ts"), F.col("turn").alias("seq"), F.col("text").alias("msg"))
    out = train_dicts(sample_window(rows, 2_000, 512 * 1024), 256, min_samples=10)
    return out.select("topic", "sample_count", "sample_bytes", F.col("dict_bytes").isNotNull().alias("trained"))


PUBLISHED = f"""WITH {i.REGISTRY},
last AS (SELECT topic, max(version) AS last FROM v GROUP BY topic),
fresh AS (SELECT topic, strlen(string_agg(role, '')) AS n FROM
  (SELECT 'src' || (conv_id % 25) AS topic, role FROM conversations) GROUP BY topic),
allv AS (
  SELECT v.topic, v.version, v.dict_id, v.created_at,
    CASE WHEN v.retired_at IS NULL AND v.topic IN (SELECT topic FROM fresh) THEN 1000000.0 ELSE v.retired_at END AS retired_at FROM v
  UNION ALL
  SELECT f.topic, greatest(coalesce(last, 0), 0) + 1, 'd:' || f.topic || ':v' || (greatest(coalesce(last, 0), 0) + 1) || ':'
    || substr(sha256(CAST(f.n AS VARCHAR)), 1, 12), 1000000.0, NULL
  FROM fresh f LEFT JOIN last USING (topic))"""


def _published(spark: SparkSession, root: str) -> DataFrame:
    fresh = i.table(spark, root, "conversations").groupBy(
        F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string")).alias("topic")).agg(
        F.encode(F.sum(F.octet_length("role")).cast("string"), "utf-8").alias("dict_bytes"))
    return publish_versions(i.document_registry(spark, root), fresh, 1_000_000.0)


@query(f"{PUBLISHED} SELECT topic, CAST(version AS BIGINT) AS version, dict_id, created_at, CAST(coalesce(retired_at, -1) AS DOUBLE) AS retired_at FROM allv")
def published_versions(spark, root):
    path = scratch_path(spark, "registry")
    publish_snapshot(_published(spark, root), path)
    return current_registry(spark, path).select(
        "topic", F.col("version").cast("long").alias("version"), "dict_id", "created_at",
        F.coalesce("retired_at", F.lit(-1.0)).alias("retired_at"))


@query(f"""WITH {i.REGISTRY} SELECT topic, count(*) FILTER (retired_at IS NOT NULL AND 40000 - retired_at >= 300) AS removed,
  count(*) FILTER (retired_at IS NULL OR 40000 - retired_at < 300) AS remaining FROM v GROUP BY topic""")
def collected_versions(spark, root):
    return gc_report(i.document_registry(spark, root), 40_000.0, 300.0)


@query(f"""WITH {i.REGISTRY},
a AS (SELECT topic, dict_id, version, size FROM v WHERE retired_at IS NULL
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY version DESC) = 1),
x AS (SELECT topic, count(*) AS total_versions, count(retired_at) AS retired_versions FROM v GROUP BY topic),
s AS (SELECT source AS topic, count(*) AS n FROM documents WHERE strlen(text) > 0 GROUP BY 1)
SELECT x.topic, total_versions, retired_versions, coalesce(dict_id, '') AS active_dict_id, coalesce(version, -1) AS active_version,
  coalesce(size, 0) AS active_dict_size, s.n AS push_count
FROM x LEFT JOIN a USING (topic) LEFT JOIN s USING (topic)""")
def registry_overview(spark, root):
    docs = i.document_messages(spark, root)
    stats = registry_stats(i.document_registry(spark, root), sample_stats(docs, sample_window(docs, 30, 40_000)))
    return stats.select(
        "topic", "total_versions", "retired_versions", F.coalesce("active_dict_id", F.lit("")).alias("active_dict_id"),
        F.coalesce("active_version", F.lit(-1)).cast("long").alias("active_version"), "active_dict_size", "push_count")


@query("SELECT count(DISTINCT source) AS total_topics, count(*) AS total_versions FROM documents")
def registry_size(spark, root):
    return registry_totals(i.document_registry(spark, root))


@query("""WITH x AS (SELECT source AS topic, sum(strlen(text)) AS bytes, count(*) AS n FROM documents GROUP BY 1),
e AS (SELECT 'src' || (user_id % 25) AS topic, count(*) AS drift_events FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT e.topic, drift_events, CASE WHEN e.topic IN ('src3', 'src7') THEN 'already_running'
  WHEN coalesce(bytes, 0) < 200 * 256 THEN 'not_enough_bytes' WHEN n < 10 THEN 'too_few_samples' ELSE 'retrain' END AS decision
FROM e LEFT JOIN x USING (topic)""")
def retrain_decisions(spark, root):
    drifted = i.table(spark, root, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("topic"),
        F.when(F.col("event_type") == "error", "drift_detected").otherwise("ratio_update").alias("event_type"))
    ready = training_readiness(i.document_messages(spark, root), 256)
    running = i.table(spark, root, "documents").filter(F.col("source").isin("src3", "src7")).select(F.col("source").alias("topic"))
    return retrain_candidates(drifted, ready, running)


@query(f"""WITH {i.REGISTRY} SELECT topic, dict_id, 'dicts/' || safe || '.v' || version || '.dict' AS path, size, version, created_at
FROM v WHERE retired_at IS NULL QUALIFY row_number() OVER (PARTITION BY topic ORDER BY version DESC) = 1""")
def dictionary_index(spark, root):
    text = index_json(active_versions(i.document_registry(spark, root)), "dicts")
    rows = index_entries(text)
    return rows.withColumn("version", F.col("version").cast("long"))


@query(f"""WITH {i.REGISTRY} SELECT v.topic, v.dict_id, v.version, v.size, sha256(d.text) AS content_sha256, v.created_at
FROM v JOIN documents d ON d.doc_id = v.version
WHERE retired_at IS NULL QUALIFY row_number() OVER (PARTITION BY topic ORDER BY version DESC) = 1""")
def dictionary_files(spark, root):
    """Active dictionaries written as files with an index, in two steps that the index merges, and read back."""
    path, active = scratch_path(spark, "dicts"), active_versions(i.document_registry(spark, root))
    even = F.length("topic") % 2 == 0
    write_dict_files(active.filter(even).withColumn("created_at", F.lit(0.0)), path)
    write_dict_files(active.filter(~even), path)
    rows = write_dict_files(active.filter(even), path)
    return rows.select(
        "topic", "dict_id", F.col("version").cast("long").alias("version"), F.octet_length("dict_bytes").cast("long").alias("size"),
        F.sha2("dict_bytes", 256).alias("content_sha256"), "created_at")


# Ratio monitoring

EMA = f"""WITH RECURSIVE {i.SERIES},
e AS (
  SELECT topic, n, r AS ema FROM s WHERE n = 1
  UNION ALL
  SELECT s.topic, s.n, e.ema + 0.1 * (s.r - e.ema) FROM e JOIN s ON s.topic = e.topic AND s.n = e.n + 1)
SELECT s.topic, s.seq, round(e.ema, 6) AS ema FROM e JOIN s USING (topic, n)"""


def _ratio(spark: SparkSession, root: str) -> DataFrame:
    return i.ratio_series(spark, root).withColumn("r", F.col("comp_len") / F.col("raw_len"))


@query(EMA)
def ratio_average(spark, root):
    return ema(_ratio(spark, root), "r").select("topic", "seq", r6("ema").alias("ema"))


@query(EMA)
def ratio_average_chunked(spark, root):
    rows = ema(_ratio(spark, root), "r", **small_chunks(spark, root, "events"))
    return rows.select("topic", "seq", r6("ema").alias("ema"))


@query(EMA.replace("SELECT s.topic, s.seq, round(e.ema, 6) AS ema", """SELECT s.topic, s.seq,
  coalesce(round(CASE WHEN n >= 20 THEN max(CASE WHEN n = 20 THEN e.ema END) OVER (PARTITION BY topic) END, 6), -1) AS baseline"""))
def ratio_baselines(spark, root):
    rows = ratio_baseline(i.ratio_series(spark, root))
    return rows.select("topic", "seq", F.coalesce(r6("baseline"), F.lit(-1.0)).alias("baseline"))


def _monitor_sql(retrains: bool) -> str:
    """The monitor as a row-by-row recursion; a retrain comes before every 300th batch of a topic."""
    was = "(s.n % 300 = 0)" if retrains else "false"
    base = f"CASE WHEN {was} THEN e.ema ELSE e.base END"
    state = f"CASE WHEN {was} THEN 'normal' ELSE e.state END"
    run = f"CASE WHEN {was} THEN 0 ELSE e.run END"
    return f"""WITH RECURSIVE {i.SERIES},
e AS (
  SELECT topic, n, r AS ema, CAST(NULL AS DOUBLE) AS base, 'warmup' AS state, 0 AS run, 'ratio_update' AS event_type
  FROM s WHERE n = 1
  UNION ALL
  SELECT topic, n, ema, CASE WHEN st = 'warmup' AND n >= 20 THEN ema ELSE b END,
    CASE WHEN st = 'warmup' THEN CASE WHEN n >= 20 THEN 'normal' ELSE 'warmup' END
      WHEN st = 'normal' THEN CASE WHEN ema - b > 0.2 * b AND ru + 1 >= 3 THEN 'drifted' ELSE 'normal' END
      ELSE CASE WHEN ema - b <= 0.05 * b THEN 'normal' ELSE 'drifted' END END,
    CASE WHEN st = 'normal' THEN CASE WHEN ema - b > 0.2 * b THEN ru + 1 ELSE 0 END
      WHEN st = 'drifted' AND ema - b <= 0.05 * b THEN 0 ELSE ru END,
    CASE WHEN st = 'warmup' AND n >= 20 THEN 'warmup_complete'
      WHEN st = 'normal' AND ema - b > 0.2 * b AND ru + 1 >= 3 THEN 'drift_detected'
      WHEN st = 'drifted' AND ema - b <= 0.05 * b THEN 'recovered' ELSE 'ratio_update' END
  FROM (
    SELECT s.topic, s.n, e.ema + 0.1 * (s.r - e.ema) AS ema, {base} AS b, {state} AS st, {run} AS ru
    FROM e JOIN s ON s.topic = e.topic AND s.n = e.n + 1))"""


EVENTS_SELECT = """ SELECT s.topic, s.seq, e.n AS batch_count, event_type, state, CAST(run AS BIGINT) AS consecutive_drift,
  round(ema, 6) AS ema, round(coalesce(ema - base, 0), 6) AS drift_magnitude FROM e JOIN s USING (topic, n)"""


def _events(rows: DataFrame) -> DataFrame:
    return rows.select(
        "topic", "seq", "batch_count", "event_type", "state", "consecutive_drift", r6("ema").alias("ema"),
        r6("drift_magnitude").alias("drift_magnitude"))


def _series(spark: SparkSession, root: str) -> DataFrame:
    """The series without the column that no query over it shows."""
    return i.ratio_series(spark, root).drop("us")


@query(_monitor_sql(False) + EVENTS_SELECT)
def drift_monitor(spark, root):
    return _events(ratio_events(_series(spark, root)))


@query(_monitor_sql(False) + EVENTS_SELECT)
def drift_monitor_chunked(spark, root):
    return _events(ratio_events(i.ratio_series(spark, root), **small_chunks(spark, root, "events")))


def _retrains(series: DataFrame) -> DataFrame:
    """A retrain at the time of every 300th batch of a topic; it comes before that batch."""
    from ..operators.ordered import N, order_rows

    rows = order_rows(series.select("topic", "ts", "seq"), ["topic"], ["ts", "seq"])
    return rows.df.filter(F.col(N) % 300 == 0).select("topic", "ts")


@query(_monitor_sql(True) + EVENTS_SELECT)
def drift_monitor_retrained(spark, root):
    series = _series(spark, root)
    return _events(ratio_events(series, retrains=_retrains(series)))


@query(_monitor_sql(False) + """, p AS (SELECT topic, max(r) AS peak, max(n) AS n FROM s GROUP BY topic)
SELECT topic, state, round(ema, 6) AS ema, round(base, 6) AS baseline, round(s.r, 6) AS last_ratio,
  round(p.peak, 6) AS peak_ratio, round(ema - base, 6) AS drift_magnitude, n AS batch_count,
  CAST(run AS BIGINT) AS consecutive_drift, CAST(0 AS BIGINT) AS retrain_count
FROM p JOIN e USING (topic, n) JOIN s USING (topic, n)""")
def drift_monitor_stats(spark, root):
    return monitor_stats(ratio_events(_series(spark, root)))


# Metrics

TOTALS = """CAST(sum(count) AS BIGINT) AS messages_processed, CAST(sum(raw_len) AS BIGINT) AS bytes_in,
  CAST(sum(comp_len) AS BIGINT) AS bytes_out, count(*) AS flush_count,
  round(sum(comp_len) / sum(raw_len), 6) AS compression_ratio, round(sum(flush_ms) / count(*), 6) AS avg_flush_duration_ms"""
#: Every event is a batch or an error. Errors are dated five days back, so some precede the first batch of their topic.
ERRORS = f"""er AS (SELECT topic, us - {120 * HOUR_US} AS us, CASE WHEN seq % 2 = 0 THEN 'compression' ELSE 'network' END AS kind
  FROM f WHERE flush_ms < 20)"""
LATER = "b AS (SELECT * FROM f WHERE flush_ms >= 20)"


def _rounded(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: r6(c) for c in columns})


def _errors(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = i.flushed(spark, root)
    errors = rows.filter(F.col("flush_ms") < 20).select(
        "topic", (F.col("ts") - F.expr("INTERVAL 5 DAYS")).alias("ts"),
        F.when(F.col("seq") % 2 == 0, "compression").otherwise("network").alias("kind"))
    return errors, rows.filter(F.col("flush_ms") >= 20)


@query(f"""WITH {i.FLUSHED}, {ERRORS}, {LATER}, fi AS (SELECT topic, min(us) AS us FROM b GROUP BY topic)
SELECT topic, {TOTALS}, max(us) AS last_us, round(sum(raw_len) / 1048576 / (sum(flush_ms) / 1000), 6) AS throughput_mbps,
  (SELECT count(*) FROM er WHERE er.topic = b.topic AND kind = 'compression' AND er.us >= (SELECT us FROM fi WHERE fi.topic = b.topic)) AS compression_errors,
  (SELECT count(*) FROM er WHERE er.topic = b.topic AND kind = 'network' AND er.us >= (SELECT us FROM fi WHERE fi.topic = b.topic)) AS network_errors
FROM b GROUP BY topic""")
def metrics_by_topic(spark, root):
    errors, batches = _errors(spark, root)
    rows = topic_metrics(batches, errors)
    rows = rows.withColumn("last_us", F.unix_micros("last_flush_timestamp")).drop("last_flush_timestamp")
    return _rounded(rows, "compression_ratio", "avg_flush_duration_ms", "throughput_mbps")


@query(f"""WITH {i.FLUSHED}, {ERRORS}, {LATER} SELECT {TOTALS}, CAST(1000 AS DOUBLE) AS uptime_seconds,
  round(sum(raw_len) / 1048576 / 1000.0, 6) AS throughput_mbps, round(sum(count) / 1000.0, 6) AS messages_per_second,
  (SELECT count(*) FROM er WHERE kind = 'compression') AS compression_errors,
  (SELECT count(*) FROM er WHERE kind = 'network') AS network_errors FROM b""")
def metrics_overall(spark, root):
    errors, batches = _errors(spark, root)
    rows = overall_metrics(batches, 500.0, 1500.0, errors)
    return _rounded(rows, "compression_ratio", "avg_flush_duration_ms", "throughput_mbps", "messages_per_second")


@query(f"""WITH {i.FLUSHED} SELECT coalesce(topic, '*') AS topic, grouping(topic) = 1 AS overall, {TOTALS}, max(us) AS last_us,
  round(sum(raw_len) / 1048576 / (sum(flush_ms) / 1000), 6) AS throughput_mbps,
  (SELECT count(DISTINCT topic) FROM f) AS topic_count FROM f GROUP BY ROLLUP (topic)""")
def metrics_combined(spark, root):
    rows = metrics_report(i.flushed(spark, root)).fillna("*", ["topic"])
    rows = rows.withColumn("last_us", F.unix_micros("last_flush_timestamp")).drop("last_flush_timestamp")
    return _rounded(rows, "compression_ratio", "avg_flush_duration_ms", "throughput_mbps")


@query(f"""WITH {i.FLUSHED}, {ERRORS}, {LATER}, fi AS (SELECT topic, min(us) AS us FROM b GROUP BY topic)
SELECT er.topic, false AS overall, count(*) FILTER (kind = 'compression' AND er.us >= fi.us) AS compression_errors,
  count(*) FILTER (kind = 'network' AND er.us >= fi.us) AS network_errors FROM er JOIN fi USING (topic) GROUP BY er.topic
UNION ALL SELECT '*', true, count(*) FILTER (kind = 'compression'), count(*) FILTER (kind = 'network') FROM er""")
def delivery_errors(spark, root):
    errors, batches = _errors(spark, root)
    return error_counts(errors, batches).fillna("*", ["topic"])


@query(f"""WITH {i.FLUSHED} SELECT printf('%s,%d,%d,%d,%.4f,%d,%.2f', topic, CAST(sum(count) AS BIGINT), CAST(sum(raw_len) AS BIGINT),
  CAST(sum(comp_len) AS BIGINT), sum(comp_len) / sum(raw_len), count(*), sum(flush_ms) / count(*)) AS csv FROM f GROUP BY topic""")
def metrics_text(spark, root):
    return metrics_csv(topic_metrics(i.flushed(spark, root)))


RUNNING = """SELECT seq, CAST(sum(count) OVER w AS BIGINT) AS cum_messages, CAST(sum(raw_len) OVER w AS BIGINT) AS cum_bytes_in,
  CAST(sum(comp_len) OVER w AS BIGINT) AS cum_bytes_out, count(*) OVER w AS cum_batches,
  round(sum(comp_len) OVER w / sum(raw_len) OVER w, 6) AS cum_ratio FROM f WINDOW w AS ({} ORDER BY us, seq ROWS UNBOUNDED PRECEDING)"""


def _running(rows: DataFrame) -> DataFrame:
    return rows.select("seq", "cum_messages", "cum_bytes_in", "cum_bytes_out", "cum_batches", r6("cum_ratio").alias("cum_ratio"))


@query(f"WITH {i.FLUSHED} {RUNNING.format('PARTITION BY topic')}")
def running_by_topic(spark, root):
    return _running(running_metrics(i.flushed(spark, root)))


@query(f"WITH {i.FLUSHED} {RUNNING.format('')}")
def running_overall(spark, root):
    rows = running_metrics(i.flushed(spark, root), by_topic=False, **small_chunks(spark, root, "events"))
    return _running(rows)


@query(f"""WITH {i.FLUSHED}, {i.PENDING}, {i.REGISTRY} SELECT 'degraded' AS status, round(sum(comp_len) / sum(raw_len), 6) AS ratio,
  CAST(sum(raw_len) AS BIGINT) AS bytes_in, CAST(sum(comp_len) AS BIGINT) AS bytes_out,
  CAST(sum(raw_len) - sum(comp_len) AS BIGINT) AS bytes_saved, CAST(sum(count) AS BIGINT) AS messages_processed,
  count(*) AS batch_count, (SELECT count(DISTINCT topic) FROM v WHERE retired_at IS NULL) AS active_dicts,
  (SELECT CAST(sum(user_id) AS BIGINT) FROM events) AS queue_depth, (SELECT count(*) FROM p) AS buffered_frames,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS open_circuits FROM f""")
def health(spark, root):
    rows = i.events(spark, root)
    breaker = rows.select(F.when(F.col("event_type") == "error", "OPEN").otherwise("CLOSED").alias("state"))
    row = health_snapshot(
        i.flushed(spark, root), breaker, rows.select(F.col("user_id").alias("queued")), i.pending(spark, root),
        i.document_registry(spark, root))
    return _rounded(row.drop("json"), "ratio")


@query("""WITH x AS (SELECT CASE user_id % 4 WHEN 0 THEN 10 WHEN 1 THEN 50 WHEN 2 THEN 100 ELSE 200 END AS batch_max,
  (value + 1) / 1000 AS seconds FROM events),
y AS (SELECT batch_max, count(*) AS reps, median(seconds) AS m FROM x GROUP BY 1)
SELECT batch_max, reps, round(m * 1000, 3) AS median_batch_ms, CAST(round(batch_max / m) AS BIGINT) AS msg_per_sec,
  round(batch_max * 150 / m / 1e6, 2) AS raw_mb_per_sec FROM y""")
def batch_timings(spark, root):
    size = F.element_at(F.array(*map(F.lit, (10, 50, 100, 200))), (F.col("user_id") % 4 + 1).cast("int"))
    rows = i.events(spark, root).select(
        size.alias("batch_max"), ((F.col("value") + 1) / 1000).alias("seconds"), (size * 150).alias("raw_bytes"))
    return batch_latency(rows)


# Timelines


@query(f"""WITH {i.TIMELINE} SELECT series, timestamp, timestamp - (SELECT min(timestamp) FROM t) AS seconds,
  bytes_in - bytes_out AS bytes_saved,
  CAST(CASE breaker_state WHEN 'CLOSED' THEN 0 WHEN 'OPEN' THEN 1 ELSE 0.5 END AS DOUBLE) AS state_level FROM t""")
def timeline_series(spark, root):
    return timeline_curves(i.timeline(spark, root)).select("series", "timestamp", "seconds", "bytes_saved", "state_level")


@query(f"""WITH {i.TIMELINE},
x AS (SELECT *, CASE WHEN lag(breaker_state) OVER (PARTITION BY series ORDER BY timestamp) = breaker_state THEN 0 ELSE 1 END AS new FROM t),
y AS (SELECT *, CAST(sum(new) OVER (PARTITION BY series ORDER BY timestamp) AS BIGINT) AS island FROM x),
z AS (SELECT series, island, min(breaker_state) AS state, min(timestamp) AS from_ts, max(timestamp) AS last_ts, count(*) AS samples
  FROM y GROUP BY ALL)
SELECT series, island, state, from_ts, coalesce(lead(from_ts) OVER (PARTITION BY series ORDER BY island), last_ts) AS to_ts, samples FROM z""")
def breaker_intervals(spark, root):
    return state_intervals(i.timeline(spark, root), ["series"])


@query(f"""WITH {i.TIMELINE}, x AS (SELECT *, series || ':' || CAST(floor(timestamp / 86400) AS BIGINT) AS incident FROM t),
s AS (SELECT incident, min(timestamp) AS outage_start FROM x GROUP BY 1),
o AS (SELECT incident, min(timestamp) AS opened_at FROM x JOIN s USING (incident) WHERE breaker_state = 'OPEN' AND timestamp >= outage_start GROUP BY 1),
c AS (SELECT incident, min(timestamp) AS closed_at FROM x JOIN o USING (incident) WHERE breaker_state = 'CLOSED' AND timestamp >= opened_at GROUP BY 1)
SELECT incident, coalesce(opened_at - outage_start, -1) AS detection_seconds, coalesce(closed_at - opened_at, -1) AS recovery_seconds
FROM s LEFT JOIN o USING (incident) LEFT JOIN c USING (incident)""")
def outage_delays(spark, root):
    day = F.floor(F.col("timestamp") / 86400).cast("string")
    rows = outage_latency(i.timeline(spark, root).withColumn("incident", F.concat("series", F.lit(":"), day)))
    return rows.select(
        "incident", F.coalesce("detection_seconds", F.lit(-1.0)).alias("detection_seconds"),
        F.coalesce("recovery_seconds", F.lit(-1.0)).alias("recovery_seconds"))


@query(f"""WITH {i.TIMELINE}, x AS (SELECT *, timestamp - lag(timestamp) OVER w AS dt, msgs_processed - lag(msgs_processed) OVER w AS dm,
  bytes_in - lag(bytes_in) OVER w AS di, bytes_out - lag(bytes_out) OVER w AS dout FROM t WINDOW w AS (PARTITION BY series ORDER BY timestamp))
SELECT series, timestamp, coalesce(round(dm / dt, 6), -1) AS msgs_per_sec, coalesce(round(di / dt, 6), -1) AS bytes_in_per_sec,
  coalesce(round(dout / dt, 6), -1) AS bytes_out_per_sec, coalesce(round(dout / di, 6), -1) AS interval_ratio FROM x""")
def interval_rates(spark, root):
    rows = rates(i.timeline(spark, root), ["series"])
    figures = ("msgs_per_sec", "bytes_in_per_sec", "bytes_out_per_sec", "interval_ratio")
    return rows.select("series", "timestamp", *[F.coalesce(r6(c), F.lit(-1.0)).alias(c) for c in figures])


# Store and forward


@query(f"WITH {i.PENDING} SELECT id, topic, timestamp FROM p ORDER BY timestamp, id LIMIT 10")
def oldest_frames(spark, root):
    return oldest_pending(i.pending(spark, root)).select("id", "topic", "timestamp")


@query(f"""WITH {i.PENDING}, x AS (SELECT *, row_number() OVER (ORDER BY timestamp, id) AS n FROM p)
SELECT id, topic, timestamp FROM x WHERE n > (SELECT count(*) // 10 FROM p)""")
def evicted_store(spark, root):
    return evict_pending(i.pending(spark, root), 1_000).select("id", "topic", "timestamp")


@query(f"""WITH {i.PENDING}, x AS (SELECT *, sum(size) OVER (ORDER BY timestamp DESC, id DESC) AS total FROM p)
SELECT id, topic, timestamp FROM x WHERE total <= 40000""")
def evicted_store_exact(spark, root):
    return evict_pending(i.pending(spark, root), 40_000, exact=True).select("id", "topic", "timestamp")


@query(f"""WITH {i.PENDING} SELECT coalesce(topic, '*') AS topic, grouping(topic) = 1 AS overall, count(*) AS frames,
  CAST(sum(size) AS BIGINT) AS bytes, 1e9 - min(timestamp) AS oldest_age FROM p GROUP BY ROLLUP (topic)""")
def pending_overview(spark, root):
    return pending_stats(i.pending(spark, root), 1e9).fillna("*", ["topic"])


@query(f"""WITH {i.PENDING} SELECT id, topic, timestamp FROM p
WHERE id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def unsettled_frames(spark, root):
    delivered = i.table(spark, root, "lineitem").filter(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("id"))
    return settle(i.pending(spark, root), delivered).select("id", "topic", "timestamp")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, o_orderstatus = 'P' AS recovered FROM orders""")
def delivered_once(spark, root):
    rows = i.table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return merge_delivery(rows.filter("status IN ('F', 'O')"), rows.filter("status IN ('O', 'P')"), ["id"])


# Queue and breaker

DEPTH = f"""{i.GATE}, d AS (SELECT *, CASE WHEN n <= 0 THEN 0 WHEN op = 'acquire' THEN n WHEN op = 'release' THEN -n ELSE 0 END AS c FROM g),
s AS (SELECT *, sum(c) OVER w AS s FROM d WINDOW w AS (PARTITION BY queue ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY queue ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS depth FROM s)"""
DEPTH_ROWS = f"""WITH {DEPTH} SELECT queue, seq, depth,
  max(depth) OVER (PARTITION BY queue ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS peak FROM z"""


@query(DEPTH_ROWS)
def queue_depths(spark, root):
    return queue_depth(i.gate_log(spark, root), "queue").select("queue", "seq", "depth", "peak")


@query(DEPTH_ROWS)
def queue_depths_chunked(spark, root):
    rows = queue_depth(i.gate_log(spark, root), "queue", **small_chunks(spark, root, "events"))
    return rows.select("queue", "seq", "depth", "peak")


@query(f"""WITH {DEPTH}, x AS (SELECT queue,
  CAST(coalesce(sum(n) FILTER (op = 'acquire' AND n > 0), 0) AS BIGINT) AS total_acquired,
  CAST(coalesce(sum(n) FILTER (op = 'release' AND n > 0), 0) AS BIGINT) AS total_released,
  count(*) FILTER (op = 'delay') AS total_delayed, round(sum(delay_ms) FILTER (op = 'delay'), 2) AS total_delay_ms,
  CAST(coalesce(sum(n) FILTER (op = 'drop' AND n > 0), 0) AS BIGINT) AS total_dropped,
  count(*) FILTER (op = 'block') AS total_blocked, count(*) FILTER (op = 'timeout') AS total_timeouts,
  max(depth) AS peak_queued, arg_max(depth, seq) AS current_queued FROM z GROUP BY queue)
SELECT *, round(CASE WHEN current_queued <= 10 THEN 0.0 ELSE least(1.0, (current_queued - 10) / 90.0) END, 4) AS pressure,
  round(current_queued / 100 * 100, 1) AS queue_pct FROM x""")
def queue_totals(spark, root):
    return queue_stats(i.gate_log(spark, root), "queue", soft=10, hard=100)


def _breaker_sql(timeout: float, compare: str, failures: int, successes: int, tail: str) -> str:
    """The breaker as a row-by-row recursion per target."""
    return f"""WITH RECURSIVE a AS (
  SELECT 'u' || (user_id % 8) AS target, event_id AS seq, epoch_us(ts) / 1e6 AS t,
    event_type NOT IN ('error', 'purchase', 'view') AS ok,
    row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n FROM events),
st AS (
  SELECT target, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS seq, false AS ok, CAST(0 AS DOUBLE) AS t, 'CLOSED' AS state_before,
    true AS allowed, 'CLOSED' AS state, 0 AS fails, 0 AS wins, CAST(0 AS DOUBLE) AS since
  FROM a GROUP BY target
  UNION ALL
  SELECT target, n, seq, ok, t, b, b <> 'OPEN',
    CASE b WHEN 'CLOSED' THEN CASE WHEN NOT ok AND fails + 1 >= {failures} THEN 'OPEN' ELSE 'CLOSED' END
      WHEN 'HALF_OPEN' THEN CASE WHEN NOT ok THEN 'OPEN' WHEN wins + 1 >= {successes} THEN 'CLOSED' ELSE 'HALF_OPEN' END
      ELSE 'OPEN' END,
    CASE b WHEN 'CLOSED' THEN CASE WHEN ok THEN 0 ELSE fails + 1 END
      WHEN 'HALF_OPEN' THEN CASE WHEN ok AND wins + 1 >= {successes} THEN 0 ELSE fails END ELSE fails END,
    CASE b WHEN 'HALF_OPEN' THEN CASE WHEN ok AND wins + 1 < {successes} THEN wins + 1 ELSE 0 END ELSE 0 END,
    CASE WHEN b <> 'OPEN' AND NOT ok AND (b = 'HALF_OPEN' OR fails + 1 >= {failures}) THEN t ELSE since END
  FROM (SELECT a.*, st.fails, CASE WHEN st.state = 'HALF_OPEN' THEN st.wins ELSE 0 END AS wins, st.since,
    CASE WHEN st.state = 'OPEN' AND a.t {compare} st.since + {timeout} THEN 'HALF_OPEN' ELSE st.state END AS b
    FROM st JOIN a ON a.target = st.target AND a.n = st.n + 1)),
br AS (SELECT target, seq, n, ok, t, state_before, allowed, state AS state_after FROM st WHERE n > 0)
{tail}"""


BREAKER_ROWS = "SELECT target, seq, state_before, allowed, state_after FROM br"
RULES = Rules(3, 7_200.0, 2, True)
STATS = """, bs AS (SELECT target, arg_max(state_after, n) AS state, count(*) AS total_calls, count(*) FILTER (NOT allowed) AS rejected,
  count(*) FILTER (allowed AND NOT ok) AS total_failures, count(*) FILTER (allowed AND ok) AS total_successes,
  max(t) FILTER (allowed AND NOT ok) AS last_failure_time FROM br GROUP BY target)"""


def _breaker(spark: SparkSession, root: str, rules: Rules = RULES, **kw) -> DataFrame:
    return breaker_states(i.attempts(spark, root), rules=rules, order=("at", "seq"), **kw)


@query(_breaker_sql(7200.0, ">", 3, 2, BREAKER_ROWS))
def breaker_log(spark, root):
    return _breaker(spark, root).select("target", "seq", "state_before", "allowed", "state_after")


@query(_breaker_sql(7200.0, ">", 3, 2, BREAKER_ROWS))
def breaker_log_chunked(spark, root):
    rows = _breaker(spark, root, **small_chunks(spark, root, "events"))
    return rows.select("target", "seq", "state_before", "allowed", "state_after")


@query(_breaker_sql(3600.0, ">=", 5, 2, BREAKER_ROWS))
def breaker_log_second(spark, root):
    rows = _breaker(spark, root, Rules(5, 3_600.0, 2, False))
    return rows.select("target", "seq", "state_before", "allowed", "state_after")


@query(_breaker_sql(7200.0, ">", 3, 2, STATS + "SELECT *  FROM bs"))
def breaker_summary(spark, root):
    return breaker_stats(_breaker(spark, root), order=("at", "seq"))


@query(_breaker_sql(7200.0, ">", 3, 2, STATS + """SELECT count(*) FILTER (state = 'OPEN') = 0 AS healthy, count(*) AS total_circuits,
  count(*) FILTER (state = 'OPEN') AS open_count, coalesce(string_agg(target, ',' ORDER BY target) FILTER (state = 'OPEN'), '') AS open_circuits FROM bs"""))
def breaker_overview(spark, root):
    row = breaker_health(breaker_stats(_breaker(spark, root), order=("at", "seq")))
    return row.withColumn("open_circuits", F.array_join("open_circuits", ","))


# Streams


def _stream(spark: SparkSession, root: str) -> DataFrame:
    """Events as a file stream, with the columns of ``inputs.events``."""
    schema = i.table(spark, root, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    return rows.withColumn("ts", F.timestamp_micros(i.micros("ts"))).withColumnRenamed("event_id", "seq")


#: Rows of a file, and so of a micro-batch, where rows must come in order.
FILE_ROWS = 2_000_000


def _ordered_stream(spark: SparkSession, rows: DataFrame, file_rows: int | None = None) -> DataFrame:
    """A stream of *rows* in order of time, in as many files of some *file_rows* as it takes, one per micro-batch."""
    ranges, path = scratch_path(spark, "ranges"), scratch_path(spark, "in-order")
    parts = -(-rows.count() // (file_rows or FILE_ROWS)) or 1
    laid = rows.repartitionByRange(parts, "ts", "seq").withColumn("step", F.spark_partition_id())
    laid.write.partitionBy("step").parquet(ranges)
    written = spark.read.schema(laid.schema).parquet(ranges)
    rows.limit(0).write.parquet(path)
    # a file stream reads files in the order in which they were written
    for (step,) in written.select("step").distinct().orderBy("step").collect():
        spark.read.schema(rows.schema).parquet(f"{ranges}/step={step}").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream_messages(spark: SparkSession, root: str) -> DataFrame:
    kind = F.col("event_type")
    msg = i._json(*i._body(kind, F.col("props")), ',"headers":{"Accept":"*/*", "X-Amzn-Trace-Id":"Root=', F.col("seq"), '"}}')
    return _stream(spark, root).select(F.concat(F.lit("events."), kind).alias("topic"), "ts", "seq", msg.alias("msg"))


@query(f"WITH {i.MESSAGES} SELECT topic, seq, msg FROM m")
def streamed_messages(spark, root):
    valid = ingest(_stream_messages(spark, root)).filter(F.col("error").isNull())
    return run_available(valid.select("topic", "seq", "msg"), "ingest")


#: Time steps that the out-of-order files are cut into, and rows of a file at most.
STEPS, LATE_ROWS = 5, 100_000


def _late_files(
    spark: SparkSession, rows: DataFrame, ends: DataFrame | None = None, file_rows: int | None = None, batch_rows: int | None = None,
) -> tuple[DataFrame, float]:
    """A stream that reads *rows* from files out of order, then *ends*, and the most that a row is late (ms).

    A step of time is laid in one go; a tenth of its rows comes a step later, some more two steps later. A micro-batch has
    the files of two steps, or as many files as hold *batch_rows* (``FILE_ROWS``) where these would be more.
    """
    path = scratch_path(spark, "late")
    low, high, count = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts")), F.count(F.lit(1))).first()
    width = (high - low) // STEPS + 1 if low is not None else 1
    late = F.when(F.col("seq") % 10 == 0, 1).when(F.col("seq") % 37 == 0, 2).otherwise(0)
    step = F.floor((F.unix_micros("ts") - F.lit(low)) / width) + late
    for k in range(STEPS + 2):
        rows.filter(step == k).write.mode("append").option("maxRecordsPerFile", file_rows or LATE_ROWS).parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    most = min(2 * -(-files // (STEPS + 2)), files * (batch_rows or FILE_ROWS) // max(count, 1))
    if ends is not None:
        ends.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(most, 2)).parquet(path)
    return stream, 3 * width / 1000


@query(f"""WITH {i.batched(20, 6 * HOUR_US)}, x AS (SELECT {BATCH_COLUMNS} FROM b GROUP BY topic, batch_id)
SELECT topic, batch_id, count, raw_len, first_us / 1000000.0 AS t0, last_us / 1000000.0 AS t1 FROM x""")
def streamed_batches(spark, root):
    """All messages, some files late; a last row per topic ends the input, so the open batches come out as well."""
    messages = i.messages(spark, root).select("topic", "ts", "seq", "msg", F.lit(False).alias("ends"))
    ends = messages.groupBy("topic").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq")).withColumns({
        "msg": F.lit(None).cast("string"), "ends": F.lit(True)})
    stream, delay = _late_files(spark, messages, ends)
    valid = ingest(stream).filter(F.col("error").isNull() | F.col("ends")).drop("error")
    return run_available(stream_batches(valid, 20, 6 * 3_600_000, delay_ms=delay, end="ends"), "batches").drop("payload")


@query(f"""WITH {i.FLUSHED}, x AS (SELECT topic, us // {6 * HOUR_US} AS k, {TOTALS},
  round(sum(raw_len) / 1048576 / (sum(flush_ms) / 1000), 6) AS throughput_mbps FROM f GROUP BY ALL)
SELECT k * {6 * HOUR_US} AS start_us, x.* EXCLUDE (k) FROM x""")
def streamed_metrics(spark, root):
    """Sums per micro-batch, added up: late files count in full."""
    rows = i.flushed(spark, root).select("topic", "ts", "seq", "count", "raw_len", "comp_len", "flush_ms")
    stream, _ = _late_files(spark, rows)
    parts = scratch_path(spark, "metric-parts")
    run_each(stream, "metrics", metrics_sink(parts, "1", "6 hours"))
    out = window_metrics(spark, parts)
    out = out.withColumn("start_us", F.unix_micros("window_start")).drop("window_start", "window_end")
    return _rounded(out, "compression_ratio", "avg_flush_duration_ms", "throughput_mbps")


@query(_monitor_sql(False) + EVENTS_SELECT)
def streamed_monitor(spark, root):
    rows = i.ratio_series(spark, root).drop("us")
    return _events(run_available(stream_monitor(_ordered_stream(spark, rows)), "monitor"))


@query(_breaker_sql(7200.0, ">", 3, 2, BREAKER_ROWS))
def streamed_breaker(spark, root):
    rows = i.attempts(spark, root).drop("at")
    return run_available(stream_breaker(_ordered_stream(spark, rows), rules=RULES), "breaker").select(
        "target", "seq", "state_before", "allowed", "state_after")


@query(f"""WITH {i.batched(100, 6 * HOUR_US)} SELECT topic, msg FROM b WHERE batch_id % 3 <> 0""")
def streamed_decoding(spark, root):
    """Signed frames through the decoding sink; every third batch has a bad signature and is set aside."""
    registry_root, out = scratch_path(spark, "registry"), scratch_path(spark, "decoded")
    registry = _trained(spark, root)
    publish_snapshot(registry, registry_root)
    frames = sign_frames(compress_batches(_batches(spark, root), registry), KEY)
    frames = frames.withColumn("hmac", F.when(F.col("batch_id") % 3 == 0, F.lit("00")).otherwise(F.col("hmac")))
    stored = scratch_table(frames, "frames")
    stream = spark.readStream.schema(stored.schema).parquet(stored.inputFiles()[0].rsplit("/", 1)[0])
    run_each(stream, "decode", decode_sink(out, lambda s: current_registry(s, registry_root), KEY, run="1"))
    lines = spark.read.option("basePath", f"{out}/lines").text(f"{out}/lines")
    return lines.select("topic", F.col("value").alias("msg"))


@query(_monitor_sql(False) + f""", {i.MESSAGES},
enough AS (SELECT substr(topic, 8) AS topic FROM m GROUP BY 1 HAVING sum(strlen(msg)) >= 256 * 200)
SELECT DISTINCT topic, 2 AS version FROM e SEMI JOIN enough USING (topic) WHERE event_type = 'drift_detected'
UNION SELECT DISTINCT topic, 1 AS version FROM s""")
def streamed_retraining(spark, root):
    """Drift events start training, which publishes a second version for each drifted topic."""
    registry_root, events_path = scratch_path(spark, "registry"), scratch_path(spark, "events")
    texts = i.messages(spark, root).withColumn("topic", F.expr("substring(topic, 8)"))
    first = train_dicts(sample_window(texts, 2_000, 256 * 1024), 256).filter(F.col("error").isNull())
    publish_snapshot(publish_versions(spark.createDataFrame([], REGISTRY_SCHEMA), first, 1.0), registry_root)
    ratio_events(i.ratio_series(spark, root)).select("topic", "event_type").write.parquet(events_path)
    stream = spark.readStream.schema("topic STRING, event_type STRING").parquet(events_path)
    run_each(stream, "retrain", retrain_step(lambda s: texts, registry_root, lambda: 2.0, size=256))
    return current_registry(spark, registry_root).select("topic", "version")
