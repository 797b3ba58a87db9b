import json
import random

import pytest
from pyspark.sql import functions as F

from framewright.operators.batching import assign_batches, build_batches
from framewright.operators.codec import compress_batches, train_dicts
from framewright.operators.metrics import (
    batch_latency, error_counts, health_snapshot, metrics_csv, metrics_report, overall_metrics, running_metrics,
    topic_metrics)
from framewright.operators.registry import publish_versions
from framewright.operators.timeline import outage_latency, phase_summary, rates, state_intervals, timeline_curves
from framewright.schemas import REGISTRY, TIMELINE, VEHICLE
from framewright.functions.normalize import normalize
from framewright.sources.files import read_timeline

PLANS = [("window", 1000), ("chunked", 3)]
BATCH = "topic string, ts double, seq long, count long, raw_len long, comp_len long, flush_ms double"


def batches(spark):
    rows = [("s", 1.0, 1, 60, 3000, 750, 15.5), ("s", 2.0, 2, 40, 2000, 500, 20.5), ("t", 3.0, 3, 5, 0, 0, 0.0)]
    return spark.createDataFrame(rows, BATCH)


def test_topic_metrics(spark):
    rows = {r.topic: r for r in topic_metrics(batches(spark)).collect()}
    s = rows["s"]
    assert (s.messages_processed, s.bytes_in, s.bytes_out, s.compression_ratio) == (100, 5000, 1250, 0.25)
    assert (s.avg_flush_duration_ms, s.flush_count, s.last_flush_timestamp) == (18.0, 2, 2.0)
    assert s.throughput_mbps == pytest.approx(5000 / 1024 / 1024 / 0.036)
    assert (rows["t"].compression_ratio, rows["t"].throughput_mbps) == (0.0, 0.0)
    assert "s,100,5000,1250,0.2500,2,18.00" in {r.csv for r in metrics_csv(topic_metrics(batches(spark))).collect()}


def test_overall_and_report(spark):
    row = overall_metrics(batches(spark), 10.0, 20.0).first()
    assert (row.messages_processed, row.messages_per_second, row.uptime_seconds) == (105, 10.5, 10.0)
    assert overall_metrics(batches(spark), 10.0, 10.0).first().throughput_mbps == 0.0
    empty = overall_metrics(batches(spark).limit(0), 0.0, 1.0).first()
    assert (empty.messages_processed, empty.compression_ratio, empty.avg_flush_duration_ms) == (0, 0.0, 0.0)
    report = metrics_report(batches(spark)).collect()
    total = [r for r in report if r.overall][0]
    assert (len(report), total.messages_processed, total.topic_count) == (3, 105, 2)


def test_errors_count_from_the_first_batch(spark):
    errors = spark.createDataFrame(
        [("s", 0.5, "network"), ("s", 1.0, "network"), ("s", 9.0, "compression"), ("new", 1.0, "network")],
        "topic string, ts double, kind string")
    rows = {r.topic: r for r in error_counts(errors, batches(spark)).collect()}
    assert set(rows) == {"s", None}
    assert (rows["s"].network_errors, rows["s"].compression_errors) == (1, 1)
    assert (rows[None].network_errors, rows[None].compression_errors) == (3, 1)
    by_topic = {r.topic: r.network_errors for r in topic_metrics(batches(spark), errors).collect()}
    assert by_topic == {"s": 1, "t": 0}
    assert overall_metrics(batches(spark), 0.0, 1.0, errors).first().network_errors == 3


@pytest.mark.parametrize("plan", PLANS)
def test_running(spark, plan):
    rows = [(f"t{i % 2}", float(i), i, i, 10, 5, 1.0) for i in range(12)]
    df = spark.createDataFrame(rows, BATCH)
    got = running_metrics(df, by_topic=False, strategy=plan[0], chunk_rows=plan[1]).orderBy("seq").collect()
    assert [r.cum_messages for r in got] == [sum(range(i + 1)) for i in range(12)]
    assert {r.cum_ratio for r in got} == {0.5} and got[-1].cum_batches == 12
    topic = running_metrics(df, strategy=plan[0], chunk_rows=plan[1]).filter("topic = 't1'").orderBy("seq").collect()
    assert [r.cum_messages for r in topic] == [1, 4, 9, 16, 25, 36]


def test_health(spark):
    breaker = spark.createDataFrame([("a", "CLOSED"), ("b", "OPEN")], "target string, state string")
    row = health_snapshot(batches(spark), breaker).first()
    assert (row.status, row.ratio, row.bytes_saved, row.batch_count, row.open_circuits) == ("degraded", 0.25, 3750, 3, 1)
    assert json.loads(row.json)["messages_processed"] == 105
    assert health_snapshot(batches(spark)).first().status == "healthy"


def test_latency(spark):
    df = spark.createDataFrame([(10, s / 1000, 1500) for s in (1.0, 2.0, 9.0)], "batch_max int, seconds double, raw_bytes long")
    row = batch_latency(df).first()
    assert (row.reps, row.median_batch_ms, row.msg_per_sec, row.raw_mb_per_sec) == (3, 2.0, 5000, 0.75)
    even = df.unionByName(df.filter("seconds < 0.009").withColumn("seconds", F.col("seconds") + 0.002)).filter("seconds != 0.001")
    row = batch_latency(even, strategy="chunked", chunk_rows=2).first()
    assert (row.reps, row.median_batch_ms) == (4, 3.5)


def timeline(spark):
    states = ["CLOSED", "CLOSED", "OPEN", "OPEN", "HALF_OPEN", "CLOSED"]
    rows = [(100.0 + 2 * i, "Normal" if i < 2 else "Outage", i, s, 10 * i, 1000 * i, 50 * i, 0.05 + i / 100)
            for i, s in enumerate(states)]
    return spark.createDataFrame(rows, TIMELINE)


@pytest.mark.parametrize("plan", PLANS)
def test_timeline(spark, plan, tmp_path):
    kw = dict(strategy=plan[0], chunk_rows=plan[1])
    timeline(spark).coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    tl = read_timeline(spark, str(tmp_path / "t"))
    curves = timeline_curves(tl).orderBy("timestamp").collect()
    assert [r.seconds for r in curves] == [0, 2, 4, 6, 8, 10]
    assert [r.state_level for r in curves] == [0, 0, 1, 1, 0.5, 0] and curves[2].bytes_saved == 1900
    phases = {r.step: r for r in phase_summary(tl).collect()}
    assert (phases["Normal"].mean_ratio, phases["Outage"].max_buffer) == (pytest.approx(0.055), 5)
    assert phases["Normal"].reduction == pytest.approx(0.945)
    runs = state_intervals(tl, **kw).orderBy("from_ts").collect()
    assert [(r.state, r.from_ts, r.to_ts, r.samples) for r in runs] == [
        ("CLOSED", 100, 104, 2), ("OPEN", 104, 108, 2), ("HALF_OPEN", 108, 110, 1), ("CLOSED", 110, 110, 1)]
    speed = rates(tl, **kw).orderBy("timestamp").collect()
    assert speed[0].msgs_per_sec is None and {r.msgs_per_sec for r in speed[1:]} == {5.0}
    assert {r.interval_ratio for r in speed[1:]} == {0.05}


def test_outage(spark):
    tl = timeline(spark).withColumn("incident", F.lit("i1"))
    row = outage_latency(tl).first()
    assert (row.detection_seconds, row.recovery_seconds) == (4.0, 6.0)
    known = spark.createDataFrame([("i1", 103.0), ("i2", 5.0)], "incident string, outage_start double")
    rows = {r.incident: (r.detection_seconds, r.recovery_seconds) for r in outage_latency(tl, known).collect()}
    assert rows == {"i1": (1.0, 6.0), "i2": (None, None)}


def _funnel(rows, starts):
    out = {}
    for k in {i for i, _, _ in rows} | set(starts or {}):
        mine = sorted((t, s) for i, t, s in rows if i == k)
        start = starts.get(k) if starts is not None else mine[0][0]
        if start is None:
            continue
        opened = min((t for t, s in mine if s == "OPEN" and t >= start), default=None)
        closed = min((t for t, s in mine if s == "CLOSED" and opened is not None and t >= opened), default=None)
        out[k] = (None if opened is None else opened - start, None if closed is None else closed - opened)
    return out


@pytest.mark.parametrize("seconds", [1.0, 7.0, 1e9])
@pytest.mark.parametrize("known", [False, True])
def test_outage_in_any_slices(spark, seconds, known):
    r = random.Random(int(seconds))
    rows = [(f"i{k}", float(r.randrange(60)), r.choice(["OPEN", "CLOSED", "HALF_OPEN", "CLOSED"])) for k in range(12) for _ in range(r.randrange(1, 12))]
    starts = {f"i{k}": float(r.randrange(50)) for k in range(0, 14, 2)} if known else None
    tl = spark.createDataFrame(rows, "incident string, timestamp double, breaker_state string")
    given = spark.createDataFrame(list(starts.items()), "incident string, outage_start double") if known else None
    got = outage_latency(tl, given, slice_seconds=seconds)
    assert {x.incident: (x.detection_seconds, x.recovery_seconds) for x in got.collect()} == _funnel(rows, starts)


def test_outage_reads_its_input_once(spark, tmp_path):
    timeline(spark).withColumn("incident", F.lit("i1")).write.parquet(str(tmp_path / "t"))
    plan = outage_latency(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_dictionary_pays_for_small_batches(spark):
    """A feed of small batches: with a dictionary they take well below what they take without."""
    i = F.col("id")
    turn = i.cast("double") / 40
    data = F.struct(
        F.round(14 + 9 * F.sin(turn), 2).alias("velocity"),
        F.struct(F.round(52 + i / 1e5, 5).alias("lat"), F.round(13 - i / 7e4, 5).alias("lng")).alias("location"),
        F.round(70 + F.pmod(F.hash("id"), F.lit(300)) / 10, 1).alias("engine_temp"))
    text = F.to_json(F.struct(
        F.lit("fleet.tram").alias("topic"), F.concat(F.lit("tram-"), (i % 6).cast("string")).alias("device_id"),
        F.element_at(F.array(*map(F.lit, ("moving", "halted", "parked"))), (i % 3 + 1).cast("int")).alias("status"), data.alias("data"),
        F.create_map(F.lit("X-Amzn-Trace-Id"), F.sha1(i.cast("string").cast("binary"))).alias("headers")))
    feed = spark.range(2400).select(
        F.lit("fleet.tram").alias("topic"), F.timestamp_micros(i * 25_000).alias("ts"), i.alias("seq"), text.alias("msg"))
    clean = normalize(feed, schema=VEHICLE)
    assert "Trace" not in clean.first().msg
    registry = publish_versions(spark.createDataFrame([], REGISTRY), train_dicts(clean.filter("seq < 1200"), 8192), 0.0)
    batches = build_batches(assign_batches(clean.filter("seq >= 1200"), 100, 250))
    sizes = [compress_batches(batches, r).agg((F.sum("comp_len") / F.sum("raw_len")).alias("r")).first().r
             for r in (registry, registry.filter("false"))]
    assert sizes[0] < 0.5 and sizes[1] == 1.0
