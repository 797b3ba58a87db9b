import random

import pytest
from pyspark.sql import functions as F

from framewright import schemas
from framewright.operators.batching import assign_batches, build_batches
from framewright.operators.breaker import Rules, breaker_states
from framewright.operators.codec import compress_batches, train_dicts
from framewright.operators.drift import ratio_events
from framewright.operators.registry import active_versions, publish_versions
from framewright.functions.auth import sign_frames
from framewright.sources.registry_store import current_registry, publish_snapshot
from framewright.streaming.flows import (
    decode_sink, ingest, metrics_sink, retrain_step, run_available, run_each, stream_metrics, window_metrics)
from framewright.streaming.stateful import _Batcher, stream_batches, stream_breaker, stream_monitor


def as_stream(spark, df, path, files=3, order="seq"):
    """Write *df* as several files that a stream reads one at a time, in order."""
    n = df.count()
    for i in range(files):
        low, high = n * i // files, n * (i + 1) // files
        df.filter((F.col(order) >= low) & (F.col(order) < high)).coalesce(1).write.mode("append").parquet(f"{path}/f{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "latestFirst", False).parquet(f"{path}/*")


def messages(spark, n=120, seed=1):
    rng, now, rows = random.Random(seed), 0, []
    for i in range(n):
        now += rng.choice([0, 1, 4, 30]) * 1000
        rows.append((rng.choice("ab"), now, i, f'{{"i":{i}}}'))
    df = spark.createDataFrame(rows, "topic string, us long, seq long, msg string")
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us")


def ended(df):
    """A last row per topic that ends its input."""
    last = df.groupBy("topic").agg(F.max("ts").alias("ts"), F.max("seq").alias("seq"))
    return last.withColumns({"msg": F.lit(None).cast("string"), "ends": F.lit(True)}).select("topic", "seq", "msg", "ts", "ends")


def going_on(df):
    return df.select("topic", "seq", "msg", "ts", F.lit(False).alias("ends"))


def in_files(spark, parts, path):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{path}/f{k}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def all_batches(rows):
    return {(r.topic, r.batch_id): (r["count"], r.raw_len, r.t0, r.t1, bytes(r.payload)) for r in rows.collect()}


def test_stream_batches_equal_batch_form(spark, tmp_path):
    """Rows late by up to three micro-batches, and the open batches at the end."""
    df = messages(spark).cache()
    late = F.floor(F.col("seq") / 20) + F.when(F.col("seq") % 7 == 0, 3).when(F.col("seq") % 5 == 0, 1).otherwise(0)
    parts = [df.filter(late == k) for k in range(9)]
    got = run_available(stream_batches(in_files(spark, [*map(going_on, parts), ended(df)], str(tmp_path / "in")), 7, 20, delay_ms=2_000, end="ends"), "batches")
    assert got.count() == len(all_batches(got))
    assert all_batches(got) == all_batches(build_batches(assign_batches(df, 7, 20)))


def test_stream_batches_lose_no_late_row(spark, tmp_path):
    """Without a delay late rows can't be put in order, but in equals out."""
    df = messages(spark).cache()
    parts = [df.filter(F.col("seq") % 4 == k) for k in (3, 0, 2, 1)]
    got = run_available(stream_batches(in_files(spark, [*map(going_on, parts), ended(df)], str(tmp_path / "in")), 7, 20, delay_ms=0, end="ends"), "batches")
    lines = sorted(x for r in got.collect() for x in bytes(r.payload).decode().split("\n")[:-1])
    assert lines == sorted(r.msg for r in df.collect()) and got.agg(F.sum("count")).first()[0] == 120
    assert got.filter("count > 7").isEmpty()
    ids = [r.batch_id for r in got.filter("topic = 'a'").orderBy("batch_id").collect()]
    assert len(ids) == len(set(ids))


class _Cell:
    """A state variable in memory that counts the values written to it."""

    def __init__(self):
        self.held, self.written = {}, 0

    def exists(self):
        return () in self.held

    def get(self):
        return self.held[()]

    def update(self, value):
        self.updateValue((), value)

    def clear(self):
        del self.held[()]

    def containsKey(self, key):
        return key in self.held

    def getValue(self, key):
        return self.held[key]

    def updateValue(self, key, value):
        self.held[key] = value
        self.written += sum(len(v) if isinstance(v, list) else 1 for v in value)

    def keys(self):
        return iter(list(self.held))

    def removeKey(self, key):
        del self.held[key]


class _Handle:
    def __init__(self):
        self.cells = {}

    def getValueState(self, name, schema):
        return self.cells.setdefault(name, _Cell())

    def getMapState(self, name, key, value):
        return self.cells.setdefault(name, _Cell())


def _fed(files, batch_max, span_us, delay_us):
    """Batches of the processor for files of (us, seq, msg, ends), and the numbers written per file."""
    import pandas as pd

    handle, processor = _Handle(), _Batcher(["topic"], batch_max, span_us, delay_us, None)
    processor.init(handle)
    out, written = [], []
    for rows in files:
        before = sum(c.written for c in handle.cells.values())
        for part in processor.handleInputRows(("a",), iter([pd.DataFrame(rows, columns=["us", "seq", "msg", "ends"])]), None):
            out += part.to_dict("records")
        written.append(sum(c.written for c in handle.cells.values()) - before)
    return out, written


@pytest.mark.parametrize("seed", range(6))
def test_batcher_equals_loop(seed):
    """Rows late by less than the delay, nulls among them, in micro-batches of any size."""
    r = random.Random(seed)
    span, most = r.choice([0, 5_000, 20_000, 900_000]), r.choice([1, 4, 9])
    now, rows = 0, []
    for k in range(300):
        now += r.choice([0, 0, 1, 500, 4_000, 70_000])
        rows.append((now, k, f"m{k}"))
    delay, files = 300_000, []
    arrival = sorted(rows, key=lambda x: x[0] + r.randrange(delay))
    while arrival:
        n = r.randrange(1, 40)
        files.append([(*x, False) for x in arrival[:n]] + [(arrival[0][0], 10_000, None, False)])
        arrival = arrival[n:]
    got, _ = _fed([*files, [(0, 0, None, True)]], most, span, delay)
    want, at = [], 0
    while at < len(rows):
        end = at + 1
        while end < len(rows) and end - at < most and rows[end][0] < rows[at][0] + span:
            end += 1
        want.append((at + 1, end - at, "".join(f"{m}\n" for _, _, m in rows[at:end]).encode()))
        at = end
    assert [(b["batch_id"], b["count"], b["payload"]) for b in got] == want


def test_null_messages_change_no_batch():
    rows = [(1000 * k, k, f"m{k}", False) for k in range(20)]
    clean, _ = _fed([rows, [(0, 0, None, True)]], 10, 10**9, 0)
    holed, _ = _fed([rows[:5], [(5000, 99, None, False)], rows[5:], [(0, 0, None, True)]], 10, 10**9, 0)
    assert [b["count"] for b in holed] == [10, 10] and [b["payload"] for b in holed] == [b["payload"] for b in clean]


def test_input_may_go_on_after_its_end():
    first = [(1000 * k, k, f"m{k}", k == 4) for k in range(5)]
    got, _ = _fed([first, [(6000, 6, "m6", False), (100, 7, "late", False)], [(0, 0, None, True)]], 10, 10**9, 0)
    assert [(b["batch_id"], b["count"]) for b in got] == [(1, 5), (6, 2)]


def test_state_written_does_not_grow_with_the_delay():
    files = [[(10_000 * (10 * k + j), 10 * k + j, "m", False) for j in range(10)] for k in range(100)]
    most = [max(_fed(files, 50, 200_000, delay)[1][20:]) for delay in (1_000_000, 5_000_000, 1_000_000_000)]
    assert max(most) <= 1.3 * most[0]


def test_rows_of_a_slot_are_written_once(monkeypatch):
    """However many micro-batches have rows for the same slots, none writes what an earlier one has written."""
    def update(self, key, value):
        self.held[key] = value
        self.written += sum(len(v) if isinstance(v, (list, bytes)) else 1 for v in value)

    monkeypatch.setattr(_Cell, "updateValue", update)
    files = [[(10_000 * j, 10 * k + j, "m", False) for j in range(10)] for k in range(60)]
    got, written = _fed([*files, [(0, 0, None, True)]], 7, 80_000, 1_000_000_000)
    assert max(written[:60]) <= 1.3 * written[0]
    assert sum(b["count"] for b in got) == 600 and [b["batch_id"] for b in got][:3] == [1, 8, 15]


def test_rows_of_many_slots_and_idle_keys_come_out():
    """Rows that are final at once are one walk, however many slots they lie in; an idle key gives out all that it holds."""
    import time

    import pandas as pd

    class Timers(_Handle):
        def registerTimer(self, at):
            self.at = at

        def deleteTimer(self, at):
            self.at = None

        def getCurrentProcessingTimeInMs(self):
            return 5

        def getExpiryTimeInMs(self):
            return self.at

    handle, processor = Timers(), _Batcher(["topic"], 10, 20_000, 0, 1_000)
    processor.init(handle)
    rows = pd.DataFrame([(50_000 * k, k, f"m{k}", False) for k in range(20_000)], columns=["us", "seq", "msg", "ends"])
    began = time.process_time()
    got = [x for part in processor.handleInputRows(("a",), iter([rows]), handle) for x in part["count"]]
    assert time.process_time() - began < 5
    got += [x for part in processor.handleExpiredTimer(("a",), handle, handle) for x in part["count"]]
    assert got == [1] * 20_000 and not handle.cells["open"].exists() and not handle.cells["parts"].held


def test_final_slots_are_walked_in_blocks(monkeypatch):
    """What becomes final at once comes out a block at a time, and equals one walk over all of it."""
    import pandas as pd

    from framewright.streaming import stateful

    r = random.Random(5)
    rows = sorted((r.randrange(5_000_000), k, f"m{k}", False) for k in range(500))
    files = [*([x for x in rows if x[1] % 3 == k] for k in range(3)), [(0, 0, None, True)]]
    found = []
    for most in (1000, 50, 1):
        monkeypatch.setattr(stateful, "BLOCK_ROWS", most)
        processor = _Batcher(["topic"], 9, 30_000, 4_000_000, None)
        processor.init(_Handle())
        found.append([
            list(processor.handleInputRows(("a",), iter([pd.DataFrame(x, columns=["us", "seq", "msg", "ends"])]), None)) for x in files])
    assert [len(x[-1]) for x in found][0] == 1 and max(part["count"].sum() for part in found[1][-1]) < 100
    whole = [pd.concat([part for file in x for part in file], ignore_index=True) for x in found]
    assert whole[0]["count"].sum() == 500 and whole[1].equals(whole[0]) and whole[2].equals(whole[0])


def test_metrics_sink_counts_late_rows(spark, tmp_path):
    df = messages(spark).select(
        "topic", "ts", "seq", F.lit(2).cast("long").alias("count"), (F.col("seq") + 10).alias("raw_len"),
        F.lit(5).cast("long").alias("comp_len"), F.lit(1.5).alias("flush_ms")).cache()
    parts = [df.filter(F.col("seq") % 4 == k) for k in (3, 0, 2, 1)]
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run_each(in_files(spark, parts, str(tmp_path / "in")), "m", metrics_sink(out, "a", "100 milliseconds"), check)
    # the same checkpoint has nothing more to read; another run adds to it
    run_each(in_files(spark, parts[:1], str(tmp_path / "in2")), "m", metrics_sink(out, "b", "100 milliseconds"))
    both = df.unionByName(parts[0])
    expected = both.groupBy(F.window("ts", "100 milliseconds").start.alias("w"), "topic").agg(F.sum("raw_len"), F.count(F.lit(1)))
    got = window_metrics(spark, out).select("window_start", "topic", "bytes_in", "flush_count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_stream_monitor_equals_batch_form(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, 1000, rng.choice([50, 52, 70, 90]) if i > 80 else 50) for i in range(200)]
    df = spark.createDataFrame(rows, "topic string, seq long, raw_len long, comp_len long").withColumn(
        "ts", F.timestamp_micros(F.col("seq")))
    columns = ["topic", "seq", "event_type", "state", "batch_count", "consecutive_drift"]
    got = run_available(stream_monitor(as_stream(spark, df, str(tmp_path / "in"), files=7), 0.3, 10, 0.2, 3, 0.05), "monitor")
    want = ratio_events(df, alpha=0.3, warmup=10)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert {"drift_detected", "warmup_complete"} <= {r.event_type for r in got.collect()}


def test_stream_breaker_equals_batch_form(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, rng.random() > 0.5) for i in range(150)]
    df = spark.createDataFrame(rows, "target string, seq long, ok boolean").withColumn(
        "ts", F.timestamp_micros(F.col("seq") * 1_000_000))
    rules = Rules(2, 4.0, 2)
    columns = ["target", "seq", "state_before", "allowed", "state_after"]
    got = run_available(stream_breaker(as_stream(spark, df, str(tmp_path / "in")), rules=rules), "breaker")
    want = breaker_states(df, rules=rules)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_monitor_and_breaker_give_rows_out_in_blocks(monkeypatch):
    """A micro-batch in any order comes out in order, a block at a time, and equals one walk over all of it."""
    import pandas as pd

    from framewright.streaming import stateful

    r = random.Random(8)
    rows = [(k, k, False, r.random(), r.random() > 0.5) for k in range(250)]
    parts = lambda: iter([pd.DataFrame(x, columns=["us", "seq", "retrain", "ratio", "ok"]) for x in (rows[100:], rows[:100])])
    for processor in (stateful._Monitor(0.1, 20, 0.2, 3, 0.05), stateful._Breaker(Rules(2, 4e-6, 2))):
        found = []
        for most in (1000, 60):
            monkeypatch.setattr(stateful, "BLOCK_ROWS", most)
            processor.init(_Handle())
            found.append(list(processor.handleInputRows(("a",), parts(), None)))
        assert [len(x) for x in found[1]] == [60, 60, 60, 60, 10] and len(found[0]) == 1
        assert pd.concat(found[1], ignore_index=True).equals(found[0][0])
        assert found[0][0]["seq"].tolist() == list(range(250))


def test_ordered_stream_has_files_of_bounded_size(spark):
    from framewright.plans.catalog import _ordered_stream

    df = messages(spark, 100).repartition(3)
    seen = []
    run_each(_ordered_stream(spark, df, 30), "seen", lambda b, k: seen.append([x.seq for x in b.select("seq").collect()]))
    seen = [sorted(x) for x in seen if x]
    assert len(seen) > 2 and [x for part in seen for x in part] == list(range(100))


def test_late_files_of_many_partitions_share_micro_batches(spark):
    """Two steps of time make a micro-batch, whatever number of tasks wrote them; a large step has several."""
    from framewright.plans.catalog import _late_files

    df = messages(spark, 200).repartition(8).cache()
    seen = []
    run_each(_late_files(spark, df)[0], "seen", lambda b, k: seen.append([x.seq for x in b.select("seq").collect()]))
    assert 3 <= len(seen) <= 5 and sorted(x for part in seen for x in part) == list(range(200))
    seen.clear()
    run_each(_late_files(spark, df, None, 5, 20)[0], "seen", lambda b, k: seen.append([x.seq for x in b.select("seq").collect()]))
    assert max(map(len, seen)) <= 40 and sorted(x for part in seen for x in part) == list(range(200))


def test_stream_metrics(spark, tmp_path):
    df = spark.range(100).select(
        F.lit("a").alias("topic"), F.timestamp_micros(F.col("id") * 10_000_000).alias("ts"), F.col("id").alias("seq"),
        F.lit(2).cast("long").alias("count"), F.lit(10).cast("long").alias("raw_len"),
        F.lit(5).cast("long").alias("comp_len"), F.lit(1.0).alias("flush_ms"))
    rows = run_available(stream_metrics(as_stream(spark, df, str(tmp_path / "in")), delay="0 seconds"), "metrics").collect()
    assert len(rows) == 16 and {(r.flush_count, r.messages_processed, r.compression_ratio) for r in rows} == {(6, 12, 0.5)}


def test_ingest(spark):
    df = spark.createDataFrame(
        [("a", '{"x": 1}'), ("a b", '{"x": 1}'), ("a", "[1]"), ("a", "{")], "topic string, msg string")
    rows = [(r.topic, r.msg, r.error) for r in ingest(df.coalesce(1)).collect()]
    assert rows == [("a", '{"x":1}', None), ("a b", '{"x": 1}', "bad_character"), ("a", "[1]", "not_an_object"), ("a", "{", "not_an_object")]


def test_decode_sink_and_refresh(spark, tmp_path):
    key = "01" * 32
    df = messages(spark, 300)
    empty = spark.createDataFrame([], schemas.REGISTRY)
    first = publish_versions(empty, train_dicts(df, 256).filter("error is null"), 1.0).cache()
    frames = sign_frames(compress_batches(build_batches(assign_batches(df, 20, 500)), first), key)
    frames = frames.withColumn("seq", F.row_number().over(__import__("pyspark").sql.Window.orderBy("topic", "batch_id")) - 1)
    frames = frames.withColumn("hmac", F.when(F.col("seq") > 0, F.col("hmac"))).cache()
    root = str(tmp_path / "registry")
    publish_snapshot(publish_versions(first, train_dicts(df, 300).filter("error is null"), 2.0), root)
    out = str(tmp_path / "out")
    sink = decode_sink(out, lambda s: current_registry(s, root), key, run="1")
    run_each(as_stream(spark, frames, str(tmp_path / "in")), "decode", sink)
    bad = frames.filter("seq = 0").first()
    assert spark.read.text(out + "/lines").count() == 300 - bad["count"]
    assert [r.error for r in spark.read.parquet(out + "/rejected").collect()] == ["signature"]
    metrics = spark.read.option("header", True).csv(out + "/metrics")
    assert metrics.count() == frames.count() - 1
    sink(frames.filter("seq > 0"), 0)
    sink(frames.filter("seq > 0"), 0)
    assert spark.read.text(out + "/lines/run=1/batch=0").count() == 300 - bad["count"]
    # another run starts at micro-batch 0 again and leaves the first one's output alone
    before = spark.read.text(out + "/lines/run=1").count()
    decode_sink(out, lambda s: current_registry(s, root), key, run="2")(frames.filter("seq > 0"), 0)
    assert spark.read.text(out + "/lines/run=1").count() == before
    assert spark.read.text(out + "/lines/run=2").count() == 300 - bad["count"]


def test_retrain_step(spark, tmp_path):
    df = messages(spark, 600)
    root = str(tmp_path / "registry")
    first = publish_versions(
        spark.createDataFrame([], schemas.REGISTRY), train_dicts(df, 256).filter("error is null"), 1.0)
    publish_snapshot(first, root)
    events = spark.createDataFrame([("a", "drift_detected"), ("b", "ratio_update")], "topic string, event_type string")
    told = []
    hook = lambda versions: told.extend((r.topic, r.version) for r in versions.collect())
    step = retrain_step(lambda s: df, root, lambda: 50.0, size=256, on_retrained=hook)
    step(events, 0)
    assert told == []
    retrain_step(lambda s: df, root, lambda: 50.0, size=8, on_retrained=hook)(events.filter("topic = 'b'"), 1)
    assert current_registry(spark, root).count() == 2
    big = df.withColumn("msg", F.concat(F.lit("x" * 200), "msg"))
    retrain_step(lambda s: big, root, lambda: 60.0, size=256, on_retrained=hook)(events, 2)
    assert told == [("a", 2)]
    live = {r.topic: r.version for r in active_versions(current_registry(spark, root)).collect()}
    assert live == {"a": 2, "b": 1}
