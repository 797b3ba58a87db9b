import json
import random
import threading
import zlib
from urllib.parse import unquote

import pytest
import zstandard
from pyspark.sql import functions as F

from framewright import schemas
from framewright.functions.auth import sign_frames
from framewright.operators.batching import assign_batches, build_batches
from framewright.operators.codec import (
    compress_batches, compression_report, compression_report_wide, decode_frames, reconcile, train_dicts,
    train_global_dict)
from framewright.operators.registry import (
    active_versions, attach_active_dict, budget_prefix, dict_as_of, gc_report, gc_versions, publish_versions,
    registry_stats, registry_totals, retrain_candidates, sample_stats, sample_window, training_readiness,
    unknown_dicts)
from framewright.session import scratch_table
from framewright.sources.files import read_log_events, read_messages, read_samples, sample_files
from framewright.sources.frames import encode_frames, read_frame_table, read_frames
from framewright.sources.registry_store import (
    MovedOn, change_registry, current_name, current_registry, expire_snapshots, index_report, index_to_registry, publish_snapshot, read_dict_index,
    write_dict_files, write_dict_index)
from framewright.sources.stores import create_once, names_in, read_small
from framewright.sources.sinks import frame_metrics, write_metrics, write_topic_jsonl

KEY = "0b" * 32


@pytest.fixture(scope="module")
def messages(spark):
    text = F.to_json(F.struct(
        F.col("topic"), F.concat(F.lit("s-"), (F.col("id") % 10).cast("string")).alias("sensor_id"),
        (22 + (F.col("id") % 7) * 0.5).alias("value"), F.lit("é").alias("unit")))
    topic = F.element_at(F.array(*map(F.lit, ["sensors.temp", "sensors-hum", "cold"])), (F.col("id") % 3 + 1).cast("int"))
    df = spark.range(1500).withColumn("topic", topic)
    return df.select("topic", F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.col("id").alias("seq"), text.alias("msg")).cache()


@pytest.fixture(scope="module")
def registry(spark, messages):
    trained = train_dicts(messages.filter("topic != 'cold'"), size=1024).filter("error is null")
    return publish_versions(spark.createDataFrame([], schemas.REGISTRY), trained, 100.0).cache()


def empty_registry(spark):
    return spark.createDataFrame([], schemas.REGISTRY)


@pytest.mark.parametrize("codec", ["zstd", "zlib", "none"])
def test_round_trip(spark, messages, registry, codec):
    batches = build_batches(assign_batches(messages, 50, 10_000))
    frames = sign_frames(compress_batches(batches, registry, codec), KEY).cache()
    for r in frames.select("topic", "codec", "dict_id", "comp_len", "raw_len").collect():
        if r.topic == "cold" or codec == "none":
            assert (r.codec, r.dict_id, r.comp_len) == ("none", "", r.raw_len)
        else:
            assert r.codec == codec and r.dict_id.startswith("d:sensors_") and r.comp_len < r.raw_len
    decoded = decode_frames(frames, registry, KEY)
    back = decoded.lines.select("topic", "msg")
    assert back.exceptAll(messages.select("topic", "msg")).isEmpty() and back.count() == 1500
    assert decoded.rejected.isEmpty()
    check = reconcile(frames, decoded.lines, ["topic", "batch_id"])
    assert check.filter("not agrees").isEmpty() and check.count() == frames.count()


def test_rejections(spark, messages, registry):
    batches = build_batches(assign_batches(messages, 200, 10_000))
    frames = sign_frames(compress_batches(batches, registry), KEY)
    first = frames.filter("topic = 'sensors.temp'").orderBy("batch_id").limit(1)
    forged = first.withColumn("payload", F.concat("payload", F.lit(bytearray(b"x"))))
    lost = first.withColumn("dict_id", F.lit("d:gone"))
    broken = sign_frames(forged.drop("hmac", "hmac_algo"), KEY)
    cut = sign_frames(first.withColumn("payload", F.substring("payload", 1, 20)).drop("hmac", "hmac_algo"), KEY)
    decoded = decode_frames(forged.unionByName(lost).unionByName(cut), registry, KEY)
    assert decoded.lines.isEmpty()
    assert sorted(r.error for r in decoded.rejected.collect()) == ["corrupt", "signature", "unknown_dict"]
    assert [tuple(r) for r in unknown_dicts(lost, registry).collect()] == [("d:gone", 1)]


def test_signature_is_checked_below_the_decoder(spark, messages, registry):
    frames = sign_frames(compress_batches(build_batches(assign_batches(messages)), registry), KEY)
    stored = scratch_table(frames, "frames")
    plan = decode_frames(stored, registry, KEY).lines._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert "sha2" in below and "sha2" not in above
    assert "Filter isnull(error" in below


def test_wire_files(spark, messages, registry, tmp_path):
    frames = sign_frames(compress_batches(build_batches(assign_batches(messages, 100, 10_000)), registry), KEY)
    wire = encode_frames(frames).orderBy("topic", "batch_id").select("frame")
    blobs = [bytes(r.frame) for r in wire.collect()]
    folder = tmp_path / "wire"
    folder.mkdir()
    (folder / "a.bin").write_bytes(b"".join(blobs[:5]))
    (folder / "b.bin").write_bytes(b"".join(blobs[5:]) + blobs[0][:-1])
    bad = b'{"topic":"x"}'
    (folder / "c.bin").write_bytes(blobs[0] + len(bad).to_bytes(4, "big") + bad + b"rest")
    (folder / "d.bin").write_bytes(b"\0\0")
    read = read_frames(spark, str(folder)).cache()
    assert read.filter("error is null").count() == len(blobs) + 1
    # nothing ends without a row: the cut frame, the header that is not usable, two bytes that are no length
    broken = {r.path[-5]: (r.pos, r.error, r.bytes_left) for r in read.filter("error is not null").collect()}
    assert broken == {
        "b": (len(blobs) - 5, "truncated", len(blobs[0]) - 1), "c": (1, "missing:codec,comp_len,count,raw_len,v", 4 + len(bad) + 4),
        "d": (0, "truncated", 2)}
    whole = read.filter(F.col("path").rlike("[ab].bin")).filter("error is null")
    assert [r.pos for r in whole.filter(F.col("path").endswith("a.bin")).orderBy("pos").collect()] == list(range(5))
    lines = decode_frames(whole.drop("error"), registry, KEY).lines
    assert lines.select("msg").exceptAll(messages.select("msg")).isEmpty() and lines.count() == 1500
    wire.write.parquet(str(tmp_path / "table"))
    table = read_frame_table(spark, str(tmp_path / "table"))
    assert decode_frames(table.drop("error"), registry, KEY).lines.count() == 1500


@pytest.mark.parametrize("codec", ["zstd", "zlib"])
def test_cut_payloads_raise(codec):
    from framewright.operators.codec import _decoder, _encoder

    text = random.Random(1).randbytes(150_000).hex().encode() + b"a" * 500_000
    payload, decode = _encoder(codec, 7, None)(text), _decoder(codec, None)
    assert decode(payload, len(text)) == text
    for cut, most in ((payload[:len(payload) // 2], len(text)), (payload[:-1], len(text)), (b"", 10), (payload, len(text) - 1)):
        with pytest.raises((zstandard.ZstdError, zlib.error)):
            decode(cut, most)


def _followed(path, blob):
    """Position, header, payload and bytes left of all frames of a file, one after the other."""
    out, at = [], 0
    while at < len(blob):
        size = int.from_bytes(blob[at:at + 4], "big")
        if at + 4 > len(blob) or at + 4 + size > len(blob):
            return [*out, (path, len(out), None, None, len(blob) - at)]
        text = blob[at + 4:at + 4 + size].decode("utf-8", "replace")
        try:
            length = json.loads(text)["comp_len"]
        except (ValueError, KeyError):
            length = None
        if length is None or at + 4 + size + length > len(blob):
            return [*out, (path, len(out), text, None, len(blob) - at)]
        out.append((path, len(out), text, blob[at + 4 + size:at + 4 + size + length], None))
        at += 4 + size + length
    return out


def _wire(header, payload):
    text = json.dumps({**header, "comp_len": len(payload)}).encode()
    return len(text).to_bytes(4, "big") + text + payload


@pytest.mark.parametrize("range_bytes", [29, 500, 1 << 20])
def test_ranges_of_wire_files(spark, tmp_path, range_bytes):
    """Any cutting into ranges gives what following a file from its start gives, forged frames in payloads included."""
    r, folder = random.Random(8), tmp_path / "wire files"
    folder.mkdir()
    inner = [_wire({"topic": "forged", "n": k}, r.randbytes(20)) for k in range(4)]
    # forged frames that lead to one another, to a true frame, into another payload, or behind the end of the file
    payloads = [b"", r.randbytes(200), b"".join(inner), b"xx" + inner[0], inner[1][:-5], b"\0\0\0\x02{}" * 9, b"{" * 40,
                b"\0\0\0\x11{\"comp_len\": 9999}", b"\0\0\0\x10{\"comp_len\": 300}", inner[2] + b"tail"]
    frames = [_wire({"topic": "t", "n": k, "pad": "é" * r.randrange(30)}, p) for k, p in enumerate(payloads * 3)]
    spaced = b" \n" + json.dumps({"comp_len": 2, "topic": "spaced"}).encode()
    whole = b"".join(frames) + len(spaced).to_bytes(4, "big") + spaced + b"ab" + b"".join(frames[:2])
    files = {"a b%.bin": whole, "cut.bin": whole[:-1], "short.bin": whole + b"\0\0", "bad.bin": frames[2] + b"\0\0\0\x0d{\"topic\":\"x\"}" + inner[0],
             "junk.bin": b"\xff" * 50, "text.bin": b"\0\0\0\x05{nojs" + inner[0], "empty.bin": b"", "one.bin": frames[2]}
    for name, blob in files.items():
        (folder / name).write_bytes(blob if range_bytes > 100 else blob[:900])
    got = read_frames(spark, str(folder), range_bytes=range_bytes).select("path", "pos", "header", "payload", "bytes_left").collect()
    want = [row for f in folder.iterdir() for row in _followed(f.name, f.read_bytes())]
    plain = lambda p: unquote(p).rsplit("/", 1)[1]
    assert sorted(((plain(x[0]), x[1], x[2], bytes(x[3] or b"") or None, x[4]) for x in got), key=repr) == sorted(((*w[:3], w[3] or None, w[4]) for w in want), key=repr)


def test_ranges_are_bounded():
    from framewright.sources.frames import RANGE_BYTES, WireReader

    parts = WireReader([("file:/x", 3 * 10**9), ("file:/y", 0), ("file:/z", 5)], RANGE_BYTES).partitions()
    assert len(parts) == -(-3 * 10**9 // RANGE_BYTES) + 1
    assert max(p.end - p.begin for p in parts) <= 256 << 20


def test_small_wire_files_share_tasks():
    """Files of a few bytes are dealt many to a task, each once; no task gets more than a range."""
    from framewright.sources.frames import OPEN_BYTES, RANGE_BYTES, WireFiles, WireReader

    files = [(f"file:/{k}", k * 997 % 3_000_000) for k in range(2000)] + [("file:/big", 5 * RANGE_BYTES)]
    parts = WireReader(files, RANGE_BYTES).partitions()
    small = [p for p in parts if isinstance(p, WireFiles)]
    assert len(parts) < 100 and len(parts) - len(small) == 5
    assert sorted(f for p in small for f in p.files) == sorted(f for f in files[:-1] if f[1])
    assert max(sum(n + OPEN_BYTES for _, n in p.files) for p in small) <= RANGE_BYTES


def test_hmac_header_name(spark, messages, registry):
    frames = sign_frames(compress_batches(build_batches(assign_batches(messages)), registry), KEY)
    from framewright.sources.frames import split_frames

    blobs = encode_frames(frames, hmac_name="x-sig").selectExpr("topic path", "frame content")
    read = split_frames(blobs, hmac_name="x-sig")
    assert '"x-sig"' in read.first().header
    assert decode_frames(read.drop("error"), registry, KEY).rejected.isEmpty()


def test_sinks(spark, messages, registry, tmp_path):
    frames = compress_batches(build_batches(assign_batches(messages, 100, 10_000)), registry)
    lines = decode_frames(frames, registry).lines
    out = str(tmp_path / "out")
    write_topic_jsonl(lines, out, ["batch_id", "pos"])
    write_topic_jsonl(lines.limit(0), out)
    back = spark.read.text(out)
    assert back.count() == 1500 and {r.topic for r in back.select("topic").distinct().collect()} == {
        "sensors.temp", "sensors-hum", "cold"}
    first = spark.read.text(out + "/topic=cold").first().value
    assert first == messages.filter("topic = 'cold'").orderBy("seq").first().msg
    write_metrics(frame_metrics(frames, F.lit(5.0)), str(tmp_path / "metrics"))
    metrics = spark.read.schema(schemas.FRAME_METRICS).option("header", True).csv(str(tmp_path / "metrics"))
    assert metrics.agg(F.sum("count")).first()[0] == 1500 and metrics.filter("timestamp != 5").isEmpty()


def test_report(spark, messages):
    batches = build_batches(assign_batches(messages, 100, 10_000))
    trained = train_dicts(messages, size=1024)
    report = compression_report(batches, trained, train_global_dict(messages, 1024), codec="zlib").cache()
    size = {(r.topic, r.method): r.comp_total for r in report.collect()}
    assert size["cold", "topic_dict"] < size["cold", "no_dict"] < size["cold", "raw"]
    for method in ("raw", "no_dict", "global_dict", "topic_dict"):
        assert size["*", method] == sum(size[t, method] for t in ("cold", "sensors.temp", "sensors-hum"))
    wide = {r.topic: r for r in compression_report_wide(report).collect()}
    assert wide["cold"].no_dict_total == size["cold", "no_dict"] and wide["*"].messages == 1500


def test_training(spark, messages):
    few = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, "y")], "topic string, ts long, seq long, msg string")
    failed = train_dicts(few).first()
    assert failed.dict_bytes is None and failed.error.startswith("training_failed")
    assert train_dicts(few, min_samples=10).first().error == "too_few_samples"
    assert bytes(train_dicts(few, 3, "prefix").first().dict_bytes) == b"x\ny"
    with pytest.raises(ValueError):
        train_dicts(few, method="other")


def fifo(samples, max_samples, max_bytes):
    kept = []
    for s in samples:
        if s:
            kept.append(s)
            while len(kept) > max_samples or sum(map(len, kept)) > max_bytes:
                kept.pop(0)
    return kept


@pytest.mark.parametrize("max_samples,max_bytes", [(3, 1000), (50, 60), (5, 20), (1000, 9)])
def test_sample_window_equals_fifo(spark, max_samples, max_bytes):
    rng = random.Random(max_samples)
    texts = {t: ["x" * rng.randint(0, 12) for _ in range(n)] for t, n in (("a", 80), ("b", 3), ("c", 1))}
    rows = [(t, i // 3, i, s) for t, all_ in texts.items() for i, s in enumerate(all_)]
    df = spark.createDataFrame(rows, "topic string, ts long, seq long, msg string")
    kept = sample_window(df, max_samples, max_bytes)
    got = kept.orderBy("topic", "seq").collect()
    for t, all_ in texts.items():
        assert [r.msg for r in got if r.topic == t] == fifo(all_, max_samples, max_bytes)
    stats = {r.topic: r for r in sample_stats(df, kept).collect()}
    for t, all_ in texts.items():
        if any(all_):
            n = sum(map(bool, all_))
            assert (stats[t].push_count, stats[t].eviction_count) == (n, n - len(fifo(all_, max_samples, max_bytes)))


def test_readiness(spark):
    df = spark.range(205).selectExpr("'a' topic", "id ts", "id seq", "repeat('x', 1000) msg")
    row = training_readiness(df, 1024).first()
    assert (row.enough_bytes, row.enough_samples, row.sample_count) == (True, True, 205)
    assert training_readiness(df, 1024).first().ready_ratio == round(205_000 / (1024 * 200), 3)
    assert not training_readiness(df, 1026).first().enough_bytes


@pytest.mark.parametrize("plan", [("window", 100), ("chunked", 4)])
def test_budget(spark, plan):
    rows = [("a", f"f{i:02}", n) for i, n in enumerate([600, 600, 100])] + [("b", f"f{i:02}", 10) for i in range(20)]
    df = spark.createDataFrame(rows, "topic string, path string, length long")
    kept = budget_prefix(df, 500, strategy=plan[0], chunk_rows=plan[1])
    a = kept.filter("topic = 'a'").collect()
    assert [(r.path, r.budget_bytes) for r in a] == [("f00", 601)]
    assert budget_prefix(df, 110, strategy=plan[0], chunk_rows=plan[1]).filter("topic = 'b'").count() == 10


def versions(spark):
    rows = [
        ("a", 1, "a1", b"1", 0.0, 10.0), ("a", 2, "a2", b"22", 10.0, 20.0), ("a", 3, "a3", b"333", 20.0, None),
        ("b", 0, "b0", b"0", 5.0, None), ("c", 1, "c1", b"1", 5.0, 8.0)]
    return spark.createDataFrame(rows, schemas.REGISTRY)


def test_versions(spark):
    registry = versions(spark)
    assert {r.topic: r.dict_id for r in active_versions(registry).collect()} == {"a": "a3", "b": "b0"}
    trained = spark.createDataFrame([("a", b"new"), ("d", b"new")], "topic string, dict_bytes binary")
    after = publish_versions(registry, trained, 30.0)
    rows = {(r.topic, r.version): r for r in after.collect()}
    assert rows["a", 3].retired_at == 30.0 and rows["a", 2].retired_at == 20.0 and rows["b", 0].retired_at is None
    assert rows["a", 4].created_at == 30.0 and rows["a", 4].dict_id.startswith("d:a:v4:") and rows["d", 1].retired_at is None
    assert sorted(r.dict_id for r in gc_versions(registry, 310.0, 300).collect()) == ["a2", "a3", "b0"]
    report = {r.topic: (r.removed, r.remaining) for r in gc_report(registry, 310.0, 300).collect()}
    assert report == {"a": (1, 2), "b": (0, 1), "c": (1, 0)}
    running = spark.createDataFrame([("b",)], "topic string")
    stats = {r.topic: r for r in registry_stats(registry, running=running).collect()}
    assert (stats["a"].active_dict_id, stats["a"].active_dict_size, stats["a"].total_versions,
            stats["a"].retired_versions) == ("a3", 3, 3, 2)
    assert stats["c"].active_dict_id is None and stats["b"].retrain_in_progress
    assert tuple(registry_totals(registry).first()) == (3, 5)
    attached = attach_active_dict(spark.createDataFrame([("a",), ("z",)], "topic string"), registry)
    assert {r.topic: r.dict_id for r in attached.collect()} == {"a": "a3", "z": ""}


@pytest.mark.parametrize("strategy,chunk", [("lookup", 10), ("scan", 1000), ("chunked", 4)])
def test_as_of(spark, strategy, chunk):
    times = [("a", -1.0), ("a", 0.0), ("a", 9.9), ("a", 10.0), ("a", 25.0), ("b", 4.0), ("b", 6.0), ("c", 7.0), ("c", 8.0), ("z", 1.0)]
    batches = spark.createDataFrame([(t, s, i) for i, (t, s) in enumerate(times)], "topic string, t0 double, batch_id long")
    rows = dict_as_of(batches, versions(spark), strategy=strategy, chunk_rows=chunk).orderBy("batch_id").collect()
    assert [r.dict_id for r in rows] == ["", "a1", "a1", "a2", "a3", "", "b0", "c1", "", ""]
    assert [r.version for r in rows][:3] == [None, 1, 1]


def test_candidates(spark):
    events = spark.createDataFrame([(t, "drift_detected") for t in "aabcd"] + [("e", "ratio_update")], "topic string, event_type string")
    ready = spark.createDataFrame(
        [("a", True, True), ("b", False, True), ("c", True, False), ("d", True, True)],
        "topic string, enough_bytes boolean, enough_samples boolean")
    running = spark.createDataFrame([("d",)], "topic string")
    rows = {r.topic: (r.drift_events, r.decision) for r in retrain_candidates(events, ready, running).collect()}
    assert rows == {"a": (2, "retrain"), "b": (1, "not_enough_bytes"), "c": (1, "too_few_samples"), "d": (1, "already_running")}


def test_index_files(spark, registry, tmp_path):
    root = tmp_path / "dicts"
    root.mkdir()
    (root / "a.dict").write_bytes(b"bytes")
    index = {"a": {"dict_id": "id_a", "path": "./dicts/a.dict"}, "b": {"dict_id": "id_b", "path": "./dicts/b.dict"}}
    (root / "dict_index.json").write_text(json.dumps(index, indent=2))
    read = read_dict_index(spark, str(root))
    assert tuple(index_report(read).first()) == (1, 1)
    row = index_to_registry(read).first()
    assert (row.topic, row.version, row.dict_id, bytes(row.dict_bytes)) == ("a", 0, "id_a", b"bytes")
    write_dict_index(active_versions(registry), str(tmp_path / "index"), "dicts")
    written = json.loads(spark.read.text(str(tmp_path / "index")).first().value)
    assert set(written) == {"sensors.temp", "sensors-hum"}
    assert written["sensors.temp"]["path"] == "dicts/sensors_temp.v1.dict"


def test_snapshots(spark, registry, tmp_path):
    root = str(tmp_path / "registry")
    publish_snapshot(registry, root)
    publish_snapshot(versions(spark), root)
    assert current_registry(spark, root).count() == 5


def test_dictionary_files_and_merged_index(spark, registry, tmp_path):
    root = str(tmp_path / "dicts")
    active = active_versions(registry)
    write_dict_files(active.filter("topic = 'sensors.temp'"), root)
    read = write_dict_files(active.filter("topic <> 'sensors.temp'"), root)
    assert {(r.topic, r.dict_id, bytes(r.dict_bytes)) for r in read.collect()} == {
        (r.topic, r.dict_id, bytes(r.dict_bytes)) for r in active.collect()}
    later = active.filter("topic = 'sensors.temp'").withColumn("version", F.col("version") + 1)
    again = {r.topic: r.version for r in write_dict_files(later, root).collect()}
    assert again["sensors.temp"] == later.first().version and len(again) == active.count()
    assert tuple(index_report(read_dict_index(spark, root)).first()) == (active.count(), 0)


def test_publishing_notices_another_publisher(spark, registry, tmp_path):
    root = str(tmp_path / "registry")
    first = publish_snapshot(registry, root)
    second = publish_snapshot(registry, root, based_on=first)
    with pytest.raises(MovedOn):
        publish_snapshot(registry.limit(0), root, based_on=first)
    assert current_name(spark, root) == second and not current_registry(spark, root).isEmpty()


def test_two_publishers_at_once_both_land(spark, registry, tmp_path):
    """Every change is made on the state that the other one left: none is lost."""
    root = str(tmp_path / "registry")
    publish_snapshot(registry.limit(0), root)
    meet = threading.Barrier(2)

    def add(topic):
        met = []

        def change(known):
            if not met:  # both look at the same state first
                met.append(meet.wait(60))
            one = spark.createDataFrame([(topic, 1, "d", bytearray(b"x"), 1.0, None)], known.schema)
            return known.unionByName(one)

        change_registry(spark, root, change)

    threads = [threading.Thread(target=add, args=(t,)) for t in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.topic for r in current_registry(spark, root).collect()} == {"a", "b"}
    newest = current_name(spark, root)
    assert len(expire_snapshots(spark, root, keep=1)) == 2 and expire_snapshots(spark, root, keep=1) == []
    assert current_name(spark, root) == newest and current_registry(spark, root).count() == 2
    assert len(list((tmp_path / "registry" / "snapshots").iterdir())) == 1


def test_a_name_is_given_once(spark, tmp_path):
    path = str(tmp_path / "p" / "1")
    assert create_once(spark, path, b"first") and not create_once(spark, path, b"second")
    assert read_small(spark, path) == "first" and names_in(spark, str(tmp_path / "p")) == ["1"]


def test_an_aborted_write_leaves_no_entry(spark, registry, tmp_path):
    root = str(tmp_path / "dicts")
    active = active_versions(registry)
    write_dict_files(active.filter("topic = 'sensors.temp'"), root)
    before = sorted(p.name for p in (tmp_path / "dicts").iterdir() if not p.name.endswith(".crc"))
    fails = F.udf(lambda b: (_ for _ in ()).throw(ValueError("broken")), "binary")
    broken = active.filter("topic <> 'sensors.temp'").withColumn("dict_bytes", fails("dict_bytes"))
    good = active.withColumn("version", F.col("version") + 5).withColumn("topic", F.concat("topic", F.lit("x")))
    with pytest.raises(Exception, match="broken"):
        write_dict_files(good.unionByName(broken), root)
    assert {r.topic for r in read_dict_index(spark, root).collect()} == {"sensors.temp"}
    left = sorted(p.name for p in (tmp_path / "dicts").iterdir() if not p.name.endswith(".crc"))
    assert "dict_index.json" in left and set(before) <= set(left)


def test_versions_without_a_date_are_never_in_force(spark):
    versions = spark.createDataFrame(
        [("a", 1, "d1", None, None), ("a", 2, "d2", 10.0, None), ("b", 1, "d3", None, None)],
        "topic string, version int, dict_id string, created_at double, retired_at double")
    batches = spark.createDataFrame([("a", 5.0, 1), ("a", 15.0, 2), ("a", None, 3), ("b", 5.0, 4)], "topic string, t0 double, batch_id long")
    want = {1: "", 2: "d2", 3: "", 4: ""}
    for strategy in ("lookup", "scan", "auto", "chunked"):
        got = {r.batch_id: r.dict_id for r in dict_as_of(batches, versions, strategy=strategy, chunk_rows=2).collect()}
        assert got == want, strategy


def test_files(spark, tmp_path):
    for topic, n in (("a.b", 2), ("c", 1)):
        folder = tmp_path / "samples" / topic
        folder.mkdir(parents=True)
        for i in range(n):
            (folder / f"{i}.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "samples" / "empty").mkdir()
    (tmp_path / "samples" / "c" / "notes.txt").write_text("no")
    rows = read_samples(spark, str(tmp_path / "samples"))
    assert {(r.topic, r["count"]) for r in rows.groupBy("topic").count().collect()} == {("a.b", 4), ("c", 2)}
    files = sample_files(spark, str(tmp_path / "samples"))
    assert {(r.topic, r.length) for r in files.collect()} == {("a.b", 18), ("c", 18)}
    (tmp_path / "m.jsonl").write_text(
        '{"camera":"front","frame":1,"objects":[{"type":"car","bbox":[1,2,3,4],"confidence":0.5}],"timestamp":5}\n'
        '{"camera":"left","frame":2,"objects":[],"timestamp":6}\n{oops\n')
    got = read_messages(spark, str(tmp_path / "m.jsonl"), schemas.CAMERA).collect()
    assert got[0].objects[0].bbox == [1, 2, 3, 4] and got[1].objects == [] and got[2].corrupt == "{oops"
    (tmp_path / "log").write_text(
        '{"timestamp":"2026-01-02T03:04:05.5","level":"info","event":"started","service":"agent","pid":7}\n'
        '{"timestamp":"2026-01-02T03:04:05+00:00","level":"ERROR","logger":"x","message":"failed","topic":"a"}\nplain\n')
    logs = read_log_events(spark, str(tmp_path / "log")).collect()
    assert [(r.level, r.event, r.service, r.extras, r.corrupt) for r in logs] == [
        ("INFO", "started", "agent", {"pid": "7"}, None), ("ERROR", "failed", "x", {"topic": "a"}, None),
        (None, None, None, None, "plain")]
    assert logs[0].ts.microsecond == 500000


@pytest.mark.parametrize("kind", ["long", "timestamp", "string"])
def test_sample_window_of_a_large_topic(spark, kind, monkeypatch):
    from framewright.operators import registry as module

    monkeypatch.setattr(module, "SAMPLE_SPREAD", 2)
    rng = random.Random(8)
    rows = [("a", int(rng.random() ** 4 * 10**9), i, "x" * rng.randint(0, 3)) for i in range(500)] + [("b", 7, 1, "y")]
    rows += [("c", 5, i, "z") for i in range(40)]
    df = spark.createDataFrame(rows, "topic string, at long, seq long, msg string")
    at = {"long": F.col("at"), "timestamp": F.timestamp_micros("at"), "string": F.lpad(F.col("at").cast("string"), 12, "0")}
    kept = sample_window(df.withColumn("ts", at[kind]), 9, 1_000).collect()
    rows += [("d", 10 ** 9 * (k == 0) + k, k, "z") for k in range(300)]  # one time far from all others
    df = spark.createDataFrame(rows, "topic string, at long, seq long, msg string")
    kept = sample_window(df.withColumn("ts", at[kind]), 9, 1_000).collect()
    for topic in "abcd":
        full = sorted((r for r in rows if r[0] == topic and r[3]), key=lambda r: r[1:3])
        assert sorted(r.seq for r in kept if r.topic == topic) == sorted(r[2] for r in full[-9:])


def test_decoding_is_bounded(spark):
    """Small frames with long texts are handed over in parts; no text may be longer than announced."""
    text = (b'{"k":"' + b"v" * 60 + b'"}\n') * 4000
    packed = zstandard.ZstdCompressor(3).compress(text)
    zipped = zlib.compress(text)
    rows = [(i, "a", "d", "zstd", 1, len(text), packed) for i in range(400)]
    rows += [(1000, "a", "d", "zstd", 1, len(text) - 1, packed), (1001, "a", "d", "zstd", 1, len(text) + 1, packed)]
    rows += [(1002, "a", "d", "zlib", 1, len(text), zipped), (1003, "a", "d", "zlib", 1, 10, zipped), (1004, "a", "", "none", 1, 3, b"abcd")]
    rows += [(1005, "a", "d", "zstd", 1, len(text), packed[:-9]), (1006, "a", "", "none", 1, 4, b"abc\n")]
    frames = spark.createDataFrame(rows, "n long, topic string, dict_id string, codec string, count long, raw_len long, payload binary").coalesce(1)
    registry = spark.createDataFrame([("a", 1, "d", b"", 1.0, True)], "topic string, version int, dict_id string, dict_bytes binary, created_at double, active boolean")
    decoded = decode_frames(frames, registry)
    assert decoded.frames.filter(F.octet_length("raw") == len(text)).count() == 401
    assert {r.n: r.error for r in decoded.rejected.collect()} == dict.fromkeys((1000, 1001, 1003, 1004, 1005), "corrupt")
    assert decoded.frames.filter("n = 1006").first().raw == b"abc\n"
