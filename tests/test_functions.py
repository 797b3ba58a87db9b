import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from framewright.functions.auth import sign_frames, verify_frames
from framewright.functions.checks import (
    MAX_MESSAGE_BYTES, TOPIC_ERRORS, observe_outcomes, outcome_counts, quarantine, quarantine_counts, size_error, validate_dict_id, validate_header, validate_sizes,
    validate_topic)
from framewright.functions.normalize import normalize
from framewright.functions.scalars import dict_file_name, dict_id, pressure_cols, ratio_cols, trained_dict_id


def column(spark, values, kind="string", name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def test_topics(spark):
    cases = {
        None: "empty", "": "empty", "q" * 255: None, "q" * 256: "too_long", "Z": None, "0-9_x": None, "plant.line7.oven": None,
        "plant..oven": "path_traversal", "oven/../x": "path_traversal", "/oven": "leading_separator", "\\oven": "leading_separator",
        "oven.": "trailing_dot", "oven 7": "bad_character", "oven\t": "bad_character", "oven\n": "bad_character", "öfen": "bad_character",
    }
    rows = validate_topic(column(spark, list(cases)), "x").collect()
    assert {r.x: r.error for r in rows} == cases


def test_dict_ids(spark):
    cases = {"": None, None: None, "d:a_b:v1:00ff": None, "d:a.b:00": None, "x" * 129: "too_long", "a b": "bad_character"}
    rows = validate_dict_id(column(spark, list(cases)), "x").collect()
    assert {r.x: r.error for r in rows} == cases
    assert validate_dict_id(column(spark, ["d:a.b:00"]), "x", allow_dot=False).first().error == "bad_character"


def test_sizes(spark):
    df = spark.range(2).select(F.repeat(F.lit("a"), (MAX_MESSAGE_BYTES + F.col("id")).cast("int")).alias("msg"))
    assert [r.error for r in validate_sizes(df).select("error").collect()] == [None, "message_too_large"]
    assert df.select(size_error(F.col("msg"), 10).alias("e")).first().e == "too_large"


def test_headers(spark):
    good = {"v": 1, "topic": "a.b", "codec": "zstd", "count": 5, "raw_len": 10, "comp_len": 0, "dict_id": "d:a.b:00"}
    changed = lambda **kw: json.dumps({**good, **kw})
    without = lambda *names: json.dumps({k: v for k, v in good.items() if k not in names})
    cases = {
        json.dumps(good): None, without("dict_id"): None, changed(dict_id=None): None, changed(dict_id=""): None,
        without("v", "count"): "missing:count,v", "[1]": "not_an_object", "{bad": "not_an_object", "5": "not_an_object",
        changed(v=999): "version", changed(v="1"): "version", changed(v=None): "version",
        changed(topic=""): "topic_empty", changed(topic=5): "topic_type", changed(topic="a b"): "topic_bad_character",
        changed(count=0): "count", changed(count=5.0): "count", changed(count="5"): "count", changed(count=True): "count",
        changed(raw_len=-1): "raw_len", changed(comp_len=None): "comp_len",
        changed(dict_id=7): "dict_id_type", changed(dict_id="a b"): "dict_id_bad_character",
    }
    df = validate_header(column(spark, list(cases)), "x")
    assert {r.x: r.error for r in df.collect()} == cases
    valid, rejected = quarantine(df)
    assert valid.count() == 4 and rejected.count() == len(cases) - 4 and "error" not in valid.columns
    assert {r.outcome: r.frames for r in quarantine_counts(df).collect()}["valid"] == 4


@pytest.mark.parametrize("algo", ["sha256", "sha384", "sha512"])
@pytest.mark.parametrize("size", [32, 64, 200])
def test_signatures(spark, algo, size):
    key = bytes(range(size % 256)) if size < 256 else b"k" * size
    payloads = [b"", b"payload", bytes(range(256)) * 5]
    df = sign_frames(column(spark, payloads, "binary", "payload"), key.hex(), algo)
    for r in df.collect():
        assert r.hmac == hmac.new(key, bytes(r.payload), getattr(hashlib, algo)).hexdigest()
    checked = verify_frames(df, key.hex())
    assert [r.verified for r in checked.collect()] == [True] * 3
    bad = {
        "tampered": df.withColumn("payload", F.concat("payload", F.lit(bytearray(b"x")))),
        "unsigned": df.withColumn("hmac", F.lit(None).cast("string")),
        "unknown": df.withColumn("hmac_algo", F.lit("md5")),
    }
    for frames in bad.values():
        assert not any(r.verified for r in verify_frames(frames, key.hex()).collect())
    assert not any(r.verified for r in verify_frames(df, "00" * 32).collect())


def test_signature_with_header(spark):
    df = spark.createDataFrame([('{"v":1}', b"body")], "head string, payload binary")
    signed = sign_frames(df, "0a" * 32, header="head")
    assert signed.first().hmac == hmac.new(b"\n" * 32, b'{"v":1}body', "sha256").hexdigest()
    assert verify_frames(signed, "0a" * 32, header="head").first().verified
    assert not verify_frames(signed, "0a" * 32).first().verified


def test_normalize_odd_text(spark):
    texts = ['{"a":"\\ud800"}', '{"a":"\\ud83d\\ude00"}', '{"a":' + "[" * 20000 + "]" * 20000 + "}"]
    rows = [r.msg for r in normalize(column(spark, texts, name="msg").coalesce(1)).collect()]
    assert rows[:2] == ['{"a":"\\ud800"}', '{"a":"\U0001f600"}'] and rows[2] in (None, texts[2])


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        sign_frames(column(spark, [b"x"], "binary", "payload"), "00", "md5")


MIXED = {
    "oven": "Küche 3", "pans": -7, "heat": 181.250, "lit": False, "cook": None, "racks": [[], [0.5, "x"]],
    "door": {"z": {"y": 1e3}, "angle": 4}, "headers": {"X-Amzn-Trace-Id": "Root=9", "Via": "belt"},
}


def test_normalize_any_json(spark):
    texts = [json.dumps(MIXED), '{"headers": "X-Amzn-Trace-Id", "z": 1, "a": null}', '{"a": [ ]}', "[1]", "{bad", None]
    rows = [r.msg for r in normalize(column(spark, texts, name="msg").coalesce(1)).collect()]
    kept = {**MIXED, "headers": {"Via": "belt"}}
    assert rows[0] == json.dumps(kept, ensure_ascii=False, separators=(",", ":"))
    assert rows[1:] == ['{"headers":"X-Amzn-Trace-Id","z":1,"a":null}', '{"a":[]}', None, None, None]
    sorted_row = normalize(column(spark, texts[:1], name="msg"), sort_keys=True).first().msg
    assert list(json.loads(sorted_row)) == sorted(MIXED)


@pytest.mark.parametrize("headers", ["MAP<STRING, STRING>", "STRUCT<Accept: STRING, `X-Amzn-Trace-Id`: STRING>"])
def test_normalize_typed(spark, headers):
    schema = f"name STRING, size BIGINT, headers {headers}"
    texts = ['{"name": "a", "size": 3, "headers": {"Accept": "x", "X-Amzn-Trace-Id": "r"}}', '{"name": null}', "[]"]
    rows = [r.msg for r in normalize(column(spark, texts, name="msg").coalesce(1), schema=schema).collect()]
    assert rows == [
        '{"name":"a","size":3,"headers":{"Accept":"x"}}', '{"name":null,"size":null,"headers":null}', None]
    ordered = normalize(column(spark, texts[:1], name="msg"), schema=schema, sort_keys=True).first().msg
    assert ordered == '{"headers":{"Accept":"x"},"name":"a","size":3}'


def test_pressure(spark):
    rows = {r.queued: r for r in pressure_cols(column(spark, [5, 10, 20, 30, 999], "long", "queued"), 10, 30).collect()}
    assert [(q, r.pressure, r.delay_ms) for q, r in sorted(rows.items())] == [
        (5, 0.0, 0.0), (10, 0.0, 0.0), (20, 0.5, 50.0), (30, 1.0, 100.0), (999, 1.0, 100.0)]
    assert rows[20].queue_pct == 66.7
    with pytest.raises(ValueError):
        pressure_cols(column(spark, [1], "long", "queued"), 10, 10)


def test_ratios_and_ids(spark):
    row = ratio_cols(spark.createDataFrame([(1000, 250, 10)], "raw_len long, comp_len long, count long")).first()
    assert (row.ratio, row.bytes_saved, row.savings_pct, row.bytes_per_msg) == (0.25, 750, 75.0, 25.0)
    assert ratio_cols(spark.createDataFrame([(0, 0, 0)], "raw_len long, comp_len long, count long")).first().ratio == 0
    data = b"dictionary"
    digest = hashlib.sha256(data).hexdigest()
    row = spark.createDataFrame([("sensors.te-mp", 3, data)], "t string, v int, b binary").select(
        dict_id(F.col("t"), F.col("v"), F.col("b")).alias("a"), trained_dict_id(F.col("t"), F.col("b")).alias("b"),
        dict_file_name(F.col("t"), F.col("v")).alias("c")).first()
    assert tuple(row) == (f"d:sensors_te_mp:v3:{digest[:12]}", f"d:sensors.te-mp:{digest[:16]}", "sensors_te-mp.v3.dict")


def test_outcomes_are_counted_while_rows_are_written(spark, tmp_path):
    rows = validate_topic(column(spark, ["a.b", "", "c..d", "x y", "x y", "p.", None]), "x")
    watched, seen = observe_outcomes(rows, [k for k in TOPIC_ERRORS if k != "trailing_dot"])
    watched.write.parquet(str(tmp_path / "out"))
    counted = {r.outcome: r.frames for r in outcome_counts(spark, seen).collect()}
    plain = {r.outcome: r.frames for r in quarantine_counts(rows).collect()}
    assert counted == {"other" if k == "trailing_dot" else k: n for k, n in plain.items()}


def test_outcomes_of_a_stream(spark, tmp_path):
    column(spark, ["a.b", "", "x y"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x string").parquet(str(tmp_path / "in"))
    watched, _ = observe_outcomes(validate_topic(stream, "x"), TOPIC_ERRORS)
    query = watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    counts = [p["observedMetrics"]["outcomes"] for p in query.recentProgress if "outcomes" in p["observedMetrics"]]
    assert sum(c["valid"] for c in counts) == 1 and sum(c["bad_character"] for c in counts) == 1
