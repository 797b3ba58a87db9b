import random

import pytest
from pyspark.sql import functions as F

from framewright.operators.batching import assign_batches, build_batches


def messages(spark, topics):
    rows = [(t, us, i, f"m{i}") for t, times in topics.items() for i, us in enumerate(times)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "topic string, us long, seq long, msg string").withColumn(
        "ts", F.timestamp_micros("us"))


def batch_ids(times, batch_max, span, mode):
    out, size, opened, start = [], 0, 0, 0
    for n, t in enumerate(times, 1):
        if size and mode == "timer" and t >= start + span:
            size = 0
        if not size:
            opened, start = n, t
        out.append(opened)
        size += 1
        if size >= batch_max or (mode == "arrival" and t - start >= span):
            size = 0
    return out


def random_topics(seed, n=3, longest=150):
    rng = random.Random(seed)
    topics = {}
    for k in range(n):
        now, times = 0, []
        for _ in range(rng.randint(1, longest)):
            now += rng.choice([0, 0, 1, 2, 5, 30]) * 1000
            times.append(now)
        topics[f"t{k}"] = times
    return topics


@pytest.mark.parametrize("mode", ["timer", "arrival"])
@pytest.mark.parametrize("plan", [("window", 1000), ("chunked", 10), ("chunked", 64)])
@pytest.mark.parametrize("seed,batch_max,batch_ms", [(1, 4, 20), (2, 10, 3), (3, 7, 1000), (4, 1, 5), (5, 3, 0)])
def test_batches_equal_loop(spark, mode, plan, seed, batch_max, batch_ms):
    topics = random_topics(seed)
    got = assign_batches(
        messages(spark, topics), batch_max, batch_ms, mode, strategy=plan[0], chunk_rows=plan[1]).collect()
    for topic, times in topics.items():
        seen = [r.batch_id for r in sorted((r for r in got if r.topic == topic), key=lambda r: r.seq)]
        assert seen == batch_ids(times, batch_max, batch_ms * 1000, mode)


def test_payload_and_header_fields(spark):
    df = messages(spark, {"a": [0, 1000, 2000], "b": [0]})
    rows = {(r.topic, r.batch_id): r for r in build_batches(assign_batches(df, 2, 1000)).collect()}
    first = rows["a", 1]
    assert bytes(first.payload) == b"m0\nm1\n"
    assert (first["count"], first.raw_len, first.t0, first.t1) == (2, 6, 0.0, 0.001)
    assert bytes(rows["a", 3].payload) == b"m2\n" and bytes(rows["b", 1].payload) == b"m0\n"


def test_session_zone_does_not_matter(spark):
    topics = random_topics(6, n=1, longest=40)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for plan in (("window", 1000), ("chunked", 10)):
            got = assign_batches(messages(spark, topics), 4, 20, strategy=plan[0], chunk_rows=plan[1])
            times = {r.seq: r.us for r in got.select("seq", F.unix_micros("ts").alias("us")).collect()}
            assert [times[i] for i in range(len(topics["t0"]))] == topics["t0"]
            assert [r.batch_id for r in got.orderBy("seq").collect()] == batch_ids(topics["t0"], 4, 20_000, "timer")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_rows_without_time_or_text(spark):
    df = messages(spark, {"a": [0, 1000, 2000]})
    late = df.withColumn("ts", F.when(F.col("seq") > 0, F.col("ts")))
    assert [r.batch_id for r in assign_batches(late, 10, 1000).orderBy("seq").collect()] == [1, 2, 2]
    empty = df.withColumn("msg", F.when(F.col("seq") != 1, F.col("msg")))
    row = build_batches(assign_batches(empty, 10, 1000)).first()
    assert (row["count"], row.raw_len, bytes(row.payload)) == (2, 6, b"m0\nm2\n")


def test_raw_length_counts_bytes(spark):
    df = messages(spark, {"a": [0, 1]}).withColumn("msg", F.lit("é€"))
    row = build_batches(assign_batches(df)).first()
    assert row.raw_len == len(bytes(row.payload)) == 12
