import random

import pytest
from pyspark.sql import functions as F

from framewright.operators.drift import ema, monitor_stats, ratio_baseline, ratio_events

SCHEMA = "topic string, ts long, seq long, raw_len long, comp_len long"


def series(spark, topics):
    rows = [(t, i // 2, i, 1000, c) for t, values in topics.items() for i, c in enumerate(values)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def monitor(values, alpha, warmup, drift, consecutive, recovery, retrain_before=()):
    """Straight restatement of the rule, one topic; retrain_before lists batch numbers a retrain comes before."""
    out, ema_now, base, state, run = [], None, None, "warmup", 0
    for n, comp in enumerate(values, 1):
        for _ in range(list(retrain_before).count(n)):
            base, state, run = ema_now, "normal", 0
        r = comp / 1000
        ema_now = r if ema_now is None else ema_now + alpha * (r - ema_now)
        event = "ratio_update"
        rel = None if base is None else (ema_now - base) / max(base, 1e-9)
        if state == "warmup":
            if n >= warmup:
                base, state, event = ema_now, "normal", "warmup_complete"
        elif state == "normal":
            if rel is not None and rel > drift:
                run += 1
                if run >= consecutive:
                    state, event = "drifted", "drift_detected"
            else:
                run = 0
        elif rel is not None and rel <= recovery:
            state, run, event = "normal", 0, "recovered"
        out.append((n, ema_now, base, event, state, run))
    return out


def assert_same(got, topic, expected):
    rows = sorted((r for r in got if r.topic == topic), key=lambda r: r.batch_count)
    seen = [(r.batch_count, r.ema, r.baseline, r.event_type, r.state, r.consecutive_drift) for r in rows]
    assert len(seen) == len(expected)
    for a, b in zip(seen, expected):
        assert (a[0], *a[3:]) == (b[0], *b[3:])
        assert a[1] == pytest.approx(b[1], rel=1e-9)
        assert (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], rel=1e-9))


def topics_of(seed, n=4, longest=160):
    rng = random.Random(seed)
    topics = {}
    for k in range(n):
        level, values = 50, []
        for _ in range(rng.randint(1, longest)):
            if rng.random() < 0.08:
                level = rng.choice([40, 50, 60, 75, 100, 0])
            values.append(level + rng.randint(0, 3))
        topics[f"t{k}"] = values
    return topics


@pytest.mark.parametrize("mode", [("window", 1000), ("chunked", 7), ("chunked", 33)])
@pytest.mark.parametrize("seed,alpha,recovery", [(1, 0.1, 0.05), (2, 0.5, 0.013), (3, 0.9, 0.1), (4, 0.3, 0.35)])
def test_events_equal_state_machine(spark, mode, seed, alpha, recovery):
    topics = topics_of(seed)
    got = ratio_events(
        series(spark, topics), alpha=alpha, warmup=5, drift=0.2, consecutive=3, recovery=recovery,
        strategy=mode[0], chunk_rows=mode[1]).collect()
    for topic, values in topics.items():
        assert_same(got, topic, monitor(values, alpha, 5, 0.2, 3, recovery))


@pytest.mark.parametrize("mode", [("window", 1000), ("chunked", 9)])
def test_retrains_reset_the_baseline(spark, mode):
    topics = topics_of(9, n=3, longest=60)
    before = {"t0": [3, 20, 20], "t1": [1], "t2": []}
    marks = [(t, (n - 1) // 2) for t, ns in before.items() for n in ns if n <= len(topics[t])]
    # a retrain at time x comes before both batches of that time
    expected_before = {t: [((n - 1) // 2) * 2 + 1 for n in ns if n <= len(topics[t])] for t, ns in before.items()}
    retrains = spark.createDataFrame(marks, "topic string, ts long")
    got = ratio_events(
        series(spark, topics), alpha=0.3, warmup=5, drift=0.1, retrains=retrains,
        strategy=mode[0], chunk_rows=mode[1]).cache()
    for topic, values in topics.items():
        assert_same(got.collect(), topic, monitor(values, 0.3, 5, 0.1, 3, 0.05, expected_before[topic]))
    stats = {r.topic: r for r in monitor_stats(got, retrains).collect()}
    assert stats["t0"].retrain_count == len(expected_before["t0"])
    assert stats["t2"].batch_count == len(topics["t2"])


def test_known_average(spark):
    df = series(spark, {"a": [100, 50]}).withColumn("ratio", F.col("comp_len") / 1000)
    assert [round(r.ema, 12) for r in ema(df, "ratio", alpha=0.2).orderBy("seq").collect()] == [0.10, 0.09]


@pytest.mark.parametrize("alpha", [1e-4, 0.01, 0.1, 0.999, 1.0])
@pytest.mark.parametrize("mode", [("window", 10_000), ("chunked", 50)])
def test_average_equals_loop(spark, alpha, mode):
    rng = random.Random(5)
    values = [rng.randint(0, 1000) for _ in range(700)]
    df = series(spark, {"a": values}).withColumn("r", F.col("comp_len") / 1000)
    got = [r.ema for r in ema(df, "r", alpha=alpha, strategy=mode[0], chunk_rows=mode[1]).orderBy("seq").collect()]
    e = None
    for v, g in zip(values, got):
        e = v / 1000 if e is None else e + alpha * (v / 1000 - e)
        assert g == pytest.approx(e, rel=1e-9, abs=1e-12)


def test_average_across_many_blocks(spark):
    df = spark.range(5000).selectExpr("'a' topic", "id ts", "id seq", "double(id % 17) r")
    got = [r.ema for r in ema(df, "r", alpha=0.5).orderBy("seq").collect()]
    e = None
    for i, g in enumerate(got):
        e = i % 17 if e is None else e + 0.5 * (i % 17 - e)
        assert g == pytest.approx(e, rel=1e-12)


def test_baseline_null_before_warmup(spark):
    rows = ratio_baseline(series(spark, {"a": [50] * 6}), warmup=5).orderBy("seq").collect()
    assert [r.baseline is None for r in rows] == [True] * 4 + [False] * 2


def test_third_drifted_batch_triggers(spark):
    events = ratio_events(
        series(spark, {"a": [56] * 5 + [112] * 3}), alpha=0.5, warmup=5, drift=0.10).orderBy("seq").collect()
    assert [r.event_type for r in events][4:] == ["warmup_complete", "ratio_update", "ratio_update", "drift_detected"]


def test_bad_arguments(spark):
    df = series(spark, {"a": [1]})
    with pytest.raises(ValueError):
        ema(df, "comp_len", alpha=0)
    with pytest.raises(ValueError):
        ema(df, "comp_len", strategy="other")


@pytest.mark.parametrize("alpha", [1e-6, 0.001, 0.1, 0.5, 0.9])
def test_average_does_not_depend_on_the_form(spark, alpha):
    """More rows than chunk_rows, in both forms, against a plain loop."""
    rng = random.Random(9)
    values = [rng.random() for _ in range(230)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "topic string, seq long, v double")
    expected, e = [], None
    for v in values:
        e = v if e is None else e + alpha * (v - e)
        expected.append(e)
    for strategy in ("window", "chunked"):
        got = ema(df, "v", ("seq",), alpha=alpha, chunk_rows=5, strategy=strategy).orderBy("seq").collect()
        assert max(abs(r.ema - x) for r, x in zip(got, expected, strict=True)) < 1e-12, strategy


def test_state_of_chunks_comes_to_the_rows(spark):
    """Rows of a chunk are shuffled once for all passes of the average; what enters a chunk is broadcast to them."""
    from framewright.operators.drift import ema
    from framewright.session import scratch_table

    df = scratch_table(spark.range(400).selectExpr("if(id % 3 = 0, 'a', 'b') AS topic", "id AS ts", "id AS seq", "id % 7 / 7.0 AS r"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ema(df, "r", strategy="chunked", chunk_rows=50)
        plan = out._jdf.queryExecution().executedPlan().toString()
        cut = sorted((x.topic, x.seq, round(x.ema, 9)) for x in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "hashpartitioning(topic" in plan and "_block" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line)
    assert cut == sorted((x.topic, x.seq, round(x.ema, 9)) for x in ema(df, "r", strategy="window").collect())
