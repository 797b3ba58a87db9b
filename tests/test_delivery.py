import math
import random

import pytest
from pyspark.sql import functions as F

from framewright.operators.breaker import Rules, VARIANTS, breaker_health, breaker_states, breaker_stats
from framewright.operators.delivery import (
    evict_pending, merge_delivery, oldest_pending, pending_stats, settle)
from framewright.operators.pressure import queue_depth, queue_stats

PLANS = [("window", 10_000), ("chunked", 13)]


def pending(spark, n, size=10):
    rows = [(i, f"t{i % 2}", b"x" * size, float(i // 2)) for i in range(n)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "id long, topic string, payload binary, timestamp double")


def test_fifo(spark):
    assert [r.id for r in oldest_pending(pending(spark, 30), 4).collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("plan", PLANS)
def test_eviction(spark, plan):
    kw = dict(strategy=plan[0], chunk_rows=plan[1])
    store = pending(spark, 100)
    left = sorted(r.id for r in evict_pending(store, 900, **kw).collect())
    assert left == list(range(10, 100))
    assert evict_pending(store, 1000, **kw).count() == 100
    exact = sorted(r.id for r in evict_pending(store, 55, exact=True, **kw).collect())
    assert exact == list(range(95, 100))
    assert sorted(r.id for r in evict_pending(pending(spark, 3), 1, **kw).collect()) == [1, 2]


def test_settle_and_stats(spark):
    store = pending(spark, 6)
    done = spark.createDataFrame([(0,), (3,)], "id long")
    assert sorted(r.id for r in settle(store, done).collect()) == [1, 2, 4, 5]
    assert settle(store, done, store.filter("id = 0")).count() == 5
    stats = {r.topic: r for r in pending_stats(store, 10.0).collect()}
    assert (stats[None].frames, stats[None].bytes, stats[None].oldest_age, stats["t1"].frames) == (6, 60, 10.0, 3)


def test_merge_counts_each_frame_once(spark):
    schema = "topic string, batch_id long, count long"
    live = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], schema)
    late = spark.createDataFrame([("a", 2, 6), ("b", 1, 7), ("b", 1, 7)], schema)
    rows = {(r.topic, r.batch_id): (r["count"], r.recovered) for r in merge_delivery(live, late).collect()}
    assert rows == {("a", 1): (5, False), ("a", 2): (6, False), ("b", 1): (7, True)}


def random_log(seed, n=120):
    rng = random.Random(seed)
    ops = ["acquire", "release", "release", "drop", "delay", "block", "timeout"]
    return [(q, i, rng.choice(ops), rng.randint(-1, 9)) for q in ("a", "b") for i in range(rng.randint(1, n))]


@pytest.mark.parametrize("plan", PLANS)
@pytest.mark.parametrize("seed", [1, 2])
def test_depth_equals_loop(spark, plan, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, "queue string, seq long, op string, n long").withColumn("ts", F.col("seq"))
    rows = queue_depth(df, "queue", strategy=plan[0], chunk_rows=plan[1]).orderBy("queue", "seq").collect()
    depth, peak = {}, {}
    for (q, i, op, n), row in zip(sorted(log), rows):
        d = depth.get(q, 0)
        if n > 0 and op == "acquire":
            d += n
        elif n > 0 and op == "release":
            d = max(0, d - n)
        depth[q], peak[q] = d, max(peak.get(q, 0), d)
        assert (row.queue, row.seq, row.depth, row.peak) == (q, i, d, peak[q])
    for r in queue_stats(df, "queue", soft=5, hard=20, strategy=plan[0], chunk_rows=plan[1]).collect():
        mine = [(op, n) for q, _, op, n in log if q == r.queue]
        assert (r.current_queued, r.peak_queued) == (depth[r.queue], peak[r.queue])
        assert r.total_acquired == sum(n for op, n in mine if op == "acquire" and n > 0)
        assert r.total_dropped == sum(n for op, n in mine if op == "drop" and n > 0)
        assert r.total_timeouts == sum(op == "timeout" for op, _ in mine)
        assert r.pressure == round(min(1.0, max(0.0, (depth[r.queue] - 5) / 15)), 4)


def replay(attempts, rules):
    state, fails, wins, since, out = "CLOSED", 0, 0, math.nan, []
    for now, ok in attempts:
        waited = now - since
        if state == "OPEN" and (waited > rules.timeout if rules.late else waited >= rules.timeout):
            state, wins = "HALF_OPEN", 0
        before = state
        if state == "CLOSED":
            fails = 0 if ok else fails + 1
            if fails >= rules.failures:
                state, since = "OPEN", now
        elif state == "HALF_OPEN":
            if not ok:
                state, since = "OPEN", now
            else:
                wins += 1
                if wins >= rules.successes:
                    state, fails = "CLOSED", 0
        out.append((before, before != "OPEN", state))
    return out


@pytest.mark.parametrize("plan", [("window", 10_000), ("chunked", 11), ("chunked", 40)])
@pytest.mark.parametrize("seed,rules", [
    (1, Rules(3, 10.0, 2, True)), (2, Rules(2, 5.0, 3, False)), (3, Rules(1, 2.0, 1, False)), (4, VARIANTS["first"])])
def test_breaker_equals_replay(spark, plan, seed, rules):
    rng = random.Random(seed)
    logs = {}
    for name in ("a", "b", "c"):
        now, log, p = 0, [], rng.choice([0.3, 0.6, 0.8])
        for _ in range(rng.randint(5, 150)):
            now += rng.choice([0, 1, 1, 3, 20])
            log.append((float(now), rng.random() > p))
        logs[name] = log
    rows = [(k, t, i, ok) for k, log in logs.items() for i, (t, ok) in enumerate(log)]
    df = spark.createDataFrame(rows, "target string, ts double, seq long, ok boolean")
    got = breaker_states(df, rules=rules, strategy=plan[0], chunk_rows=plan[1]).collect()
    for name, log in logs.items():
        mine = sorted((r for r in got if r.target == name), key=lambda r: r.seq)
        assert [(r.state_before, r.allowed, r.state_after) for r in mine] == replay(log, rules)


def test_breaker_opens_and_health(spark):
    rows = [("a", float(i), i, False) for i in range(4)] + [("b", 0.0, 0, True)]
    df = spark.createDataFrame(rows, "target string, ts double, seq long, ok boolean")
    states = breaker_states(df, rules=Rules(3, 60.0, 2))
    last = states.filter("target = 'a' and seq = 3").first()
    assert (last.state_before, last.allowed) == ("OPEN", False)
    stats = breaker_stats(states)
    a = stats.filter("target = 'a'").first()
    assert (a.state, a.total_calls, a.rejected, a.total_failures, a.last_failure_time) == ("OPEN", 4, 1, 3, 2.0)
    health = breaker_health(stats).first()
    assert (health.healthy, health.total_circuits, health.open_circuits) == (False, 2, ["a"])
    with pytest.raises(ValueError):
        breaker_states(df, "third")
