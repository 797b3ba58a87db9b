"""Chunk maps combined as a tree, and ordered walks, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F, types as T

from framewright.operators.batching import assign_batches
from framewright.operators.breaker import breaker_states
from framewright.operators.fold import entry_states, fold_automaton
from framewright.operators.ordered import order_rows

TABLE = {0: [1, 0, 2], 1: [2, 1, 0], 2: [2, 0, 1]}


def states_before(symbols, chunk):
    out, state = [], 0
    for i, s in enumerate(symbols):
        if i % chunk == 0:
            out.append(state)
        state = TABLE[state][s]
    return out


def test_tree_of_a_hundred_thousand_chunks(spark):
    """Chunks of three rows: no task sees more than a thousand of their maps."""
    r = random.Random(6)
    symbols = [r.randrange(3) for _ in range(300_000)]
    maps = []
    for i in range(0, len(symbols), 3):
        now = [0, 1, 2]
        for s in symbols[i:i + 3]:
            now = [TABLE[x][s] for x in now]
        maps.append(("a", i // 3, now))
    seen = spark.sparkContext.accumulator(0)

    def counted(f):
        def run(*args):
            seen.add(1)
            return f(*args)
        return run

    step = counted(lambda state, s: {"state": s["exits"][state["state"]]})
    compose = counted(lambda a, b: {"exits": [b["exits"][x] for x in a["exits"]]})
    df = spark.createDataFrame([*maps, ("b", 0, [1, 1, 1])], "k string, _chunk long, exits array<int>")
    got = entry_states(df, ["k"], {"state": 0}, [T.StructField("exits", T.ArrayType(T.IntegerType()))],
                       [T.StructField("state", T.IntegerType())], step, compose)
    a = [r.state for r in got.filter("k = 'a'").orderBy("_chunk").collect()]
    assert a == states_before(symbols, 3)
    assert [r.state for r in got.filter("k = 'b'").collect()] == [0]
    # every map is composed once per level and walked once per level, not once per pair
    assert seen.value < 2.2 * len(maps)


@pytest.mark.parametrize("width", [2, 3, 7])
def test_any_width_and_null_keys(spark, width):
    r = random.Random(width)
    symbols = {k: [r.randrange(3) for _ in range(n)] for k, n in ((None, 25), ("x", 1), ("y", 8))}
    rows = [(k, i, [TABLE[x][s] for x in range(3)]) for k, seq in symbols.items() for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "k string, _chunk long, exits array<int>")
    got = entry_states(df, ["k"], {"state": 0}, [T.StructField("exits", T.ArrayType(T.IntegerType()))],
                       [T.StructField("state", T.IntegerType())], lambda state, s: {"state": s["exits"][state["state"]]},
                       lambda a, b: {"exits": [b["exits"][x] for x in a["exits"]]}, width)
    for k, seq in symbols.items():
        mine = got.filter(F.col("k").eqNullSafe(k)).orderBy("_chunk").collect()
        assert [x.state for x in mine] == states_before(seq, 1)


@pytest.mark.parametrize("plan", [("window", 1000), ("chunked", 3)])
def test_automaton(spark, plan):
    r = random.Random(9)
    symbols = [r.randrange(3) for _ in range(40)]
    df = spark.createDataFrame([("a", i, s, "text") for i, s in enumerate(symbols)], "k string, i int, s int, msg string")
    rows = order_rows(df, ["k"], ["i"], strategy=plan[0], chunk_rows=plan[1])
    got = fold_automaton(rows, "s", TABLE, 0, "after", "before").result().orderBy("i").collect()
    assert [x.before for x in got] == states_before(symbols, 1)


def _python_inputs(df):
    """Expressions that the plan evaluates in Python."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "ArrowEvalPython" in line or "InArrow" in line or "InPandas" in line]


@pytest.mark.parametrize("plan", [("window", 1000), ("chunked", 5)])
def test_no_text_goes_to_python(spark, plan):
    """The walk reads marks, positions, times and states; what else a row has stays in the JVM."""
    df = spark.createDataFrame([("a", 1000 * i, i, "text") for i in range(20)], "topic string, us long, seq long, msg string")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    for walked in (assign_batches(df, 4, 5, strategy=plan[0], chunk_rows=plan[1]),
                   breaker_states(df.withColumn("ok", F.lit(True)), target="topic", order=("us", "seq"), strategy=plan[0], chunk_rows=plan[1])):
        nodes = _python_inputs(walked)
        assert nodes and all("ArrowEvalPython" in n for n in nodes)
        calls = [n[n.index("walk("):n.index(")#")] for n in nodes if "walk(" in n]
        assert calls and not any("msg#" in c for c in calls)


def test_rows_out_of_order_raise(spark):
    from framewright.operators.fold import _scanned

    df = spark.createDataFrame([(1, 0), (3, 0)], "_n long, s int").coalesce(1)
    with pytest.raises(Exception, match="not in order"):
        _scanned(df, F.col("_n") == 1, ["s"], [T.StructField("x", T.IntegerType())], lambda c, s: ([c[0]], s), {}, []).collect()
