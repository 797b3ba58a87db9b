"""Circuit-breaker states from a log of attempts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .fold import Entry, fold_rows
from .ordered import CHUNK_ROWS, order_rows

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


@dataclass(frozen=True)
class Rules:
    """When a breaker changes state. ``late`` tells whether the timeout must be exceeded or only reached."""

    failures: int = 5
    timeout: float = 60.0
    successes: int = 3
    late: bool = True


# The two rule sets in use.
VARIANTS = {"first": Rules(5, 60.0, 3, True), "second": Rules(5, 60.0, 2, False)}

# A state is a pair (code, time). Codes 0 .. failures-1: closed after that many failures in a row; then successes codes:
# half open after that many; -1: open since time.


class _Machine:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.half = rules.failures
        self.codes = rules.failures + rules.successes

    def ready(self, since: float, now: float) -> bool:
        end = since + self.rules.timeout
        return now > end if self.rules.late else now >= end

    def after(self, code: int, ok: bool) -> int:
        """Successor of a closed or half-open state; -1 if the attempt opens the circuit."""
        if code < self.half:
            return 0 if ok else (code + 1 if code + 1 < self.half else -1)
        if not ok:
            return -1
        return code + 1 if code + 1 < self.codes else 0

    def name(self, code: int) -> str:
        return OPEN if code < 0 else CLOSED if code < self.half else HALF_OPEN


def breaker_states(
    attempts: DataFrame, variant: str = "first", rules: Rules | None = None, *, target: str = "target",
    order: Sequence[str] = ("ts", "seq"), chunk_rows: int = 200_000, strategy: str = "auto",
) -> DataFrame:
    """Add the state an attempt met, whether it was allowed, and the state after it.

    *attempts* has the target, the time in seconds as the first column of *order*, and ok. Enough failures in a row open
    the circuit; once it has been open for the timeout the next attempt finds it half open; there a failure opens it
    again and enough successes close it. An attempt on an open circuit is rejected and its outcome does not count.

    A chunk of a hot target is summarized by its final state for every closed or half-open start, and, for an open
    start, by the final state depending on the attempt that finds the circuit half open.
    """
    if rules is None:
        if variant not in VARIANTS:
            raise ValueError(f"unknown variant {variant!r}")
        rules = VARIANTS[variant]
    if rules.failures < 1 or rules.successes < 1:
        raise ValueError("failures and successes must be at least 1")
    machine = _Machine(rules)
    # by code; the open state is the last one, which -1 finds
    names = np.array([machine.name(c) for c in [*range(machine.codes), -1]], object)
    rows = order_rows(attempts, [target], order, chunk_rows=chunk_rows, strategy=strategy)
    rows = rows.add(_t=F.col(order[0]).cast("double"), _ok=F.coalesce(F.col("ok"), F.lit(False)))

    def scan(columns: list[pa.Array], state: Entry) -> tuple[list[pa.Array], Entry]:
        code, since = state["code"], state["since"]
        met, after = [], []
        for now, ok in zip(*[c.to_pylist() for c in columns], strict=True):
            if code < 0 and machine.ready(since, now):
                code = machine.half
            met.append(code)
            if code >= 0:
                code = machine.after(code, ok)
                if code < 0:
                    since = now
            after.append(code)
        met, after = np.array(met), np.array(after)
        named = lambda codes: pa.array(names[codes], pa.string())
        return [named(met), pa.array(met >= 0), named(after)], {"code": code, "since": since}

    def summarize(table: pa.Table) -> Entry:
        times = table.column("_t").to_numpy()
        oks = table.column("_ok").to_pylist()
        side = "right" if rules.late else "left"
        found = np.searchsorted(times, times + rules.timeout, side=side)
        codes = range(machine.codes)
        # exits of every state before row i, from the last row backwards; only the half-open one is kept for all rows
        nxt = [(c, math.nan) for c in codes]
        half = [None] * len(oks)
        for i in range(len(oks) - 1, -1, -1):
            j = int(found[i])
            opened = half[j] if j < len(oks) else (-1, float(times[i]))
            steps = (machine.after(c, oks[i]) for c in codes)
            nxt = [opened if s < 0 else nxt[s] for s in steps]
            half[i] = nxt[machine.half]
        upto, exits = [], []
        for t, exit_state in zip(times.tolist(), half):
            if exits and _same(exits[-1], exit_state):
                upto[-1] = t
            else:
                upto.append(t)
                exits.append(exit_state)
        return {
            "codes": [c for c, _ in nxt], "times": [t for _, t in nxt], "upto": upto,
            "open_codes": [c for c, _ in exits], "open_times": [t for _, t in exits],
        }

    def step(state: Entry, s: Entry) -> Entry:
        code, since = state["code"], state["since"]
        if code >= 0:
            return {"code": s["codes"][code], "since": s["times"][code]}
        at = int(np.searchsorted(s["upto"], since + rules.timeout, side="right" if rules.late else "left"))
        return {"code": s["open_codes"][at], "since": s["open_times"][at]} if at < len(s["upto"]) else state

    def compose(a: Entry, b: Entry) -> Entry:
        led = [step({"code": c, "since": t}, b) for c, t in zip(a["codes"], a["times"], strict=True)]
        # a circuit opened before both: the attempts of the first part that find it half open, then those of the second
        exits = [(u, *step({"code": c, "since": t}, b).values()) for u, c, t in zip(a["upto"], a["open_codes"], a["open_times"], strict=True)]
        exits += [x for x in zip(b["upto"], b["open_codes"], b["open_times"], strict=True) if not exits or x[0] > a["upto"][-1]]
        kept: list[tuple] = []
        for x in exits:
            if kept and _same(kept[-1][1:], x[1:]):
                kept.pop()
            kept.append(x)
        return {"codes": [e["code"] for e in led], "times": [e["since"] for e in led], "upto": [x[0] for x in kept],
                "open_codes": [x[1] for x in kept], "open_times": [x[2] for x in kept]}

    many = lambda name, kind: T.StructField(name, T.ArrayType(kind))
    rows = fold_rows(
        rows, ["_t", "_ok"],
        [T.StructField("state_before", T.StringType()), T.StructField("allowed", T.BooleanType()),
         T.StructField("state_after", T.StringType())],
        scan, {"code": 0, "since": math.nan},
        [many("codes", T.IntegerType()), many("times", T.DoubleType()), many("upto", T.DoubleType()),
         many("open_codes", T.IntegerType()), many("open_times", T.DoubleType())],
        summarize,
        [T.StructField("code", T.IntegerType()), T.StructField("since", T.DoubleType())], step, compose,
    )
    return rows.on(rows.df.drop("_t", "_ok")).result()


def _same(a: tuple[int, float], b: tuple[int, float]) -> bool:
    return a[0] == b[0] and (a[1] == b[1] or (math.isnan(a[1]) and math.isnan(b[1])))


def breaker_stats(states: DataFrame, target: str = "target", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Per target: latest state, attempts, rejected ones, failures, successes and the time of the last failure."""
    ok, allowed = F.coalesce(F.col("ok"), F.lit(False)), F.col("allowed")
    return states.groupBy(target).agg(
        F.max_by("state_after", F.struct(*order)).alias("state"), F.count(F.lit(1)).alias("total_calls"),
        F.count_if(~allowed).alias("rejected"), F.count_if(allowed & ~ok).alias("total_failures"),
        F.count_if(allowed & ok).alias("total_successes"),
        F.max(F.when(allowed & ~ok, F.col(order[0]))).alias("last_failure_time"))


def breaker_health(stats: DataFrame, target: str = "target") -> DataFrame:
    """One row: healthy, number of circuits, number of open ones and their names in order.

    The list has one entry per open circuit, not per attempt.
    """
    is_open = F.col("state") == OPEN
    return stats.agg(
        (F.count_if(is_open) == 0).alias("healthy"), F.count(F.lit(1)).alias("total_circuits"),
        F.count_if(is_open).alias("open_count"),
        F.array_sort(F.collect_list(F.when(is_open, F.col(target)))).alias("open_circuits"))
