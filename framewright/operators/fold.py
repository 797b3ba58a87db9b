"""Ordered folds that built-in window functions cannot express, run per key or, for hot keys, per chunk.

The rows of a partition lie in order behind a window or a sort, so a fold walks them batch by batch and keeps its state
from one batch to the next. Only the columns it reads go to Python; the others wait in the JVM for the result. A fold
over a hot key takes three steps: summarize every chunk as a map from the state at its start to the state at its end,
combine those maps as a tree, and walk every chunk from its known start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import broadcast_if_small, join_null_safe, scratch_table
from .ordered import CHUNK, N, Ordered

Entry = dict[str, Any]

#: Summaries that one task combines or walks.
TREE_WIDTH = 1000


def fold_rows(
    rows: Ordered,
    inputs: list[str],
    added: list[T.StructField],
    scan: Callable[[list[pa.Array], Entry], tuple[list[pa.Array], Entry]],
    start: Entry,
    summary: list[T.StructField],
    summarize: Callable[[pa.Table], Entry],
    entry: list[T.StructField],
    step: Callable[[Entry, Entry], Entry],
    compose: Callable[[Entry, Entry], Entry],
    overlap: int = 0,
) -> Ordered:
    """Run an ordered fold and add the columns *added*.

    *scan* gets the columns *inputs* of some consecutive rows and the state before them, and returns the added columns
    and the state behind them. *summarize* sees the inputs of one chunk (and of the first *overlap* rows of the next one)
    and returns the *summary* fields; *step* leads the state before a chunk over its summary, and *compose* makes one
    summary of two neighbouring ones. States before a chunk have the fields *entry*, like *start*.
    """
    if not rows.cut:
        return rows.on(_scanned(rows.df, F.col(N) == 1, inputs, added, scan, start, []))
    key_names = list(rows.part)
    narrow = rows.df.select(*key_names, N, *[c for c in inputs if c != N])
    if overlap:
        narrow = _with_overlap(narrow, rows.chunk_rows, overlap)

    def one_summary(table: pa.Table) -> pa.Table:
        keys = _zone_free(table.slice(0, 1).select(key_names))
        values = summarize(table.sort_by(N))
        for field in summary:
            keys = keys.append_column(field.name, pa.array([values[field.name]], _arrow(field)))
        return keys

    key_fields = [rows.df.schema[k] for k in key_names]
    summaries = narrow.groupBy(*key_names).applyInArrow(one_summary, T.StructType([*key_fields, *summary]))
    entries = entry_states(summaries, rows.keys, start, summary, entry, step, compose)
    names = [f.name for f in entry]
    joined = join_null_safe(rows.df, broadcast_if_small(entries), key_names, "left")
    laid = joined.repartition(*key_names).sortWithinPartitions(*key_names, N)
    return rows.on(_scanned(laid, rows.position() == 1, inputs, added, scan, start, names).drop(*names))


def _scanned(
    df: DataFrame, first: Column, inputs: list[str], added: list[T.StructField],
    scan: Callable[[list[pa.Array], Entry], tuple[list[pa.Array], Entry]], start: Entry, entry: list[str],
) -> DataFrame:
    """Walk rows that lie in order; *first* marks those at which a new walk begins, from the columns *entry* or *start*."""
    fields = [pa.field(f.name, _arrow(f)) for f in added]

    def walk(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        state, before = dict(start), 0
        for begin, number, *columns in batches:
            begins, numbers = begin.to_numpy(zero_copy_only=False), number.to_numpy()
            if not len(numbers):
                yield pa.StructArray.from_arrays([pa.array([], f.type) for f in fields], fields=fields)
                continue
            if (np.diff(numbers, prepend=before)[~begins] != 1).any():
                raise RuntimeError("rows of a key are not in order")
            before = numbers[-1]
            edges = np.flatnonzero(begins)
            parts = []
            for a, b in zip([*([0] if not begins[0] else []), *edges], [*edges[0 if not begins[0] else 1:], len(numbers)], strict=True):
                if begins[a]:
                    state = {name: c[a].as_py() for name, c in zip(entry, columns[len(inputs):], strict=True)} if entry else dict(start)
                out, state = scan([c.slice(a, b - a) for c in columns[:len(inputs)]], state)
                parts.append(out)
            yield pa.StructArray.from_arrays(
                [pa.concat_arrays([p[k].cast(f.type) for p in parts]) for k, f in enumerate(fields)], fields=fields)

    # rows must neither be filtered nor reordered before they are walked
    walked = F.arrow_udf(walk, T.StructType(added)).asNondeterministic()
    out = df.withColumn("_out", walked(first, F.col(N), *[F.col(c) for c in [*inputs, *entry]]))
    return out.withColumns({f.name: F.col(f"_out.{f.name}") for f in added}).drop("_out")


def entry_states(
    summaries: DataFrame, keys: list[str], start: Entry, summary: list[T.StructField], entry: list[T.StructField],
    step: Callable[[Entry, Entry], Entry], compose: Callable[[Entry, Entry], Entry], width: int = TREE_WIDTH,
) -> DataFrame:
    """The state before every chunk, from one summary per chunk; chunks of a key count from 0.

    Up to *width* neighbouring summaries are composed into one, these again, until a key has no more than *width*; then
    the states are led down again, level by level. No task sees more than *width* summaries.
    """
    names, group = [f.name for f in summary], "_group"
    key_fields = [summaries.schema[k] for k in keys]

    def told(table: pa.Table, columns: list[str], values: list[Entry], fields: list[T.StructField]) -> pa.Table:
        result = _zone_free(table.select(columns))
        for field in fields:
            result = result.append_column(field.name, pa.array([v[field.name] for v in values], _arrow(field)))
        return result

    def composed(table: pa.Table) -> pa.Table:
        whole, *rest = table.sort_by(CHUNK).select(names).to_pylist()
        for s in rest:
            whole = compose(whole, s)
        one = table.slice(0, 1)
        return told(one.drop_columns([CHUNK]).rename_columns([CHUNK if c == group else c for c in one.column_names if c != CHUNK]),
                    [*keys, CHUNK], [whole], summary)

    def led(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        given = [f"_in_{f.name}" for f in entry]
        first = table.slice(0, 1).to_pylist()[0]
        state = {f.name: first[g] for f, g in zip(entry, given, strict=True)} if given[0] in first else dict(start)
        states = []
        for s in table.select(names).to_pylist():
            states.append(state)
            state = step(state, s)
        return told(table, [*keys, CHUNK], states, entry)

    chunk_field = T.StructField(CHUNK, T.LongType())
    summary_type, entry_type = T.StructType([*key_fields, chunk_field, *summary]), T.StructType([*key_fields, chunk_field, *entry])
    current = scratch_table(summaries.withColumn(CHUNK, F.col(CHUNK).cast("long")), "chunk-maps")
    last = current.agg(F.max(CHUNK)).first()[0] or 0
    levels = []
    while last >= width:
        levels.append(current.withColumn(group, F.expr(f"{CHUNK} div {width}")))
        current = scratch_table(levels[-1].groupBy(*keys, group).applyInArrow(composed, summary_type), "chunk-maps")
        last //= width
    states = current.groupBy(*keys).applyInArrow(led, entry_type)
    for level in reversed(levels):
        above = states.withColumnsRenamed({CHUNK: group, **{f.name: f"_in_{f.name}" for f in entry}})
        states = join_null_safe(level, above, [*keys, group]).groupBy(*keys, group).applyInArrow(led, entry_type)
    return scratch_table(states, "chunk-states")


def _zone_free(table: pa.Table) -> pa.Table:
    """Instants come with the zone of the session but must be returned as UTC; the values stay the same."""
    for i, field in enumerate(table.schema):
        if pa.types.is_timestamp(field.type) and field.type.tz not in (None, "UTC"):
            table = table.set_column(i, field.name, table.column(i).cast(pa.timestamp("us", "UTC")))
    return table


def _with_overlap(df: DataFrame, chunk_rows: int, overlap: int) -> DataFrame:
    head = ((F.col(N) - 1) % chunk_rows < overlap) & (F.col(CHUNK) > 0)
    chunks = F.when(head, F.array(F.col(CHUNK), F.col(CHUNK) - 1)).otherwise(F.array(F.col(CHUNK)))
    return df.withColumn(CHUNK, F.explode(chunks))


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def fold_automaton(
    rows: Ordered, symbol: str, table: dict[int, list[int]], start: int, after: str, before: str
) -> Ordered:
    """Run a finite automaton over *symbol*: add the state *after* and *before* each row.

    *table* maps a state to its successor for every symbol.
    """
    states = sorted(table)
    step = {s: list(map(int, row)) for s, row in table.items()}

    def scan(columns: list[pa.Array], entry: Entry) -> tuple[list[pa.Array], Entry]:
        symbols = columns[0].to_pylist()
        seen = np.empty(len(symbols) + 1, dtype=np.int32)
        seen[0] = state = entry["state"]
        for i, s in enumerate(symbols):
            state = step[state][s]
            seen[i + 1] = state
        return [pa.array(seen[1:]), pa.array(seen[:-1])], {"state": int(state)}

    def summarize(t: pa.Table) -> Entry:
        now = {s: s for s in states}
        for s in t.column(symbol).to_pylist():
            now = {origin: step[state][s] for origin, state in now.items()}
        return {"exits": [now[s] for s in states]}

    return fold_rows(
        rows, [symbol],
        [T.StructField(after, T.IntegerType()), T.StructField(before, T.IntegerType())],
        scan, {"state": start},
        [T.StructField("exits", T.ArrayType(T.IntegerType()))], summarize,
        [T.StructField("state", T.IntegerType())],
        lambda state, s: {"state": s["exits"][states.index(state["state"])]},
        lambda a, b: {"exits": [b["exits"][states.index(x)] for x in a["exits"]]},
    )
