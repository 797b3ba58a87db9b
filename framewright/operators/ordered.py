"""Ordered scans per key that stay bounded when one key holds most of the rows.

``order_rows`` numbers the rows of each key. When every key is small, that is one window per key. When some key is
larger than ``chunk_rows``, the rows are range-partitioned on (key, order) instead, so that a hot key spreads over many
tasks; they are written once to the scratch folder, numbered by partition offsets and cut into chunks of at most
``chunk_rows`` rows. A scan then runs inside (key, chunk), and ``carry`` brings the state at the start of each chunk,
worked out on a summary with one row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import BROADCAST_ROWS, join_null_safe, scratch_table

CHUNK_ROWS = 1_000_000
N = "_n"
CHUNK = "_chunk"
START = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class GroupSizes:
    groups: int
    rows: int
    largest: int


def group_sizes(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Number of keys, rows and rows of the largest key: one aggregation over the key columns, combined map-side."""
    if not keys:
        rows = df.count()
        return GroupSizes(1, rows, rows)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    row = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    return GroupSizes(*row)


@dataclass(frozen=True)
class Ordered:
    """Rows with their 1-based position ``_n`` per key and, when cut, their ``_chunk``."""

    df: DataFrame
    keys: list[str]
    chunk_rows: int
    cut: bool
    #: The chunks are counted and few enough that one row for each may be broadcast.
    few: bool = False

    @property
    def part(self) -> list[str]:
        return [*self.keys, CHUNK] if self.cut else list(self.keys)

    def window(self, *extra: str) -> WindowSpec:
        """Rows of one chunk in order, from its start to the current row."""
        return Window.partitionBy(*self.part, *extra).orderBy(N).rowsBetween(Window.unboundedPreceding, 0)

    def before(self) -> WindowSpec:
        """Rows of one chunk before the current row."""
        return Window.partitionBy(*self.part).orderBy(N).rowsBetween(*START)

    def position(self) -> Column:
        """1-based position inside the chunk."""
        return (F.col(N) - 1) % self.chunk_rows + 1 if self.cut else F.col(N)

    def on(self, df: DataFrame) -> "Ordered":
        return Ordered(df, self.keys, self.chunk_rows, self.cut, self.few)

    def add(self, **columns: Column) -> "Ordered":
        return self.on(self.df.withColumns(columns))

    def together(self) -> "Ordered":
        """The rows of each chunk in one task; windows inside a chunk, over parts of it too, then need no other shuffle."""
        return self.on(self.df.repartition(*self.part)) if self.cut else self

    def carry(
        self,
        summary: dict[str, Column],
        entry: Callable[[DataFrame, WindowSpec, WindowSpec], DataFrame],
        initial: dict[str, Column],
    ) -> "Ordered":
        """Add the state at the start of each chunk as the columns named in *initial*.

        *summary* aggregates one chunk. *entry* gets the summary (one row per chunk), a window over the earlier chunks
        of the key and one that includes the current chunk, and adds the entry columns. Missing state becomes *initial*.
        """
        if not self.cut:
            return self.add(**initial)
        totals = self.df.groupBy(*self.part).agg(*[c.alias(name) for name, c in summary.items()])
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        states = entry(totals, chunks.rowsBetween(*START), chunks.rowsBetween(Window.unboundedPreceding, 0))
        states = states.select(*self.part, *[F.col(name) for name in initial])
        # the rows stay where they are
        states = F.broadcast(states) if self.few else states
        joined = join_null_safe(self.df, states, self.part, "left")
        return self.on(joined.withColumns({name: F.coalesce(F.col(name), c) for name, c in initial.items()}))

    def result(self) -> DataFrame:
        return self.df.drop(N, CHUNK)


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    *,
    chunk_rows: int = CHUNK_ROWS,
    strategy: str = "auto",
) -> Ordered:
    """Number the rows of each key by *order*, which must be unique inside a key.

    strategy: ``window`` (one task per key), ``chunked`` (any key size) or ``auto``, which measures the largest key.
    """
    if strategy not in ("auto", "window", "chunked"):
        raise ValueError(f"unknown strategy {strategy!r}")
    keys = list(keys)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    if strategy != "window":
        sizes = group_sizes(df, keys)
        if strategy == "auto":
            strategy = "window" if sizes.largest <= chunk_rows else "chunked"
    if strategy == "window":
        numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*columns)).cast("long")
        return Ordered(df.withColumn(N, numbered), keys, chunk_rows, False)

    spark = df.sparkSession
    parts = max(1, math.ceil(sizes.rows / chunk_rows))
    laid = (
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *columns)
        .sortWithinPartitions(*[F.col(k) for k in keys], *columns)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid = scratch_table(laid, "ordered").withColumn("_run", F.shiftright("_at", 33))
    runs = laid.groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_run").rowsBetween(*START)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1
    offsets = runs.select(*keys, "_run", shift.alias("_shift"))
    few = sizes.groups + parts <= BROADCAST_ROWS
    if few:
        offsets = F.broadcast(offsets)
    numbered = (
        join_null_safe(laid, offsets, [*keys, "_run"])
        .withColumn(N, F.col("_at") + F.col("_shift"))
        .withColumn(CHUNK, F.expr(f"({N} - 1) div {chunk_rows}"))
        .drop("_at", "_run", "_shift")
    )
    return Ordered(numbered, keys, chunk_rows, True, few)


def running_sums(rows: Ordered, **columns: str | Column) -> Ordered:
    """Add inclusive running sums, one per keyword."""
    values = {name: F.col(c) if isinstance(c, str) else c for name, c in columns.items()}
    if not rows.cut:
        return rows.add(**{name: F.sum(c).over(rows.window()) for name, c in values.items()})
    carried = rows.carry(
        {name: F.sum(c) for name, c in values.items()},
        lambda s, before, upto: s.withColumns({f"_in_{name}": F.sum(name).over(before) for name in values}),
        {f"_in_{name}": F.lit(0) for name in values},
    )
    out = carried.add(**{name: F.sum(c).over(rows.window()) + F.col(f"_in_{name}") for name, c in values.items()})
    return out.on(out.df.drop(*[f"_in_{name}" for name in values]))


def latest(rows: Ordered, **columns: Column) -> Ordered:
    """Add, per keyword, the last non-null value up to and including the current row."""
    if not rows.cut:
        return rows.add(**{name: F.last(c, ignorenulls=True).over(rows.window()) for name, c in columns.items()})
    carried = rows.carry(
        {f"_t_{name}": F.max_by(c, F.when(c.isNotNull(), F.col(N))) for name, c in columns.items()},
        lambda s, before, upto: s.withColumns(
            {f"_in_{name}": F.last(f"_t_{name}", ignorenulls=True).over(before) for name in columns}),
        {f"_in_{name}": F.lit(None) for name in columns},
    )
    out = carried.add(**{
        name: F.coalesce(F.last(c, ignorenulls=True).over(rows.window()), F.col(f"_in_{name}"))
        for name, c in columns.items()})
    return out.on(out.df.drop(*[f"_in_{name}" for name in columns]))


def previous(rows: Ordered, **columns: Column) -> Ordered:
    """Add, per keyword, the value on the row before, null on the first row of a key."""
    if not rows.cut:
        lags = {name: F.lag(c).over(Window.partitionBy(*rows.part).orderBy(N)) for name, c in columns.items()}
        return rows.add(**lags)
    carried = rows.carry(
        {f"_t_{name}": F.max_by(F.struct(c.alias("v")), N) for name, c in columns.items()},
        lambda s, before, upto: s.withColumns(
            {f"_in_{name}": F.last(f"_t_{name}").over(before) for name in columns}),
        {f"_in_{name}": F.lit(None) for name in columns},
    )
    lag = Window.partitionBy(*rows.part).orderBy(N)
    out = carried.add(**{
        name: F.when(rows.position() == 1, F.col(f"_in_{name}.v")).otherwise(F.lag(c).over(lag))
        for name, c in columns.items()})
    return out.on(out.df.drop(*[f"_in_{name}" for name in columns]))
