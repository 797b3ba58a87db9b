"""Mixing sources to target weights by Poisson replication.

Every document is repeated as often as a Poisson distribution says, inverted at a number drawn from a hash of seed and
identifier; its mean is the repetition rate that brings the source to its target share. The copies are shuffled
globally by another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Steps of a uniform number; 13 hexadecimal digits fit into a double exactly.
_STEPS = 16.0 ** 13

#: Largest mean that one table inverts, and copies that are listed at once.
MOST_RATE, BLOCK = 50.0, 10_000


def _hash_hex(*parts: Column | str) -> Column:
    texts = [F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.encode(F.concat_ws(":", *texts), "UTF-8"))


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the hash of seed and parts."""
    return (F.conv(F.substring(_hash_hex(seed, *parts), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(_STEPS)


def poisson_steps(rate: float) -> list[float]:
    """Cumulative probabilities of 0, 1, 2, ... copies, as far as they differ from 1 in a double."""
    most = math.ceil(rate + 12 * math.sqrt(rate) + 40)
    sums, total = [], 0.0
    for k in range(most + 1):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        sums.append(min(total, 1.0))
    return sums


def rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float = 1.0, source_col: str = "source") -> dict[str | None, float]:
    """Mean repetitions per document of every named source, and at None of all other sources taken together.

    Weights are relative and at least 0. Shares of sources without documents are spread over the rest in proportion.
    *epochs* is the number of copies in all per document of the input. The driver sees one count per named source,
    whatever the number of sources in the data.
    """
    if min([*weights.values(), other]) < 0:
        raise ValueError("weights can't be negative")
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")
    counts = {r[0]: r[1] for r in docs.groupBy(named.alias("s")).agg(F.count(F.lit(1))).collect()}
    targets = {s: w for s, w in {**weights, None: other}.items() if counts.get(s)}
    shares, rows = sum(targets.values()), sum(counts.values())
    return {s: epochs * rows * w / shares / counts[s] if shares else 0.0 for s, w in targets.items()}


def mix(docs: DataFrame, weights: dict[str, float], other: float, epochs: float = 1.0, seed: str = "mix",
        id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All input columns and `copy` (0, 1, ...) in a global random order that seed and identifiers fix.

    Documents whose draw is 0 are absent, as replication to a lower share demands. Sources outside *weights*, null ones
    among them, share the weight *other*. Rows that repeat an identifier are drawn alike; a null identifier counts as
    an empty text. An input column named `copy` is replaced. Texts play no part, whether null, empty or long.

    The distribution tables go into the plan, one per named source and of bounded size: a mean above MOST_RATE is the sum of
    equal smaller ones, drawn one by one from hashes of seed, identifier and number. Copies come in blocks, so a
    document with very many of them is no long list. Documents cross the network once, for the order.
    """
    means = rates(docs, weights, other, epochs, source_col)
    # names that the input doesn't have
    draw, times, start = (_free(c, docs.columns) for c in ("_draw", "_times", "_start"))
    u = F.col(draw)

    def drawn(source: str | None) -> Column:
        mean = means.get(source, 0.0)
        parts = max(1, math.ceil(mean / MOST_RATE))
        steps = F.expr(f"array({', '.join(f'{p!r}D' for p in poisson_steps(mean / parts))})")
        below = lambda x: F.size(F.filter(steps, lambda p: p < x)).cast("long")
        if parts == 1:
            return below(u)
        draws = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: uniform(seed, F.col(id_col), k))
        return F.aggregate(draws, F.lit(0).cast("long"), lambda total, x: total + below(x))

    named = F.lit(None).cast("long")
    for source in weights:
        named = F.when(F.col(source_col) == source, drawn(source)).otherwise(named)
    counted = docs.drop("copy").withColumn(draw, uniform(seed, F.col(id_col))).withColumn(times, F.coalesce(named, drawn(None)))
    blocks = counted.where(F.col(times) > 0).withColumn(start, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(BLOCK).cast("long"))))
    last = F.least(F.col(times), F.col(start) + BLOCK) - 1
    copies = blocks.withColumn("copy", F.explode(F.sequence(F.col(start), last).cast("array<int>"))).drop(draw, times, start)
    return copies.orderBy(_hash_hex(seed + ":order", F.col(id_col), F.col("copy")), id_col, "copy")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name
