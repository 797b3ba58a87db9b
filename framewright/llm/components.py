"""Connected components by joins: every node ends up with the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framewright.session import BROADCAST_ROWS, scratch_table

#: Rounds after which the loop gives up; each at least halves long chains.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component` for all nodes of *edges* (`a`, `b`, long); nodes without an edge don't occur.

    Alternates two steps until only stars are left: every node joins its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Minima are combined before the shuffle, so a node with very many neighbours
    is no hot key, and joins have one row per node on one side, which is broadcast if the count of nodes allows it. The
    minima of a round also tell whether stars are left, so a round has three shuffles then; the driver sees two counts.
    """
    current = scratch_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for _ in range(MOST_ROUNDS):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smaller = F.when(F.col("v") < F.col("u"), F.col("v"))
        nearest = both.groupBy("u").agg(F.min("v").alias("m"), F.min(smaller).alias("low"), F.max(smaller).alias("high"), F.max("v").alias("most"))
        # in a star a node has either larger neighbours or one smaller neighbour
        nearest = scratch_table(nearest.select("u", F.least("u", "m").alias("m"), F.coalesce(
            (F.col("low") < F.col("high")) | (F.col("most") > F.col("u")) & F.col("low").isNotNull(), F.lit(False)).alias("open")), "nearest")
        nodes, still_open = nearest.agg(F.count(F.lit(1)), F.count_if("open")).first()
        if not still_open:
            break
        hinted = F.broadcast if nodes <= BROADCAST_ROWS else (lambda df: df)
        large = scratch_table(both.where("v > u").join(hinted(nearest.select("u", "m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hinted(least), "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = scratch_table(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return nearest.select(F.col("u").alias("node"), F.col("m").alias("component"))
