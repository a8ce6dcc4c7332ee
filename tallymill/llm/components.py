"""Connected components of a graph given as an edge table, by repeated random contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges` (u, v); nodes have one label exactly if a path joins them.

    A round sends each node to the neighbour (or itself) that a hash of node and round ranks least and
    moves the edges along; so the edges that are left shrink by a constant factor in expectation,
    whatever the shape, and long chains take O(log n) rounds. A star is only ever aggregated (min), never
    collected. The rounds' node tables, each smaller than the one before, are folded from the last to the
    first. Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    left = materialize(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        n = len(rounds)
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("id"))
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        to = both.groupBy("u").agg(F.min(rank("v")).alias("other")).select("u", F.least(rank("u"), F.col("other"))["id"].alias("to"))
        rounds.append(to := materialize(to))
        moved = left.join(to.select("u", F.col("to").alias("a")), "u").join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        left = materialize(moved.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("u").alias("label")).where(F.lit(False))

    label = rounds.pop()
    for step in reversed(rounds):
        further = label.select(F.col("u").alias("to"), F.col("to").alias("end"))
        label = materialize(step.join(further, "to", "left").select("u", F.coalesce("end", "to").alias("to")))
    return label.select(F.col("u").alias("node"), F.col("to").alias("label"))
