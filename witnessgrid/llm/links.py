"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stash

# Rows that one task takes where many small stages follow each other.
TASK_ROWS = 100_000


def tasks_for(rows: int) -> int:
    return max(8, -(-rows // TASK_ROWS))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a link (columns a, b); root is the smallest node.

    Alternates large-star and small-star steps until nothing changes: each is a partial aggregate and
    an equi-join, and every round is written down, so a lost executor costs one round. Rounds grow
    with the logarithm of the longest path in practice. The graph shrinks, so the number of tasks of a
    round follows its rows.
    """
    current = stash(links.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            break
        seen, width = now, tasks_for(2 * now[0])
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, width).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().coalesce(width)
        small = _with_least(stash(large), width)
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = stash(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct().coalesce(width))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _with_least(edges: DataFrame, width: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").coalesce(width)
