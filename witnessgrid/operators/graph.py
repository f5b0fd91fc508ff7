"""Connected components by alternating star contraction, and near-duplicate groups.

The contraction follows the published large-star / small-star scheme: every round is a pair of
partial aggregates and equi-joins, the number of rounds is logarithmic in practice, and each
round is written down so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import ids
from ..session import drop_stash, stash
from . import digests, semantic, skew
from .ordered import totals_within

MAX_ROUNDS = 60


def _with_min(edges: DataFrame, hot_rows: int) -> DataFrame:
    """Edges (u, v) with the smallest neighbour of u; u may have any number of edges."""
    mins = edges.groupBy("analysis_id", "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return skew.lookup(edges, mins, ["analysis_id", "u"], "degree", hot_rows, spread_by=["v"])


def _large_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    both = edges.unionByName(edges.select("analysis_id", F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_min(both, hot_rows)
    return found.filter(F.col("v") > F.col("u")).select(
        "analysis_id", F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame, hot_rows: int) -> DataFrame:
    found = _with_min(edges, hot_rows)
    moved = found.filter(F.col("v") != F.col("m")).select(
        "analysis_id", F.col("v").alias("u"), F.col("m").alias("v"))
    kept = found.select("analysis_id", "u", F.col("m").alias("v"))
    return moved.unionByName(kept).distinct()


def connected_components(edges: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """(analysis_id, node, root) for every node of an edge; root is the smallest node.

    ``edges``: analysis_id, left, right. Raises when the round limit is hit unconverged.
    """
    current = stash(
        edges.filter(F.col("left") != F.col("right")).select(
            "analysis_id", F.greatest("left", "right").alias("u"), F.least("left", "right").alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("analysis_id", "u", "v"))).first()

    seen = mark(current)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        before, current = current, stash(_small_star(_large_star(current, hot_rows), hot_rows))
        drop_stash(before)
        now = mark(current)
        if tuple(now) == tuple(seen):
            break
        seen = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = current.select("analysis_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select("analysis_id", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicate_members(vectors: DataFrame, threshold: float, block_rows: int | None = None) -> DataFrame:
    """(analysis_id, root, ordinal, item_id) of every item that has a near duplicate."""
    components = connected_components(semantic.near_duplicate_edges(vectors, threshold, block_rows))
    named = components.withColumnRenamed("node", "ordinal")
    return named.join(vectors.select("analysis_id", "ordinal", "item_id"), ["analysis_id", "ordinal"])


def near_duplicate_groups(members: DataFrame) -> DataFrame:
    """(analysis_id, root, group_id, n_members): each group's digest id over its members in input order.

    The members stay rows of :func:`near_duplicate_members`; the digest streams over them.
    """
    named = digests.sha256_of(
        members, ["analysis_id", "root"], ["ordinal"], "item_id", prefix=vocab.NEAR_DUPLICATE_TAG + "\0", after="\0")
    sizes = members.groupBy("analysis_id", "root").agg(F.count(F.lit(1)).alias("n_members"))
    return named.join(sizes, ["analysis_id", "root"]).select(
        "analysis_id", "root", ids.near_duplicate_group_name(F.col("sha256")).alias("group_id"), "n_members")


def placed_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Members with their group id and 0-based place in the group."""
    placed = totals_within(members.select("analysis_id", "root", "ordinal", "item_id"), ["analysis_id", "root"], ["ordinal"], {"place": F.lit(1)})
    return placed.join(groups.select("analysis_id", "root", "group_id"), ["analysis_id", "root"])
