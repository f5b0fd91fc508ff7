"""Minimax contiguous sharding.

Groups of equal texts are atomic and keep the order of their smallest id. The smallest shard
capacity that fits the groups, cut contiguously, into the wanted number of shards is found by
binary search; each probe checks a capacity greedily. The greedy check needs one question only,
"the last group end at or below x", and it is answered from a summary of at most ``bins`` rows:
runs of consecutive group ends with their first and last end. Where a probe falls inside a run
the answer is known only as a range; runs that matter are then split again by one aggregation.
So the driver never holds more than ``bins`` rows, whatever the number of groups.

Defined cases: a null text has no bytes and forms a group of its own, apart from the empty
text; repeated rows of one id stay separate rows of one group; an empty table gives no rows;
one group larger than all others together fills its shard alone; with fewer groups than shards
the last shards stay empty. Further columns of the input are ignored.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import running_totals
from ..session import stash

BINS = 8192


def text_size(text) -> F.Column:
    """UTF-8 bytes plus one; a null text has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def text_key(text) -> F.Column:
    """Digest that equal texts share; a null text has its own."""
    return F.when(text.isNull(), F.lit(b"")).otherwise(F.unhex(F.sha2(text.cast("binary"), 256)))


class _Ends:
    """Sorted runs of group ends; between the first and last end of a run others may lie."""

    def __init__(self, runs: list[tuple[int, int, int]]):
        self.runs = sorted(runs)
        self.firsts = [r[0] for r in self.runs]

    def at_most(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end <= x (0 if there is none)."""
        i = bisect.bisect_right(self.firsts, x) - 1
        if i < 0:
            return 0, 0
        first, last, count = self.runs[i]
        if x >= last:
            return last, last
        return (first, first) if count <= 2 else (first, x)


def _greedy(ends: _Ends, capacity: int, shards: int) -> list[tuple[int, int]]:
    """Bounds of each shard's end when every shard takes as much as fits."""
    low = high = 0
    cuts = []
    for _ in range(shards):
        low, high = ends.at_most(low + capacity)[0], ends.at_most(high + capacity)[1]
        cuts.append((low, high))
    return cuts


def _smallest(low: int, high: int, fits) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def minimax_cuts(ends: DataFrame, shards: int, bins: int = BINS) -> tuple[int, list[int]]:
    """Smallest capacity and the greedy shard ends for group ends ``ends`` (columns end, size)."""
    total, largest = ends.agg(F.max("end"), F.max("size")).first()
    if total is None:
        return 0, [0] * shards
    windows = [(0, total)]
    runs: list[tuple[int, int, int]] = []
    while True:
        # Split each window into equal bins of positions and summarise the ends in each.
        each = max(2, bins // len(windows))
        bin_of = F.lit(None).cast("bigint")
        for k, (start, stop) in enumerate(windows):
            width = max(1, -(-(stop - start) // each))
            inside = (F.col("end") > start) & (F.col("end") <= stop)
            bin_of = F.when(inside, F.floor((F.col("end") - start - 1) / F.lit(width)) + k * (each + 1)).otherwise(bin_of)
        found = ends.select("end", bin_of.cast("bigint").alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(
            F.min("end").alias("first"), F.max("end").alias("last"), F.count(F.lit(1)).alias("n"))
        new = [(r["first"], r["last"], r["n"]) for r in found.select("first", "last", "n").collect()]
        kept = [r for r in runs if not any(a < r[0] and r[1] <= b for a, b in windows)]
        known = _Ends(kept + new)
        lowest = max(largest, -(-total // shards))
        sure = _smallest(lowest, total, lambda c: _greedy(known, c, shards)[-1][0] >= total)
        hoped = _smallest(lowest, sure, lambda c: _greedy(known, c, shards)[-1][1] >= total)
        cuts = _greedy(known, sure, shards)
        if hoped == sure and all(a == b for a, b in cuts):
            return sure, [a for a, _ in cuts]
        # Runs that a capacity between the two could cut into must be known better.
        first_cuts, last_cuts = _greedy(known, hoped, shards), _greedy(known, sure, shards)
        unclear = [r for r in known.runs if r[2] > 2 and any(
            lo[0] <= r[1] and hi[1] >= r[0] for lo, hi in zip(first_cuts, last_cuts))]
        windows = []
        for first, last, _ in unclear:
            if windows and first - 1 <= windows[-1][1]:
                windows[-1] = (windows[-1][0], last)
            else:
                windows.append((first - 1, last))
        windows = _merge(windows, shards * 4)
        runs = known.runs


def _merge(windows: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Joins the nearest neighbours until at most ``most`` windows are left."""
    while len(windows) > most:
        gaps = [b[0] - a[1] for a, b in zip(windows, windows[1:])]
        i = gaps.index(min(gaps))
        windows[i:i + 2] = [(windows[i][0], windows[i + 1][1])]
    return windows


def assign_shards(docs: DataFrame, shards: int = 8, bins: int = BINS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group_first for every row of ``docs``.

    Copies of a text share their shard; slots run from 0 in each shard in the order of doc_id.
    """
    rows = docs.select(
        F.col("doc_id"), text_size(F.col("text")).alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"),
        text_key(F.col("text")).alias("key"))
    rows = stash(rows)
    groups = rows.groupBy("key").agg(
        F.min("doc_id").alias("group_first"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    placed = stash(running_totals(
        groups, ["group_first", "key"], {"before": F.col("size")}
    ).withColumn("end", F.col("before") + F.col("size")))
    _, cuts = minimax_cuts(placed.select("end", "size"), shards, bins)
    shard = sum((F.when(F.col("before") >= cut, 1).otherwise(0) for cut in cuts[:-1]), F.lit(0))
    named = placed.select("key", "group_first", F.least(shard, F.lit(shards - 1)).cast("int").alias("shard"))
    # Rows of a much copied text are split over tasks by the adaptive skew join.
    joined = rows.join(named, "key").drop("key")
    # Ids can repeat, so the remaining columns break ties.
    positions = running_totals(joined, ["shard", "doc_id", "text_crc32", "size", "group_first"], {"at": F.lit(1)})
    counted = joined.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
    starts = {r["shard"]: r["rows"] for r in counted.collect()}
    start = F.lit(0).cast("bigint")
    for s in range(1, shards):
        start = F.when(F.col("shard") == s, F.lit(sum(starts.get(t, 0) for t in range(s)))).otherwise(start)
    return positions.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - start).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_first")
