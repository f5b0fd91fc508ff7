"""Mixing sources to target weights by Pfair scheduling.

Weights are integer shares ``s`` of ``D`` slots. Block j (from 0) of a source is released at slot
``floor(j * D / s)`` and due by ``ceil((j + 1) * D / s)``; each slot goes to the released block
with the earliest deadline. The windows make a source's number of blocks in any first t slots
differ from ``s * t / D`` by less than one. The schedule repeats after D slots, so one period is
worked out on the driver (D is a bounded parameter) and every block of any table finds its slot by
``block div s`` and ``block mod s``: nothing sequential grows with the data.

A block is ``block_rows`` consecutive documents of a source in id order. Sources that end leave
their later slots empty, the others go on in their proportions; no row is dropped or repeated.

Defined cases: null is a source of its own; a source without a share raises; repeated rows stay
rows of their own; ties are settled by the text; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import running_totals

SLOTS = 4096
MAX_SLOTS = 1 << 16


def tempered_shares(counts: dict, exponent: float = 0.5, slots: int = SLOTS) -> dict:
    """Integer shares of ``slots`` in proportion to count ** exponent, at least one each."""
    names = sorted((n for n, c in counts.items() if c > 0), key=lambda n: (n is not None, n))
    if len(names) > slots:
        raise ValueError("more sources than slots")
    power = {n: counts[n] ** exponent for n in names}
    total = sum(power.values()) or 1.0
    free = slots - len(names)
    exact = {n: free * power[n] / total for n in names}
    shares = {n: 1 + int(exact[n]) for n in names}
    left = slots - sum(shares.values())
    for n in sorted(names, key=lambda n: (int(exact[n]) - exact[n], n is not None, n))[:max(0, left)]:
        shares[n] += 1
    return shares


def period(shares: dict) -> list[tuple]:
    """(source, index, slot, release, deadline) of one period of D = sum of shares slots."""
    slots = sum(shares.values())
    if slots > MAX_SLOTS:
        raise ValueError(f"shares add up to more than {MAX_SLOTS}")
    names = sorted(shares, key=lambda n: (n is not None, n))
    waiting = [(0, k, 0) for k in range(len(names)) if shares[names[k]] > 0]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list = []
    found = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            release, k, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * slots // shares[names[k]]), k, block, release))
        deadline, k, block, release = heapq.heappop(ready)
        found.append((names[k], block, slot, release, deadline))
        if block + 1 < shares[names[k]]:
            heapq.heappush(waiting, ((block + 1) * slots // shares[names[k]], k, block + 1))
    return found


def source_counts(docs: DataFrame) -> dict:
    """Rows by source; at most MAX_SLOTS sources are allowed."""
    rows = docs.groupBy("source").count().limit(MAX_SLOTS + 1).collect()
    if len(rows) > MAX_SLOTS:
        raise ValueError(f"more than {MAX_SLOTS} sources")
    return {r["source"]: r["count"] for r in rows}


def interleave(docs: DataFrame, shares: dict | None = None, block_rows: int = 16) -> DataFrame:
    """doc_id, source, text_key, block, slot, release, deadline, position of every row.

    ``position`` numbers the mixed order from 0. Without ``shares`` they are tempered counts.
    """
    spark = docs.sparkSession
    counts = source_counts(docs)
    shares = tempered_shares(counts) if shares is None else shares
    missing = [n for n in counts if shares.get(n, 0) <= 0]
    if missing:
        raise ValueError(f"no share for sources {missing[:5]}")
    shares = {n: s for n, s in shares.items() if n in counts}
    slots = sum(shares.values())
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.xxhash64("text").alias("text_key"))
    placed = running_totals(rows, ["source", "doc_id", "text_key"], {"at": F.lit(1)})
    # Null sorts first; the other names sort by code point in Spark as in Python.
    starts, before = [], 0
    for name in sorted(counts, key=lambda n: (n is not None, n)):
        starts.append((name, before, shares[name]))
        before += counts[name]
    known = spark.createDataFrame(starts, "name string, start bigint, share bigint")
    # Both sides are bounded by MAX_SLOTS rows.
    pattern = spark.createDataFrame(period(shares), "name string, index bigint, first_slot bigint, first_release bigint, first_deadline bigint")
    blocked = placed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn(
        "block", F.floor((F.col("at") - F.col("start")) / block_rows).cast("bigint"))
    rounds = F.floor(F.col("block") / F.col("share")).cast("bigint") * slots
    timed = blocked.withColumn("index", F.pmod("block", "share")).join(
        F.broadcast(pattern.withColumnRenamed("index", "i")), F.col("source").eqNullSafe(F.col("name")) & (F.col("index") == F.col("i")))
    timed = timed.select(
        "doc_id", "source", "text_key", "block", *[(rounds + F.col(f"first_{c}")).alias(c) for c in ("slot", "release", "deadline")])
    return running_totals(timed, ["slot", "doc_id", "text_key"], {"position": F.lit(1)})


def mixed(docs: DataFrame, shares: dict | None = None, block_rows: int = 16) -> DataFrame:
    """The rows of ``docs``, all columns, range-partitioned and sorted in the mixed order; a repeated
    row comes right after the first of its kind."""
    order = interleave(docs, shares, block_rows).groupBy("doc_id", "source", "text_key").agg(F.min("position").alias("_position"))
    order = order.withColumnsRenamed({"doc_id": "_id", "source": "_source", "text_key": "_key"})
    found = docs.join(order, docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & docs["source"].eqNullSafe(F.col("_source"))
                      & (F.xxhash64(docs["text"]) == F.col("_key")))
    return found.repartitionByRange("_position").sortWithinPartitions("_position").select(*[docs[c] for c in docs.columns])
