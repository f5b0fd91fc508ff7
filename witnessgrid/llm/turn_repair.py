"""The cheapest repair of each conversation's turns, by bidirectional Dijkstra over the edit lattice.

A lattice node is (rows consumed, state of the role grammar ``(s?(ua)+)?``). Keep and Rerole consume
a row and emit its role, Delete consumes it, Insert emits an empty turn. The search runs from both
ends: forward labels hold the cost and least audit up to a node, reverse labels those from it to the
end. Both heaps go on while a path as cheap as the best one known is possible, so all crossings of
equal cost are finished; then the least concatenation over all crossings is the audit. That is
exact: of two different audits of equal cost to one node neither is a prefix of the other, as the
longer one would hold Inserts more.

* Rows get their place by range partitioning and offsets, so no conversation is gathered to be
  sorted. The search sees two letters a row, in blocks of ``BLOCK`` rows. A conversation of one
  block is solved at once; a longer one is solved in each block between all pairs of states, and a
  stream over its blocks, in order, joins them (four labels are held, each a chain of block audits).
* The repaired texts are hashed in a stream of rows sorted by (conversation, place), in constant
  memory. SHA-256 of one conversation is sequential by its nature.

Defined cases: null role and text read as one space, null ids are one conversation, null turns come
first, equal turns are ordered by role, text; a conversation without rows has zeros, an empty audit
and the hash of the empty string; a role other than system, user, assistant must be replaced
or deleted, and one counts by its first letter. Columns other than conv_id, turn, role, text are
ignored. Repeats are found by 128 bits of hash of role and text.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.ordered import running_totals
from ..session import stash

BLOCK = 1024
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
START, SYSTEM, USER, DONE = range(4)  # states: nothing yet, s, ...u, ...a
ENDS = (START, DONE)
_SPACES = " \t\n\v\f\r"
# State after emitting a role, where the grammar has it.
_NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, DONE: USER}, "a": {USER: DONE}, "x": {}}
# What an edit that chooses the role emits in each state: user or assistant, whichever the grammar has.
_FREE = {START: USER, SYSTEM: USER, USER: DONE, DONE: USER}
_LEGAL = {"su", "ua", "au"}


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after a fixed damage: each of five faults hits one of twenty turns, by crc32 of ``conv_id:turn``."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    return rows.filter("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.expr("array_repeat(0, IF(fault = 3, 2, 1))")).alias("copy")).drop("copy")


def steps(codes: str, at: int, state: int):
    """(rows consumed, state, cost, initial) of the edits at a node; ``codes`` has role and fault of each row."""
    yield at, _FREE[state], INSERT, "I"
    if 2 * at < len(codes):
        role, fault = codes[2 * at], codes[2 * at + 1]
        yield at + 1, state, DELETE, "D"
        if fault not in "bd":
            extra = CUT if fault == "t" else 0
            yield at + 1, _FREE[state], REROLE + extra, "R"
            if state in _NEXT[role]:
                yield at + 1, _NEXT[role][state], extra, "K"


def steps_back(codes: str, at: int, state: int):
    """The edits that lead to a node: (rows consumed before, state before, cost, initial)."""
    for before in (s for s, to in _FREE.items() if to == state):
        yield at, before, INSERT, "I"
    if at:
        role, fault = codes[2 * at - 2], codes[2 * at - 1]
        yield at - 1, state, DELETE, "D"
        if fault not in "bd":
            extra = CUT if fault == "t" else 0
            for before in (s for s, to in _FREE.items() if to == state):
                yield at - 1, before, REROLE + extra, "R"
            for before in (s for s, to in _NEXT[role].items() if to == state):
                yield at - 1, before, extra, "K"


def cheapest(codes: str, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, least audit) from ``start`` before the first row to one of ``goals`` after the last."""
    rows = len(codes) // 2
    # Labels by node: cost and audit. Free edits only move on by a row, so of equal costs the
    # node next to the side's own end goes first and a settled label is final.
    labels = ({(0, start): (0, "")}, {(rows, g): (0, "") for g in goals})
    heaps = ([(0, 0, start)], [(0, 0, g) for g in goals])
    settled: tuple[set, set] = (set(), set())
    best = None
    while True:
        for heap, done, side in zip(heaps, settled, (0, 1)):
            while heap and (rows - heap[0][1] if side else heap[0][1], heap[0][2]) in done:
                heappop(heap)
        # Both ends are settled first, so that a cheapest path always crosses between settled nodes.
        if len(settled[1]) < len(goals):
            side = 1
        elif not settled[0]:
            side = 0
        elif not heaps[0] or not heaps[1] or best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        else:
            side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, place, state = heappop(heaps[side])
        node = (rows - place if side else place, state)
        settled[side].add(node)
        audit = labels[side][node][1]
        for at, to, price, initial in (steps_back if side else steps)(codes, *node):
            other = (at, to)
            if other not in settled[side]:
                label = (cost + price, initial + audit if side else audit + initial)
                if other not in labels[side] or label < labels[side][other]:
                    if other not in labels[side] or label[0] < labels[side][other][0]:
                        heappush(heaps[side], (label[0], rows - at if side else at, to))
                    labels[side][other] = label
        if node in labels[1 - side]:
            total = cost + labels[1 - side][node][0]
            best = total if best is None else min(best, total)
    if best is None:
        return None
    # Every cheapest path has a node settled by both sides, or an edit from one side's nodes to the other's.
    forward, back = labels
    found = []
    for node in settled[0]:
        cost, audit = forward[node]
        if node in settled[1] and cost + back[node][0] == best:
            found.append(audit + back[node][1])
        for at, to, price, initial in steps(codes, *node):
            if (at, to) in settled[1] and cost + price + back[at, to][0] == best:
                found.append(audit + initial + back[at, to][1])
    return best, min(found)


def _counts(codes: str) -> list[int]:
    roles, faults = codes[::2], codes[1::2]
    return [faults.count("b"), faults.count("d"), faults.count("t"), sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:]))]


def coded(turns: DataFrame) -> DataFrame:
    """The turns with ``place`` (from 0 in each conversation) and ``code`` (role and fault)."""
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    placed = stash(running_totals(rows, ["conv_id", "turn", "role", "text"], {"at": F.lit(1)}).withColumns(
        {"h": F.xxhash64("role", "text"), "g": F.xxhash64("text", F.lit(1), "role")}))
    firsts = placed.groupBy("conv_id", "h", "g").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    begins = placed.groupBy("conv_id").agg(F.min("at").alias("begin"))
    bare = F.expr(f"trim(TRAILING '{_SPACES}' FROM text)")
    initial = F.substring("role", 1, 1)
    code = F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
        F.when(bare == "", "b").when(F.col("new").isNull(), "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("k"))
    found = placed.drop("h", "g").join(firsts, "at", "left").withColumn("code", code)
    begins = begins.withColumnRenamed("conv_id", "_conv")
    return found.join(begins, found["conv_id"].eqNullSafe(F.col("_conv"))).select(
        "conv_id", "turn", "role", "text", "code", (F.col("at") - F.col("begin")).alias("place"))


def solved_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Each block of each conversation: counts of faults, first and last role, cheapest audits between states."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    block = F.expr(f"place div {block_rows}")
    sizes = rows.groupBy("conv_id").agg((F.max(block) + 1).alias("blocks")).withColumnRenamed("conv_id", "_conv")
    grouped = rows.groupBy("conv_id", block.alias("block")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "code"))), lambda r: r["code"]), "").alias("codes"))
    grouped = grouped.join(sizes, grouped["conv_id"].eqNullSafe(F.col("_conv"))).select("conv_id", "block", "blocks", "codes")

    def solve(batches):
        for batch in batches:
            out = []
            for blocks, codes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ways = [cheapest(codes, START, ENDS)] if blocks == 1 else [
                    cheapest(codes, a, (b,)) for a in range(4) for b in range(4)]
                out.append((*_counts(codes), codes[0] + codes[-2], [w and w[0] for w in ways], [w and w[1] for w in ways]))
            columns = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([
                *[batch.column(i) for i in range(3)], *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()),
                pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.list_(pa.string()))],
                names=["conv_id", "block", "blocks", "blank", "duplicate", "truncated", "illegal", "rim", "costs", "audits"])
    return grouped.mapInArrow(
        solve, f"conv_id {kind}, block bigint, blocks bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
               "rim string, costs array<bigint>, audits array<string>")


class _Chain:
    """An audit in pieces, one a block, sharing what came before."""

    def __init__(self, before, piece: str):
        self.before, self.piece = before, piece

    def since(self, other) -> tuple[str, str]:
        """What this and ``other`` (as many blocks) hold after their last common chain."""
        mine, theirs, a, b = [], [], self, other
        while a is not b:
            mine.append(a.piece)
            theirs.append(b.piece)
            a, b = a.before, b.before
        return "".join(reversed(mine)), "".join(reversed(theirs))

    def pieces(self) -> list[str]:
        out, at = [], self
        while at is not None:
            out.append(at.piece)
            at = at.before
        return out[::-1]


def joined_blocks(blocks: DataFrame, block_rows: int) -> DataFrame:
    """Per conversation the sums, cost and audit (place null), and per block its audit piece at its first place."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "place", "piece", "odd", "blank", "duplicate", "truncated", "illegal", "cost"]

    def stream(batches):
        now = None
        for batch in batches:
            out = []
            for conv, block, total, *counts, rim, costs, audits in zip(*[c.to_pylist() for c in batch.columns]):
                if block == 0:
                    sums, last, ways = [0] * 4, "", {START: (0, None)}
                sums = [a + b for a, b in zip(sums, counts)]
                sums[3] += bool(last) and last + rim[0] not in _LEGAL
                last = rim[1]
                if total == 1:
                    now = (costs[0], _Chain(None, audits[0]))
                else:
                    after: dict[int, tuple] = {}
                    for a, (cost, chain) in ways.items():
                        for b in range(4):
                            if costs[4 * a + b] is None:
                                continue
                            way = (cost + costs[4 * a + b], _Chain(chain, audits[4 * a + b]))
                            if b not in after or way[0] < after[b][0] or way[0] == after[b][0] and _earlier(way[1], after[b][1]):
                                after[b] = way
                    ways = after
                    if block == total - 1:
                        ends = [ways[g] for g in ENDS if g in ways]
                        now = ends[0]
                        for way in ends[1:]:
                            if way[0] < now[0] or way[0] == now[0] and _earlier(way[1], now[1]):
                                now = way
                if block == total - 1:
                    pieces = now[1].pieces()
                    odd = sum(len(p) - p.count("D") for p in pieces) % 2 == 1
                    out += [(conv, i * block_rows, p, odd, None, None, None, None, None) for i, p in enumerate(pieces)]
                    out.append((conv, None, "".join(pieces), odd, *sums, now[0]))
                    ways = now = None
            columns = list(zip(*out)) or [()] * 9
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.bool_(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return ordered.mapInArrow(
        stream, f"conv_id {kind}, place bigint, piece string, odd boolean, blank bigint, duplicate bigint, truncated bigint, "
                "illegal bigint, cost bigint")


def _earlier(x: _Chain, y: _Chain) -> bool:
    mine, theirs = x.since(y)
    return mine < theirs


def repaired_hashes(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of each conversation with rows."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = plan.filter("place IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), "piece", "odd")
    joined = rows.join(pieces, rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["place"] == F.col("_place")), "left").select(
        "conv_id", "place", "role", "text", "piece", "odd")

    def stream(batches):
        digest = conv = None
        edits, emitted, shift, live = "", 0, 0, False

        def emit(role, text):
            nonlocal emitted
            digest.update((b"\n" if emitted else b"") + f"{role}:{text}".encode())
            emitted += 1

        def chosen():
            return "assistant" if (emitted + shift) % 2 else "user"

        def inserts(edits):
            while edits.startswith("I"):
                emit(chosen(), "")
                edits = edits[1:]
            return edits
        kind_of = None
        for batch in batches:
            out = []
            kind_of = batch.schema.field(0).type
            for key, place, role, text, piece, odd in zip(*[c.to_pylist() for c in batch.columns]):
                if place == 0:
                    if live:
                        inserts(edits)
                        out.append((conv, digest.hexdigest()))
                    digest, conv, edits, emitted, shift, live = hashlib.sha256(), key, "", 0, int(odd), True
                if piece is not None:
                    inserts(edits)
                    edits = piece
                edits = inserts(edits)
                edit, edits = edits[0], edits[1:]
                if edit == "K":
                    emit(role, text)
                elif edit == "R":
                    emit(chosen(), text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], kind_of), pa.array([o[1] for o in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if live:
            inserts(edits)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], kind_of), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])
    ordered = joined.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(stream, f"conv_id {kind}, repaired_sha256 string")


def repair(turns: DataFrame, conversations: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = stash(coded(turns))
    plan = stash(joined_blocks(solved_blocks(rows, block_rows), block_rows))
    hashes = repaired_hashes(rows, plan)
    seen = rows.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.coalesce(
        F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    found = conversations.select("conv_id").distinct()
    sums = plan.filter("place IS NULL").drop("place", "odd").withColumnRenamed("piece", "audit")
    for part in (seen, sums, hashes):
        part = part.withColumnRenamed("conv_id", "_conv")
        found = found.join(part, found["conv_id"].eqNullSafe(F.col("_conv")), "left").drop("_conv")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
