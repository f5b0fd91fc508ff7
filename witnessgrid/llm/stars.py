"""From documents that meet under a key to classes of linked documents, star by star.

* In every key the node with the most neighbours over all its keys goes first: the original of many
  near copies meets all of them, so one star mostly joins a group of any size. It is compared
  with the nodes of other classes than its own.
* When few pairs are left apart, or after ``STARS`` rounds, all nodes outside the largest class of
  a key are compared with the rest of the key. So every pair that shares a key ends up linked, in
  one class, or compared, and copies cost about one comparison each.
* There, where near copies that are no links share most of their keys, a pair is taken in its first common keys
  only (``BEFORE``), so its rows don't grow with the keys that it shares.
* Bit sketches, compared inside the join, drop pairs that can't be links; the others are compared as
  whole shingle sets, of which each is made and stored once.
* Links shrink to spanning forests by union-find inside the tasks; star contraction joins the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stash
from . import blocks
from .links import components, tasks_for

STARS = 2
# Keys before its own that each row knows when all pairs of a key are compared.
BEFORE = 8
BITS, DENSE, SIGMAS = 512, 150, 5.0


def fingerprint(shingle_set: np.ndarray) -> np.uint64:
    """One number for a sorted shingle set."""
    place = np.arange(1, len(shingle_set) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return blocks.mix(np.bitwise_xor.reduce(blocks.mix(shingle_set * place), keepdims=True))[0]


def fingerprints(found: list[np.ndarray]) -> np.ndarray:
    return np.array([fingerprint(s) if len(s) else 0 for s in found], np.uint64)


def bit_sketches(found: list[np.ndarray]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(level, fine, coarse): parity of BITS bits over the shingles sampled at 1 in 2^level, and at half of that.

    Each shingle flips one bit, so the Hamming distance of two sketches of one rate is at most the
    (sampled) symmetric difference.
    """
    sizes = np.array([len(s) for s in found], np.int64)
    levels = np.maximum(0, np.floor(np.log2(np.maximum(sizes, 1) / DENSE))).astype(np.int64)
    bits = np.zeros((len(found), 2, BITS // 64), np.int64)
    for i, (shingles, level) in enumerate(zip(found, levels.tolist())):
        bit = (blocks.mix(shingles) & np.uint64(BITS - 1)).astype(np.int64)
        sample = shingles >> np.uint64(24)
        kept = [(sample & np.uint64((1 << at) - 1)) == 0 for at in (level, level + 1)]
        parity = np.stack([np.bincount(bit[k], minlength=BITS) & 1 for k in kept])
        bits[i] = np.packbits(parity.astype(np.uint8), axis=1).view(np.int64)
    at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * (BITS // 64))
    return pa.array(levels), *(pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(bits[:, k]).ravel())) for k in (0, 1))


def _side(nodes: DataFrame, name: str, percent: int) -> DataFrame:
    """Size and sketches of the nodes as columns of one side of a pair."""
    # Coarse sketches serve partners of the next level, so only sizes near it carry them.
    near = 100 * F.col("size") >= percent * DENSE * F.pow(F.lit(2.0), F.col("level") + 1)
    return nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("size", "level")], *[
        column.alias(f"{name}_{c}{i}") for c in ("fine", "coarse") for i in range(BITS // 64)
        for column in [F.col(c)[i] if c == "fine" else F.when(near, F.col(c)[i])]])


def _close(percent: int) -> Column:
    """Sizes and bit sketches of a and b leave a link possible. Sets of up to 2 * DENSE shingles are
    sketched whole, and then the bound is certain; sampled ones get SIGMAS standard deviations of slack."""
    sizes, levels = ([F.col(f"{x}_{c}") for x in "ab"] for c in ("size", "level"))
    level = F.greatest(*levels)
    bits = [[F.when(own == level, F.col(f"{x}_fine{i}")).otherwise(F.col(f"{x}_coarse{i}")) for i in range(BITS // 64)]
            for x, own in zip("ab", levels)]
    distance = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(*bits)), F.lit(0))
    rate = F.pow(F.lit(2.0), -level)
    mean = rate * (100 - percent) * sum(sizes) / (100 + percent)
    return (100 * F.least(*sizes) >= percent * F.greatest(*sizes)) & (distance <= mean + SIGMAS * F.sqrt(mean * (1 - rate)))


def set_items(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, items): the whole shingle sets of ``nodes`` (node, rep, text_key), from one row that holds each."""
    wanted = nodes.select(F.col("rep").alias("_rep"), F.col("text_key").alias("_text_key"), F.col("node").alias("_node"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), "text")
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("_rep")) & (rows["text_key"] == F.col("_text_key"))).select("_node", "text")

    def sets(batches):
        for batch in batches:
            for row, found in blocks.shingle_sets(batch.column(1), size):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(found)), pa.array([s.tobytes() for s in found], pa.binary())],
                    names=["node", "items"])
    # A row that occurs several times folds here.
    return texts.mapInArrow(sets, "node bigint, items binary").groupBy("node").agg(F.first("items").alias("items"))


def similar_forest(pairs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the same classes as the pairs (a, b) of nodes whose whole sets are as similar as asked.

    At most as many as there are nodes in each block of rows, by union-find; one Python stage does both, so that
    a task has one worker.
    """
    def similar(batch):
        keep = []
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                keep.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py()))
        return keep

    def grow(batches):
        for batch in batches:
            root: dict[int, int] = {}

            def find(x):
                top = x
                while root.setdefault(top, top) != top:
                    top = root[top]
                while root[x] != top:
                    root[x], x = top, root[x]
                return top
            for a, b in similar(batch):
                a, b = find(a), find(b)
                if a != b:
                    root[max(a, b)] = min(a, b)
            moved = [(find(x), x) for x in list(root) if find(x) != x]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[k] for m in moved], pa.int64()) for k in (0, 1)], names=["a", "b"])
    left, right = (items.select(F.col("node").alias(n), F.col("items").alias(f"{n}_items"), F.octet_length("items").alias(f"{n}_size")) for n in "ab")
    near = 100 * F.least("a_size", "b_size") >= percent * F.greatest("a_size", "b_size")
    joined = pairs.join(left, "a").join(right, "b").filter(near)
    return joined.select("a", "b", "a_items", "b_items").mapInArrow(grow, "a bigint, b bigint")


def met_nodes(keyed: DataFrame) -> DataFrame:
    """(key, node, degree) of the keys that at least two nodes have; ``keyed`` holds each (key, node) once.

    The degree counts the nodes met over all keys.
    """
    shared = stash(keyed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key", "n"))
    met = stash(keyed.join(shared, "key"))
    return stash(met.select("key", "node").join(met.groupBy("node").agg(F.sum("n").alias("degree")), "node"))


def _with_before(rows: DataFrame) -> DataFrame:
    """The rows (key, node, ...) with ``before``: up to ``BEFORE`` keys of the node that precede this one.

    Two nodes with a key in common there meet under that key already, so they need not meet again: under the
    first key they share the lists have none in common, and no pair is lost. A node has a few hundred keys at most.
    """
    window = Window.partitionBy("node").orderBy("key").rowsBetween(-BEFORE, -1)
    return rows.withColumn("before", F.collect_list("key").over(window))


def star_roots(met: DataFrame, nodes: DataFrame, items: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of every linked node, root the smallest; None without links.

    ``met``: key, node and the node's degree, for keys of at least two nodes. ``nodes``: node, size, level,
    fine, coarse (:func:`bit_sketches`). ``items``: the sets of all nodes of ``met``.
    """
    nodes = stash(nodes.select("node", "size", "level", "fine", "coarse").join(items.select("node"), "node"))
    roots, tested, moved = None, None, True
    members, rows = met.agg(F.count_distinct("node"), F.count(F.lit(1))).first()
    width = tasks_for(rows)
    for turn in range(STARS + 1):
        placed = met.withColumn("root", F.col("node")) if roots is None else met.join(roots, "node", "left").coalesce(width).withColumn(
            "root", F.coalesce("root", "node"))
        placed = placed if roots is None else stash(placed)
        parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "node")).alias("top")).coalesce(width)
        count = F.col("n").cast("double")
        apart = stash(parts.groupBy("key").agg(
            F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("parts"),
            F.max("top")["node"].alias("hub"),
            ((F.pow(F.sum(count), F.lit(2.0)) - F.sum(count * count)) / 2).alias("pairs")).filter("parts > 1").drop("parts").coalesce(width))
        pending = apart.agg(F.sum("pairs")).first()[0]
        if pending is None:
            break
        placed = stash(placed.join(apart, "key").coalesce(width))
        last = turn == STARS or (turn > 0 and (pending <= 4 * members or not moved))
        if last:
            pivots = placed.filter("root <> main").select("key", F.col("node").alias("a"), F.col("root").alias("ra"))
        elif turn == 0:
            pivots = placed.filter("node = hub").select("key", F.col("node").alias("a"), F.col("root").alias("ra"))
        else:  # the best connected node outside the largest class
            outer = placed.filter("root <> main").groupBy("key").agg(F.max(F.struct("degree", "node", "root")).alias("t"))
            pivots = outer.select("key", F.col("t.node").alias("a"), F.col("t.root").alias("ra"))
        others = placed.select("key", F.col("node").alias("b"), "root")
        apart_first = F.col("root") != F.col("ra")
        if last:
            pivots = _with_before(pivots.withColumnRenamed("a", "node")).withColumnsRenamed({"node": "a", "before": "a_before"})
            others = _with_before(others.withColumnRenamed("b", "node")).withColumnsRenamed({"node": "b", "before": "b_before"})
            apart_first &= ~F.arrays_overlap("a_before", "b_before")
        # Sketches are compared inside the join, so pairs that can't be links are never rows.
        others = others.join(_side(nodes, "b", percent), "b")
        met_pairs = others.join(pivots.join(_side(nodes, "a", percent), "a"), "key").filter(apart_first & _close(percent))
        pairs = met_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().coalesce(width)
        pairs = stash(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        similar = stash(similar_forest(pairs, items, percent))
        moved = not similar.isEmpty()
        if moved:
            links = similar if roots is None else similar.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
            roots = stash(components(links))
        if last:
            break
    return roots


def named_rows(rows: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` (doc_id, text_key, node, ...) with component_id and kept, without the node.

    ``nodes``: node, rep and text_key of its first row. A class is named by its smallest id; its first
    row, smallest id and then text_key, is the one kept. A row without node is its own class.
    """
    first = F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), "text_key")
    named = nodes.select("node", first.alias("first"))
    if roots is not None:
        least = roots.join(named, "node").groupBy("root").agg(F.min("first").alias("least"))
        named = named.join(roots, "node", "left").join(least, "root", "left").select("node", F.coalesce("least", "first").alias("first"))
    alone = F.col("node").isNull()
    kept = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("text_key") == F.col("first.text_key"))
    return rows.join(named, "node", "left").withColumns({
        "component_id": F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")), "kept": alone | kept}).drop("node", "first")
