"""Vectors: checks, similarity to labels, retrieval, near-duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import policy, text
from ..session import drop_stash, stash
from . import rules, skew

# Labels of a block, and vectors that one task multiplies with a block.
LABEL_BLOCK, VECTOR_ROWS = 1_024, 5_000
# Bytes of vectors in a block of the exact pairwise comparison (one task holds two blocks), and the fewest vectors.
BLOCK_BYTES, LEAST_ROWS = 8 << 20, 1_000
# Pivots of one cell, levels of cells inside cells, rows of a cell that one task places, and rows tried before.
MAX_PIVOTS, LEVELS, SPLIT_ROWS, TRIED_ROWS = 256, 3, 100_000, 2_000
# Vectors and products that a Python worker holds at once, rows that it hands back at once, edges before they are thinned.
STRIP_ROWS, STRIP_PRODUCTS, SENT_ROWS, HELD_EDGES = 250, 2_000_000, 10_000, 1_000_000


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalized(vector: Column) -> Column:
    """L2-normalised vector, null for an empty, zero or non-finite one."""
    length = norm(vector)
    usable = (F.size(vector) > 0) & (length > 0) & rules.finite(length)
    return F.when(usable, F.transform(vector, lambda x: (x / length).cast("float")))


def cosine(left: Column, right: Column) -> Column:
    """Dot product of unit vectors kept in [-1, 1]; null when the dimensions differ."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(left) == F.size(right), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


def vector_violations(vectors: DataFrame) -> DataFrame:
    """Shape and norm of each vector, one dimension per batch, unique item ids."""
    c = F.col
    length = norm(c("embedding"))
    _, rows = rules.apply_rules(vectors, "vector", c("item_id"), {
        "empty_vector": F.size("embedding") > 0,
        "not_finite": ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))),
        "not_unit_norm": F.abs(length - 1.0) <= F.greatest(F.lit(1e-6), F.lit(1e-5) * F.greatest(length, F.lit(1.0))),
    })
    mixed = vectors.groupBy("analysis_id").agg(
        F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).filter(c("lo") != c("hi"))
    repeated = vectors.groupBy("analysis_id", "item_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    return (
        rows.unionByName(rules.violation(mixed, "batch", c("analysis_id"), "mixed_dimensions"))
        .unionByName(rules.violation(repeated, "vector", c("item_id"), "duplicate_item"))
    )


def batch_violations(item_batch: DataFrame, label_batch: DataFrame) -> DataFrame:
    """Item and label vectors must come from one provider configuration and dimension."""
    identity = F.to_json(F.struct("provider", F.size("embedding").alias("dimension")))
    both = item_batch.select("analysis_id", identity.alias("i")).unionByName(
        label_batch.select("analysis_id", identity.alias("i")))
    mixed = both.distinct().groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return rules.violation(mixed, "batch", F.col("analysis_id"), "incompatible_batches")


def label_violations(labels: DataFrame) -> DataFrame:
    """Candidate labels: not blank, claim policy, unique per analysis after folding."""
    keyed = text.computed(labels, _key=text.aggregation_key(F.col("label")))
    _, rows = rules.apply_rules(keyed, "label", F.col("label"), {
        "blank": F.col("_key") != "", "claim_policy": ~policy.violates(None, F.col("label"))})
    twice = keyed.groupBy("analysis_id", "_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return rows.unionByName(rules.violation(twice, "label", F.col("_key"), "duplicate_label"))


def score_labels(vectors: DataFrame, labels: DataFrame, threshold: float | None = None, top: int | None = None,
                 block: int = LABEL_BLOCK) -> DataFrame:
    """Similarity of items to candidate labels: analysis_id, item_id, label, similarity.

    ``labels(label, embedding)`` is a vocabulary of any size. Labels lie in blocks of about ``block``, and a task
    multiplies some vectors with one block, so nothing is collected and the work of any
    vocabulary runs alike. With ``threshold`` only pairs that reach it leave the task, with ``top`` only
    the best of each item in each block (ties by label), from which the best overall are taken.
    """
    n_blocks = max(1, -(-labels.count() // block))
    salts = max(1, -(-vectors.count() // VECTOR_ROWS))
    names = ["_b", "_salt", "_kind", "analysis_id", "item_id", "embedding"]
    embedding = F.col("embedding").cast("array<double>")
    heads = labels.select(
        F.pmod(F.xxhash64("label"), F.lit(n_blocks)).alias("_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("_salt"),
        F.lit(0).alias("_kind"), F.lit("").alias("analysis_id"), F.col("label").alias("item_id"), embedding.alias("embedding"))
    rows = vectors.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("_b"),
        F.pmod(F.xxhash64("analysis_id", "item_id"), F.lit(salts)).alias("_salt"), F.lit(1).alias("_kind"),
        F.col("analysis_id").cast("string").alias("analysis_id"), F.col("item_id").cast("string").alias("item_id"), embedding.alias("embedding"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, texts, parts, matrix = None, [], [], None
        for batch in batches:
            for key, part in batch.groupby(["_b", "_salt"], sort=False):
                if key != now:
                    now, texts, parts, matrix = key, [], [], None
                told = part[part["_kind"] == 0]
                texts += told["item_id"].tolist()
                parts += told["embedding"].tolist()
                part = part[part["_kind"] == 1]
                if not len(part) or not texts:
                    continue
                if matrix is None:  # sorted: all labels of the block come before the first vector
                    matrix = np.stack(parts).T
                dots = np.clip(np.stack(part["embedding"].to_numpy()) @ matrix, -1.0, 1.0)
                keep = np.ones(dots.shape, bool) if threshold is None else dots >= threshold
                if top is not None and dots.shape[1] > top:
                    # Labels are sorted, so a stable sort settles ties by label.
                    best = np.argsort(-dots, axis=1, kind="stable")[:, :top]
                    first = np.zeros(dots.shape, bool)
                    np.put_along_axis(first, best, True, axis=1)
                    keep &= first
                i, j = np.nonzero(keep)
                yield pd.DataFrame({
                    "analysis_id": part["analysis_id"].to_numpy()[i], "item_id": part["item_id"].to_numpy()[i],
                    "label": np.array(texts, object)[j], "similarity": dots[i, j]})
    stream = heads.unionByName(rows).repartition("_b", "_salt").sortWithinPartitions(*names[:5])
    found = stream.mapInPandas(score, "analysis_id string, item_id string, label string, similarity double")
    if top is None:
        return found
    order = Window.partitionBy("analysis_id", "item_id").orderBy(F.desc("similarity"), "label")
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= top).drop("_n")


def matched(similarities: DataFrame, threshold: float = vocab.THEME_THRESHOLD) -> DataFrame:
    return similarities.filter(F.col("similarity") >= threshold)


def retrieval(similarities: DataFrame, vectors: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Items ranked per label: similarity descending, item id ascending."""
    return skew.rank_within(
        similarities, ["analysis_id", "label"], [-F.col("similarity"), F.col("item_id")], "rank",
        sizes=vectors.select("analysis_id"), hot_rows=hot_rows)


# -- near duplicates -----------------------------------------------------------------------

def distinct_vectors(vectors: DataFrame, hot_rows: int = skew.HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Collapse equal vectors: (one row per distinct vector, item -> representative links)."""
    groups = vectors.groupBy("analysis_id", "embedding").agg(
        F.min("ordinal").alias("rep_ordinal"), F.count(F.lit(1)).alias("copies"))
    linked = skew.lookup(
        vectors.select("analysis_id", "ordinal", "embedding"), groups, ["analysis_id", "embedding"],
        "copies", hot_rows, spread_by=["ordinal"])
    self_dot = cosine(F.col("embedding"), F.col("embedding"))
    links = linked.filter(F.col("ordinal") != F.col("rep_ordinal")).select(
        "analysis_id", F.col("ordinal").alias("right"), F.col("rep_ordinal").alias("left"),
        self_dot.alias("similarity"))
    return groups.select("analysis_id", F.col("rep_ordinal").alias("ordinal"), "embedding"), links


def block_size(vectors: DataFrame) -> int:
    """Vectors of a block: as many as a task can hold, fewer where that would leave cores idle.

    Every vector is sent once for each block of its analysis, so large blocks keep the exchange small.
    """
    sizes = vectors.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d"))
    most = sizes.agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    width = 8 if "double" in vectors.schema["embedding"].dataType.simpleString() else 4
    tasks = 2 * vectors.sparkSession.sparkContext.defaultParallelism
    wanted = -(-(most["n"] or 0) // int(np.ceil(np.sqrt(2 * tasks))))
    return max(1, min(max(LEAST_ROWS, wanted), BLOCK_BYTES // (width * max(1, most["d"] or 1))))


def metric_cells(vectors: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Every vector in its cell, and in each cell where it may have a partner: analysis_id, cell,
    ordinal, embedding, home.

    A sample of an analysis' vectors are pivots; a vector's home is the cell of its nearest pivot P.
    Those nearest to Q lie beyond the bisector of P and Q, and on the sphere x is
    ``arcsin(x.(P-Q) / |P-Q|)`` away from it, so a partner within the angle ``arccos(threshold)``
    can be there only if ``x.(P-Q) <= sin(arccos(threshold)) * |P-Q|``. Each pair meets once: in the
    home of the one with the higher pivot, where the other one is a visitor. Cells of more than
    ``block_rows`` homes are split again, with pivots of their own, up to ``LEVELS`` times. Where vectors
    reach most cells, which some of them tell, a cell stays whole: its blocks send less than cells would.
    """
    rows = vectors.select("analysis_id", F.lit(0).cast("bigint").alias("cell"), "ordinal", "embedding", F.lit(True).alias("home"))
    kept = None
    for level in range(LEVELS):
        sizes = rows.groupBy("analysis_id", "cell").agg(F.count_if("home").alias("_n"), F.count(F.lit(1)).alias("_all"))
        big = stash(sizes.filter(F.col("_n") > block_rows))
        if big.isEmpty():
            break
        # A row is written once for each cell it is in, then sent once for each block it meets there.
        reached = _split(rows, big, threshold, block_rows, level, TRIED_ROWS).groupBy("analysis_id", "cell").agg(
            (F.count(F.lit(1)) / F.count_if("home")).alias("_cells"))
        worth = stash(big.join(reached, ["analysis_id", "cell"]).filter(2.5 * F.col("_cells") * block_rows < F.col("_n")).select(*big.columns))
        if worth.isEmpty():
            break
        # A big cell bounds the shuffle of the rest: both joins only tell rows of big cells apart.
        rest = rows.join(worth.select("analysis_id", "cell"), ["analysis_id", "cell"], "left_anti")
        rows = stash(rest.unionByName(_split(rows, worth, threshold, block_rows, level).withColumn(
            "cell", F.xxhash64("cell", "sub", F.lit(level))).drop("sub")))
        if kept is not None:
            drop_stash(kept)
        kept = rows
    return rows


def _split(rows: DataFrame, big: DataFrame, threshold: float, block_rows: int, level: int, tried: int | None = None) -> DataFrame:
    """The rows of ``big`` cells with the number (sub) of the smaller cell around a pivot of their own;
    only about ``tried`` homes of a cell, if given."""
    names = ["analysis_id", "cell", "_salt", "_kind", "ordinal", "embedding", "home"]
    sized = skew.lookup(rows, big.withColumn("_rows", F.col("_all")), ["analysis_id", "cell"], "_all", spread_by=["ordinal"], how="inner")

    def some(wanted: Column, seed: int) -> Column:
        return F.pmod(F.xxhash64("ordinal", F.lit(seed)), F.lit(1 << 30)) < wanted / F.col("_n") * float(1 << 30)
    salts = F.ceil(F.col("_rows") / F.lit(SPLIT_ROWS)).cast("bigint") if tried is None else F.lit(1).cast("bigint")
    pivots = sized.filter(F.col("home") & some(F.least(F.lit(float(MAX_PIVOTS)), 2 * F.ceil(F.col("_n") / F.lit(block_rows))), level)).select(
        "analysis_id", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)).alias("_salt"), F.lit(0).alias("_kind"), "ordinal", "embedding", "home")
    told = sized if tried is None else sized.filter(F.col("home") & some(F.lit(float(tried)), -1 - level))
    placed = told.select("analysis_id", "cell", F.pmod(F.xxhash64("ordinal"), salts).alias("_salt"), F.lit(1).alias("_kind"), "ordinal", "embedding", "home")
    stream = pivots.unionByName(placed).repartition("analysis_id", "cell", "_salt").sortWithinPartitions(*names[:5])
    slack = 1e-4
    reach = 2.0 if threshold <= 0 else float(np.sqrt(1 - min(1.0, threshold) ** 2))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, heads = None, []
        matrix = apart = None
        for batch in batches:
            for key, part in batch.groupby(["analysis_id", "cell", "_salt"], sort=False, dropna=False):
                if key != now:
                    now, heads, matrix = key, [], None
                heads += part.loc[part["_kind"] == 0, "embedding"].tolist()
                vectors = part[part["_kind"] == 1]
                for row in range(0, len(vectors), STRIP_ROWS):
                    part = vectors.iloc[row:row + STRIP_ROWS]
                    x = np.stack(part["embedding"].to_numpy()).astype("float64")
                    if matrix is None:  # sorted: all pivots come before the first vector
                        matrix = np.stack(heads).astype("float64") if heads else np.zeros((1, x.shape[1]))
                        apart = np.stack([np.sqrt(((matrix - pivot) ** 2).sum(-1)) for pivot in matrix])
                    dots = x @ matrix.T
                    own = dots.argmax(axis=1)
                    home = part["home"].to_numpy()
                    near = dots[np.arange(len(x)), own][:, None] - dots <= reach * apart[own] + slack
                    later = np.arange(len(matrix))[None] > own[:, None]
                    i, sub = np.nonzero(near & (later | ~home[:, None]))
                    stays = np.flatnonzero(home)
                    i, sub, is_home = np.r_[stays, i], np.r_[own[stays], sub], np.r_[np.ones(len(stays), bool), np.zeros(len(i), bool)]
                    # A vector may visit every cell, so a few vectors can make many rows.
                    for lo in range(0, len(i), SENT_ROWS):
                        at = i[lo:lo + SENT_ROWS]
                        yield pd.DataFrame({
                            "analysis_id": part["analysis_id"].to_numpy()[at], "cell": part["cell"].to_numpy()[at], "sub": sub[lo:lo + SENT_ROWS].astype("int64"),
                            "ordinal": part["ordinal"].to_numpy()[at], "embedding": part["embedding"].to_numpy()[at], "home": is_home[lo:lo + SENT_ROWS]})
    return stream.mapInPandas(
        place, f"analysis_id string, cell bigint, sub bigint, ordinal bigint, embedding {rows.schema['embedding'].dataType.simpleString()}, home boolean")


def _block_pairs(cells: DataFrame, block_rows: int) -> DataFrame:
    """Every row once per pair of blocks it takes part in; nothing is compared here.

    Home blocks of a cell come first; each meets itself, later home blocks and the visitors' blocks.
    """
    sizes = cells.groupBy("analysis_id", "cell").agg(F.count_if("home").alias("_h"), F.count(F.lit(1)).alias("_n"))
    blocks = lambda n: F.ceil(n / F.lit(block_rows)).cast("int")
    sized = sizes.withColumns({"homes": blocks(F.col("_h")), "guests": blocks(F.col("_n") - F.col("_h"))}).drop("_h")
    counted = skew.lookup(cells, sized, ["analysis_id", "cell"], "_n", spread_by=["ordinal"]).filter("homes > 0")
    spread = F.xxhash64("ordinal")
    own = F.when(F.col("home"), F.pmod(spread, F.col("homes"))).otherwise(F.col("homes") + F.pmod(spread, F.col("guests"))).cast("int")
    placed = counted.withColumn("_own", own)
    last = F.when(F.col("home"), F.col("homes") + F.col("guests") - 1).otherwise(F.col("homes") - 1)
    pair = F.transform(F.sequence(F.lit(0), last), lambda o: F.struct(
        F.least(o, F.col("_own")).alias("bi"), F.greatest(o, F.col("_own")).alias("bj")))
    return placed.select("analysis_id", "cell", "ordinal", "embedding", "_own", F.inline(pair))


def _compare(threshold: float, spanning: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analysis, same, ordinals, sides = None, True, ([], []), ([], [])
        for batch in batches:  # the vectors of two blocks, held as plain matrices
            analysis, first = batch["analysis_id"].iloc[0], batch["bi"].iloc[0]
            same = first == batch["bj"].iloc[0]
            for at, own in enumerate((batch["_own"] == first, batch["_own"] != first)):
                if own.any():
                    ordinals[at].append(batch.loc[own, "ordinal"].to_numpy())
                    sides[at].append(np.stack(batch.loc[own, "embedding"].to_numpy()))
        right_at = 0 if same else 1
        if not sides[0] or not sides[right_at]:
            return

        def sorted_side(at):
            own = np.concatenate(ordinals[at])
            order = np.argsort(own, kind="stable")
            return own[order], np.concatenate(sides[at])[order].astype("float64")
        left_ordinals, x = sorted_side(0)
        right_ordinals, y = (left_ordinals, x) if same else sorted_side(1)
        sides[0].clear(), sides[1].clear()
        forest, held, edges = (left_ordinals[:0], left_ordinals[:0], np.zeros(0)), [], 0

        def sent(low, high, value):
            for lo in range(0, len(low), SENT_ROWS):
                part = slice(lo, lo + SENT_ROWS)
                yield pd.DataFrame({"analysis_id": analysis, "left": low[part], "right": high[part], "similarity": value[part]})

        def thinned():
            return _spanning(*(np.concatenate(all_of) for all_of in zip(forest, *held)))
        strip = max(1, min(STRIP_ROWS, STRIP_PRODUCTS // len(y)))
        for row in range(0, len(x), strip):
            dots = x[row:row + strip] @ y.T
            np.clip(dots, -1.0, 1.0, out=dots)
            hit = dots >= threshold
            if same:
                hit &= np.arange(len(y))[None] > np.arange(row, row + len(hit))[:, None]
            i, j = np.nonzero(hit)
            a, b = left_ordinals[row + i], right_ordinals[j]
            found = np.minimum(a, b), np.maximum(a, b), dots[i, j]
            if not spanning:
                yield from sent(*found)
                continue
            held.append(found)
            edges += len(i)
            if edges > HELD_EDGES:
                forest, held, edges = thinned(), [], 0
        if spanning:
            yield from sent(*thinned())
    return run


def _spanning(low: np.ndarray, high: np.ndarray, value: np.ndarray):
    """Edges from each node to the smallest node of its component inside this block pair."""
    if len(low) == 0:
        return low, high, value
    nodes, flat = np.unique(np.concatenate([low, high]), return_inverse=True)
    u, v = flat[: len(low)], flat[len(low):]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, u, before[v])
        np.minimum.at(label, v, label[u])
        label = label[label]
        if np.array_equal(before, label):
            break
    moved = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[label[moved]], nodes[moved], np.full(len(moved), np.nan)


def similar_pairs(vectors: DataFrame, threshold: float = vocab.NEAR_DUPLICATE_THRESHOLD,
                  block_rows: int | None = None, spanning: bool = False) -> DataFrame:
    """Pairs of items (left before right) whose cosine reaches the threshold, exactly.

    Only vectors whose cells can hold a pair meet (:func:`metric_cells`); cells are cut into
    blocks of bounded size and each task multiplies two blocks, so pairs below the threshold never
    become rows. With ``spanning`` a task reports only edges that connect its components - at
    most as many as it has vectors - which is all that grouping needs.
    """
    rows = vectors.select("analysis_id", F.col("ordinal").cast("bigint").alias("ordinal"), "embedding")
    block_rows = block_rows or block_size(rows)
    cells = metric_cells(rows, threshold, block_rows)
    return _block_pairs(cells, block_rows).groupBy("analysis_id", "cell", "bi", "bj").applyInPandas(
        _compare(threshold, spanning), "analysis_id string, left bigint, right bigint, similarity double")


def near_duplicate_edges(vectors: DataFrame, threshold: float = vocab.NEAR_DUPLICATE_THRESHOLD,
                         block_rows: int | None = None) -> DataFrame:
    """Connecting edges (analysis_id, left, right) of the near-duplicate graph by ordinal."""
    distinct, links = distinct_vectors(vectors)
    pairs = similar_pairs(distinct, threshold, block_rows, spanning=True)
    copies = links.filter(F.col("similarity") >= threshold)
    return pairs.select("analysis_id", "left", "right").unionByName(copies.select("analysis_id", "left", "right"))
