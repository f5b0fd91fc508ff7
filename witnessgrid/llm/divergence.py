"""Which terms and sources stand apart inside each language, by exact integer arithmetic.

A term is a run of ASCII letters and non-ASCII characters; A-Z are lower-cased. A language keeps
the terms of at least ``MIN_DOCS`` of its documents. Every (lang, source) group and every language
gives each kept term the weight ``p = 1 + floor(10^9 * (count + 2) / (N + 2 * V))``; two weights
differ by ``f = floor((p - q)^2 / (p + q))``.

* Part ``pair``: for each other source of the language, f summed over all kept terms. A term that a
  source lacks has the source's least weight z, so only terms that occur are touched:
  ``V*f(z, z') + sum over the source's terms of f(p, z') - f(z, z')``, the same for the other source,
  and for the terms that both have ``f(p, p') - f(p, z') - f(z, p') + f(z, z')``. The second sums need
  the distinct weights of a source with their counts; the last is summed in tiles of terms, in numpy,
  which return one row for two sources.
* Part ``term``: the ``TOP`` terms with p above the language's weight q. f does not fall when the
  group count grows and does not rise when the language count grows, and ties go to the earlier
  term. So a term with ``TOP`` others that have no smaller group count, no larger language count and
  come earlier in UTF-8 order can't be among the first: each partition streams through its terms and
  keeps the skyband of those with fewer such dominators, the skybands of a group are merged by the
  same rule, and what is left is ranked exactly.

Defined cases: null text, lang and source count as ''; a group without terms keeps its pairs
(0 where the language has no kept term); repeated rows count each time; an empty table gives no rows.
Columns other than text, lang and source are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stash

MIN_DOCS, TOP = 10, 10
_TILE_ROWS = 100_000
_ENTRIES, _HELD = 400_000, 250_000
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) summed inside tasks, and one row with a null term for each group met."""
    def count(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for i, group in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                total, seen = groups.setdefault(group, (Counter(), Counter()))
                words = texts[i].as_py().translate(_LETTERS).split()
                total.update(words)
                seen.update(set(words))
                # What a task holds is bounded; the rest of the sums is Spark's.
                if i % 128 == 0 and sum(len(t) for t, _ in groups.values()) > _ENTRIES:
                    yield from emit(groups)
                    groups = {}
        yield from emit(groups)

    def emit(groups):
        for (lang, source), (total, seen) in groups.items():
            terms = [None, *total]
            n = len(terms)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()),
                pa.array(terms, pa.binary()).view(pa.string()),
                pa.array([0, *total.values()], pa.int64()), pa.array([0, *(seen[t] for t in total)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return plain.mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")


def weight(n: str, total: str, terms: str) -> Column:
    """p of a count; counts beyond 2^63 / 10^9 stay exact."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10)) * CAST({n} + 2 AS DECIMAL(20))) div CAST({total} + 2 * {terms} AS DECIMAL(20))")


def apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def skyband(high: np.ndarray, low: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Positions dominated by fewer than ``k`` others: ``high`` at least, ``low`` and ``name`` at most theirs."""
    order = np.lexsort((name, low, -high))  # whoever dominates a point comes before it
    low, name = low[order], name[order]
    held_low, held_name, kept = low[:0], name[:0], []
    # Whoever has k dominators has k of them in the skyband, so points dropped before need no look.
    for start in range(0, len(order), 1024):
        here = np.arange(start, min(start + 1024, len(order)))
        known = ((held_low <= low[here, None]) & (held_name <= name[here, None])).sum(axis=1)
        here, known = here[known < k], known[known < k]
        own = np.tril((low[here] <= low[here, None]) & (name[here] <= name[here, None]), -1).sum(axis=1)
        here = here[known + own < k]
        held_low, held_name = np.r_[held_low, low[here]], np.r_[held_name, name[here]]
        kept.append(here)
    return order[np.concatenate(kept)] if kept else order


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of each (lang, source) inside each partition, a bounded number of rows at a time."""
    def retain(batches):
        held: list[pa.RecordBatch] = []
        waiting = 0
        for batch in batches:
            held.append(batch)
            waiting += batch.num_rows
            if waiting >= _HELD:
                held, waiting = [*shrink(held)], 0
        yield from shrink(held)

    def shrink(held):
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        lang, source = (table.column(c).combine_chunks().dictionary_encode() for c in (0, 1))
        codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        high, low = (table.column(c).to_numpy() for c in (2, 3))
        # Arrow orders strings by their bytes.
        place = np.empty(table.num_rows, np.int64)
        place[pc.sort_indices(table, sort_keys=[("term", "ascending")]).to_numpy()] = np.arange(table.num_rows)
        order = np.argsort(codes, kind="stable")
        edges = np.flatnonzero(np.r_[True, codes[order][1:] != codes[order][:-1], True])
        kept = [rows[skyband(high[rows], low[rows], place[rows], k)] for rows in (order[a:b] for a, b in zip(edges[:-1], edges[1:]))]
        yield from table.take(pa.array(np.concatenate(kept))).combine_chunks().to_batches()
    return rows.mapInArrow(retain, "lang string, source string, n bigint, lang_n bigint, value bigint, term string")


def _shared_terms(rows: DataFrame, tiles: int) -> DataFrame:
    """(lang, a, b, value): for two sources, a before b, the sum over terms that both have, in parts."""
    def tile(table: pa.Table) -> pa.Table:
        names, source = np.unique(table["source"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        _, term = np.unique(table["term"].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        p, z = table["p"].to_numpy(), table["z"].to_numpy()
        order = np.lexsort((source, term))
        source, term, p, z = source[order], term[order], p[order], z[order]
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        held = np.diff(np.r_[first, len(term)])
        keys, sums = [], []
        for k in np.unique(held[held > 1]).tolist():
            i, j = np.triu_indices(k, 1)
            at = first[held == k]
            step = max(1, 1_000_000 // len(i))
            for some in (at[x:x + step] for x in range(0, len(at), step)):
                a, b = some[:, None] + i, some[:, None] + j
                value = _f(p[a], p[b]) - _f(p[a], z[b]) - _f(z[a], p[b]) + _f(z[a], z[b])
                key = (source[a] * len(names) + source[b]).ravel()
                by = np.argsort(key, kind="stable")
                starts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
                keys.append(key[by][starts])
                sums.append(np.add.reduceat(value.ravel()[by], starts))
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        value = np.concatenate(sums) if sums else np.zeros(0, np.int64)
        lang = table["lang"][0].as_py()
        return pa.table({
            "lang": pa.array([lang] * len(key), pa.string()), "a": pa.array(names[key // len(names)].tolist(), pa.string()),
            "b": pa.array(names[key % len(names)].tolist(), pa.string()), "value": pa.array(value, pa.int64())})
    placed = rows.select("lang", "source", "term", "p", "z", F.pmod(F.xxhash64("term"), F.lit(tiles)).alias("tile"))
    return placed.groupBy("lang", "tile").applyInArrow(tile, "lang string, a string, b string, value bigint")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    counts = stash(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counts.filter("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs).drop("docs")
    base = stash(counts.filter("term IS NOT NULL").drop("docs").join(kept, ["lang", "term"]))
    own = base.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = base.groupBy("lang", "term").agg(F.first("lang_n").alias("lang_n")).groupBy("lang").agg(
        F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stash(groups.na.fill(0, ["total", "lang_total", "terms"]).withColumn(
        "z", F.when(F.col("terms") > 0, weight("0", "total", "terms"))))
    rows = stash(base.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "lang_n", "z", weight("n", "total", "terms").alias("p"), weight("lang_n", "lang_total", "terms").alias("q")))

    above = rows.filter("p > q").select("lang", "source", "n", "lang_n", F.expr(apart("p", "q")).alias("value"), "term")
    merged = _skybands(_skybands(above, top).repartition("lang", "source"), top)
    terms = merged.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    weights = rows.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c")).groupBy("lang", "source").agg(
        F.collect_list(F.struct("p", "c")).alias("weights"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("source").alias("item"), F.col("z").alias("other"))).alias("others"))
    one = groups.join(weights, ["lang", "source"], "left").join(others, "lang").select(
        "lang", "source", "terms", "z", F.coalesce("weights", F.expr("CAST(array() AS ARRAY<STRUCT<p: BIGINT, c: BIGINT>>)")).alias("weights"),
        F.inline("others")).filter("source <> item")
    moved = F.expr(f"aggregate(weights, 0L, (sum, w) -> sum + w.c * (({apart('w.p', 'other')}) - ({apart('z', 'other')})))")
    one = one.select("lang", "source", "item", F.coalesce(moved, F.lit(0)).alias("moved"),
                     F.coalesce(F.expr(f"terms * ({apart('z', 'other')})"), F.lit(0)).alias("plain"))
    tiles = max(1, -(-rows.count() // _TILE_ROWS))
    both = _shared_terms(rows, tiles).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    swapped = [F.col("item").alias("source"), F.col("source").alias("item")]
    parts = one.select("lang", "source", "item", (F.col("plain") + F.col("moved")).alias("value")).unionByName(
        one.select("lang", *swapped, F.col("moved").alias("value"))).unionByName(
        both.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")).unionByName(
        both.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(terms).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
