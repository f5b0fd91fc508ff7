"""Self-join of documents on shingle-set Jaccard with parity sketches.

A sketch is an array of 64-bit words; every shingle XORs its hash into one word. Words differ
only where the sets differ, so the Hamming distance over words is at most the symmetric
difference, which similarity ``t`` bounds by ``(1-t)/(1+t) * (|A|+|B|)``. Pigeonhole: of each
document's non-zero words the first ``bound + 1`` include one that the partner shares too, so
documents meet in an equi-join on (size band, word number, word).

* Size bands are geometric with ratio 1/t; a band is joined with itself and the next one.
* Documents that would need more than ``PLAIN`` words use a sketch of a hash sample of their
  shingles; the bound then gets ``SIGMAS`` standard deviations on top (a pair exactly at the
  threshold is missed with a probability under 1e-6 per independent sketch, similar pairs with
  none worth naming). Smaller documents are joined without any such chance.
* Candidates then compare two-rate bit sketches of ``BITS`` bits: each (sampled) shingle XORs one
  bit, and the Hamming distance is again a lower bound of the (sampled) symmetric difference.
* Shingles of more than ``COMMON`` of the documents go to words of their own, used last, so a
  passage that many documents share brings no candidates together.
* Two passes make the keys: the first counts all of them, in the second every document takes its
  rarest first, those of no other document before all. Both partners order alike, so the pigeonhole
  argument holds, and passages shared by fewer documents than ``COMMON`` bring few together too.
* Candidates are checked star by star (``stars``): every pair that shares a word ends up linked, in one
  class, or compared by whole shingle sets, so no link is lost, and copies and near copies cost about one check each.

Defined cases: null, empty or wordless text has an empty set and no links; fewer than five
words are one shingle; equal sets are one node; rows of one id are separate documents; a row with a null
id takes part and never gives its class a name; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import small_batches, stash
from . import blocks
from .stars import SIGMAS, bit_sketches, fingerprints, met_nodes, named_rows, set_items, star_roots

PLAIN, SAMPLED = 112, 72
COMMON = 0.01
# How often a key is seen, by levels, and the bits of a key that tell it apart there: the more often, the fewer such keys.
SEEN, KEY_BITS = (2, 8, 64), (27, 24, 21)


class Bands:
    """Sketch shape of each size band and what a document of a given size must emit."""

    def __init__(self, percent: int):
        self.percent = percent
        self.ratio = 100 / percent

    def start(self, band: int) -> float:
        return self.ratio ** band

    def band(self, size: np.ndarray) -> np.ndarray:
        found = np.floor(np.log(np.maximum(size, 1)) / math.log(self.ratio) + 1e-9).astype(np.int64)
        return found

    def bound(self, size, partner):
        """Largest symmetric difference of linked sets of these sizes."""
        return (100 - self.percent) * (size + partner) / (100 + self.percent)

    def shape(self, band: int) -> tuple[float, int]:
        """(sampling rate, words) for the sketches of ``band`` joined with itself and the next."""
        top = math.ceil(self.start(band + 1)) * self.ratio
        most = self.bound(self.start(band + 1), top) + 1
        if most <= PLAIN:
            return 1.0, int(1.35 * most) + 8
        rate = SAMPLED / most
        return rate, 2 * int(self.allowed(most, rate))

    def allowed(self, bound, rate: float):
        if rate >= 1:
            return np.floor(bound)
        mean = bound * rate
        return np.ceil(mean + SIGMAS * np.sqrt(mean * (1 - rate)))


def sketch_keys(sets: list[np.ndarray], nodes: np.ndarray, common: np.ndarray, bands: Bands, level=None):
    """Join keys (key, node) of a block of shingle sets: all that may be used, or given the ``level``
    of keys (0: no other document has it) those used when lower levels go first, level 0 left out."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = bands.band(sizes)
    for step in (0, 1):  # the band as the lower one, then as the upper one of a pair of bands
        for band in np.unique(own[sizes > 0]).tolist():
            picked = np.flatnonzero((own == band) & (sizes > 0))
            joined = band - step
            if joined < 0:
                continue
            n = sizes[picked].astype(float)
            partner = np.minimum(n * bands.ratio, bands.start(joined + 2)) if step == 0 else np.full(len(n), bands.start(joined + 1))
            rate, words = bands.shape(joined)
            allowed = bands.allowed(bands.bound(n, partner), rate).astype(np.int64)
            yield _emit([sets[i] for i in picked], nodes[picked], allowed, rate, words, joined, common, level)


def _emit(sets, nodes, allowed, rate, words, joined, common, level):
    lengths = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), lengths)
    if rate < 1:
        kept = (values & np.uint64(0xFFFFFF)) < np.uint64(int(rate * (1 << 24)))
        values, doc = values[kept], doc[kept]
    # Sets are sorted, so the word number, which follows the upper bits, is sorted too.
    word = ((values >> np.uint64(32)) * np.uint64(words) >> np.uint64(32)).astype(np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        word += np.where(common[at] == values, words, 0)
    cell = doc * (2 * words) + word
    if len(common):
        order = np.argsort(cell, kind="stable")
        cell, values = cell[order], values[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
    parity = np.bitwise_xor.reduceat(blocks.mix(values), first) if len(cell) else np.zeros(0, np.uint64)
    cell = cell[first][parity != 0]
    parity = parity[parity != 0]
    d, w = cell // (2 * words), cell % (2 * words)
    tag = np.uint64(joined + 1) * np.uint64(1 << 40)
    key = blocks.mix(parity + blocks.mix(w.astype(np.uint64) + tag))
    live = np.bincount(d, minlength=len(sets))
    start = np.cumsum(live) - live
    # A document with no more live words than may differ can share none with its partner.
    bare = live <= allowed
    mark = blocks.mix(np.array([(joined + 1) << 20], np.uint64))
    used = np.ones(len(d), bool)
    if level is not None and len(d):
        rarity = level(key)
        order = np.argsort(d * (len(SEEN) + 1) + rarity, kind="stable")
        rank = np.empty(len(d), np.int64)
        rank[order] = np.arange(len(d))
        used = (rank - start[d] <= allowed[d]) & (rarity > 0)
        bare &= level(mark) > 0
    return np.r_[key[used], np.repeat(mark, int(bare.sum()))], np.r_[nodes[d[used]], nodes[bare]]


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set, null if empty) and its bit sketches; and
    rows with a null n_shingles that count shingles frequent in a block of documents (node, seen)."""
    longs = pa.list_(pa.int64())
    names = ["doc_id", "text_key", "n_shingles", "node", "seen", "level", "fine", "coarse"]

    def sets(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            column = batch.column(2)
            for row, found in blocks.shingle_sets(column):
                n = np.array([len(s) for s in found], np.int64)
                node = fingerprints(found)
                level, fine, coarse = bit_sketches(found)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(row, len(found)), texts.slice(row, len(found)), pa.array(n), pa.array(blocks.signed(node), mask=n == 0),
                    pa.nulls(len(found), pa.int64()), pa.array(level), fine, coarse], names=names)
                value, seen = np.unique(np.concatenate(found), return_counts=True)
                often = seen >= max(2, COMMON / 2 * len(found))
                if often.any():
                    k = int(often.sum())
                    yield pa.RecordBatch.from_arrays([
                        *[pa.nulls(k, pa.int64())] * 3, pa.array(blocks.signed(value[often])),
                        pa.array(seen[often]), pa.nulls(k, pa.int64()), pa.nulls(k, longs), pa.nulls(k, longs)], names=names)
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        sets, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, seen bigint, level bigint, fine array<bigint>, coarse array<bigint>")


def _common(table: DataFrame) -> np.ndarray:
    """Shingles of more than COMMON of all documents. Each document has few shingles on
    average, so at most (average set size / COMMON) values qualify, whatever the table's size."""
    total = table.filter("n_shingles IS NOT NULL").count()
    # A shingle frequent overall is frequent in at least one block; its missing counts are below half.
    found = table.filter("seen IS NOT NULL").groupBy("node").agg(F.sum("seen").alias("seen")).filter(
        F.col("seen") >= max(32, COMMON / 2 * total)).select("node").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def _bit_array(values: DataFrame, slot, bits: int) -> np.ndarray:
    """2^bits bits, set at the slot of every row; a fixed size, whatever the rows."""
    pages = values.groupBy(F.bitmap_bucket_number(slot + 1).alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    found = np.zeros(1 << bits >> 3, np.uint8)
    for page, page_bits in pages.toLocalIterator():
        at = (page - 1) * 4096
        found[at:at + 4096] |= np.frombuffer(page_bits, np.uint8)[:len(found) - at]
    return found


def _has(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    # Least significant bit first, as Spark builds them.
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def key_table(docs: DataFrame, common: np.ndarray, percent: int, seen=None) -> DataFrame:
    """(key, node) for every document: all its keys, or those used where ``seen``, a broadcast list
    of bit arrays over key slots, tells which keys have at least so many documents as ``SEEN`` says."""
    bands = Bands(percent)

    def level(key):
        return sum(_has(bits, (key >> np.uint64(64 - n)).astype(np.int64)).astype(np.int64) for bits, n in zip(seen.value, KEY_BITS))

    def keys(batches):
        for batch in batches:
            for _, found in blocks.shingle_sets(batch.column(0)):
                node = fingerprints(found)
                for key, owner in sketch_keys(found, node, common, bands, level if seen else None):
                    if len(key):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(blocks.signed(key)), pa.array(blocks.signed(owner))], names=["key", "node"])
    return docs.select("text").mapInArrow(keys, "key bigint, node bigint")


def linked_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    return classes(docs, percent).select("doc_id", "n_shingles", "component_id")


def first_of_classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` with one row left of each class; ids and texts may repeat or be null.

    Rows without words are no copies of each other and stay.
    """
    found = stash(classes(docs, percent).select("doc_id", "text_key", "n_shingles", "kept"))
    gone = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.xxhash64("text"))
    left = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_anti")
    # Rows that repeat in id and text are one class; few of them are left, so only those are brought together.
    twice = stash(found.filter("kept AND n_shingles > 0").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    if twice.isEmpty():
        return left.select(*docs.columns)
    repeated = left.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left").withColumn("_again", F.col("_key").isNotNull())
    once = repeated.filter("_again").dropDuplicates(["doc_id", "_text_key"])
    return repeated.filter("NOT _again").unionByName(once).select(*docs.columns)


def classes(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and whether the row is the one of its class to keep."""
    small_batches(docs.sparkSession)
    table = stash(set_table(docs))
    whole = table.filter("n_shingles IS NOT NULL")
    rows = whole.select("doc_id", "text_key", "n_shingles", "node")
    nodes = stash(whole.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r"), *[F.first(c).alias(n) for c, n in (
            ("n_shingles", "size"), ("level", "level"), ("fine", "fine"), ("coarse", "coarse"))]).select(
        "node", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("text_key"), "size", "level", "fine", "coarse"))
    common = _common(table)
    # Copies count too: that only makes a key look more frequent, alike for all who have it.
    found = stash(key_table(docs, common, percent).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= SEEN[0]))
    bits = docs.sparkSession.sparkContext.broadcast([
        _bit_array(found.filter(F.col("n") >= n), F.shiftrightunsigned("key", 64 - b), b) for n, b in zip(SEEN, KEY_BITS)])
    # The second pass sends little: documents without a partner have mostly keys of their own. A key's rows are folded by node first.
    sent = stash(key_table(docs, common, percent, bits).distinct())
    met = met_nodes(sent)

    items = stash(set_items(docs, nodes.select("node", "rep", "text_key").join(met.select("node").distinct(), "node", "left_semi"), blocks.SHINGLE))
    return named_rows(rows, nodes, star_roots(met, nodes, items, percent))
