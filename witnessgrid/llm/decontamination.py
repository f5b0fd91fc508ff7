"""Benchmark decontamination: containment search for short items inside long documents.

An item of q distinct five-word shingles is in a document if at least ``percent`` of them are.
The items' MinHash sketches are their smallest shingle hashes. Items are partitioned by size
(powers of two), and a partition of items up to u shingles keeps ``u - ceil(percent * u) + 1``
values: at most that many less one may be missing, so a document that contains the item holds a
sketch value for certain. Documents probe with all their shingles, and only items whose needed
overlap is not above the document's own size count. Candidates are checked on whole sets of
shingle strings. All of it is DataFrame functions; nothing runs in Python.

Words are ``[^\\x20\\x09-\\x0D]+`` of the lower-cased text. Defined cases: null or wordless texts
and items have no shingles and match nothing; with fewer than five words the whole sequence is one
shingle, found in texts of just these words; a repeated item id is two items with that id, reported
once per document with the larger share; a repeated document id is looked up once per distinct
text; empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stash

# Sketch values (16 bytes and an id each) up to this many are broadcast; more are joined by shuffle.
BROADCAST_SKETCHES = 1_000_000
_WORDS = "split(btrim(lower(text), ' \\t\\n\\u000b\\u000c\\r'), '[\\\\x20\\\\x09-\\\\x0D]+')"
# The words are bound to a lambda's variable: as a column they would be split anew for each shingle.
_HASHES = f"""transform(array({_WORDS}), w -> CASE WHEN size(w) >= 5
  THEN transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))
  ELSE array(xxhash64(concat_ws(' ', w))) END)[0]"""
_STRINGS = f"""array_distinct(transform(array({_WORDS}), w -> CASE WHEN size(w) >= 5
  THEN transform(sequence(0, size(w) - 5), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))
  ELSE array(concat_ws(' ', w)) END)[0])"""


def _worded(rows: DataFrame) -> DataFrame:
    """Rows whose text has a word."""
    return rows.filter("text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(hash, item_id, needed): the MinHash sketch of every item by its size partition."""
    sets = _worded(items.select("item_id", "text")).select("item_id", F.sort_array(F.array_distinct(F.expr(_HASHES))).alias("set"))
    top = F.pow(F.lit(2), F.floor(F.log2(F.size("set"))) + 1) - 1
    length = (top - F.ceil(top * percent / 100) + 1).cast("int")
    return sets.select(
        "item_id", F.ceil(F.size("set") * F.lit(percent) / 100).alias("needed"),
        F.explode(F.slice("set", F.lit(1), length)).alias("hash"))


def contained(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, text_key, item_id, item_shingles, shared, containment of every item found in a document.

    ``text_key`` is xxhash64 of the text, which tells repeated ids apart.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    key = F.xxhash64("text").alias("text_key")
    probes = stash(sketches(items, percent))
    if probes.count() <= BROADCAST_SKETCHES:
        probes = F.broadcast(probes)
    probing = _worded(docs).select("doc_id", key, F.expr(_HASHES).alias("set")).select(
        "doc_id", "text_key", F.size("set").alias("size"), F.explode("set").alias("hash"))
    found = probing.join(probes, "hash").filter("size >= needed").select("doc_id", "text_key", "item_id").distinct()
    # Few rows: what holds a sketch value. Their texts are read again for the exact check.
    candidates = stash(found)
    item_sets = _worded(items.select("item_id", "text")).select("item_id", F.expr(_STRINGS).alias("item_set"))
    same = docs.withColumn("text_key", F.xxhash64("text")).join(
        candidates.withColumnsRenamed({"doc_id": "id", "text_key": "k"}),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("k")))
    shared = _worded(same.select("doc_id", "text_key", "item_id", "text")).select(
        "doc_id", "text_key", "item_id", F.expr(_STRINGS).alias("doc_set")).join(item_sets, "item_id").select(
        "doc_id", "text_key", "item_id", F.size("item_set").alias("item_shingles"),
        F.size(F.array_intersect("doc_set", "item_set")).alias("shared"))
    enough = shared.filter(F.col("shared") * 100 >= F.col("item_shingles") * percent)
    best = enough.groupBy("doc_id", "text_key", "item_id").agg(
        F.max_by(F.struct("item_shingles", "shared"), F.col("shared") / F.col("item_shingles")).alias("m"))
    return best.select("doc_id", "text_key", "item_id", "m.item_shingles", "m.shared",
                       (F.col("m.shared") / F.col("m.item_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns."""
    dirty = stash(contained(docs, items, percent).select(F.col("doc_id").alias("_id"), "text_key").distinct())
    return docs.join(dirty, docs["doc_id"].cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("text_key")), "left_anti")
