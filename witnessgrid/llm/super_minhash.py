"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

Every shingle of a document walks its own pseudo-random permutation of the ``SLOTS`` signature
slots: at step j it reaches one slot it has not been to and offers the value ``j`` plus a fraction.
A slot keeps the least offer. The ranks of one shingle are all different, which spreads the
minima over the slots better than independent hashes do and lowers the variance of the share of
equal slots. Later steps only offer larger values, so a document stops as soon as all its slots
are filled: after about ``SLOTS * ln(SLOTS) / shingles`` steps, one step for long texts.

* Bands: ``BANDS`` fixed choices of ``ROWS`` slots. Documents of Jaccard similarity 0.8 agree in at
  least one band but for a chance of about 3e-8, more similar ones miss each other less often still;
  sets of more than about 300 shingles are also
  compared by sampled sketches with five standard deviations of slack, which a pair exactly at the threshold
  misses with a probability below 1e-6; these are the only ways a link can be lost. Unlike documents (0.3 and less) meet in a band
  for at most one pair in twenty.
* Equal sets are one node before anything is compared, so exact copies cost nothing further.
* Verification compares whole sets, star by star (``stars``), so every pair of a band ends up linked, in
  one class, or compared; links shrink to spanning forests by union-find inside the tasks.

Defined cases: null, empty or wordless text has an empty set, no links and itself as class;
fewer words than a shingle has are one shingle; rows of one id are separate documents; a row with a
null id takes part, never gives its class a name and is kept only where all ids of its class are
null; an empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stash
from . import blocks
from .stars import bit_sketches, fingerprints, met_nodes, named_rows, set_items, star_roots

SLOTS, BANDS, ROWS = 256, 72, 6
_ELEMENTS = 1 << 15
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OPEN = np.uint64(2**64 - 1)


def _band_slots() -> np.ndarray:
    """The slots of each band, a fixed choice that all tasks share."""
    rng = np.random.default_rng(72006)
    return np.stack([rng.choice(SLOTS, ROWS, replace=False) for _ in range(BANDS)])


def _offers(elements: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, pick) of each element at ``step``: 48 random bits below the step, and a slot position from it on."""
    random = blocks.mix(elements + np.uint64((step + 1) * int(_STEP) & 2**64 - 1))
    pick = step + (((random & np.uint64(0xFFFF)) * np.uint64(SLOTS - step)) >> np.uint64(16)).astype(np.int64)
    return (np.uint64(step) << np.uint64(48)) | (random >> np.uint64(16)), pick


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SLOTS) signature values of non-empty shingle sets."""
    out = np.full((len(sets), SLOTS), _OPEN, np.uint64)
    flat = out.reshape(-1)
    lengths = np.array([len(s) for s in sets], np.int64)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    value, first = _offers(elements, 0)
    np.minimum.at(flat, owner * SLOTS + first, value)
    unfilled = (out == _OPEN).any(axis=1)
    starts = np.cumsum(lengths) - lengths
    # Only documents with open slots need permutations, a bounded number of elements at a time.
    waiting = np.flatnonzero(unfilled)
    group = (np.cumsum(lengths[waiting]) - 1) // _ELEMENTS
    for g in np.unique(group):
        docs = waiting[group == g]
        at = blocks.ranges(starts[docs], lengths[docs])
        e, d, picked = elements[at], owner[at], first[at]
        order = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(at), 1))
        row = np.arange(len(at))
        order[row, picked] = order[row, 0]
        for step in range(1, SLOTS):
            value, pick = _offers(e, step)
            slot = order[row, pick]
            order[row, pick] = order[row, step]
            np.minimum.at(flat, d * SLOTS + slot, value)
            docs_open = docs[(out[docs] == _OPEN).any(axis=1)]
            if len(docs_open) < len(docs):
                docs = docs_open
                if not len(docs):
                    break
                keep = np.isin(d, docs)
                e, d, row = e[keep], d[keep], row[keep]
    return out


def band_keys(signature: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """(documents, bands) join keys, one for the slots of each band."""
    key = np.broadcast_to(blocks.mix(np.arange(1, len(bands) + 1, dtype=np.uint64) * _STEP), (len(signature), len(bands)))
    for position in range(bands.shape[1]):
        key = blocks.mix(key ^ signature[:, bands[:, position]])
    return key


def signed_documents(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (fingerprint of the set; null if empty) and its band keys."""
    bands = _band_slots()

    def sign(batches):
        for batch in batches:
            for row, found in blocks.shingle_sets(batch.column(2), size):
                n = np.array([len(s) for s in found], np.int64)
                full = np.flatnonzero(n)
                level, fine, coarse = bit_sketches(found)
                keys = band_keys(signatures([found[i] for i in full]), bands)
                ends = np.zeros(len(found) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(row, len(found)), batch.column(1).slice(row, len(found)), pa.array(n),
                    pa.array(blocks.signed(fingerprints(found)), mask=n == 0),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(blocks.signed(keys).ravel())), level, fine, coarse],
                    names=["doc_id", "text_key", "n_shingles", "node", "keys", "level", "fine", "coarse"])
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        sign, "doc_id bigint, text_key bigint, n_shingles bigint, node bigint, keys array<bigint>, "
              "level bigint, fine array<bigint>, coarse array<bigint>")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    rows = stash(signed_documents(docs, size))
    nodes = stash(rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("r"),
        *[F.first(c).alias(n) for c, n in (("keys", "keys"), ("n_shingles", "size"), ("level", "level"), ("fine", "fine"), ("coarse", "coarse"))]).select(
        "node", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("text_key"), "keys", "size", "level", "fine", "coarse"))
    met = met_nodes(nodes.select(F.explode("keys").alias("key"), "node"))
    items = stash(set_items(docs, nodes.select("node", "rep", "text_key").join(met.select("node").distinct(), "node", "left_semi"), size))
    roots = star_roots(met, nodes, items, percent)
    found = named_rows(rows.select("doc_id", "text_key", "n_shingles", "node"), nodes, roots)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
