"""Token-id files: concatenated ids with Elias-Fano document boundaries.

A corpus is a folder of segments, one row each, written by Spark's own committed writer (so any
store will do and a lost task is written anew): the document ids of the segment, its boundaries
as an Elias-Fano block, and its ids as little-endian unsigned numbers of ``width`` bytes. A
segment closes at the first document end at or after ``SEGMENT`` ids; ``part`` numbers the
range partitions in order and ``part_start`` counts the ids before the segment in its part, so
only one offset per part (not per document or segment) is ever held in memory.

Encoding: a word's ids do not depend on its neighbours, so each worker process encodes every distinct
piece once (``CACHED_PIECES`` at most are kept) with the tokenizers library and gathers ids by piece number. Pieces are cut at white
space and between an ASCII letter and ASCII punctuation, where the tokenizer cuts as well; texts
that may hold special-token strings are encoded whole. A piece is recognised by a 64-bit hash.

Defined cases: a null or empty text is a document of the end id alone; repeated ids stay
separate documents; null ids come first; an empty table makes an empty folder and reads back as
no rows; a text longer than a segment gets a segment of its own size. Further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small_batches
from . import blocks, elias_fano

SEGMENT = 1 << 20
CACHED_PIECES = 1 << 20
_LAYOUT = "part int, part_start bigint, n_tokens bigint, width int, doc_ids array<bigint>, bounds binary, ids binary"
_LETTER, _MARK = 1, 2


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[*range(65, 91), *range(97, 123)]] = _LETTER
    kind[[ord(c) for c in '.,;:!?*%&$#()-_/@+=~^`"[]{}']] = _MARK
    return kind


_KIND = _classes()


class PieceEncoder:
    """Ids of whole texts, remembering the ids of each distinct piece."""

    def __init__(self, tokenizer, specials: bool = True):
        self.tokenizer = tokenizer
        self.known = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int32)
        self.values = np.zeros(0, np.uint32)

    def _learn(self, hashes, strings):
        found = [e.ids for e in self.tokenizer.encode_batch(strings, add_special_tokens=False)]
        lengths = np.array([len(f) for f in found], np.int32)
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(lengths.sum()))
        begin = len(self.values) + np.cumsum(lengths, dtype=np.int64) - lengths
        slots = len(self.start) + np.arange(len(found), dtype=np.int32)
        self.values = np.concatenate([self.values, flat])
        self.start, self.length = np.concatenate([self.start, begin]), np.concatenate([self.length, lengths])
        at = np.searchsorted(self.known, hashes)  # both are sorted
        self.known, self.slot = np.insert(self.known, at, hashes), np.insert(self.slot, at, slots)

    def _slots(self, distinct, data, starts, ends):
        """Slot of each distinct hash, encoding those not met before."""
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            if len(self.known) + int(new.sum()) > CACHED_PIECES:
                # The cache starts anew with all pieces of this block, however many they are.
                self.__init__(self.tokenizer)
                new[:] = True
            self._learn(distinct[new], [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(
                starts[new].tolist(), ends[new].tolist())])
            at = np.searchsorted(self.known, distinct)
            assert np.array_equal(self.known[at], distinct)
        return self.slot[at]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of a block of texts."""
        starts, ends, first = self._pieces(data, offsets)
        count = np.zeros(len(offsets) - 1, np.int64)
        ids = np.zeros(0, np.uint32)
        if len(starts):
            hashes = blocks.span_hashes(data, starts, ends)
            distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            slots = self._slots(distinct, data, starts[example], ends[example])[inverse]
            lengths = self.length[slots].astype(np.int64)
            ids = self.values[blocks.ranges(self.start[slots], lengths)]
            total = np.concatenate([[0], np.cumsum(lengths)])
            count = total[first[1:]] - total[first[:-1]]
        special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))) if len(data) > 1 else []
        if len(special):
            rows = np.unique(np.searchsorted(offsets, special, "right") - 1)
            per_text = np.split(ids, np.cumsum(count)[:-1])
            for r in rows.tolist():
                text = data[offsets[r]:offsets[r + 1]].tobytes().decode("utf-8", "replace")
                per_text[r] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, count = np.concatenate(per_text), np.array([len(t) for t in per_text], np.int64)
        return ids, count

    @staticmethod
    def _pieces(data, offsets):
        starts, ends, _ = blocks.word_spans(data, offsets)
        if len(data) > 1:
            kind = _KIND[data]
            cut = np.flatnonzero(kind[1:] + kind[:-1] == _LETTER + _MARK) + 1
            cut = cut[(kind[cut] != 0) & (kind[cut - 1] != 0)]
            cut = cut[~np.isin(cut, offsets)] if len(cut) else cut
            starts = np.sort(np.concatenate([starts, cut]))
            ends = np.sort(np.concatenate([ends, cut]))
        return starts, ends, np.searchsorted(starts, offsets)


@functools.lru_cache(maxsize=1)
def process_encoder(tokenizer_path: str) -> PieceEncoder:
    """The encoder of this process: tasks that follow each other in a worker know the pieces of those before."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return PieceEncoder(Tokenizer.from_file(tokenizer_path))


def with_end(ids: np.ndarray, count: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(count), end_id, np.uint32)
    body = np.ones(len(out), bool)
    body[np.cumsum(count + 1) - 1] = False
    out[body] = ids
    return out


def write_corpus(docs: DataFrame, path: str, tokenizer_path: str, end_id: int,
                 order: tuple[str, ...] = ("doc_id",), segment: int = SEGMENT) -> None:
    """Encodes every text of ``docs`` in the order of the columns ``order`` and writes the segments."""
    def encode(batches):
        encoder = process_encoder(tokenizer_path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        held, bounds, names, part, written = [], [], [], 0, 0

        def close():
            nonlocal written
            ids = np.concatenate(held)
            ends = np.cumsum(np.concatenate(bounds))
            row = pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([written]), pa.array([len(ids)]), pa.array([width], pa.int32()),
                pa.array([[n for group in names for n in group.to_pylist()]], pa.list_(pa.int64())),
                pa.array([elias_fano.encode(ends, len(ids))], pa.binary()),
                pa.array([ids.astype(f"<u{width}").tobytes()], pa.binary())],
                names=["part", "part_start", "n_tokens", "width", "doc_ids", "bounds", "ids"])
            written += len(ids)
            held.clear(), bounds.clear(), names.clear()
            return row

        size = 0
        for batch in batches:
            for row, stop, data, offsets in blocks.text_blocks(batch.column(1), 1 << 20):
                part = batch.column(2)[row].as_py()
                ids, count = encoder.encode(data, offsets)
                held.append(with_end(ids, count, end_id))
                bounds.append(count + 1)
                names.append(batch.column(0).slice(row, stop - row))
                size += len(held[-1])
                if size >= segment:
                    yield close()
                    size = 0
        if held:
            yield close()

    small_batches(docs.sparkSession)
    wanted = docs.select(F.col("doc_id").cast("bigint"), "text", *[c for c in order if c != "doc_id"])
    # Ties beyond the order columns (repeated ids) are settled by the text itself.
    ranged = wanted.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ranged.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, _LAYOUT).write.mode(
        "overwrite").option("compression", "zstd").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (little-endian unsigned 32-bit) of every document."""
    segments = spark.read.schema(_LAYOUT).parquet(path)
    # One row per part, as many as the writer had tasks.
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, offsets = 0, {}
    for part, n in totals:
        offsets[part] = before
        before += n

    def decode(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, part_start, width = (batch.column(c)[i].as_py() for c in (0, 1, 2))
                ends = elias_fano.EliasFano(batch.column(4)[i].as_py()).all()
                ids = np.frombuffer(batch.column(5)[i].as_buffer(), f"<u{width}").astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                view = memoryview(ids.tobytes())
                for lo in range(0, len(ends), 1024):
                    hi = min(lo + 1024, len(ends))
                    spans = [view[4 * a:4 * b] for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(3)[i].values.slice(lo, hi - lo), pa.array(starts[lo:hi] + part_start + offsets[part]),
                        pa.array(ends[lo:hi] - starts[lo:hi]), pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                        pa.array([bytes(s) for s in spans], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
    return segments.select("part", "part_start", "width", "doc_ids", "bounds", "ids").mapInArrow(
        decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
