"""Language identification: multinomial naive Bayes over hashed character n-grams.

Learning counts the n-grams of every labelled text, with no sample: each task sums one dense
block of counts, Spark adds the non-zero cells. The log-probability matrix has ``BUCKETS`` rows
and one column per language, whatever the corpus; it is broadcast, and texts are scored in numpy
as sums of matrix rows over their n-grams.

Defined cases: a text that is null or holds no letter is ``und`` with score 0; null labels teach
nothing; languages that never occur are never predicted; with no learnable row at all everything
is ``und``; a tie goes to the language first in code-point order; repeated rows count as often as
they occur; long texts are scored whole. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
# Bounds the matrix (BUCKETS x languages) and its broadcast.
MAX_LANGUAGES = 500
UNDETERMINED = "und"
_SMOOTHING = 0.5
_BLOCK_CHARS = 1 << 20


def id_part(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def _gram_buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that ends at each character, one array per order."""
    multipliers = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
    found = []
    total = np.zeros(len(codes), np.uint32)
    for order in range(1, max(ORDERS) + 1):
        total[order - 1:] += codes[:len(codes) - order + 1] * np.uint32(multipliers[order - 1])
        if order in ORDERS:
            x = total + np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            found.append(x >> np.uint32(16))
    return found


def _text_groups(texts: list, limit: int = _BLOCK_CHARS):
    """Runs of texts of about ``limit`` characters: (first, codes of all, offsets)."""
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        # A text begins and ends with a space, which also keeps n-grams apart between texts.
        held.append(f" {(text or '').lower()} ".encode("utf-32-le", "replace"))
        size += len(held[-1]) // 4
        if size >= limit or i + 1 == len(texts):
            codes = np.frombuffer(b"".join(held), np.uint32)
            yield first, codes, np.cumsum([0] + [len(h) // 4 for h in held])
            held, first, size = [], i + 1, 0


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang); bucket -1 counts texts."""
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for first, codes, offsets in _text_groups(batch.column(0).to_pylist()):
                grams = _gram_buckets(codes)
                names, which = np.unique(langs[first:first + len(offsets) - 1], return_inverse=True)
                cell = np.repeat(which, np.diff(offsets)) * BUCKETS
                seen = sum(np.bincount(cell + g, minlength=len(names) * BUCKETS) for g in grams)
                for k, name in enumerate(names.tolist()):
                    held = totals.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                    held[:-1] += seen[k * BUCKETS:(k + 1) * BUCKETS]
                    held[-1] += int((which == k).sum())
        for name, held in totals.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([
                pa.array([name] * len(at)), pa.array(np.where(at == BUCKETS, -1, at)), pa.array(held[at])],
                names=["lang", "bucket", "n"])
    return rows.select("text", "lang").mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))


class Model:
    """Languages, log prior and log-probability matrix."""

    def __init__(self, languages: list[str], prior: np.ndarray, matrix: np.ndarray):
        self.languages, self.prior, self.matrix = languages, prior, matrix


def fit(rows: DataFrame) -> Model:
    """Learns from every row with text and label."""
    usable = rows.filter("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r[0] for r in usable.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    column = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((BUCKETS, max(1, len(languages))))
    texts = np.ones(max(1, len(languages)))
    for lang, bucket, n in count_grams(usable).toLocalIterator():
        if bucket < 0:
            texts[column[lang]] = n
        else:
            counts[bucket, column[lang]] = n
    counts += _SMOOTHING
    return Model(languages, np.log(texts / texts.sum()), np.log(counts / counts.sum(0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row, with lang_pred and the posterior probability as score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            names, scores = [], []
            for first, codes, offsets in _text_groups(texts):
                sums = np.zeros((len(offsets) - 1, model.matrix.shape[1]))
                for grams in _gram_buckets(codes):
                    sums += np.add.reduceat(model.matrix[grams], offsets[:-1], axis=0, dtype=np.float64)
                sums += model.prior
                best = sums.argmax(1)
                chance = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for k, text in enumerate(texts[first:first + len(best)]):
                    known = bool(model.languages) and text is not None and any(map(str.isalpha, text))
                    names.append(model.languages[best[k]] if known else UNDETERMINED)
                    scores.append(float(chance[k]) if known else 0.0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(score, schema)
