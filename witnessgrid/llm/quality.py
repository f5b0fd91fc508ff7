"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a row of numbers (:data:`FEATURES`). Boosting visits the features in turn; each
visit fits a tree of at most four leaves to the current gradient over one feature's bins and adds
it, shrunk, to that feature's lookup table. The pairs of features whose best four-way split
explains most of what is left get tables over coarser bins in the same way. A score is the sum
of one table entry per feature and pair, taken for whole batches at once.

Features cover every document and whole texts and are computed once. The model is fitted on at
most ``SAMPLE_ROWS`` labelled rows (taken by a hash of the id), as features, so what reaches the
driver is bounded by that parameter.

Defined cases: a null text counts as empty and gets the score of an empty text; null labels and
labels of unknown ids teach nothing; an id labelled twice teaches twice; with one class only, or no
labels, every score is the share of label 1 (0 without labels); repeated rows are scored each.
Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stash
from . import blocks
from .language_id import id_part
from .toxicity import bounded_sample, labelled

FEATURES = (
    "log_words", "log_bytes", "word_bytes", "longest_word", "upper_share", "symbol_share", "mark_share", "bang_share",
    "digit_share", "high_share", "line_words", "distinct_share", "top_word_share", "repeat_share", "symbol_words", "copied_lines")
SAMPLE_ROWS = 40_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 200, 80, 0.1
_PULL = 1.0
_UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK, _BANG, _HIGH, _LINE = range(1, 9)


def _byte_kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
    kind[[ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"]] = _SYMBOL
    kind[[ord(c) for c in ".,;:'\"()-"]] = _MARK
    kind[[ord(c) for c in "!?"]] = _BANG
    kind[ord("\n")] = _LINE
    return kind


_KINDS = _byte_kinds()


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def block_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text of a block."""
    n = len(offsets) - 1
    kinds = _KINDS[data]
    count = {k: _sums(kinds == k, offsets).astype(float) for k in range(1, 9)}
    size = np.diff(offsets).astype(float)
    starts, ends, first = blocks.word_spans(data, offsets)
    words = np.diff(first).astype(float)
    hashes = blocks.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    lengths = ends - starts
    odd = np.isin(kinds[ends - 1], (_SYMBOL, _BANG)) if len(ends) else np.zeros(0, bool)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[first[:-1][first[:-1] < first[1:]]] = False
    # Lines: a text ends its last line.
    breaks = np.union1d(np.flatnonzero(kinds == _LINE) + 1, offsets)
    line_starts, line_ends = breaks[:-1], breaks[1:]
    line_hashes = blocks.span_hashes(data, line_starts, line_ends) if len(data) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(line_starts, offsets)
    longest, distinct, top, copied = (np.zeros(n) for _ in range(4))
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b > a:
            found, seen = np.unique(hashes[a:b], return_counts=True)
            longest[i], distinct[i], top[i] = lengths[a:b].max(), len(found), seen.max()
        a, b = line_first[i], line_first[i + 1]
        if b > a + 1:
            copied[i] = 1 - len(np.unique(line_hashes[a:b])) / (b - a)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    letters = np.maximum(count[_UPPER] + count[_LOWER], 1)
    return np.column_stack([
        np.log1p(words), np.log1p(size), (size - words) / per_word, np.log1p(longest), count[_UPPER] / letters,
        count[_SYMBOL] / per_byte, count[_MARK] / per_byte, count[_BANG] / per_byte, count[_DIGIT] / per_byte,
        count[_HIGH] / per_byte, np.log1p(words / (count[_LINE] + 1)), distinct / per_word, top / per_word,
        _sums(same, first) / per_word, _sums(odd, first) / per_word, copied])


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and the array ``features`` of every row."""
    schema = docs.select(*keep, F.lit(None).cast("array<double>").alias("features")).schema

    def compute(batches):
        for batch in batches:
            for row, stop, data, offsets in blocks.text_blocks(batch.column(0)):
                found = block_features(data, offsets)
                at = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES))
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(row, stop - row) for c in batch.columns[1:]], pa.ListArray.from_arrays(at, pa.array(found.ravel()))],
                    names=[*keep, "features"])
    return docs.select(F.col("text").alias("_text"), *keep).mapInArrow(compute, schema)


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value of each bin in the best small tree over ordered bins."""
    whole = -gradient.sum() / (weight.sum() + _PULL)
    if depth and len(gradient) > 1:
        g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        rest_g, rest_w = gradient.sum() - g, weight.sum() - w
        gain = g * g / (w + _PULL) + rest_g * rest_g / (rest_w + _PULL)
        at = int(gain.argmax()) + 1
        if gain[at - 1] > gradient.sum() ** 2 / (weight.sum() + _PULL) + 1e-9:
            return np.concatenate([_tree(gradient[:at], weight[:at], depth - 1), _tree(gradient[at:], weight[at:], depth - 1)])
    return np.full(len(gradient), whole)


def _quarters(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a pair's grid into four by one cut a side."""
    def corners(grid):
        total = grid.cumsum(0).cumsum(1)
        low = total[:-1, :-1]
        right, below = total[:-1, -1:] - low, total[-1:, :-1] - low
        return low, right, below, total[-1, -1] - low - right - below
    gs, ws = corners(gradient), corners(weight)
    gain = sum(g * g / (w + _PULL) for g, w in zip(gs, ws))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    values = [-g[i, j] / (w[i, j] + _PULL) for g, w in zip(gs, ws)]
    rows, columns = np.arange(gradient.shape[0])[:, None] > i, np.arange(gradient.shape[1])[None, :] > j
    return float(gain[i, j]), np.where(rows, np.where(columns, values[3], values[2]), np.where(columns, values[1], values[0]))


class Model:
    """Bin cuts and lookup tables of single features and pairs."""

    def __init__(self, base: float, cuts=(), tables=(), pair_cuts=(), pairs=()):
        self.base, self.cuts, self.tables, self.pair_cuts, self.pairs = base, cuts, tables, pair_cuts, pairs

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.pair_cuts)]
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return total

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of the logistic loss; ``x`` rows of features, ``y`` 0 or 1."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(float(np.log(np.clip(share, 1e-12, 1 - 1e-12) / np.clip(1 - share, 1e-12, 1))))
    base = float(np.log(y.mean() / (1 - y.mean())))
    cuts = [_cuts(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    margin = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-margin))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
            tables[j] += step
            margin += step[b]
    pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]

    def grid(i, j, values):
        shape = len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quarters(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)
                     if len(pair_cuts[i]) and len(pair_cuts[j])), reverse=True)[:PAIRS]
    pairs = [(i, j, np.zeros((len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            g, h = slopes()
            step = RATE * _quarters(grid(i, j, g), grid(i, j, h))[1]
            table += step
            margin += step[coarse[i], coarse[j]]
    return Model(base, cuts, tables, pair_cuts, pairs)


def fit_rows(rows: DataFrame) -> Model:
    """Fits on rows (doc_id, features, quality), on about SAMPLE_ROWS of them at most."""
    usable = rows.filter("quality IS NOT NULL").select("doc_id", "features", "quality")
    usable = bounded_sample(usable, SAMPLE_ROWS)
    table = usable.toArrow()
    flat = [c.flatten().to_numpy() for c in table.column("features").chunks]
    x = np.concatenate(flat).reshape(-1, len(FEATURES)) if flat else np.zeros((0, len(FEATURES)))
    return fit(x, (table.column("quality").to_numpy() > 0).astype(float))


def score(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns and score of rows with ``features``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.select(*keep, F.lit(0.0).alias("score")).schema

    def add(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.chance(x))], names=[*keep, "score"])
    return rows.select("features", *keep).mapInArrow(add, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: rows whose id part is 0 of 5 teach nothing."""
    rows = stash(features(docs.select(F.col("doc_id").cast("bigint"), "text"), ["doc_id"]))
    part = id_part(F.col("doc_id"), 5)
    model = fit_rows(labelled(rows.filter(part != 0), labels, "quality"))
    return score(rows, model, ["doc_id"]).select(
        "doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
