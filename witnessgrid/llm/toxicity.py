"""Toxicity from two class-conditional Kneser-Ney bigram models with shared backoff counts.

The toxic and the plain model share one backoff chain: bigram, word, corpus. As in Kneser-Ney
smoothing a level counts distinct left contexts, not occurrences (so copies of a text teach no
more than one), and every level discounts its counts and gives the mass to the level below. The two classes differ much in size,
so a constant discount would make each rare word of the larger class look harmless. Here the
discount is taken from a class's excess over what the shared level below predicts: the
expectation again (what a topic or a language's share of a class explains) and ``DISCOUNT``
standard deviations. A rare expression so has the shared probability in both models and cancels;
what a class uses clearly more keeps its own. The log-likelihood ratio of a text is then a sum of stored weights over its words and
bigrams, almost all zero and not stored; the signed root of its mean per word is calibrated to a
probability by logistic regression.

Counts cover every labelled text outside the calibration sample and are summed by Spark. Words are runs of letters with A-Z
lower-cased, known by 32-bit hashes. The weights reach the tasks in slices of at most ``SLICE``
entries; with more slices, texts pass through one scoring step per slice, so a larger model needs
more steps and no larger broadcast. The calibration is fitted on labelled rows that give no counts:
a hash sample of about half of ``CALIBRATION_ROWS`` from each class, a quarter of a class at most,
weighted back to the classes' numbers. If that would take every row of a class, none are held out.

Defined cases: a null text or one without letters has the mean 0 and the score that goes with
it; null labels and labels of unknown ids teach nothing; an id labelled twice teaches twice;
with only one class labelled, or none, every score is the share of toxic labels (0 without any);
repeated rows are scored each. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stash
from . import blocks
from .language_id import id_part

DISCOUNT = 3.0
_PRIOR_COUNT = 1.0
SLICE = 4 << 20
CALIBRATION_ROWS = 20_000
# Labels up to this many rows (16 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_LABELS = 4_000_000
_HELD = 2 << 20
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit word hashes, first word of each text and the count) of runs of letters."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _LETTERS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = letter[1:-1]
    starts = np.flatnonzero(inside & (~letter[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside & (~letter[2:] | edge[1:])) + 1
    hashes = blocks.span_hashes(data, starts, ends) >> np.uint64(32)
    return np.maximum(hashes, np.uint64(1)), np.searchsorted(starts, offsets)


def _pairs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(previous word, word) as one number; 0 stands before a text's first word."""
    before = np.zeros(len(words), np.uint64)
    before[1:] = words[:-1]
    before[first[:-1][first[:-1] < first[1:]]] = 0
    return before << np.uint64(32) | words


def count_pairs(rows: DataFrame) -> DataFrame:
    """(pair, toxic, plain): for each bigram and class, the number of different words seen before it.

    Tasks send every (pair, word before, class) once and Spark counts the distinct ones, so the counts
    have no bound and copies of a text add none.
    """
    def count(batches):
        def merged(parts):
            key, seen = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            order = np.lexsort((seen, key))
            key, seen = key[order], seen[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (seen[1:] != seen[:-1])]
            return key[new], seen[new]

        def out(part):
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks.signed(column)) for column in part], names=["pair", "seen"])

        held: list = []
        size = 0
        for batch in batches:
            label = batch.column(1).to_numpy() > 0
            for row, stop, data, offsets in blocks.text_blocks(batch.column(0)):
                words, first = _words(data, offsets)
                if not len(words):
                    continue
                key = _pairs(words, first)
                before = np.zeros(len(words), np.uint64)
                before[1:] = key[:-1] >> np.uint64(32)
                before[first[:-1][first[:-1] < first[1:]]] = 0
                toxic = np.repeat(label[row:stop], np.diff(first)).astype(np.uint64)
                held.append((key, before << np.uint64(1) | toxic))
                size += len(key)
                if size > _HELD:
                    part = merged(held)
                    if len(part[0]) > _HELD // 2:
                        yield out(part)
                        held, size = [], 0
                    else:
                        held, size = [part], len(part[0])
        if held:
            yield out(merged(held))
    # Dealt out by pair, distinct and count need no further shuffle.
    triples = rows.select("text", F.col("toxic").cast("int")).mapInArrow(count, "pair bigint, seen bigint").repartition("pair").distinct()
    toxic = F.col("seen").bitwiseAND(F.lit(1)) == 1
    return triples.groupBy("pair").agg(F.count_if(toxic).alias("toxic"), F.count_if(~toxic).alias("plain"))


def _share(toxic, plain, below):
    """Toxic share of an event after discounting, given the share ``below`` the next level predicts."""
    n = toxic + plain
    expected = n * below
    excess = toxic - expected
    discount = DISCOUNT * F.sqrt(expected * (1 - below) + below) + F.least(expected, n * (1 - below))
    left = F.greatest(F.abs(excess) - discount, F.lit(0.0))
    return (expected + F.signum(excess) * left + _PRIOR_COUNT * below) / (n + _PRIOR_COUNT)


def _gain(share, below):
    return (F.log(share / below) - F.log((1 - share) / (1 - below))).cast("float")


def weights(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, weight) of words and of bigrams, without zeros, from bigram counts."""
    counts = counts.withColumn("w", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    words = counts.groupBy("w").agg(
        F.count_if(F.col("toxic") != 0).alias("t"), F.count_if(F.col("plain") != 0).alias("o"))
    t, o = words.agg(F.sum("t"), F.sum("o")).first()
    corpus = F.lit(t / (t + o))
    shares = stash(words.select("w", _share(F.col("t"), F.col("o"), corpus).alias("below")))
    word_weights = shares.select(F.col("w").alias("key"), _gain(F.col("below"), corpus).alias("weight"))
    pairs = counts.join(shares, "w").select(
        F.col("pair").alias("key"), _gain(_share(F.col("toxic"), F.col("plain"), F.col("below")), F.col("below")).alias("weight"))
    some = F.abs("weight") > 1e-6
    return word_weights.filter(some), pairs.filter(some)


def _slices(weights: DataFrame) -> list:
    """The weight table as broadcasts of sorted arrays of at most about SLICE entries."""
    spark = weights.sparkSession
    total = weights.count()
    count = max(1, -(-total // SLICE))
    found = []
    for k in range(count):
        part = weights.filter(F.pmod(F.hash("key"), F.lit(count)) == k) if count > 1 else weights
        table = part.toArrow()
        key = table.column("key").to_numpy().view(np.uint64) if len(table) else np.zeros(0, np.uint64)
        order = np.argsort(key)
        value = table.column("weight").to_numpy()[order] if len(table) else np.zeros(0, np.float32)
        found.append(spark.sparkContext.broadcast((key[order], value)))
    return found


def log_ratios(docs: DataFrame, words: list, pairs: list, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_words and llr (sum of weights over the whole text) of every row."""
    steps = [(words[i] if i < len(words) else None, pairs[i] if i < len(pairs) else None)
             for i in range(max(len(words), len(pairs)))]
    found = docs.select("text", *keep, F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("llr"))
    schema = found.schema

    def step(word_table, pair_table):
        def add(batches):
            def look(table, keys):
                key, value = table.value
                if not len(key):
                    return np.zeros(len(keys))
                at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
                return np.where(key[at] == keys, value[at], 0)

            for batch in batches:
                llr = batch.column(len(batch.columns) - 1).to_numpy().copy()
                count = np.zeros(len(llr), np.int64)
                for row, stop, data, offsets in blocks.text_blocks(batch.column(0)):
                    tokens, first = _words(data, offsets)
                    gain = np.zeros(len(tokens) + 1)
                    if word_table is not None:
                        gain[1:] += look(word_table, tokens)
                    if pair_table is not None:
                        gain[1:] += look(pair_table, _pairs(tokens, first))
                    total = np.cumsum(gain)
                    llr[row:stop] += total[first[1:]] - total[first[:-1]]
                    count[row:stop] = np.diff(first)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-2], pa.array(count), pa.array(llr)], schema=batch.schema)
        return add

    for word_table, pair_table in steps:
        found = found.mapInArrow(step(word_table, pair_table), schema)
    return found.drop("text")


def labelled(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Rows of ``docs`` with the label ``column``; unlabelled ones go."""
    known = labels.select(F.col("doc_id").cast("bigint"), F.col(column).cast("int")).filter(f"doc_id IS NOT NULL AND {column} IS NOT NULL")
    if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.drop(column).join(known, "doc_id")


def bounded_sample(rows: DataFrame, most: int) -> DataFrame:
    """All rows if they are at most ``most``, else about that many, chosen by a hash of doc_id."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(most / total * (1 << 30)))


def calibrates(share: dict):
    """Condition of the calibration sample, from the number of rows of the toxic (True) and plain class."""
    most = {c: int(min(0.25, CALIBRATION_ROWS / 2 / n) * (1 << 30)) for c, n in share.items()}
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.when(F.col("toxic") > 0, most[True]).otherwise(most[False])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps, with a slight pull to zero."""
    a, b = 0.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w, miss = weight * (p * (1 - p) + 1e-9), weight * (p - y)
        gradient = np.array([(miss * x).sum() + 1e-2 * a, miss.sum() + 1e-2 * b])
        hessian = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        move = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(move[0], -5, 5), b - np.clip(move[1], -5, 5)
        if abs(move).max() < 1e-8:
            break
    return float(a), float(b)


class Model:
    def __init__(self, words=(), pairs=(), slope=0.0, intercept=0.0, center=0.0, scale=1.0, constant=None):
        self.words, self.pairs, self.constant = words, pairs, constant
        self.slope, self.intercept, self.center, self.scale = slope, intercept, center, scale


def fit(rows: DataFrame) -> Model:
    """Learns from rows (doc_id, text, toxic)."""
    usable = rows.filter("text IS NOT NULL AND toxic IS NOT NULL")
    share = {r[0]: r[1] for r in usable.groupBy(F.col("toxic") > 0).count().collect()}
    if len(share) < 2:
        return Model(constant=1.0 if share.get(True) else 0.0)
    chosen = calibrates(share)
    left = {r[0]: r[1] for r in usable.filter(~chosen).groupBy(F.col("toxic") > 0).count().collect()}
    if len(left) < 2:
        chosen, left = F.lit(False), share
    counts = stash(count_pairs(usable.filter(~chosen)))
    classes = counts.agg(F.count_if(F.col("toxic") != 0), F.count_if(F.col("plain") != 0)).first()
    if not classes[0] or not classes[1]:
        return Model(constant=share[True] / sum(share.values()))
    word_weights, pair_weights = weights(counts)
    words, pairs = _slices(word_weights), _slices(pair_weights)
    sample = log_ratios(usable.filter(chosen).select("text", "toxic"), words, pairs, ["toxic"]).toArrow()
    n = sample.column("n_words").to_numpy()
    mean = sample.column("llr").to_numpy() / np.maximum(n, 1)
    x, y = np.sign(mean) * np.sqrt(np.abs(mean)), (sample.column("toxic").to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(words, pairs, 1.0)
    center, scale = float(x.mean()), float(x.std()) or 1.0
    # Each class stands for all its rows; the weights have the mean 1.
    held = {c: n - left[c] for c, n in share.items()}
    weight = np.where(y > 0, share[True] / held[True], share[False] / held[False])
    slope, intercept = _logistic((x - center) / scale, y, weight / weight.mean())
    return Model(words, pairs, slope, intercept, center, scale)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with the probability of being toxic as score, n_words and mean_llr."""
    if model.constant is not None:
        return docs.select(*keep, F.lit(model.constant).alias("score"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0.0).alias("mean_llr"))
    found = log_ratios(docs, model.words, model.pairs, keep)
    mean = F.col("llr") / F.greatest("n_words", F.lit(1))
    root = F.signum(mean) * F.sqrt(F.abs(mean))
    odds = F.lit(model.slope) * (root - F.lit(model.center)) / F.lit(model.scale) + F.lit(model.intercept)
    return found.select(*keep, (1 / (1 + F.exp(-odds))).alias("score"), "n_words", mean.alias("mean_llr"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: rows whose id part is 0 of 5 teach nothing."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    part = id_part(F.col("doc_id"), 5)
    train = labelled(docs.filter(part != 0), labels, "toxic")
    model = fit(train)
    return score(docs, model, ["doc_id"]).select(
        "doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "mean_llr")
