"""Evaluation metrics as aggregates.

``keys`` lets one job score many runs (or slices, or label types) at once; an empty list gives
one overall row, also for empty input, where each metric has its own agreed value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import vocab
from ..functions import numbers, policy, text
from ..session import stash
from . import rules, skew


def label_matches(truth: DataFrame, predicted: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Distinct identities of both sides in one shuffle, flagged ``expected`` / ``predicted``."""
    t = truth.select(*identity).distinct().withColumn("expected", F.lit(True))
    p = predicted.select(*identity).distinct().withColumn("predicted", F.lit(True))
    return t.join(p, list(identity), "full_outer").select(
        *identity, F.coalesce("expected", F.lit(False)).alias("expected"),
        F.coalesce("predicted", F.lit(False)).alias("predicted"))


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("expected") & F.col("predicted")).alias("tp"),
        F.count_if("expected").alias("n_expected"), F.count_if("predicted").alias("n_predicted"),
    ]


def precision_recall_f1(matches: DataFrame, keys: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    """Set semantics; nothing expected and nothing predicted counts as perfect.

    ``extra``: further aggregates to carry along.
    """
    tp, exp, pred = F.col("tp"), F.col("n_expected"), F.col("n_predicted")
    extra = extra or {}
    counted = matches.groupBy(*keys).agg(*_counts(), *[a.alias(n) for n, a in extra.items()])
    scored = counted.select(
        *keys, "tp", "n_expected", "n_predicted", *extra,
        F.when(pred > 0, tp / pred).when(exp == 0, 1.0).otherwise(0.0).alias("precision"),
        F.when(exp > 0, tp / exp).when(pred == 0, 1.0).otherwise(0.0).alias("recall"))
    return scored.withColumn("f1", numbers.f1(F.col("precision"), F.col("recall")))


def class_f1(matches: DataFrame, class_cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """F1 of every class seen in truth or prediction: 2TP / (2TP + FP + FN)."""
    counted = matches.groupBy(*keys, *class_cols).agg(*_counts())
    return counted.withColumn("f1", 2.0 * F.col("tp") / (F.col("n_expected") + F.col("n_predicted")))


def macro_f1(matches: DataFrame, class_cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    per_class = class_f1(matches, class_cols, keys)
    return per_class.groupBy(*keys).agg(
        F.coalesce(numbers.decimal_sum(F.col("f1")).cast("double") / F.count(F.lit(1)), F.lit(1.0)).alias("macro_f1"),
        F.count(F.lit(1)).alias("class_count"))


def outside_universe(matches: DataFrame, classes: DataFrame, class_col: str) -> DataFrame:
    """Labels that an explicit class universe does not contain."""
    return matches.select(class_col).distinct().join(classes.select(class_col), class_col, "left_anti")


def calibration_error(observations: DataFrame, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error over equal-width bins of (confidence, correct)."""
    binned = observations.withColumn("bin", numbers.calibration_bin(F.col("confidence"), bins))
    high, low = numbers.unit_sum_parts(F.col("confidence"))
    per_bin = binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("hits"), high.alias("hi"), low.alias("lo"))
    gap = F.abs(F.col("hits") - numbers.unit_sum(F.col("hi"), F.col("lo")))
    return per_bin.groupBy(*keys).agg(
        F.coalesce(numbers.decimal_sum(gap).cast("double") / F.sum("n"), F.lit(0.0)).alias("ece"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"))


def word_error_rates(pairs: DataFrame, keys: list[str], ref: str, pred: str) -> DataFrame:
    """(keys, wer): token edit distance over reference length; null if a side is null.

    Tokens are numbered inside their pair, and the numbers become one character each. ``keys`` are unique.
    """
    def words(c: str) -> Column:
        return F.filter(F.split(F.translate(F.col(c), text.SPACES, " " * len(text.SPACES)), " "), lambda w: w != "")
    sides = F.array(*[F.struct(F.lit(side).alias("side"), words(c).alias("words")) for side, c in enumerate((ref, pred))])
    tokens = pairs.select(*keys, F.inline(sides)).select(*keys, "side", F.posexplode("words").alias("pos", "token"))
    # One window and one array hold the tokens of a single pair.
    coded = tokens.withColumn("code", F.dense_rank().over(Window.partitionBy(*keys).orderBy("token")))
    texts = coded.groupBy(*keys).agg(*[numbers.code_text(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("side") == side, F.struct("pos", "code")))), lambda t: t["code"])).alias(name) for side, name in enumerate(("_r", "_p"))])
    found = pairs.select(*keys, (F.col(ref).isNull() | F.col(pred).isNull()).alias("_none")).join(texts, keys, "left")
    rate = numbers.character_error_rate(F.coalesce("_r", F.lit("")), F.coalesce("_p", F.lit("")))
    return found.select(*keys, F.when(~F.col("_none"), rate).alias("wer"))


def text_error_rates(pairs: DataFrame, ref: str = "reference", pred: str = "prediction") -> DataFrame:
    """Per-sample character and word error rates, on raw and on cleaned text; equal pairs are worked out once."""
    c = F.col
    cleaned = text.computed(pairs, _rn=text.ocr_text(c(ref)), _pn=text.ocr_text(c(pred)))
    key = lambda x, y: F.sha2(F.to_json(F.struct(c(x).alias("a"), c(y).alias("b"))), 256)
    keyed = stash(text.computed(cleaned, _k=key(ref, pred), _n=key("_rn", "_pn")))
    distinct = keyed.select("_k", c(ref).alias("r"), c(pred).alias("p")).unionByName(
        keyed.select(c("_n").alias("_k"), c("_rn").alias("r"), c("_pn").alias("p"))).groupBy("_k").agg(F.first("r").alias("r"), F.first("p").alias("p"))
    words = word_error_rates(distinct, ["_k"], "r", "p")
    rates = stash(distinct.join(words, "_k").select("_k", numbers.character_error_rate(c("r"), c("p")).alias("cer"), "wer"))
    raw, normal = (rates.select(c("_k").alias(k), c("cer").alias(f"{name}_cer"), c("wer").alias(f"{name}_wer")) for k, name in (
        ("_k", "raw"), ("_n", "normalized")))
    return keyed.join(raw, "_k").join(normal, "_n").select(
        *pairs.columns, "raw_cer", "raw_wer", "normalized_cer", "normalized_wer")


def mean_error_rates(rates: DataFrame, keys: Sequence[str] = (), extra: dict[str, Column] | None = None) -> DataFrame:
    def mean(c: str) -> Column:
        return (numbers.decimal_sum(F.col(c)).cast("double") / F.count(c)).alias(c)
    return rates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sample_count"), mean("raw_cer"), mean("raw_wer"),
        mean("normalized_cer"), mean("normalized_wer"), *[value.alias(name) for name, value in (extra or {}).items()])


def unsupported_claim_rate(claims: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of claims (key, label) that break the claim policy; 0 without claims."""
    flagged = policy.flagged(claims, F.col("key"), F.col("label"), "_bad")
    return flagged.groupBy(*keys).agg(
        F.coalesce(F.count_if("_bad") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("unsupported_claim_rate"),
        F.count(F.lit(1)).alias("claim_count"))


# -- retrieval -----------------------------------------------------------------------------

def ranking_violations(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Items ranked twice, and queries known to one side only."""
    c = F.col
    twice = ranked.groupBy("query", "item_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    r = ranked.select("query").distinct()
    t = relevant.select("query").distinct()
    return (
        twice.select("query", c("item_id").alias("detail"), F.lit("duplicate_item").alias("rule"))
        .unionByName(r.join(t, "query", "left_anti").select("query", F.lit("").alias("detail"), F.lit("no_relevance_entry").alias("rule")))
        .unionByName(t.join(r, "query", "left_anti").select("query", F.lit("").alias("detail"), F.lit("no_ranking").alias("rule")))
    )


def hits(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked rows that are relevant. Joined on (query, item), so a popular query spreads."""
    return ranked.join(relevant.select("query", "item_id").distinct(), ["query", "item_id"])


def query_scores(ranked: DataFrame, relevant: DataFrame, k: int, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Recall@k and average precision per query.

    The running hit count is the position of a hit among the hits of its query, so only hits
    are ordered, not whole rankings.
    """
    found = hits(ranked, relevant)
    counted = skew.rank_within(found, ["query"], [F.col("rank"), F.col("item_id")], "hit_no", relevant, hot_rows)
    per_query = counted.groupBy("query").agg(
        F.count_if(F.col("rank") <= k).alias("hits_at_k"),
        numbers.decimal_sum(F.col("hit_no") / F.col("rank")).cast("double").alias("precision_sum"))
    totals = relevant.select("query", "item_id").distinct().groupBy("query").agg(F.count(F.lit(1)).alias("n_relevant"))
    queries = ranked.select("query").distinct()
    joined = queries.join(totals, "query", "left").join(per_query, "query", "left")
    n = F.col("n_relevant")
    return joined.select(
        "query", F.coalesce(n, F.lit(0)).alias("n_relevant"),
        F.coalesce(F.col("hits_at_k") / n, F.lit(0.0)).alias("recall_at_k"),
        F.coalesce(F.col("precision_sum") / n, F.lit(0.0)).alias("average_precision"))


def retrieval_summary(scores: DataFrame) -> DataFrame:
    """mAP over all queries, recall only over queries that have relevant items."""
    with_truth = F.col("n_relevant") > 0
    recall = numbers.decimal_sum(F.when(with_truth, F.col("recall_at_k"))).cast("double") / F.nullif(F.count_if(with_truth), F.lit(0))
    average = numbers.decimal_sum(F.col("average_precision")).cast("double") / F.nullif(F.count(F.lit(1)), F.lit(0))
    return scores.agg(
        F.coalesce(recall, F.lit(0.0)).alias("mean_recall_at_k"), F.coalesce(average, F.lit(0.0)).alias("map"),
        F.count(F.lit(1)).alias("query_count"))


# -- themes --------------------------------------------------------------------------------

def theme_f1_by_slice(matches: DataFrame, slices: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Macro F1 over labels per slice of the samples; null for a slice without truth.

    ``matches``: sample_id, label, expected, predicted; ``slices``: sample_id, slice.
    """
    spark = matches.sparkSession
    sliced = matches.join(slices.filter(F.col("slice").isin(*wanted)), "sample_id")
    scored = macro_f1(sliced, ["label"], ["slice"])
    with_truth = sliced.groupBy("slice").agg(F.count_if("expected").alias("n_expected"))
    every = spark.createDataFrame([(s,) for s in wanted], "slice string")
    return every.join(scored.join(with_truth, "slice"), "slice", "left").select(
        "slice", F.when(F.col("n_expected") > 0, F.col("macro_f1")).alias("macro_f1"))


def similarity_diagnostics(similarities: DataFrame, expected: DataFrame, threshold: float) -> DataFrame:
    """Score range over all pairs and over the expected (item, label) pairs."""
    flagged = similarities.join(
        expected.select("item_id", "label", F.lit(True).alias("_e")).distinct(), ["item_id", "label"], "left")
    inside = F.when(F.col("_e"), F.col("similarity"))
    return flagged.agg(
        F.count_if(F.col("similarity") >= threshold).alias("matched_count"),
        F.min("similarity").alias("score_min"), F.max("similarity").alias("score_max"),
        F.min(inside).alias("expected_score_min"), F.max(inside).alias("expected_score_max"))


def score_diagnostics(scores: DataFrame, kinds: Sequence[str] = vocab.OBSERVATION_KINDS) -> DataFrame:
    """Count, range and mean of scores per kind (``kind``, ``score``, ``expected``), zero-filled."""
    spark = scores.sparkSession
    inside = F.when(F.col("expected"), F.col("score"))

    def stats(c: Column, prefix: str) -> list[Column]:
        return [
            F.count(c).alias(f"{prefix}count"), F.min(c).alias(f"{prefix}min"), F.max(c).alias(f"{prefix}max"),
            (numbers.decimal_sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))).alias(f"{prefix}mean")]

    found = scores.groupBy("kind").agg(*stats(F.col("score"), ""), *stats(inside, "expected_"))
    every = spark.createDataFrame([(k,) for k in kinds], "kind string")
    return every.join(found, "kind", "left").fillna(0, ["count", "expected_count"])


def per_type_scores(matches: DataFrame, types: Sequence[str] = vocab.VISUAL_LABEL_TYPES) -> DataFrame:
    """P/R/F1 per label type; a type without truth is not evaluated and stays out of 'overall'."""
    spark = matches.sparkSession
    c = F.col
    per_type = precision_recall_f1(matches, ["type"])
    every = spark.createDataFrame([(t,) for t in types], "type string")
    filled = every.join(per_type, "type", "left").fillna(0, ["tp", "n_expected", "n_predicted"])
    evaluated = c("n_expected") > 0
    shaped = filled.select(
        "type", evaluated.alias("evaluated"), "n_expected", "n_predicted", "tp",
        *[F.when(evaluated, c(m)).alias(m) for m in ("precision", "recall", "f1")])
    sums = shaped.filter("evaluated").agg(
        F.sum("tp").alias("tp"), F.sum("n_expected").alias("n_expected"), F.sum("n_predicted").alias("n_predicted"))
    p = F.coalesce(c("tp") / F.nullif(c("n_predicted"), F.lit(0)), F.lit(0.0))
    r = c("tp") / c("n_expected")
    has = c("n_expected").isNotNull()
    overall = sums.select(
        F.lit("overall").alias("type"), has.alias("evaluated"), F.coalesce("n_expected", F.lit(0)).alias("n_expected"),
        F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.when(has, p).alias("precision"), F.when(has, r).alias("recall"), F.when(has, numbers.f1(p, r)).alias("f1"))
    return shaped.unionByName(overall)


# -- the report of one run -----------------------------------------------------------------

def coverage_violations(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions must cover exactly the EVAL samples of the same dataset version."""
    keys = ["dataset_id", "dataset_version", "sample_id"]
    want = samples.filter(F.col("split") == "eval").select(*keys, F.lit(True).alias("_w"))
    have = predictions.select(*keys, F.lit(True).alias("_h")).distinct()
    both = want.join(have, keys, "full_outer").filter(F.col("_w").isNull() | F.col("_h").isNull())
    return both.select(*keys, F.when(F.col("_h").isNull(), "missing_prediction").otherwise("unexpected_prediction").alias("rule"))


def evaluation_report(samples: DataFrame, truth: DataFrame, predicted: DataFrame, predicted_text: DataFrame,
                      claims: DataFrame, bins: int = 10) -> DataFrame:
    """Long metrics table (name, value, sample_count, minimum, maximum), sorted by name.

    Only EVAL samples are scored; OCR labels are judged by their text, not as labels.
    """
    c = F.col
    evaluated = samples.filter(c("split") == "eval").select("sample_id", "ocr_text")
    ids = evaluated.select("sample_id")
    identity = ["sample_id", "type", "label", "value"]
    t = truth.filter(c("type") != "ocr_text").join(ids, "sample_id", "left_semi")
    p = predicted.filter(c("type") != "ocr_text").join(ids, "sample_id", "left_semi")
    # Every sample adds one marker row, so the sample count comes out of the same aggregate.
    markers = ids.select(
        *[F.lit(None).cast("string").alias(i) for i in identity],
        F.lit(False).alias("expected"), F.lit(False).alias("predicted"), F.lit(True).alias("_sample"))
    judged_labels = label_matches(t, p, identity).withColumn("_sample", F.lit(False)).unionByName(markers)
    scores = precision_recall_f1(judged_labels, extra={"n": F.count_if("_sample")})

    def metric(df: DataFrame, name: str, value: Column, n: Column, maximum: float | None) -> DataFrame:
        return df.select(
            F.lit(name).alias("name"), value.alias("value"), n.cast("bigint").alias("sample_count"),
            F.lit(0.0).alias("minimum"), F.lit(maximum).cast("double").alias("maximum"))

    judged = p.join(t.select(*identity).distinct().withColumn("_ok", F.lit(True)), identity, "left").select(
        "confidence", F.coalesce("_ok", F.lit(False)).alias("correct"))
    ece = calibration_error(judged, bins)
    rate = unsupported_claim_rate(claims.join(ids, "sample_id", "left_semi"))
    # A truth text without prediction is a violation (text_violations), and then there is no mean.
    texts = evaluated.filter(c("ocr_text").isNotNull()).join(
        predicted_text.select("sample_id", c("ocr_text").alias("prediction")), "sample_id", "left").withColumnRenamed("ocr_text", "reference")
    errors = mean_error_rates(text_error_rates(texts), extra={"_given": F.count("prediction")}).filter(
        (c("sample_count") > 0) & (c("_given") == c("sample_count")))
    parts = [
        metric(scores, "visual_precision", c("precision"), c("n"), 1.0),
        metric(scores, "visual_recall", c("recall"), c("n"), 1.0),
        metric(scores, "visual_f1", c("f1"), c("n"), 1.0),
        metric(ece, "confidence_ece", c("ece"), c("sample_count"), 1.0),
        metric(rate, "unsupported_claim_rate", c("unsupported_claim_rate"), c("claim_count"), 1.0),
        metric(errors, "ocr_cer", c("raw_cer"), c("sample_count"), None),
        metric(errors, "ocr_wer", c("raw_wer"), c("sample_count"), None),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def text_violations(samples: DataFrame, predicted_text: DataFrame) -> DataFrame:
    """EVAL samples with text truth but no text prediction."""
    need = samples.filter((F.col("split") == "eval") & F.col("ocr_text").isNotNull())
    have = predicted_text.filter(F.col("ocr_text").isNotNull())
    return need.join(have.select("sample_id"), "sample_id", "left_anti").select(
        "sample_id", F.lit("text_prediction_missing").alias("rule"))


def metric_violations(metrics: DataFrame) -> DataFrame:
    """Finite values inside their bounds, unique names, p95 not below p50."""
    c = F.col
    _, rows = rules.apply_rules(
        metrics.withColumn("analysis_id", c("report_id")), "metric", c("name"),
        {"bounds": rules.metric_bounds(c("value"), c("minimum"), c("maximum")),
         "sample_count": c("sample_count") >= 0, "name": rules.trimmed_text(c("name"))})
    twice = metrics.groupBy(c("report_id").alias("analysis_id"), "name").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    return rows.unionByName(rules.violation(twice, "metric", c("name"), "duplicate_name"))
