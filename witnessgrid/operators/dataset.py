"""Evaluation datasets: audit, label-blind holdout, taxonomies, coverage, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import ids, text
from . import rules, skew


def _crossing(samples: DataFrame, key: str, name: str) -> DataFrame:
    """Key values used twice: leakage when they cross splits, a duplicate otherwise."""
    found = samples.filter(F.col(key).isNotNull()).groupBy("dataset_id", key).agg(
        F.count(F.lit(1)).alias("n"), (F.min("split") != F.max("split")).alias("crosses")).filter(F.col("n") > 1)
    rule = F.when(F.col("crosses"), f"leakage_{name}").otherwise(f"duplicate_{name}")
    return found.select("dataset_id", F.lit(name).alias("entity"), F.col(key).cast("string").alias("entity_id"), rule.alias("rule"))


def audit(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Violations of a dataset: repeats, train/eval leakage, no EVAL sample, label identity."""
    c = F.col
    twice = samples.groupBy("dataset_id", "sample_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    no_eval = samples.groupBy("dataset_id").agg(F.count_if(c("split") == "eval").alias("n")).filter(c("n") == 0)
    parts = [
        twice.select("dataset_id", F.lit("sample").alias("entity"), c("sample_id").alias("entity_id"), F.lit("duplicate_sample").alias("rule")),
        _crossing(samples, "item_id", "item"), _crossing(samples, "relative_path", "path"),
        no_eval.select("dataset_id", F.lit("dataset").alias("entity"), c("dataset_id").alias("entity_id"), F.lit("no_eval_sample").alias("rule")),
    ]
    if "content_hash" in samples.columns:
        parts.append(_crossing(samples, "content_hash", "content"))
    for cols, rule in ((["label_id"], "duplicate_label_id"), (["type", "label", "value"], "duplicate_label_identity")):
        found = labels.groupBy("dataset_id", "sample_id", *cols).agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
        parts.append(found.select("dataset_id", F.lit("label").alias("entity"), c("sample_id").alias("entity_id"), F.lit(rule).alias("rule")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def holdout_violations(samples: DataFrame, new_version: str, train_count: int) -> DataFrame:
    per = samples.groupBy("dataset_id", "dataset_version").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "train").alias("train"))
    broken = F.array_compact(F.array(
        F.when(F.col("dataset_version") == new_version, "version_not_new"),
        F.when((F.lit(train_count) <= 0) | (F.lit(train_count) >= F.col("n")), "train_count_out_of_range"),
        F.when(F.col("train") > 0, "already_split")))
    return per.select("dataset_id", F.explode(broken).alias("rule"))


def holdout_split(samples: DataFrame, new_version: str, train_count: int, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Label-blind split: the ``train_count`` samples with the lowest id digest become TRAIN.

    Datasets with a violation (see :func:`holdout_violations`) are left out.
    """
    refused = holdout_violations(samples, new_version, train_count).select("dataset_id").distinct()
    usable = samples.join(refused, "dataset_id", "left_anti")
    digest = F.sha2(F.concat_ws("\n", "dataset_id", "sample_id"), 256)
    ranked = skew.rank_within(
        usable.withColumn("_d", digest), ["dataset_id"], [F.col("_d"), F.col("sample_id")], "_rank",
        sizes=samples, hot_rows=hot_rows)
    return (
        ranked.withColumn("split", F.when(F.col("_rank") <= train_count, "train").otherwise("eval"))
        .withColumn("dataset_version", F.lit(new_version)).drop("_d", "_rank"))


def train_taxonomy(samples: DataFrame, labels: DataFrame, types: Sequence[str] = vocab.VISUAL_LABEL_TYPES) -> DataFrame:
    """Distinct label values of TRAIN samples per type: (type, label)."""
    train = samples.filter(F.col("split") == "train").select("dataset_id", "sample_id")
    values = labels.filter(F.col("type").isin(*types)).join(train, ["dataset_id", "sample_id"], "left_semi")
    return values.select("type", text.truth_value(F.col("label"), F.col("value")).alias("label")).distinct()


def ordered_taxonomy(taxonomy: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Taxonomy positions by (case-folded label, label)."""
    keyed = text.computed(taxonomy, _k=text.casefold(F.col("label")))
    return skew.rank_within(keyed, ["type"], [F.col("_k"), F.col("label")], "position", hot_rows=hot_rows).drop("_k")


def taxonomy_violations(taxonomy: DataFrame) -> DataFrame:
    """Labels trimmed, unique per type after case folding, and at least one overall."""
    keyed = text.computed(taxonomy, _k=text.casefold(F.col("label")))
    twice = keyed.groupBy("type", "_k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    untrimmed = taxonomy.filter(~rules.trimmed_text(F.col("label")))
    return twice.select("type", F.col("_k").alias("label"), F.lit("not_unique").alias("rule")).unionByName(
        untrimmed.select("type", "label", F.lit("not_trimmed").alias("rule"))).unionByName(
        taxonomy.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
            F.lit("").alias("type"), F.lit("").alias("label"), F.lit("no_labels").alias("rule")))


def covered_labels(eval_labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """EVAL labels with a flag telling whether the taxonomy knows their value."""
    valued = eval_labels.withColumn("label", text.truth_value(F.col("label"), F.col("value")))
    return valued.join(taxonomy.select("type", "label", F.lit(True).alias("_c")), ["type", "label"], "left").withColumn(
        "covered", F.coalesce("_c", F.lit(False))).drop("_c")


def taxonomy_coverage(eval_labels: DataFrame, taxonomy: DataFrame, types: Sequence[str] = vocab.VISUAL_LABEL_TYPES) -> DataFrame:
    spark = taxonomy.sparkSession
    seen = covered_labels(eval_labels, taxonomy).groupBy("type").agg(
        F.count(F.lit(1)).alias("expected"), F.count_if("covered").alias("covered"))
    sizes = taxonomy.groupBy("type").agg(F.count(F.lit(1)).alias("taxonomy_labels"))
    every = spark.createDataFrame([(t,) for t in types], "type string")
    filled = every.join(sizes, "type", "left").join(seen, "type", "left").fillna(0)
    return filled.withColumn(
        "coverage", F.coalesce(F.col("covered") / F.nullif(F.col("expected"), F.lit(0)), F.lit(1.0)))


def label_coverage(samples: DataFrame, labels: DataFrame, types: Sequence[str] = vocab.VISUAL_LABEL_TYPES,
                   slices: Sequence[str] = vocab.SLICES) -> DataFrame:
    """Label counts of EVAL samples per type (slice '(all)') and per slice and type, zero-filled."""
    spark = samples.sparkSession
    evals = samples.filter(F.col("split") == "eval").select("dataset_id", "sample_id", "slices")
    found = labels.filter(F.col("type").isin(*types)).join(evals, ["dataset_id", "sample_id"])
    # Adding the '(all)' level to the slices of a sample gives both levels in one aggregate.
    levels = found.select("type", F.explode(F.array_append("slices", F.lit("(all)"))).alias("slice"))
    counts = levels.groupBy("slice", "type").agg(F.count(F.lit(1)).alias("label_count"))
    every = spark.createDataFrame([(s, t) for s in ("(all)", *slices) for t in types], "slice string, type string")
    return every.join(counts, ["slice", "type"], "left").fillna(0, ["label_count"])


def missing_types(coverage: DataFrame) -> DataFrame:
    return coverage.filter((F.col("slice") == "(all)") & (F.col("label_count") == 0)).select("type")


def text_truth_coverage(samples: DataFrame, slices: Sequence[str] = vocab.SLICES) -> DataFrame:
    """EVAL samples with text truth per slice, zero-filled."""
    spark = samples.sparkSession
    found = samples.filter((F.col("split") == "eval") & F.col("ocr_text").isNotNull()).select(
        F.explode("slices").alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("sample_count"))
    every = spark.createDataFrame([(s,) for s in slices], "slice string")
    return every.join(found, "slice", "left").fillna(0)


def content_fingerprint(samples: DataFrame) -> DataFrame:
    return ids.fingerprint(samples, ["sample_id", "item_id", "relative_path", "content_hash"], ["dataset_id"])


def fingerprint_violations(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Datasets whose fingerprint differs from the expected one (or is not there)."""
    joined = expected.select("dataset_id", F.col("fingerprint").alias("_want")).join(actual, "dataset_id", "left")
    return joined.filter(~F.coalesce(F.col("fingerprint") == F.col("_want"), F.lit(False))).select(
        "dataset_id", F.lit("fingerprint_mismatch").alias("rule"))


def holdout_report(samples: DataFrame, labels: DataFrame, types: Sequence[str] = vocab.VISUAL_LABEL_TYPES) -> DataFrame:
    """Split counts, id fingerprints per split and TRAIN vocabulary sizes as (name, value) rows."""
    spark = samples.sparkSession
    counts = samples.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat("split", F.lit("_sample_count")).alias("name"), F.col("n").cast("string").alias("value"))
    prints = ids.fingerprint(samples, ["sample_id"], ["split"]).select(
        F.concat("split", F.lit("_ids_fingerprint")).alias("name"), F.col("fingerprint").alias("value"))
    sizes = train_taxonomy(samples, labels, types).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(t,) for t in types], "type string").join(sizes, "type", "left").fillna(0)
    vocabulary = every.select(F.concat(F.lit("train_labels_"), "type").alias("name"), F.col("n").cast("string").alias("value"))
    total = every.agg(F.sum("n").alias("n")).select(F.lit("train_labels_total").alias("name"), F.col("n").cast("string").alias("value"))
    return reduce(lambda a, b: a.unionByName(b), [counts, prints, vocabulary, total])
