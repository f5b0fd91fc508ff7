"""The published aggregation workload, and replay of samples as a workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import aggregate, skew

_TYPES = ("object", "scene", "activity", "topic")


def items_range(spark: SparkSession, analyses: int, items_per_analysis: int) -> DataFrame:
    """analysis_id, item_index, item_id for any number of analyses."""
    n = items_per_analysis
    return spark.range(analyses * n).select(
        (F.col("id") / n).cast("bigint").cast("string").alias("analysis_id"),
        F.pmod("id", F.lit(n)).alias("item_index"),
    ).withColumn("item_id", F.format_string("img-%04d", "item_index"))


def workload_evidence(items: DataFrame, evidence_per_item: int = 20) -> DataFrame:
    """Deterministic evidence of every item (columns of aggregate.support_signals input).

    Every item gets the same concepts, so their normal forms are made once and joined to the items.
    """
    e = F.col("e")
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.pmod(e, F.lit(len(_TYPES))) + 1).cast("int"))
    concept = F.pmod(e, F.lit(max(1, evidence_per_item // 4)))
    label = F.concat("type", F.format_string("_concept_%03d", concept))
    concepts = items.sparkSession.range(evidence_per_item).select(F.col("id").cast("int").alias("e")).withColumn("type", kind).select(
        "e", "type", label.alias("label"), label.alias("value"), F.concat(F.lit("benchmark_"), "type").alias("source"),
        F.format_string("-%04d", "e").alias("_tail"))
    numbered = items.withColumn("_head", F.format_string("ev-%04d", "item_index"))
    rows = numbered.crossJoin(F.broadcast(aggregate.named_concepts(concepts)))
    return rows.select(
        "analysis_id", F.concat("_head", "_tail").alias("id"), "item_id", "type", "label", "value",
        (F.lit(0.5) + F.pmod(F.col("item_index") + e, F.lit(50)) / 100.0).alias("confidence"),
        "source", F.col("item_id").alias("canonical_item_id"), F.lit(False).alias("has_copies"), "_text", "_key")


def workload_similarities(items: DataFrame, labels: tuple[str, ...] = ("semantic_alpha", "semantic_beta")) -> DataFrame:
    provider = F.struct(
        F.lit("phase7-benchmark-semantic").alias("name"), F.lit("1").alias("version"),
        F.lit("synthetic-contract-input").alias("model_id"), F.lit("1").alias("model_version"),
        F.lit("phase7-benchmark-v1").alias("config_version"))
    themes = items.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    rows = items.crossJoin(F.broadcast(aggregate.named_labels(themes)))
    return rows.select(
        "analysis_id", "item_id", F.col("item_id").alias("canonical_item_id"), F.lit(False).alias("has_copies"),
        "label", F.lit(0.8).alias("similarity"), F.lit(0.5).alias("threshold"), provider.alias("provider"), "_text", "_key")


def replay(requests: DataFrame, samples: DataFrame, order: str, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Request i takes sample i modulo the number of samples; ``requests`` has request_no.

    ``replay_round`` is 0 for the first pass over the samples (distinct input) and counts on.
    """
    indexed = skew.dense_index(samples, [F.col(order)], "sample_no", hot_rows)
    total = samples.count()
    wanted = requests.withColumn("sample_no", F.pmod("request_no", F.lit(total)).cast("bigint")).withColumn(
        "replay_round", (F.col("request_no") / total).cast("bigint"))
    # Every sample is asked for about equally often; few samples make all of them hot keys.
    per_sample = F.lit(requests.count() // max(total, 1) + 1)
    table = indexed.withColumn("_asked", per_sample)
    return skew.lookup(wanted, table, ["sample_no"], "_asked", hot_rows, how="inner", spread_by=["request_no"]).drop("_asked")
