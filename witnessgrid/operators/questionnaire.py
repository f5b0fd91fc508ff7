"""Scoring of consented self-report questionnaires."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions import numbers
from . import rules


def violations(responses: DataFrame, max_items: int = vocab.MAX_QUESTIONNAIRE_ITEMS,
               max_chars: int = vocab.MAX_CLAIM_CHARS) -> DataFrame:
    """Row rules, then per-questionnaire rules: unique items, all five traits, item limit."""
    c = F.col
    _, rows = rules.apply_rules(responses, "response", c("item_id"), {
        "scale_order": rules.finite(c("scale_min")) & rules.finite(c("scale_max")) & (c("scale_min") < c("scale_max")),
        "outside_scale": rules.finite(c("response_value")) & c("response_value").between(c("scale_min"), c("scale_max")),
        "trait": rules.one_of(c("trait"), vocab.TRAITS),
        "item_id_text": rules.trimmed_text(c("item_id")) & (F.length("item_id") <= max_chars),
        "instrument_text": rules.trimmed_text(c("instrument_id")) & (F.length("instrument_id") <= max_chars)
        & rules.trimmed_text(c("instrument_version")) & (F.length("instrument_version") <= max_chars),
        "consent": c("consent_confirmed"),
        "basis": c("basis") == vocab.QUESTIONNAIRE_BASIS,
    })
    per = responses.groupBy("analysis_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(F.col("trait") == t).alias(f"has_{t}") for t in vocab.TRAITS])
    all_traits = c(f"has_{vocab.TRAITS[0]}")
    for t in vocab.TRAITS[1:]:
        all_traits = all_traits & c(f"has_{t}")
    twice = responses.groupBy("analysis_id", "item_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    owner = c("analysis_id")
    return (
        rows.unionByName(rules.violation(per.filter(c("n") > max_items), "questionnaire", owner, "too_many_items"))
        .unionByName(rules.violation(per.filter(~F.coalesce(all_traits, F.lit(False))), "questionnaire", owner, "missing_trait"))
        .unionByName(rules.violation(twice, "response", c("item_id"), "duplicate_item"))
    )


def trait_scores(responses: DataFrame) -> DataFrame:
    """One row per (analysis, trait): reverse-adjusted mean, normalised to the scale.

    Valid questionnaires hold at most ``MAX_QUESTIONNAIRE_ITEMS`` responses, which bounds the
    id lists.
    """
    c = F.col
    adjusted = numbers.reverse_adjusted(c("response_value"), c("scale_min"), c("scale_max"), c("reverse_scored"))
    grouped = responses.withColumn("_v", adjusted).groupBy("analysis_id", "trait").agg(
        F.first("instrument_id").alias("instrument_id"), F.first("scale_min").alias("lo"), F.first("scale_max").alias("hi"),
        (numbers.decimal_sum(c("_v")).cast("double") / F.count(F.lit(1))).alias("_mean"),
        F.count(F.lit(1)).cast("int").alias("item_count"), F.array_sort(F.collect_list("item_id")).alias("supporting_item_ids"))
    normalized = (c("_mean") - c("lo")) / (c("hi") - c("lo"))
    return grouped.select(
        "analysis_id", "trait", F.bround(normalized, 6).alias("normalized_score"), F.bround("_mean", 6).alias("scored_mean"),
        "item_count", "supporting_item_ids",
        F.format_string(
            "Normalized mean of %d explicit self-report questionnaire item(s) mapped by instrument '%s' to %s; "
            "reverse-scored items were transformed before averaging.", c("item_count"), c("instrument_id"), c("trait"),
        ).alias("explanation"))


def profiles(scores: DataFrame) -> DataFrame:
    """The five traits of an analysis as columns, with the summary sentence in trait order."""
    wide = scores.groupBy("analysis_id").pivot("trait", list(vocab.TRAITS)).agg(F.first("normalized_score"))
    shown = [F.concat(F.lit(f"{t}="), F.format_string("%.6f", F.col(t))) for t in vocab.TRAITS]
    summary = F.concat(F.lit("Self-reported Big Five scores: "), F.concat_ws(" | ", *shown))
    return wide.select("analysis_id", *vocab.TRAITS, summary.alias("summary"))
