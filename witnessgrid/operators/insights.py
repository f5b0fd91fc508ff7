"""Support policy, scoring, ranking and wording of insights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import ids, numbers, policy
from . import parts, rules, skew


@dataclass(frozen=True)
class SupportPolicy:
    version: str = "phase8-candidate-v1"
    min_evidence: int = 2
    min_items: int = 2
    min_coverage: float = 0.10
    min_diversity: int = 1
    min_consistency: float = 0.0
    min_confidence: float = 0.0
    diversity_saturation: int = 2

    def __post_init__(self) -> None:
        if self.diversity_saturation < self.min_diversity:
            raise ValueError("diversity_saturation must be at least min_diversity")


def eligible(p: SupportPolicy) -> Column:
    c = F.col
    return (
        (c("evidence_count") >= p.min_evidence)
        & (c("unique_item_count") >= p.min_items)
        & (c("item_coverage") >= p.min_coverage)
        & (c("source_diversity") >= p.min_diversity)
        & (c("cross_item_consistency") >= p.min_consistency)
        & c("average_confidence").isNotNull()
        & (c("average_confidence") >= p.min_confidence)
    )


def observable(aggregates: DataFrame) -> DataFrame:
    """Drop mode of the claim policy: offending aggregates vanish silently."""
    judged = policy.flagged(aggregates, F.col("key"), F.col("label"), "_bad")
    return judged.filter(~F.col("_bad")).drop("_bad")


def _rule_maps() -> tuple[Column, Column]:
    def build(position: int) -> Column:
        flat = [F.lit(v) for kind, rule in vocab.INSIGHT_RULES.items() for v in (kind, rule[position])]
        return F.create_map(*flat)
    return build(0), build(1)


def candidate_insights(aggregates: DataFrame, p: SupportPolicy = SupportPolicy()) -> DataFrame:
    """Eligible, observable aggregates in insight form; kinds without a rule never qualify."""
    types, prefixes = _rule_maps()
    mapped = aggregates.withColumn("type", types[F.col("kind")]).filter(F.col("type").isNotNull())
    kept = observable(mapped.filter(eligible(p)))
    score = numbers.support_score(
        F.col("average_confidence"), F.col("item_coverage"), F.col("cross_item_consistency"),
        F.col("source_diversity"), p.diversity_saturation)
    return kept.select(
        "*",
        ids.insight_key(F.col("type"), F.col("kind"), F.col("key")).alias("insight_key"),
        F.concat(prefixes[F.col("kind")], F.lit(": "), F.col("label")).alias("insight_label"),
        score.alias("confidence"),
    )


def split_supported(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies seen through different sources can be represented by different originals; then
    the evidence reaches more items than the aggregate counts and the insight is refused."""
    broken = ~F.col("support_preserved")
    return candidates.filter(~broken), rules.violation(
        candidates.filter(broken), "aggregate", F.concat_ws(":", "kind", "key"), "unique_item_support_not_preserved")


def insight_order() -> list[Column]:
    c = F.col
    return [
        -c("confidence"), -c("item_coverage"), -c("unique_item_count"), -c("evidence_count"),
        -c("source_diversity"), -c("cross_item_consistency"), c("type"), c("key"), c("insight_label"),
    ]


def rank_insights(candidates: DataFrame, sizes: DataFrame | None = None,
                  hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """``sizes``: rows per analysis that bound the insights per analysis (see rank_within)."""
    return skew.rank_within(candidates, ["analysis_id"], insight_order(), "rank", sizes, hot_rows)


def explanation_head() -> Column:
    """The explanation up to its list of items; the ids and ``EXPLANATION_END`` follow."""
    c = F.col
    return F.format_string(
        "Supported by %d evidence signals across %d/%d images (coverage=%.6f); source_diversity=%d; "
        "cross_image_consistency=%.6f; average_evidence_confidence=%.6f; max_evidence_confidence=%.6f; "
        "supporting_image_ids=[",
        c("evidence_count"), c("unique_item_count"), c("item_universe_count"), c("item_coverage"),
        c("source_diversity"), c("cross_item_consistency"), c("average_confidence"), c("max_confidence"))


EXPLANATION_END = "]."


def support_ids(ranked: DataFrame, links: DataFrame) -> DataFrame:
    """The supporting ids of every insight as rows: analysis_id, insight_key, rank, part (signal or item), id."""
    found = links.join(ranked.select("analysis_id", "kind", "key", "insight_key", "rank"), ["analysis_id", "kind", "key"])
    kinds = F.array(*[F.struct(F.lit(part).alias("part"), F.col(c).alias("id")) for part, c in (
        ("signal", "signal_id"), ("item", "original_item_id"))])
    return found.select("analysis_id", "insight_key", "rank", F.inline(kinds)).distinct()


def explanation_parts(ranked: DataFrame, support: DataFrame, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """(analysis_id, insight_key, part_no, payload): the explanation sentence of any number of items."""
    keys, items = ["analysis_id", "insight_key"], support.filter("part = 'item'")

    def order(place: int, own: Column | None = None) -> dict[str, Column]:
        return {"place": F.lit(place), "own": F.lit("") if own is None else own}
    rows = parts.piece(ranked, keys, order(0), explanation_head(), opens=True).unionByName(
        parts.piece(items, keys, order(1, F.col("id")), F.col("id"), between=", ")).unionByName(
        parts.piece(ranked, keys, order(2), F.lit(EXPLANATION_END)))
    return parts.cut(rows, keys, ["place", "own"], part_bytes)


def finished_violations(insights: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Fail mode of the claim policy on finished labels, explanations and the ids they name."""
    checks = {
        "label_policy": ~policy.violates(F.col("insight_key"), F.col("insight_label")),
        "explanation_policy": ~policy.violates(F.col("insight_key"), explanation_head()),
        "key_shape": rules.key_shape(F.col("insight_key"))}
    _, broken = rules.apply_rules(insights, "insight", F.col("insight_key"), checks)
    if support is None:
        return broken
    # Ids are parted by a comma, so no phrase reaches from one to the next.
    named = support.filter("part = 'item'").select("analysis_id", "insight_key", "id")
    offending = policy.flagged(named, F.lit(None).cast("string"), F.col("id"), "_bad").filter("_bad")
    return broken.unionByName(rules.violation(
        offending.select("analysis_id", "insight_key").distinct(), "insight", F.col("insight_key"), "item_id_policy"))


def summary_pieces(ranked: DataFrame, analyses: DataFrame, keys: list[str], order, text) -> DataFrame:
    """Pieces of the summary sentence: ``order(step, rank)`` places them, ``text`` shapes every string."""
    first = ranked.filter("rank = 1").select("analysis_id", F.lit(True).alias("_any"))
    heads = analyses.select("analysis_id").distinct().join(first, "analysis_id", "left")
    begin = F.when(F.col("_any"), F.lit(vocab.SUMMARY_PREFIX)).otherwise(F.lit(vocab.EMPTY_SUMMARY))
    return parts.piece(heads, keys, order(0, F.lit(0)), text(begin), opens=True).unionByName(
        parts.piece(ranked, keys, order(1, F.col("rank")), text(F.col("insight_label")), between=" | "))


def summary_parts(ranked: DataFrame, analyses: DataFrame, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """(analysis_id, part_no, payload): one sentence per analysis, its labels in rank order."""
    def order(step: int, rank: Column) -> dict[str, Column]:
        return {"step": F.lit(step), "place": rank.cast("bigint")}
    rows = summary_pieces(ranked, analyses, ["analysis_id"], order, lambda c: c)
    return parts.cut(rows, ["analysis_id"], ["step", "place"], part_bytes)
