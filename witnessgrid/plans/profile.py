"""The whole analysis as one plan: items and evidence in, ranked insights and documents out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, text
from ..operators import aggregate, insights as ins, items as item_ops, parts, result, rules, skew
from ..session import cut_lineage, stash


def retained_signals(evidence: DataFrame, similarities: DataFrame | None = None) -> DataFrame:
    """Signals that may support a theme: repeats counted once, copies spoken for once."""
    signals = aggregate.support_signals(evidence)
    if similarities is not None:
        signals = aggregate.union_signals(signals, aggregate.semantic_signals(similarities))
    return aggregate.represent(aggregate.distinct_evidence(signals))


def themed(evidence: DataFrame) -> DataFrame:
    """Redacted evidence with the normal form of its concept (_text) and a hash of its theme (_theme)."""
    named = aggregate.named_concepts(evidence)
    return result.redacted(named.withColumn("_theme", F.xxhash64("type", "_key"))).drop("_key")


def wide_evidence(rows: DataFrame, universe: DataFrame, policy: ins.SupportPolicy = ins.SupportPolicy()) -> DataFrame:
    """:func:`themed` evidence whose theme may reach the counts of the policy; no insight rests on any other.

    Themes are told by a hash and copies count here, so the counts are upper bounds: more may stay than
    becomes an insight, but every row of a theme stays if the theme does.
    """
    n, total = F.col("n"), F.col("item_universe_count")
    counts = rows.filter("_text <> ''").groupBy("analysis_id", "_theme").agg(F.count(F.lit(1)).alias("n"))
    least = F.lit(max(policy.min_evidence, policy.min_items))
    sized = skew.lookup(counts.filter(n >= least), universe.withColumn("_size", total), ["analysis_id"], "_size", 10_000, how="inner", spread_by=["_theme"])
    wide = stash(sized.filter(n / total >= policy.min_coverage).select("analysis_id", "_theme"))
    kept = rows.join(wide, ["analysis_id", "_theme"], "left_semi")
    return text.computed(kept, _key=text.aggregation_key(F.col("_text")))


def ranked_insights(aggregates: DataFrame, sizes: DataFrame, policy: ins.SupportPolicy = ins.SupportPolicy(),
                    hot_rows: int = 100_000) -> DataFrame:
    """``sizes``: the items; counting them tells whether any analysis needs the split ranking."""
    kept, _ = ins.split_supported(ins.candidate_insights(aggregates, policy))
    return ins.rank_insights(kept, sizes, hot_rows)


@dataclass(frozen=True)
class Analysis:
    """Durable intermediate tables of a run and the frames derived from them."""

    items: DataFrame
    evidence: DataFrame
    retained: DataFrame
    aggregates: DataFrame
    insights: DataFrame
    violations: DataFrame


def analyse(items: DataFrame, evidence: DataFrame, policy: ins.SupportPolicy = ins.SupportPolicy(),
            similarities: DataFrame | None = None) -> Analysis:
    """Run all analyses of ``items`` (analysis_id, ordinal, item_id, content_hash, ...).

    ``evidence`` carries canonical_item_id and has_copies (extract from
    ``items.with_canonical(items)`` or use ``aggregate.resolve_items``). Conflicting or stray
    evidence fails its analysis. The retained signals and the ranked insights are checkpointed,
    because several outputs read them.
    """
    broken = aggregate.evidence_conflicts(evidence).unionByName(aggregate.evidence_outside_batch(evidence, items))
    usable = rules.drop_failed(evidence, broken)
    retained = cut_lineage(retained_signals(usable, similarities))
    themes = aggregate.theme_aggregates(retained, item_ops.universe(items))
    candidates = ins.candidate_insights(themes, policy)
    kept, refused = ins.split_supported(candidates)
    ranked = cut_lineage(ins.rank_insights(kept, items.select("analysis_id"), 100_000))
    return Analysis(items, usable, retained, themes, ranked, broken.unionByName(refused))


def supporting_ids(insights: DataFrame, retained: DataFrame) -> DataFrame:
    """The ids behind every insight, one row each."""
    return ins.support_ids(insights, aggregate.support_links(retained))


def documents(run: Analysis, policy: ins.SupportPolicy = ins.SupportPolicy(), claims: DataFrame | None = None,
              profiles: DataFrame | None = None, part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """Redacted, versioned result documents of all analyses, in parts."""
    support = stash(supporting_ids(run.insights, run.retained))
    return result.document_parts(
        run.items, result.redacted(run.evidence), run.insights, support, policy.version, claims, profiles, part_bytes)


def items_from_text(df: DataFrame) -> DataFrame:
    """Items of a table with analysis_id, ordinal, item_id and text."""
    return df.withColumn("content_hash", ids.content_hash(F.col("text")))
