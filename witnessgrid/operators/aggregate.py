"""Evidence to support signals to theme aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ids, numbers, text
from . import rules, skew

SIGNAL_COLUMNS = [
    "analysis_id", "signal_id", "original_item_id", "canonical_item_id", "has_copies", "kind",
    "key", "label", "source", "confidence",
]
_REP_KEYS = ["analysis_id", "canonical_item_id", "kind", "key", "source"]


def _present(name: str) -> Column:
    """Identity columns are never null. Saying so keeps the optimizer from adding different
    not-null filters to different uses of the signals, which would stop exchange reuse."""
    return F.coalesce(F.col(name), F.lit("")).alias(name)


def _as_signals(df: DataFrame) -> DataFrame:
    text_columns = {"analysis_id", "original_item_id", "canonical_item_id", "kind", "key", "source"}
    flag = F.coalesce("has_copies", F.lit(False)).alias("has_copies")
    # A column that can't be null stays as it is, so Spark still knows how the rows are partitioned.
    open_columns = {f.name for f in df.schema.fields if f.nullable}
    return df.select(*[
        F.col(c) if c not in open_columns else _present(c) if c in text_columns else flag if c == "has_copies" else F.col(c)
        for c in SIGNAL_COLUMNS])


def distinct_evidence(evidence: DataFrame) -> DataFrame:
    """An identical repeat of an evidence row counts once; ``repeats`` says how often it came.

    Grouping by every column keeps this a hash aggregate with map-side combine.
    """
    return evidence.groupBy(*evidence.columns).agg(F.count(F.lit(1)).alias("repeats"))


def evidence_conflicts(evidence: DataFrame, entity: str = "evidence", id_cols: tuple[str, ...] = ("id",)) -> DataFrame:
    """Ids that occur with more than one payload. Also serves any (analysis, identity) pair."""
    distinct = distinct_evidence(evidence)
    many = distinct.groupBy("analysis_id", *id_cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])
    return rules.violation(many, entity, name, "conflicting_payload")


def evidence_outside_batch(evidence: DataFrame, items: DataFrame) -> DataFrame:
    known = items.select("analysis_id", "item_id")
    stray = evidence.join(known, ["analysis_id", "item_id"], "left_anti")
    return rules.violation(stray, "evidence", F.col("id"), "item_outside_batch")


def resolve_items(evidence: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Original item -> canonical item; an item that is no duplicate stands for itself."""
    pairs = duplicates.select(
        "analysis_id", F.col("duplicate_item_id").alias("item_id"), F.col("canonical_item_id").alias("_c"))
    canons = duplicates.select(
        "analysis_id", F.col("canonical_item_id").alias("item_id"), F.lit(True).alias("_is")).distinct()
    return (
        evidence.join(pairs, ["analysis_id", "item_id"], "left")
        .join(canons, ["analysis_id", "item_id"], "left")
        .withColumn("canonical_item_id", F.coalesce("_c", "item_id"))
        .withColumn("has_copies", F.col("_c").isNotNull() | F.coalesce("_is", F.lit(False)))
        .drop("_c", "_is")
    )


def named_concepts(rows: DataFrame) -> DataFrame:
    """``rows`` (type, label, value) with the normal forms of their concept, _text and _key."""
    concept = text.computed(
        rows, _concept=text.concept_label(F.col("type"), F.col("label"), F.col("value")))
    return text.computed(
        concept, _text=text.visual_text(F.col("_concept")), _key=text.aggregation_key(F.col("_concept"))).drop("_concept")


def named_labels(rows: DataFrame) -> DataFrame:
    """``rows`` (label) with the normal forms of the label, _text and _key."""
    return text.computed(rows, _text=text.visual_text(F.col("label")), _key=text.aggregation_key(F.col("label")))


def _is_named(rows: DataFrame) -> bool:
    return {"_text", "_key"} <= set(rows.columns)


def support_signals(evidence: DataFrame) -> DataFrame:
    """Evidence rows (with canonical_item_id, has_copies) as support signals.

    Evidence of few distinct concepts may come with :func:`named_concepts` joined to it; then
    no row passes its text through the normal forms again.
    """
    named = evidence if _is_named(evidence) else named_concepts(evidence)
    return _as_signals(named.filter(F.col("_text") != "").select(
        "analysis_id", F.col("id").alias("signal_id"), F.col("item_id").alias("original_item_id"),
        "canonical_item_id", "has_copies", F.col("type").alias("kind"), F.col("_key").alias("key"),
        F.col("_text").alias("label"), "source", "confidence",
    ))


def semantic_signals(similarities: DataFrame) -> DataFrame:
    """Matched similarities as signals without confidence.

    ``similarities``: analysis_id, item_id, canonical_item_id, has_copies, label, similarity,
    threshold, provider struct; :func:`named_labels` may be joined to them.
    """
    matched = similarities.filter(F.col("similarity") >= F.col("threshold"))
    rows = matched if _is_named(matched) else named_labels(matched)
    p = F.col("provider")
    sid = ids.semantic_signal_id({
        "image_id": F.col("item_id"), "kind": F.lit("semantic_theme"), "theme_label": F.col("label"),
        "similarity": F.col("similarity"), "threshold": F.col("threshold"), "provider": p["name"],
        "provider_version": p["version"], "model_id": p["model_id"],
        "model_version": p["model_version"], "config_version": p["config_version"],
    })
    return _as_signals(rows.select(
        "analysis_id", sid.alias("signal_id"), F.col("item_id").alias("original_item_id"),
        "canonical_item_id", "has_copies", F.lit("semantic_theme").alias("kind"),
        F.col("_key").alias("key"), F.col("_text").alias("label"), p["name"].alias("source"),
        F.lit(None).cast("double").alias("confidence"),
    ))


def union_signals(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*SIGNAL_COLUMNS) for p in parts])


def represent(distinct: DataFrame) -> DataFrame:
    """Keep one original item per (canonical item, kind, key, source) among exact copies.

    Takes the result of :func:`distinct_evidence` on signals. The canonical item speaks when it
    has such a signal, else the smallest id. Items without copies skip the choice; for the rest
    it is a partial aggregate plus an equi-join that includes the chosen item, so a group of
    copies of any size is spread by item.
    """
    # Tying the filter to the count keeps it above the aggregate, so that both sides (and every
    # later use) read the same exchange instead of computing the signals again.
    copied = F.when(F.col("repeats") > 0, F.col("has_copies"))
    alone = distinct.filter(~copied).select(*SIGNAL_COLUMNS)
    copies = distinct.filter(copied)
    chosen = (
        copies.groupBy(*_REP_KEYS)
        .agg(F.min(F.struct((F.col("original_item_id") != F.col("canonical_item_id")).alias("is_copy"),
                            "original_item_id")).alias("_r"))
        .select(*_REP_KEYS, F.col("_r.original_item_id").alias("original_item_id"))
    )
    kept = copies.join(chosen, [*_REP_KEYS, "original_item_id"]).select(*SIGNAL_COLUMNS)
    return alone.unionByName(kept)


def theme_aggregates(retained: DataFrame, universe: DataFrame,
                     hot_items: int = 10_000) -> DataFrame:
    """One row per (analysis, kind, key), all measures from partial aggregates.

    Counts and sums keep numeric buffers only, so both levels are hash aggregates; names come
    from the few distinct (label, source) pairs of a theme. The lists of supporting items and
    signals stay relational (:func:`support_links`): a theme may be supported by any number of
    rows. Sources are extractor identities, a short list.
    """
    theme = ["analysis_id", "kind", "key"]
    high, low = numbers.unit_sum_parts(F.col("confidence"))
    origin = F.xxhash64("original_item_id")
    per_item = retained.groupBy(*theme, "canonical_item_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("confidence").alias("nc"), high.alias("hi"), low.alias("lo"),
        F.max("confidence").alias("mx"), (F.min(origin) == F.max(origin)).cast("int").alias("one"))
    measured = per_item.groupBy(*theme).agg(
        F.sum("n").alias("evidence_count"), F.count(F.lit(1)).alias("unique_item_count"), F.sum("nc").alias("nc"),
        F.sum("hi").alias("hi"), F.sum("lo").alias("lo"), F.max("mx").alias("max_confidence"),
        (F.min("n") / F.max("n")).alias("cross_item_consistency"), (F.min("one") == 1).alias("support_preserved"))
    named = retained.select(*theme, "label", "source").distinct().groupBy(*theme).agg(
        F.min("label").alias("label"), F.collect_set("source").alias("srcs"))
    average = F.when(F.col("nc") > 0, numbers.unit_sum(F.col("hi"), F.col("lo")) / F.col("nc"))
    shaped = measured.join(named, theme).select(
        *theme, "label", "evidence_count", "unique_item_count",
        average.alias("average_confidence"), "max_confidence",
        F.size("srcs").cast("bigint").alias("source_diversity"), "cross_item_consistency",
        sorted_texts(F.col("srcs")).alias("sources"), "support_preserved",
    )
    joined = skew.lookup(
        shaped, universe.withColumn("_size", F.col("item_universe_count")), ["analysis_id"], "_size",
        hot_items, how="inner", spread_by=["kind", "key"],
    ).drop("_size")
    return joined.withColumn("item_coverage", F.col("unique_item_count") / F.col("item_universe_count"))


def sorted_texts(c: Column) -> Column:
    """Distinct strings by (case-folded, text)."""
    pairs = F.transform(F.array_distinct(c), lambda s: F.struct(F.lower(F.replace(s, F.lit("ß"), F.lit("ss"))).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(pairs), lambda p: p["s"])


def support_links(retained: DataFrame) -> DataFrame:
    """The supporting signals of every theme, one row each."""
    return retained.select(
        "analysis_id", "kind", "key", "signal_id", "canonical_item_id", "original_item_id", "confidence")


def aggregate_violations(aggregates: DataFrame) -> DataFrame:
    """Self-consistency of theme aggregates."""
    c = F.col
    checks = {
        "key_not_canonical": text.aggregation_key(c("key")) == c("key"),
        "evidence_count": rules.positive_int(c("evidence_count")),
        "unique_items_exceed_universe": (c("unique_item_count") > 0) & (c("unique_item_count") <= c("item_universe_count")),
        "coverage": rules.probability(c("item_coverage"))
        & (F.abs(c("item_coverage") - c("unique_item_count") / c("item_universe_count")) <= 1e-12),
        "confidence_pair": c("average_confidence").isNull() == c("max_confidence").isNull(),
        "average_exceeds_max": F.coalesce(c("average_confidence") <= c("max_confidence") + 1e-12, F.lit(True)),
        "confidence_range": F.coalesce(rules.probability(c("max_confidence")), F.lit(True)),
        "consistency": rules.probability(c("cross_item_consistency")),
        "source_count": c("source_diversity") == F.size("sources"),
    }
    _, broken = rules.apply_rules(aggregates, "aggregate", F.concat_ws(":", "kind", "key"), checks)
    return broken
