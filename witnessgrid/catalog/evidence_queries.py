"""Items, evidence, aggregation and insights over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, claims as claim_ops, extract, insights as ins, items as item_ops, metrics, parts, questionnaire, result, runs as run_ops
from ..plans import profile
from ..session import cut_lineage, drop_stash, shared_path, stash
from ..sources import readers, writers
from . import views
from .registry import query
from .views import sql


def insights(spark, sf, retained=None):
    sizes = views.table(spark, sf, "documents").select(F.col("source").alias("analysis_id"))
    aggregates = views.aggregates(spark, sf) if retained is None else aggregate.theme_aggregates(retained, item_ops.universe(views.items(spark, sf)))
    return profile.ranked_insights(aggregates, sizes)


def kept_evidence(spark, sf):
    """Redacted evidence with its themes, made once for all that comes from it."""
    return stash(views.themed_evidence(spark, sf), "zstd")


def kept_retained(spark, sf, evidence=None):
    """The retained signals of themes that may become insights, made once for the insights and the ids behind them."""
    own = kept_evidence(spark, sf) if evidence is None else evidence
    retained = stash(views.retained(spark, sf, own))
    if evidence is None:
        drop_stash(own)
    return retained


@query("AGG5 AGG6 PRJ3 PRJ5 RULE13 RULE19 MTH7 WIN7 HSH4", sql("""
SELECT analysis_id, CAST(rank AS INTEGER) AS rank, insight_key, type, insight_label, round(confidence, 6) AS confidence,
       evidence_count, unique_item_count, round(item_coverage, 6) AS item_coverage
FROM insights""", "insights"))
def ranked_insights(spark, sf):
    return insights(spark, sf).select(
        "analysis_id", F.col("rank").cast("int").alias("rank"), "insight_key", "type", "insight_label", F.round("confidence", 6).alias("confidence"),
        "evidence_count", "unique_item_count", F.round("item_coverage", 6).alias("item_coverage"))


@query("AGG5 AGG6 ARR1 WIN2", sql("""
SELECT analysis_id, kind, key, label, evidence_count, unique_item_count, item_universe_count,
       round(item_coverage, 6) AS item_coverage, round(average_confidence, 6) AS average_confidence,
       round(max_confidence, 6) AS max_confidence, source_diversity, sources,
       round(cross_item_consistency, 6) AS cross_item_consistency, resolved_item_count = unique_item_count AS support_preserved
FROM aggregates""", "aggregates"))
def theme_aggregates(spark, sf):
    r = lambda c: F.round(c, 6).alias(c)
    return views.aggregates(spark, sf).select(
        "analysis_id", "kind", "key", "label", "evidence_count", "unique_item_count", "item_universe_count",
        r("item_coverage"), r("average_confidence"), r("max_confidence"), "source_diversity",
        F.array_join("sources", ",").alias("sources"), r("cross_item_consistency"), "support_preserved")


@query("WIN1 JOIN2 HSH6", sql("""
SELECT analysis_id, item_id, canonical_item_id, copies, content_hash FROM resolved""", "resolved"))
def canonical_items(spark, sf):
    return views.resolved_items(spark, sf).select(
        "analysis_id", "item_id", "canonical_item_id", "copies", "content_hash")


# -- evidence rows -------------------------------------------------------------------------

@query("PRJ1 HSH1 STR4 STR7", sql("""
SELECT id, item_id, value, source, round(confidence, 6) AS confidence, ord AS block_order, 'latin' AS script_hint FROM evidence WHERE regexp_matches(value, '[A-Za-zÀ-ÿ]')
UNION ALL SELECT id, item_id, value, source, round(confidence, 6), ord, CASE WHEN regexp_matches(value, '[0-9]') THEN 'numeric' ELSE 'other' END FROM evidence WHERE NOT regexp_matches(value, '[A-Za-zÀ-ÿ]')""", "evidence"))
def text_evidence(spark, sf):
    return views.evidence(spark, sf).select(
        "id", "item_id", "value", "source", F.round("confidence", 6).alias("confidence"),
        F.get_json_object("metadata", "$.block_order").cast("bigint").alias("block_order"),
        F.get_json_object("metadata", "$.script_hint").alias("script_hint"))


def visual_evidence(spark, sf):
    o = views.observations(spark, sf).withColumn("canonical_item_id", F.col("item_id")).withColumn("has_copies", F.lit(False))
    provider = {"provider_version": F.lit("1"), "model_id": F.lit("m"), "model_version": F.lit("1"), "config_version": F.lit("c"),
                "confidence_semantics": F.lit("uncalibrated")}
    return extract.observation_evidence(o, F.lit("event_log"), provider, keep=("canonical_item_id", "has_copies"))


views.cte("visual_evidence", """
SELECT analysis_id, item_id, 'vision-' || substr(sha256('phase5-visual-evidence-v1' || chr(0) || item_id || chr(0) || type || chr(0) || elabel || chr(0) || label), 1, 24) AS id,
       type, elabel AS label, label AS value, confidence, 'event_log' AS source, kind
FROM (SELECT *, CASE kind WHEN 'caption' THEN 'other_observable' ELSE kind END AS type, CASE kind WHEN 'caption' THEN 'factual_caption' ELSE label END AS elabel FROM observations)""", "observations")


@query("PRJ2 HSH2 STR3", sql("SELECT id, item_id, type, label, value, round(confidence, 6) AS confidence, kind AS visual_kind, 'false' AS calibrated FROM visual_evidence", "visual_evidence"))
def observation_evidence(spark, sf):
    return visual_evidence(spark, sf).select(
        "id", "item_id", "type", "label", "value", F.round("confidence", 6).alias("confidence"),
        F.get_json_object("metadata", "$.visual_kind").alias("visual_kind"), F.get_json_object("metadata", "$.confidence_calibrated").alias("calibrated"))


def all_evidence(spark, sf):
    return views.evidence(spark, sf).unionByName(visual_evidence(spark, sf))


@query("SET1", sql("""
SELECT type, count(*) AS n, count(DISTINCT item_id) AS items FROM (SELECT type, item_id FROM evidence UNION ALL SELECT type, item_id FROM visual_evidence) GROUP BY type""", "evidence", "visual_evidence"))
def evidence_by_type(spark, sf):
    per_item = all_evidence(spark, sf).groupBy("type", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return per_item.groupBy("type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("items"))


@query("PRJ3 STR8", sql(f"""
SELECT id AS signal_id, item_id AS original_item_id, type AS kind, {views.fold_sql('CASE WHEN type = $$other_observable$$ THEN value ELSE label END')} AS key, source FROM visual_evidence""", "visual_evidence"))
def observation_signals(spark, sf):
    return aggregate.support_signals(visual_evidence(spark, sf)).select("signal_id", "original_item_id", "kind", "key", "source")


@query("AGG2", sql("""
SELECT analysis_id, 'evidence' AS entity, id AS entity_id, 'conflicting_payload' AS rule
FROM (SELECT DISTINCT analysis_id, id, confidence FROM visual_evidence) GROUP BY analysis_id, id HAVING count(*) > 1""", "visual_evidence"))
def evidence_id_conflicts(spark, sf):
    return aggregate.evidence_conflicts(visual_evidence(spark, sf))


@query("AGG2", sql("SELECT count(*) AS n FROM (SELECT DISTINCT id, item_id, value, confidence, source FROM evidence)", "evidence"))
def distinct_evidence_count(spark, sf):
    e = views.evidence(spark, sf)
    return aggregate.distinct_evidence(e.unionByName(e)).agg(F.count(F.lit(1)).alias("n"))


@query("JOIN1", sql("""
SELECT analysis_id, 'evidence' AS entity, id AS entity_id, 'item_outside_batch' AS rule FROM evidence WHERE item_id IN (SELECT item_id FROM items WHERE n_chars % 10 = 0)""", "evidence"))
def evidence_outside_batch(spark, sf):
    return aggregate.evidence_outside_batch(views.evidence(spark, sf), views.items(spark, sf).filter("n_chars % 10 <> 0"))


@query("JOIN2", sql("SELECT id, item_id, canonical_item_id, has_copies FROM evidence", "evidence"))
def canonical_evidence_items(spark, sf):
    plain = views.evidence(spark, sf).drop("canonical_item_id", "has_copies")
    return aggregate.resolve_items(plain, item_ops.duplicates_of(views.resolved_items(spark, sf))).select("id", "item_id", "canonical_item_id", "has_copies")


@query("WIN2", sql("SELECT signal_id, original_item_id, canonical_item_id, kind, key, source FROM retained", "retained"))
def representative_signals(spark, sf):
    return views.retained(spark, sf).select("signal_id", "original_item_id", "canonical_item_id", "kind", "key", "source")


EVENT_AGGREGATES = views.AGGREGATES_SQL.format(signals="""(
  SELECT DISTINCT analysis_id, id, type AS kind, lower(CASE WHEN type = 'other_observable' THEN value ELSE label END) AS key,
         CASE WHEN type = 'other_observable' THEN value ELSE label END AS label, item_id AS canonical_item_id, confidence FROM visual_evidence)""",
    universe="(SELECT analysis_id, count(DISTINCT item_id) AS item_universe_count FROM observations GROUP BY analysis_id)")


@query("AGG5 AGG6 SET1", sql(f"""
SELECT analysis_id, kind, key, label, evidence_count, unique_item_count, item_universe_count, round(average_confidence, 6) AS average_confidence,
       round(max_confidence, 6) AS max_confidence, round(cross_item_consistency, 6) AS cross_item_consistency FROM ({EVENT_AGGREGATES})""", "visual_evidence", "observations"))
def observation_aggregates(spark, sf):
    days = views.observations(spark, sf).select("analysis_id", "item_id").distinct()
    signals = aggregate.distinct_evidence(aggregate.support_signals(visual_evidence(spark, sf)))
    a = aggregate.theme_aggregates(aggregate.represent(signals), item_ops.universe(days))
    r = lambda c: F.round(c, 6).alias(c)
    return a.select("analysis_id", "kind", "key", "label", "evidence_count", "unique_item_count", "item_universe_count",
                    r("average_confidence"), r("max_confidence"), r("cross_item_consistency"))


@query("RULE23", "SELECT '' AS analysis_id, '' AS entity, '' AS entity_id, '' AS rule WHERE false")
def aggregate_violations(spark, sf):
    a = views.aggregates(spark, sf)
    return aggregate.aggregate_violations(a)


@query("RULE23", sql("""
SELECT analysis_id, 'aggregate' AS entity, kind || ':' || key AS entity_id, unnest(['coverage', 'source_count']) AS rule FROM aggregates WHERE evidence_count = 2""", "aggregates"))
def spoiled_aggregate_violations(spark, sf):
    a = views.aggregates(spark, sf)
    two = F.col("evidence_count") == 2
    spoiled = a.withColumn("item_coverage", F.when(two, F.col("item_coverage") / 2).otherwise(F.col("item_coverage"))).withColumn(
        "source_diversity", F.when(two, F.col("source_diversity") + 1).otherwise(F.col("source_diversity")))
    return aggregate.aggregate_violations(spoiled)


@query("AGG4", sql("""
SELECT analysis_id, 'aggregate' AS entity, kind || ':' || key AS entity_id, 'conflicting_payload' AS rule FROM aggregates WHERE unique_item_count >= 2""", "aggregates"))
def aggregate_identity_conflicts(spark, sf):
    a = views.aggregates(spark, sf).select("analysis_id", "kind", "key", "evidence_count", "unique_item_count")
    other = a.filter("unique_item_count >= 2").withColumn("evidence_count", F.col("evidence_count") + 1)
    return aggregate.evidence_conflicts(a.unionByName(a).unionByName(other), "aggregate", ("kind", "key"))


@query("RULE19", sql("SELECT analysis_id, key FROM aggregates WHERE evidence_count >= 2 AND unique_item_count >= 2 AND item_coverage >= 0.05 AND average_confidence >= 0.7", "aggregates"))
def eligible_aggregates(spark, sf):
    p = ins.SupportPolicy(min_coverage=0.05, min_confidence=0.7)
    return views.aggregates(spark, sf).filter(ins.eligible(p)).select("analysis_id", "key")


@query("RULE13", sql(f"""
SELECT sample_id, key FROM claims WHERE NOT {views.violates_sql('key', 'label')}""", "claims"))
def observable_claims(spark, sf):
    return ins.observable(views.claims(spark, sf)).select("sample_id", "key")


# -- support -------------------------------------------------------------------------------

@query("JOIN5", sql("""
SELECT analysis_id, key, signal_id, original_item_id AS evidence_item FROM retained r WHERE length(label) % 4 <> 0""", "retained"))
def resolved_support(spark, sf):
    links = aggregate.support_links(views.retained(spark, sf))
    known = views.evidence(spark, sf).filter(F.length("value") % 4 != 0)
    good, _ = result.resolve_support(links, known)
    return good.select("analysis_id", "key", "signal_id", "evidence_item")


@query("JOIN5", sql("""
SELECT analysis_id, 'aggregate' AS entity, signal_id AS entity_id, CASE WHEN length(label) % 4 = 0 THEN 'unknown_evidence' ELSE 'incompatible_type' END AS rule
FROM retained WHERE length(label) % 4 IN (0, 1)""", "retained"))
def unresolved_support(spark, sf):
    links = aggregate.support_links(views.retained(spark, sf))
    e = views.evidence(spark, sf)
    m = F.length("value") % 4
    known = e.filter(m != 0).withColumn("type", F.when(m == 1, "topic").otherwise(F.col("type")))
    _, bad = result.resolve_support(links, known)
    return bad


def insight_links(ranked, retained):
    links = aggregate.support_links(retained).join(
        ranked.select("analysis_id", "kind", "key", "insight_key"), ["analysis_id", "kind", "key"])
    none = F.lit(None).cast("string")
    ev = links.select("analysis_id", F.col("insight_key").alias("key"), F.col("signal_id").alias("evidence_id"), none.alias("item_id"))
    it = links.select("analysis_id", F.col("insight_key").alias("key"), none.alias("evidence_id"), F.col("original_item_id").alias("item_id")).distinct()
    return ev.unionByName(it)


@query("JOIN10", "SELECT '' AS analysis_id, '' AS entity, '' AS entity_id, '' AS rule WHERE false")
def result_graph_violations(spark, sf):
    retained = kept_retained(spark, sf)
    ranked = cut_lineage(insights(spark, sf, retained))
    owners = ranked.select("analysis_id", F.col("insight_key").alias("key"), "evidence_count", "item_coverage")
    return result.support_violations(owners, insight_links(ranked, retained), views.evidence(spark, sf), views.items(spark, sf))


@query("JOIN10", sql("""
SELECT analysis_id, 'statement' AS entity, insight_key AS entity_id, unnest(['coverage', 'evidence_count']) AS rule FROM insights WHERE evidence_count % 2 = 0""", "insights"))
def spoiled_graph_violations(spark, sf):
    retained = kept_retained(spark, sf)
    ranked = cut_lineage(insights(spark, sf, retained))
    even = F.col("evidence_count") % 2 == 0
    owners = ranked.select(
        "analysis_id", F.col("insight_key").alias("key"), F.when(even, F.col("evidence_count") + 1).otherwise(F.col("evidence_count")).alias("evidence_count"),
        F.when(even, F.col("item_coverage") / 2).otherwise(F.col("item_coverage")).alias("item_coverage"))
    return result.support_violations(owners, insight_links(ranked, retained), views.evidence(spark, sf), views.items(spark, sf))


@query("JOIN10 RULE6", "SELECT '' AS analysis_id, '' AS entity, '' AS entity_id, '' AS rule WHERE false")
def evidence_graph_violations(spark, sf):
    return result.evidence_violations(views.evidence(spark, sf), views.items(spark, sf))


@query("JOIN10", sql("""
SELECT analysis_id, 'evidence' AS entity, id AS entity_id, 'duplicate_evidence' AS rule FROM evidence WHERE confidence > 0.9
UNION ALL SELECT analysis_id, 'evidence', id, 'unknown_item' FROM (SELECT * FROM evidence UNION ALL SELECT * FROM evidence WHERE confidence > 0.9)
WHERE item_id IN (SELECT item_id FROM items WHERE n_chars % 10 = 0)""", "evidence", "items"))
def spoiled_evidence_violations(spark, sf):
    """Some evidence comes twice, and some items are missing."""
    e = views.evidence(spark, sf)
    return result.evidence_violations(e.unionByName(e.filter("confidence > 0.9")), views.items(spark, sf).filter("n_chars % 10 <> 0"))


# -- results of analyses of any size -------------------------------------------------------

views.cte("analyses", "SELECT DISTINCT analysis_id FROM items", "items")


def all_items(spark, sf):
    """The items of all analyses; the request limit on items is a rule of its own."""
    return views.items(spark, sf)


def kept_insights(spark, sf, retained=None):
    """Ranked insights, kept for the several outputs that read them."""
    return cut_lineage(insights(spark, sf, retained))


def support(ranked, retained):
    """The ids behind the insights, kept for the several outputs that read them."""
    return stash(profile.supporting_ids(ranked, retained))


views.cte("support", """
SELECT DISTINCT i.analysis_id, i.insight_key, i.rank, part, id
FROM (SELECT analysis_id, kind, key, unnest(['signal', 'item']) AS part, unnest([signal_id, original_item_id]) AS id FROM retained) r
JOIN insights i USING (analysis_id, kind, key)""", "retained", "insights")

views.cte("explained", """
SELECT analysis_id, insight_key, 0 AS place, '' AS own, 'Supported by ' || evidence_count || ' evidence signals across ' || unique_item_count || '/' || item_universe_count
       || ' images (coverage=' || printf('%.6f', item_coverage) || '); source_diversity=' || source_diversity || '; cross_image_consistency='
       || printf('%.6f', cross_item_consistency) || '; average_evidence_confidence=' || printf('%.6f', average_confidence) || '; max_evidence_confidence='
       || printf('%.6f', max_confidence) || '; supporting_image_ids=[' AS text, '' AS sep, true AS opens FROM insights
UNION ALL SELECT analysis_id, insight_key, 1, id, id, ', ', false FROM support WHERE part = 'item'
UNION ALL SELECT analysis_id, insight_key, 2, '', '].', '', false FROM insights""", "insights", "support")

EXPLANATION_BYTES, SUMMARY_BYTES, DOCUMENT_BYTES = 128, 64, 2048


@query("PRJ5 ARR1", sql("SELECT analysis_id, insight_key, CAST(rank AS INTEGER) AS rank, part, id FROM support", "support"))
def insight_support(spark, sf):
    retained = kept_retained(spark, sf)
    return support(kept_insights(spark, sf, retained), retained).withColumn("rank", F.col("rank").cast("int"))


@query("STR10 PRJ5 RULE16", sql(
    "SELECT analysis_id, insight_key, part_no, payload AS explanation FROM (" + views.parts_sql("explained", "analysis_id, insight_key", "place, own", 128) + ")", "explained"))
def explained_insights(spark, sf):
    """Explanations in small parts, so that the check sees the cuts."""
    retained = kept_retained(spark, sf)
    ranked = kept_insights(spark, sf, retained)
    return ins.explanation_parts(ranked, support(ranked, retained), EXPLANATION_BYTES).withColumnRenamed("payload", "explanation")


@query("RULE12", "SELECT '' AS analysis_id, '' AS entity, '' AS entity_id, '' AS rule WHERE false")
def finished_insight_violations(spark, sf):
    retained = kept_retained(spark, sf)
    ranked = kept_insights(spark, sf, retained)
    return ins.finished_violations(ranked, support(ranked, retained))


@query("RULE12", sql("""
SELECT analysis_id, 'insight' AS entity, insight_key AS entity_id, 'label_policy' AS rule FROM insights WHERE evidence_count % 2 = 0
UNION ALL SELECT analysis_id, 'insight', insight_key, 'item_id_policy' FROM support WHERE part = 'item' GROUP BY ALL HAVING bool_or(id LIKE '%7')""", "insights", "support"))
def spoiled_insight_violations(spark, sf):
    """Labels of insights with even counts and ids ending in 7 break the policy."""
    retained = kept_retained(spark, sf)
    ranked = kept_insights(spark, sf, retained)
    ids = support(ranked, retained).withColumn("id", F.when(F.col("id").endswith("7"), F.lit("Person religion = x")).otherwise(F.col("id")))
    return ins.finished_violations(ranked.withColumn(
        "insight_label", F.when(F.col("evidence_count") % 2 == 0, F.lit("Person religion = x")).otherwise(F.col("insight_label"))), ids)


views.cte("summary_pieces", """
SELECT s.analysis_id, 0 AS step, 0 AS place, CASE WHEN i.analysis_id IS NULL THEN 'No supported insights met the configured evidence policy.' ELSE 'Supported insights: ' END AS text,
       '' AS sep, true AS opens FROM analyses s LEFT JOIN (SELECT analysis_id FROM insights WHERE rank = 1) i USING (analysis_id)
UNION ALL SELECT analysis_id, 1, rank, insight_label, ' | ', false FROM insights""", "analyses", "insights")


@query("STR11", sql(
    "SELECT analysis_id, part_no, payload AS summary FROM (" + views.parts_sql("summary_pieces", "analysis_id", "step, place", 64) + ")", "summary_pieces"))
def insight_summaries(spark, sf):
    return ins.summary_parts(kept_insights(spark, sf), all_items(spark, sf), SUMMARY_BYTES).withColumnRenamed("payload", "summary")


@query("AGG28", sql("SELECT analysis_id, n % 3 <> 0 OR n = 0 AS factual FROM (SELECT s.analysis_id, count(i.rank) AS n FROM analyses s LEFT JOIN insights i USING (analysis_id) GROUP BY ALL)", "analyses", "insights"))
def summary_factuality(spark, sf):
    """Summaries of stored documents beside those rebuilt; where the number of insights is a
    multiple of three, the documents were stored without the last insight."""
    evidence = kept_evidence(spark, sf)
    retained = kept_retained(spark, sf, evidence)
    ranked = kept_insights(spark, sf, retained)
    last = ranked.groupBy("analysis_id").agg(F.max("rank").alias("rank")).filter("rank % 3 = 0")
    stored = documents(spark, sf, (evidence, retained, ranked.join(last, ["analysis_id", "rank"], "left_anti")))
    _, leaves, _ = result.read_documents(stored, ("summary",))
    was = leaves.filter("path = 'summary'").select("analysis_id", F.col("chunk_no").cast("bigint").alias("n"), F.col("value").alias("text"))
    again = ins.summary_parts(ranked, all_items(spark, sf)).select("analysis_id", F.col("part_no").alias("n"), F.col("payload").alias("text"))
    return run_ops.summary_factuality(was, again)


@query("AGG29", sql("""
WITH e AS (SELECT DISTINCT analysis_id, type, insight_label AS label FROM insights WHERE rank <= 1 UNION SELECT analysis_id, 'activity', 'expected but absent' FROM analyses),
m AS (SELECT coalesce(e.analysis_id, i.analysis_id) AS a, e.label IS NOT NULL AS expected, i.insight_label IS NOT NULL AS predicted
      FROM e FULL JOIN insights i ON e.analysis_id = i.analysis_id AND e.type = i.type AND e.label = i.insight_label)
SELECT count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (expected) AS n_expected, count(*) FILTER (predicted) AS n_predicted,
       round(count(*) FILTER (expected AND predicted) / count(*) FILTER (predicted)::DOUBLE, 6) AS precision, round(count(*) FILTER (expected AND predicted) / count(*) FILTER (expected)::DOUBLE, 6) AS recall
FROM m""", "insights", "analyses"))
def insight_precision_recall(spark, sf):
    got = insights(spark, sf).select("analysis_id", "type", F.col("insight_label").alias("label"), "rank")
    absent = all_items(spark, sf).select("analysis_id").distinct().select(
        "analysis_id", F.lit("activity").alias("type"), F.lit("expected but absent").alias("label"))
    want = got.filter("rank <= 1").drop("rank").unionByName(absent)
    out = metrics.precision_recall_f1(metrics.label_matches(want, got, ["analysis_id", "type", "label"]))
    return out.select("tp", "n_expected", "n_predicted", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("PRJ6", sql("""
SELECT id, type, CASE WHEN type = 'ocr_text' THEN NULL ELSE value END AS value, false AS has_raw_text, type = 'ocr_text' AS has_order
FROM (SELECT id, type, value FROM evidence UNION ALL SELECT id, type, value FROM visual_evidence)""", "evidence", "visual_evidence"))
def redacted_evidence(spark, sf):
    keys = F.json_object_keys("metadata")
    return result.redacted(all_evidence(spark, sf)).select(
        "id", "type", "value", F.array_contains(keys, "raw_text").alias("has_raw_text"), F.array_contains(keys, "block_order").alias("has_order"))


@query("PRJ10", sql("""
SELECT analysis_id, key, label, count(*) AS n FROM (SELECT analysis_id, type AS key, label FROM evidence UNION ALL SELECT analysis_id, type, insight_label FROM insights
UNION ALL SELECT analysis_id, kind, label FROM observations) GROUP BY ALL""", "evidence", "insights", "observations"))
def stated_claims(spark, sf):
    c = result.evidence_claims(views.evidence(spark, sf), insights(spark, sf)).unionByName(result.provider_claims(views.observations(spark, sf)))
    return c.groupBy("analysis_id", "key", "label").agg(F.count(F.lit(1)).alias("n"))


def claims_of(spark, sf):
    """A claim for every language of an analysis; those of analyses with a bad claim are left out."""
    told = views.table(spark, sf, "documents").filter("lang IS NOT NULL").select(F.col("source").alias("analysis_id"), "lang").distinct()
    rows = told.select(
        "analysis_id", F.concat(F.lit("c-"), "lang").alias("claim_id"), F.lit("religion").alias("category"), F.col("lang").alias("value"),
        F.lit("src").alias("source_id"), F.lit("bio").alias("source_type"), (F.col("analysis_id") != "src3").alias("consent_confirmed"),
        F.lit("explicit_self_report").alias("basis"))
    good, _ = claim_ops.accepted(rows)
    return good


views.cte("told_claims", "SELECT DISTINCT source AS analysis_id, 'c-' || lang AS claim_id, lang FROM documents WHERE lang IS NOT NULL AND source <> 'src3'")


def documents(spark, sf, made=None, with_claims=True):
    """Stored documents in small parts; measures are rounded, so that engines print them alike.

    ``made``: the kept evidence and retained signals, which end here, and the insights of them."""
    if made is None:
        evidence = kept_evidence(spark, sf)
        retained = kept_retained(spark, sf, evidence)
        made = evidence, retained, kept_insights(spark, sf, retained)
    evidence, retained, ranked = made
    shown = ranked.withColumns({c: F.round(c, 6) for c in ("confidence", "item_coverage")})
    ids = support(ranked, retained)
    drop_stash(retained)
    stored = result.document_parts(
        all_items(spark, sf), evidence.withColumn("confidence", F.round("confidence", 6)), shown, ids, ins.SupportPolicy().version,
        claims_of(spark, sf) if with_claims else None, part_bytes=DOCUMENT_BYTES)
    drop_stash(evidence)
    return stored


_LATIN = "regexp_matches(value, '[A-Za-zÀ-ÿ]')"
_INNER = lambda c: f"substr(CAST(to_json({c}) AS VARCHAR), 2, length(CAST(to_json({c}) AS VARCHAR)) - 2)"

views.cte("document_pieces", f"""
SELECT analysis_id, 1 AS o1, 0 AS o2, 0 AS o3, '' AS o4, '{{"insight_policy_version":"phase8-candidate-v1","personality_profile":null,"result":{{"analysis_id":' || to_json(analysis_id) || ',"images":[' AS text, '' AS sep, true AS opens FROM analyses
UNION ALL SELECT analysis_id, 2, ordinal, 0, '', '{{"analysis_id":' || to_json(analysis_id) || ',"evidence":[', ',', true FROM items
UNION ALL SELECT e.analysis_id, 2, i.ordinal, 1, e.id, '{{"confidence":' || to_json(round(confidence, 6)) || ',"id":' || to_json(e.id) || ',"image_id":' || to_json(e.item_id) || ',"label":"ocr_text","metadata":'
  || to_json('{{"block_order":"' || ord || '","config_version":"v1","language_hint":' || CASE WHEN {_LATIN} THEN '"en"' ELSE 'null' END || ',"model_id":"lines","provider_version":"1","script_hint":"'
  || CASE WHEN {_LATIN} THEN 'latin' WHEN regexp_matches(value, '[0-9]') THEN 'numeric' ELSE 'other' END || '"}}') || ',"source":' || to_json(source) || ',"type":"ocr_text","value":null}}', ',', false
  FROM evidence e JOIN items i USING (analysis_id, item_id)
UNION ALL SELECT analysis_id, 2, ordinal, 2, '', '],"image_id":' || to_json(item_id) || '}}', '', false FROM items
UNION ALL SELECT analysis_id, 3, 0, 0, '', '],"insights":[', '', true FROM analyses
UNION ALL SELECT analysis_id, 4, rank, 0, '', '{{"confidence":' || to_json(round(confidence, 6)) || ',"evidence_count":' || evidence_count || ',"explanation":"', ',', false FROM insights
UNION ALL SELECT analysis_id, 4, rank, 1, '', {_INNER('text')}, '', true FROM explained JOIN (SELECT analysis_id, insight_key, rank FROM insights) USING (analysis_id, insight_key) WHERE place = 0
UNION ALL SELECT analysis_id, 4, rank, 2, id, {_INNER('id')}, ', ', false FROM support WHERE part = 'item'
UNION ALL SELECT analysis_id, 4, rank, 3, '', '].","image_coverage":' || to_json(round(item_coverage, 6)) || ',"key":' || to_json(insight_key) || ',"label":' || to_json(insight_label) || ',"supporting_evidence_ids":[', '', true FROM insights
UNION ALL SELECT analysis_id, 4, rank, 4, id, CAST(to_json(id) AS VARCHAR), ',', false FROM support WHERE part = 'signal'
UNION ALL SELECT analysis_id, 4, rank, 5, '', '],"supporting_image_ids":[', '', true FROM insights
UNION ALL SELECT analysis_id, 4, rank, 6, id, CAST(to_json(id) AS VARCHAR), ',', false FROM support WHERE part = 'item'
UNION ALL SELECT analysis_id, 4, rank, 7, '', '],"type":' || to_json(type) || '}}', '', false FROM insights
UNION ALL SELECT analysis_id, 5, 0, 0, '', '],"status":"completed","themes":[]}},"schema_version":"profile-analysis-result-v3","self_reported_claims":[', '', true FROM analyses
UNION ALL SELECT analysis_id, 6, 0, 0, claim_id, '{{"basis":"explicit_self_report","category":"religion","claim_id":' || to_json(claim_id) || ',"consent_confirmed":true,"source_id":"src","source_type":"bio","value":' || to_json(lang) || '}}', ',', false FROM told_claims
UNION ALL SELECT analysis_id, 7, 0, 0, '', '],"summary":"', '', false FROM analyses
UNION ALL SELECT analysis_id, 8, place, step, '', {_INNER('text')}, sep, opens FROM summary_pieces
UNION ALL SELECT analysis_id, 9, 0, 0, '', '"}}', '', false FROM analyses""",
    "analyses", "items", "evidence", "insights", "explained", "support", "told_claims", "summary_pieces")


@query("SNK1 HSH7", sql(
    "SELECT analysis_id, 'completed' AS status, part_no, payload AS result_payload FROM ("
    + views.parts_sql("document_pieces", "analysis_id", "o1, o2, o3, o4", 2048) + ")", "document_pieces"))
def completed_documents(spark, sf):
    return documents(spark, sf)


CONTENT = ("summary", "result.insights[].key", "result.insights[].explanation", "self_reported_claims[].claim_id")


@query("SNK1 PRJ9 RULE17", sql(f"""
WITH told AS (
  SELECT analysis_id, 'summary' AS path, 0 AS place, string_agg(CASE WHEN n > 2 THEN sep ELSE '' END || text, '' ORDER BY n) AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY step, place) AS n FROM summary_pieces) GROUP BY ALL
  UNION ALL SELECT analysis_id, 'result.insights[].key', rank - 1, insight_key FROM insights
  UNION ALL SELECT analysis_id, 'result.insights[].explanation', rank - 1, string_agg(CASE WHEN place = 1 AND n > 2 THEN sep ELSE '' END || text, '' ORDER BY n)
  FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, insight_key ORDER BY place, own) AS n FROM explained) JOIN (SELECT analysis_id, insight_key, rank FROM insights) USING (analysis_id, insight_key) GROUP BY ALL
  UNION ALL SELECT analysis_id, 'self_reported_claims[].claim_id', row_number() OVER (PARTITION BY analysis_id ORDER BY claim_id) - 1, claim_id FROM told_claims)
SELECT s.analysis_id, 'profile-analysis-result-v3' AS schema_version, 'phase8-candidate-v1' AS insight_policy_version,
       (SELECT count(*) FROM items i WHERE i.analysis_id = s.analysis_id) AS images, (SELECT count(*) FROM evidence e WHERE e.analysis_id = s.analysis_id) AS evidence_rows,
       (SELECT count(*) FROM insights x WHERE x.analysis_id = s.analysis_id) AS insights, (SELECT count(*) FROM told_claims c WHERE c.analysis_id = s.analysis_id) AS claims,
       t.path, t.place, unnest(range(greatest(1, (length(t.value) + {parts.CHUNK_CHARS - 1}) // {parts.CHUNK_CHARS}))) AS chunk_no,
       substr(t.value, unnest(range(greatest(1, (length(t.value) + {parts.CHUNK_CHARS - 1}) // {parts.CHUNK_CHARS}))) * {parts.CHUNK_CHARS} + 1, {parts.CHUNK_CHARS}) AS value
FROM analyses s JOIN told t USING (analysis_id)""", "analyses", "items", "evidence", "insights", "explained", "told_claims", "summary_pieces"))
def stored_results(spark, sf):
    """Documents merged into the result table as parts and read back as a stream of leaves: the summary, the insights' keys
    and explanations and the claims of each, whole and in order, in chunks, beside its versions and counts."""
    path = shared_path(spark, "results")
    stored = documents(spark, sf)
    writers.write_state(stored.limit(0), path)
    writers.write_completed(stored, path, ("results", 1))
    objects = {"images": "result.images[]", "evidence_rows": "result.images[].evidence[]", "insights": "result.insights[]", "claims": "self_reported_claims[]"}
    good, leaves, _ = result.read_documents(readers.read_state(spark, path, "completed"), (*CONTENT, *objects.values()))
    counts = leaves.filter("kind = 'object'").groupBy("analysis_id").agg(*[F.count_if(F.col("path") == p).alias(n) for n, p in objects.items()])
    told = leaves.filter(F.col("path").isin(*CONTENT) & (F.col("kind") == "string")).select(
        "analysis_id", "path", F.coalesce(F.get("at", F.lit(0)), F.lit(0)).alias("place"), "chunk_no", "value")
    return good.join(counts, "analysis_id").select("analysis_id", "schema_version", "insight_policy_version", *objects).join(told, "analysis_id")


@query("PRJ9 SORT1 STR10", sql("""
SELECT analysis_id, 'result.images[].image_id' AS path, row_number() OVER (PARTITION BY analysis_id ORDER BY ordinal) - 1 AS place, 0 AS inner_place, item_id AS value FROM items
UNION ALL SELECT analysis_id, 'result.images[].evidence[].id', item_no - 1, row_number() OVER (PARTITION BY analysis_id, item_no ORDER BY id) - 1, id
  FROM evidence JOIN (SELECT analysis_id, item_id, row_number() OVER (PARTITION BY analysis_id ORDER BY ordinal) AS item_no FROM items) USING (analysis_id, item_id)
UNION ALL SELECT analysis_id, 'result.insights[].key', rank - 1, 0, insight_key FROM insights
UNION ALL SELECT analysis_id, 'result.insights[].explanation', rank - 1, 0, string_agg(CASE WHEN place = 1 AND n > 2 THEN sep ELSE '' END || text, '' ORDER BY n)
  FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id, insight_key ORDER BY place, own) AS n FROM explained) JOIN (SELECT analysis_id, insight_key, rank FROM insights) USING (analysis_id, insight_key) GROUP BY ALL
UNION ALL SELECT analysis_id, CASE part WHEN 'signal' THEN 'result.insights[].supporting_evidence_ids[]' ELSE 'result.insights[].supporting_image_ids[]' END, rank - 1,
  row_number() OVER (PARTITION BY analysis_id, insight_key, part ORDER BY id) - 1, id FROM support
UNION ALL SELECT analysis_id, 'self_reported_claims[].claim_id', row_number() OVER (PARTITION BY analysis_id ORDER BY claim_id) - 1, 0, claim_id FROM told_claims""",
    "items", "evidence", "insights", "support", "explained", "told_claims"))
def stored_content(spark, sf):
    """Ids, keys and explanations of stored documents with their positions, one row each."""
    wanted = ("result.images[].image_id", "result.images[].evidence[].id", "result.insights[].key", "result.insights[].explanation",
              "result.insights[].supporting_evidence_ids[]", "result.insights[].supporting_image_ids[]", "self_reported_claims[].claim_id")
    _, leaves, _ = result.read_documents(documents(spark, sf), wanted)
    return leaves.filter(F.col("path").isin(*wanted)).select(
        "analysis_id", "path", F.col("at")[0].alias("place"), F.when(F.size("at") > 1, F.element_at("at", 2)).otherwise(0).cast("bigint").alias("inner_place"), "value")


@query("PRJ9 RULE7", sql("""
SELECT analysis_id, CASE right(analysis_id, 1) WHEN '1' THEN 'unknown_version' WHEN '2' THEN 'invalid_fields' WHEN '3' THEN 'id_mismatch' WHEN '5' THEN 'invalid_fields' ELSE 'payload_missing' END AS reason
FROM analyses WHERE right(analysis_id, 1) IN ('1', '2', '3', '4', '5')""", "analyses"))
def rejected_results(spark, sf):
    d = documents(spark, sf)
    tail, p = F.substring("analysis_id", -1, 1), F.col("result_payload")
    first = F.col("part_no") == 0
    spoiled = (
        F.when(tail == "1", F.regexp_replace(p, '"profile-analysis-result-v3"', '"v9"')).when(tail == "2", F.regexp_replace(p, '"summary":', '"text":'))
        .when((tail == "3") & first, F.replace(p, F.concat(F.lit('"result":{"analysis_id":"'), F.col("analysis_id"), F.lit('"')), F.lit('"result":{"analysis_id":"other"')))
        .when(tail == "4", F.lit(None).cast("string")).when((tail == "5") & ~F.col("_last"), p)
        .when(tail == "5", F.concat(p, F.lit("}"))).otherwise(p))
    last = d.groupBy("analysis_id").agg(F.max("part_no").alias("_n"))
    marked = d.join(last, "analysis_id").withColumn("_last", F.col("part_no") == F.col("_n"))
    _, _, bad = result.read_documents(marked.withColumn("result_payload", spoiled), ())
    return bad


@query("PRJ9", sql("""
SELECT analysis_id, CASE WHEN right(analysis_id, 1) IN ('0', '2', '4', '6', '8') THEN 'phase9-analysis-result-v1' ELSE 'profile-analysis-result-v2' END AS schema_version, 0 AS claims
FROM analyses""", "analyses"))
def old_result_versions(spark, sf):
    d = documents(spark, sf, with_claims=False)
    even = F.substring("analysis_id", -1, 1).isin("0", "2", "4", "6", "8")
    bare = F.regexp_replace("result_payload", '"personality_profile":null,', "")
    v1 = F.regexp_replace(bare, "profile-analysis-result-v3", "phase9-analysis-result-v1")
    for gone, left in (('"self_reported_claims":[', ""), ('],"summary":"', '"summary":"')):  # may lie in two parts
        v1 = F.replace(v1, F.lit(gone), F.lit(left))
    v2 = F.regexp_replace(bare, "profile-analysis-result-v3", "profile-analysis-result-v2")
    good, leaves, _ = result.read_documents(d.withColumn("result_payload", F.when(even, v1).otherwise(v2)), ("self_reported_claims[]",))
    claims = leaves.filter("path = 'self_reported_claims[]'").groupBy("analysis_id").agg(F.count(F.lit(1)).cast("int").alias("claims"))
    return good.join(claims, "analysis_id", "left").select("analysis_id", "schema_version", F.coalesce("claims", F.lit(0)).alias("claims"))


@query("PRJ7", sql("""
SELECT analysis_id, item_count, openness FROM (SELECT CAST(o_custkey AS VARCHAR) AS analysis_id, count(*) AS item_count FROM orders GROUP BY 1)
LEFT JOIN (SELECT analysis_id, max(normalized_score) FILTER (trait = 'openness') AS openness FROM trait_scores GROUP BY 1) USING (analysis_id)""", "trait_scores"))
def profile_view(spark, sf):
    from . import source_queries
    p = questionnaire.profiles(questionnaire.trait_scores(source_queries.valid_responses(spark, sf)))
    results = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").cast("string").alias("analysis_id")).agg(F.count(F.lit(1)).alias("item_count"))
    return result.profile_view(results, p).select("analysis_id", "item_count", F.col("self_report.openness").alias("openness"))
