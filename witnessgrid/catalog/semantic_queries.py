"""Similarity, retrieval and near duplicates over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, numbers
from ..operators import aggregate, extract, graph, semantic
from ..session import stash
from . import views
from .registry import query
from .views import sql

THRESHOLD = 0.4


@query("JOIN3 MTH1 MTH2", sql("SELECT item_id, label, round(similarity, 6) AS similarity FROM similarities", "similarities"))
def label_similarities(spark, sf):
    return views.similarities(spark, sf).select("item_id", "label", F.round("similarity", 6).alias("similarity"))


@query("MTH2 RULE22", """
SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, len(embedding) AS dimension,
       round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * 3 / (3 * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))))), 4) AS component_sum
FROM embeddings""")
def vector_norms(spark, sf):
    e = views.table(spark, sf, "embeddings")
    tripled = F.transform("embedding", lambda x: x * F.lit(3.0))
    unit = semantic.normalized(tripled)
    total = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(semantic.norm(F.col("embedding")), 5).alias("norm"),
                    F.size("embedding").cast("bigint").alias("dimension"), F.round(total, 4).alias("component_sum"))


@query("RULE22", """
SELECT CAST(NULL AS VARCHAR) AS analysis_id, CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS entity_id,
       CAST(NULL AS VARCHAR) AS rule WHERE false
UNION ALL SELECT 'embeddings', 'vector', CAST(vec_id AS VARCHAR), 'not_unit_norm' FROM embeddings
WHERE abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-5
UNION ALL SELECT 'doubled', 'vector', CAST(vec_id AS VARCHAR), 'not_unit_norm' FROM embeddings WHERE label = 3""")
def vector_violations(spark, sf):
    good = views.vectors(spark, sf)
    bad = good.filter("truth = 3").select(
        F.lit("doubled").alias("analysis_id"), "ordinal", "item_id",
        F.transform("embedding", lambda x: (x * 2).cast("float")).alias("embedding"), "truth")
    return semantic.vector_violations(good.unionByName(bad))


@query("RULE20", sql("SELECT item_id, label, round(similarity, 6) AS similarity FROM similarities WHERE similarity >= 0.25", "similarities"))
def matched_themes(spark, sf):
    return semantic.matched(views.similarities(spark, sf)).select(
        "item_id", "label", F.round("similarity", 6).alias("similarity"))


@query("WIN3", sql("""
SELECT label, item_id, CAST(row_number() OVER (PARTITION BY label ORDER BY round(similarity, 12) DESC, item_id) AS INTEGER) AS rank
FROM similarities""", "similarities"))
def retrieval_ranking(spark, sf):
    sims = views.similarities(spark, sf).withColumn("similarity", F.round("similarity", 12))
    return semantic.retrieval(sims, views.vectors(spark, sf)).select("label", "item_id", F.col("rank").cast("int").alias("rank"))


@query("WIN4 MTH3 PRJ2", sql("""
SELECT item_id, label, rank, round(score, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, lower(label), label) AS INTEGER) AS rank FROM (
    SELECT item_id, label, 1 / (1 + exp(-(exp(2.0) * similarity - 3.0))) AS score FROM similarities) WHERE score >= 0.1)
WHERE rank <= 3""", "similarities"))
def top_label_scores(spark, sf):
    sims = views.similarities(spark, sf)
    scored = sims.select("analysis_id", "item_id", F.lit("topic").alias("kind"), "label",
                         F.round(numbers.sigmoid_score(F.col("similarity"), 2.0, -3.0), 12).alias("score"))
    return extract.top_observations(scored, 0.1, 3).select("item_id", "label", "rank", F.round("score", 6).alias("score"))


PAIRS = """
SELECT a.vec_id AS l, b.vec_id AS r, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4"""


@query("JOIN4", f"SELECT l AS left_item, r AS right_item, round(similarity, 6) AS similarity FROM ({PAIRS})")
def near_duplicate_pairs(spark, sf):
    return semantic.similar_pairs(views.vectors(spark, sf), THRESHOLD).select(
        F.col("left").alias("left_item"), F.col("right").alias("right_item"), F.round("similarity", 6).alias("similarity"))


@query("GRF1 HSH5", f"""
WITH RECURSIVE pairs AS ({PAIRS}), both_ways AS (SELECT l, r FROM pairs UNION SELECT r, l FROM pairs),
reach(n, m) AS (SELECT l, l FROM both_ways UNION SELECT reach.n, b.r FROM reach JOIN both_ways b ON reach.m = b.l),
roots AS (SELECT n, min(m) AS root FROM reach GROUP BY n),
named AS (SELECT root, 'near-duplicate-' || substr(sha256('phase6-near-duplicate-v1' || chr(0) || string_agg(n || chr(0), '' ORDER BY n)), 1, 24) AS group_id FROM roots GROUP BY root)
SELECT group_id, row_number() OVER (PARTITION BY root ORDER BY n) - 1 AS place, CAST(n AS VARCHAR) AS item_id FROM roots JOIN named USING (root)""")
def near_duplicate_groups(spark, sf):
    """Every member of a group with the group's id and its place."""
    members = stash(graph.near_duplicate_members(views.vectors(spark, sf), THRESHOLD))
    return graph.placed_members(members, graph.near_duplicate_groups(members)).select("group_id", "place", "item_id")


def _provider():
    return F.struct(F.lit("centroid").alias("name"), F.lit("1").alias("version"), F.lit("m").alias("model_id"),
                    F.lit("1").alias("model_version"), F.lit("c1").alias("config_version"))


def similarity_rows(spark, sf, threshold=None):
    """Similarities of items to labels; with ``threshold`` the others never leave the product."""
    scored = semantic.score_labels(views.vectors(spark, sf), views.label_vectors(spark, sf), threshold)
    return scored.select(
        "analysis_id", "item_id", F.col("item_id").alias("canonical_item_id"), F.lit(False).alias("has_copies"),
        "label", "similarity", F.lit(0.25).alias("threshold"), _provider().alias("provider"))


@query("PRJ4 AGG3 SET2", sql("""
SELECT item_id, 'semantic_theme' AS kind, label AS key, 'centroid' AS source, true AS no_confidence
FROM similarities WHERE similarity >= 0.25""", "similarities"))
def semantic_signals(spark, sf):
    return aggregate.semantic_signals(similarity_rows(spark, sf, 0.25)).select(
        F.col("original_item_id").alias("item_id"), "kind", "key", "source", F.col("confidence").isNull().alias("no_confidence"))


@query("HSH3 HSH7", sql("""
SELECT 'semantic-' || substr(sha256('phase7-semantic-support-v1' || chr(0) || '{"config_version":"c1","image_id":"' || item_id || '","kind":"semantic_theme","model_id":"m","model_version":"1",'
       || '"provider":"centroid","provider_version":"1","similarity":' || to_json(s) || ',"theme_label":"' || label || '","threshold":0.25}'), 1, 24) AS signal_id,
       item_id AS original_item_id, label AS key
FROM (SELECT *, round(similarity, 4) AS s FROM similarities) WHERE s >= 0.25""", "similarities"))
def semantic_signal_ids(spark, sf):
    """Similarities are rounded, so that engines print them alike."""
    rows = similarity_rows(spark, sf).withColumn("similarity", F.round("similarity", 4))
    return aggregate.semantic_signals(rows).select("signal_id", "original_item_id", "key")


@query("AGG3", sql("""
SELECT 'embeddings' AS analysis_id, 'similarity' AS entity, item_id || ':' || label AS entity_id, 'conflicting_payload' AS rule
FROM similarities WHERE truth = 1""", "similarities"))
def semantic_identity_conflicts(spark, sf):
    rows = similarity_rows(spark, sf).select("analysis_id", "item_id", "label", F.round("similarity", 6).alias("similarity"))
    truth = views.vectors(spark, sf).filter("truth = 1").select("item_id")
    again = rows.join(truth, "item_id").withColumn("similarity", F.col("similarity") - 2.0)
    return aggregate.evidence_conflicts(rows.unionByName(rows).unionByName(again.select(*rows.columns)), "similarity", ("item_id", "label"))


@query("SET2 AGG5 AGG6", sql("""
SELECT kind, key, sum(n)::BIGINT AS evidence_count, count(*) AS unique_item_count, round(count(*) / max(u)::DOUBLE, 6) AS item_coverage,
       round(avg(c), 6) AS average_confidence, min(n) / max(n)::DOUBLE AS cross_item_consistency FROM (
  SELECT kind, key, item_id, count(*) AS n, avg(confidence) AS c FROM (
    SELECT item_id, 'semantic_theme' AS kind, label AS key, CAST(NULL AS DOUBLE) AS confidence FROM similarities WHERE similarity >= 0.25
    UNION ALL SELECT CAST(vec_id AS VARCHAR), 'topic', 'label_' || label, 0.5 + (vec_id % 50) / 100.0::DOUBLE FROM embeddings)
  GROUP BY ALL), (SELECT count(*) AS u FROM embeddings) GROUP BY kind, key""", "similarities"))
def semantic_and_topic_aggregates(spark, sf):
    v = views.vectors(spark, sf)
    topic = v.select(
        "analysis_id", F.concat(F.lit("t-"), F.col("item_id")).alias("signal_id"), F.col("item_id").alias("original_item_id"),
        F.col("item_id").alias("canonical_item_id"), F.lit(False).alias("has_copies"), F.lit("topic").alias("kind"),
        F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("key"),
        F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("label"), F.lit("table").alias("source"),
        (F.lit(0.5) + F.pmod("ordinal", F.lit(50)) / 100.0).alias("confidence"))
    both = aggregate.union_signals(topic, aggregate.semantic_signals(similarity_rows(spark, sf, 0.25)))
    from ..operators import items as item_ops
    out = aggregate.theme_aggregates(aggregate.represent(aggregate.distinct_evidence(both)), item_ops.universe(v))
    return out.select("kind", "key", "evidence_count", "unique_item_count", F.round("item_coverage", 6).alias("item_coverage"),
                      F.round("average_confidence", 6).alias("average_confidence"), "cross_item_consistency")


@query("JOIN15", """
SELECT 'label_' || label AS analysis_id, 'batch' AS entity, 'label_' || label AS entity_id, 'incompatible_batches' AS rule
FROM embeddings GROUP BY label HAVING label % 2 = 1""")
def incompatible_batches(spark, sf):
    labels = views.label_vectors(spark, sf)
    items = views.vectors(spark, sf).select(
        F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("analysis_id"), _provider().alias("provider"), "embedding")
    odd = F.substring("label", -1, 1).cast("int") % 2 == 1
    label_side = labels.select(
        F.col("label").alias("analysis_id"), _provider().alias("provider"),
        F.when(odd, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"))
    return semantic.batch_violations(items, label_side.withColumn("embedding", F.col("embedding").cast("array<float>")))
