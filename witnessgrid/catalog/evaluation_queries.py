"""Evaluation metrics, dataset audits and benchmark roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, numbers, policy, text
from ..operators import dataset, metrics, runs as run_ops, semantic
from . import views
from .registry import query
from .views import sql

IDENTITY = ["sample_id", "type", "label", "value"]


def eval_matches(spark, sf):
    evals = views.labelled_samples(spark, sf).filter("split = 'eval'").select("sample_id")
    t = views.truth_labels(spark, sf).join(evals, "sample_id", "left_semi")
    p = views.pred_labels(spark, sf).join(evals, "sample_id", "left_semi")
    return metrics.label_matches(t, p, IDENTITY)


views.cte("matches", """
SELECT sample_id, type, label, value, coalesce(t.e, false) AS expected, coalesce(p.p, false) AS predicted
FROM (SELECT DISTINCT sample_id, type, label, value, true AS e FROM truth_labels WHERE sample_id IN (FROM eval_ids)) t
FULL JOIN (SELECT DISTINCT sample_id, type, label, value, true AS p FROM pred_labels WHERE sample_id IN (FROM eval_ids)) p
USING (sample_id, type, label, value)""", "truth_labels", "pred_labels", "eval_ids")


@query("JOIN7 SET3 RULE21", sql("SELECT * FROM matches", "matches"))
def label_matches(spark, sf):
    return eval_matches(spark, sf)


PRF = """
SELECT {k}count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (expected) AS n_expected, count(*) FILTER (predicted) AS n_predicted,
       round(count(*) FILTER (expected AND predicted) / count(*) FILTER (predicted)::DOUBLE, 6) AS precision,
       round(count(*) FILTER (expected AND predicted) / count(*) FILTER (expected)::DOUBLE, 6) AS recall,
       round(2.0 * count(*) FILTER (expected AND predicted) / (count(*) FILTER (expected) + count(*) FILTER (predicted)), 6) AS f1
FROM {m} {g}"""


def _rounded(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("AGG8 RULE21", sql(PRF.format(k="", m="matches", g=""), "matches"))
def micro_scores(spark, sf):
    return _rounded(metrics.precision_recall_f1(eval_matches(spark, sf)), {"precision", "recall", "f1"})


@query("AGG9 SET4", sql("""
SELECT round(avg(f1), 6) AS macro_f1, count(*) AS class_count FROM (
  SELECT type, label, value, 2.0 * count(*) FILTER (expected AND predicted) / (count(*) FILTER (expected) + count(*) FILTER (predicted)) AS f1
  FROM matches GROUP BY ALL)""", "matches"))
def macro_f1(spark, sf):
    return _rounded(metrics.macro_f1(eval_matches(spark, sf), ["type", "label", "value"]), {"macro_f1"})


@query("AGG9", sql("SELECT DISTINCT label FROM matches WHERE label NOT IN ('quality_0', 'quality_1', 'language en')", "matches"))
def labels_outside_universe(spark, sf):
    m = eval_matches(spark, sf)
    train = views.pred_labels(spark, sf).filter("type <> 'topic'").select("label").distinct()
    return metrics.outside_universe(m, train, "label")


@query("AGG10 MTH10", sql("""
SELECT round(sum(abs(hits - conf)) / sum(n), 6) AS ece, sum(n)::BIGINT AS sample_count FROM (
  SELECT least(CAST(floor(p.confidence * 10) AS INT), 9) AS bin, count(*) AS n, sum(CASE WHEN t.sample_id IS NOT NULL THEN 1 ELSE 0 END) AS hits,
         sum(p.confidence) AS conf
  FROM pred_labels p LEFT JOIN (SELECT DISTINCT sample_id, type, label, value FROM truth_labels) t USING (sample_id, type, label, value)
  WHERE p.sample_id IN (FROM eval_ids) GROUP BY 1)""", "pred_labels", "truth_labels", "eval_ids"))
def calibration_error(spark, sf):
    evals = views.labelled_samples(spark, sf).filter("split = 'eval'").select("sample_id")
    p = views.pred_labels(spark, sf).join(evals, "sample_id", "left_semi")
    t = views.truth_labels(spark, sf).select(*IDENTITY).distinct().withColumn("ok", F.lit(True))
    judged = p.join(t, IDENTITY, "left").select("confidence", F.coalesce("ok", F.lit(False)).alias("correct"))
    return _rounded(metrics.calibration_error(judged, 10), {"ece"})


@query("AGG12 RULE11 STR5 STR6", sql(f"""
SELECT lang, round(avg(CASE WHEN {views.violates_sql('key', 'label')} THEN 1.0 ELSE 0 END), 6) AS unsupported_claim_rate, count(*) AS claim_count
FROM claims GROUP BY lang""", "claims"))
def unsupported_claim_rate(spark, sf):
    return _rounded(metrics.unsupported_claim_rate(views.claims(spark, sf), ["lang"]), {"unsupported_claim_rate"})


@query("RULE11 RULE12", sql(f"SELECT sample_id FROM claims WHERE {views.violates_sql('key', 'label')}", "claims"))
def claims_breaking_policy(spark, sf):
    return policy.flagged(views.claims(spark, sf), F.col("key"), F.col("label")).filter("violates").select("sample_id")


# French, German and Spanish letters become single-byte characters, so that the byte-based
# SQL edit distance counts characters.
_LETTERS = "àâäçèéêëîïñòóôöùúûüßáíÀÂÄÇÈÉÊËÎÏÑÒÓÔÖÙÚÛÜÁÍ¿¡"
_AS_BYTES = " || ".join(f"chr({c})" for c in (list(range(1, 9)) + list(range(14, 32)) + [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126, 127])[: len(_LETTERS)])


def _bytes_sql(c: str) -> str:
    return f"translate({c}, '{_LETTERS}', {_AS_BYTES})"


@query("MTH4 MTH5 AGG11", sql(f"""
SELECT role, count(*) AS sample_count, round(avg(levenshtein({_bytes_sql('reference')}, {_bytes_sql('prediction')}) / length(reference)::DOUBLE), 6) AS raw_cer
FROM text_pairs GROUP BY role""", "text_pairs"))
def character_error_rates(spark, sf):
    pairs = views.text_pairs(spark, sf)
    rated = pairs.select("role", numbers.character_error_rate(F.col("reference"), F.col("prediction")).alias("cer"))
    return rated.groupBy("role").agg(
        F.count(F.lit(1)).alias("sample_count"), F.round(numbers.decimal_sum(F.col("cer")).cast("double") / F.count("cer"), 6).alias("raw_cer"))


def _norm_text_sql(c: str) -> str:
    """The text clean-up, for texts in NFC without Arabic letters."""
    flat = f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '[\\t\\f\\v ]+', ' ', 'g')"
    return f"regexp_replace(regexp_replace({flat}, '\\s*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


def _tokens_sql(c: str) -> str:
    return f"[w FOR w IN string_split_regex({c}, '\\s+') IF w <> '']"


# One row of the edit table per step: the least over smaller columns stands in for its last term.
WORD_DISTANCES = f"""
WITH RECURSIVE text_rows AS (SELECT role, reference, prediction, {_norm_text_sql('reference')} AS rn, {_norm_text_sql('prediction')} AS pn FROM text_pairs),
token_pairs AS (SELECT DISTINCT r, p FROM (SELECT {_tokens_sql('reference')} AS r, {_tokens_sql('prediction')} AS p FROM text_rows
  UNION ALL SELECT {_tokens_sql('rn')}, {_tokens_sql('pn')} FROM text_rows)),
steps AS (SELECT r, p, 0 AS i, range(len(p) + 1) AS line FROM token_pairs
  UNION ALL
  SELECT r, p, i + 1, [list_min(x[1:k + 1]) + k FOR k IN range(len(p) + 1)] FROM (
    SELECT *, [CASE WHEN k = 0 THEN i + 1 ELSE least(line[k + 1] + 1, line[k] + CASE WHEN p[k] = r[i + 1] THEN 0 ELSE 1 END) - k END FOR k IN range(len(p) + 1)] AS x
    FROM steps WHERE i < len(r))),
wers AS (SELECT r, p, CASE WHEN len(r) > 0 THEN line[len(p) + 1] / len(r)::DOUBLE WHEN len(p) = 0 THEN 0.0 ELSE 1.0 END AS wer FROM steps WHERE i = len(r)),
rates AS (SELECT t.role, levenshtein({_bytes_sql('reference')}, {_bytes_sql('prediction')}) / length(reference)::DOUBLE AS raw_cer, a.wer AS raw_wer,
    levenshtein({_bytes_sql('rn')}, {_bytes_sql('pn')}) / length(rn)::DOUBLE AS normalized_cer, b.wer AS normalized_wer
  FROM text_rows t JOIN wers a ON a.r = {_tokens_sql('reference')} AND a.p = {_tokens_sql('prediction')} JOIN wers b ON b.r = {_tokens_sql('rn')} AND b.p = {_tokens_sql('pn')})
"""


@query("MTH4 MTH5 MTH6 AGG11", sql(WORD_DISTANCES + """
SELECT role, count(*) AS sample_count, round(avg(raw_cer), 6) AS raw_cer, round(avg(raw_wer), 6) AS raw_wer, round(avg(normalized_cer), 6) AS normalized_cer,
       round(avg(normalized_wer), 6) AS normalized_wer FROM rates GROUP BY role""", "text_pairs"))
def text_error_rates_by_role(spark, sf):
    rates = metrics.text_error_rates(views.text_pairs(spark, sf))
    return _rounded(metrics.mean_error_rates(rates, ["role"]), {"raw_cer", "raw_wer", "normalized_cer", "normalized_wer"})


views.cte("ranked", """
SELECT label AS query, item_id, truth, row_number() OVER (PARTITION BY label ORDER BY round(similarity, 12) DESC, item_id) AS rank FROM similarities""", "similarities")
views.cte("query_scores", """
SELECT query, count(*) FILTER (rel) AS n_relevant, count(*) FILTER (rel AND rank <= 25) / count(*) FILTER (rel)::DOUBLE AS recall_at_k,
       sum(CASE WHEN rel THEN h / rank::DOUBLE END) / count(*) FILTER (rel) AS average_precision
FROM (SELECT *, sum(CASE WHEN rel THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY rank) AS h
      FROM (SELECT *, query = 'label_' || truth AS rel FROM ranked)) GROUP BY query""", "ranked")


def retrieval_scores(spark, sf):
    from ..operators import semantic
    vectors = views.vectors(spark, sf)
    sims = views.similarities(spark, sf).withColumn("similarity", F.round("similarity", 12))
    ranked = semantic.retrieval(sims, vectors).select(F.col("label").alias("query"), "item_id", "rank")
    relevant = vectors.select(F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("query"), "item_id")
    return metrics.query_scores(ranked, relevant, 25)


@query("AGG13 AGG14 JOIN9 WIN5 WIN9", sql("""
SELECT query, n_relevant, round(recall_at_k, 6) AS recall_at_k, round(average_precision, 6) AS average_precision FROM query_scores""", "query_scores"))
def retrieval_query_scores(spark, sf):
    return _rounded(retrieval_scores(spark, sf), {"recall_at_k", "average_precision"})


@query("AGG13 AGG15", sql("""
SELECT round(avg(recall_at_k), 6) AS mean_recall_at_k, round(avg(average_precision), 6) AS map, count(*) AS query_count FROM query_scores""", "query_scores"))
def mean_average_precision(spark, sf):
    return _rounded(metrics.retrieval_summary(retrieval_scores(spark, sf)), {"mean_recall_at_k", "map"})


@query("AGG15", """
SELECT DISTINCT 'label_' || label AS query, '' AS detail, 'no_relevance_entry' AS rule FROM embeddings WHERE label < 2
UNION ALL SELECT 'extra', '', 'no_ranking' UNION ALL SELECT 'label_5', CAST(vec_id AS VARCHAR), 'duplicate_item' FROM embeddings WHERE label = 5""")
def ranking_violations(spark, sf):
    v = views.vectors(spark, sf).select(F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("query"), "item_id")
    ranked = v.unionByName(v.filter("query = 'label_5'"))
    relevant = v.filter(~F.col("query").isin("label_0", "label_1")).unionByName(v.select(F.lit("extra").alias("query"), "item_id"))
    return metrics.ranking_violations(ranked, relevant)


def theme_matches(spark, sf):
    sims = views.similarities(spark, sf).filter("similarity >= 0.25").select(F.col("item_id").alias("sample_id"), "label")
    truth = views.vectors(spark, sf).select(F.col("item_id").alias("sample_id"), F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("label"))
    return metrics.label_matches(truth, sims, ["sample_id", "label"])


@query("AGG16 JOIN14", sql("""
WITH m AS (SELECT item_id, label, label = 'label_' || truth AS expected, similarity >= 0.25 AS predicted FROM similarities),
s AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, unnest(CASE vec_id % 3 WHEN 0 THEN ['persian_heavy'] WHEN 1 THEN ['english_heavy', 'persian_heavy'] ELSE ['indoor'] END) AS slice FROM embeddings)
SELECT slice, round(avg(f1), 6) AS macro_f1 FROM (
  SELECT slice, label, 2.0 * count(*) FILTER (expected AND predicted) / (count(*) FILTER (expected) + count(*) FILTER (predicted)) AS f1
  FROM m JOIN s USING (item_id) WHERE slice <> 'indoor' AND (expected OR predicted) GROUP BY ALL) GROUP BY slice
UNION ALL SELECT 'mixed_persian_english', NULL""", "similarities"))
def theme_f1_by_slice(spark, sf):
    m = F.pmod("ordinal", F.lit(3))
    slices = F.when(m == 0, F.array(F.lit("persian_heavy"))).when(m == 1, F.array(F.lit("english_heavy"), F.lit("persian_heavy"))).otherwise(F.array(F.lit("indoor")))
    sliced = views.vectors(spark, sf).select(F.col("item_id").alias("sample_id"), F.explode(slices).alias("slice"))
    from ..vocab import LANGUAGE_SLICES
    return _rounded(metrics.theme_f1_by_slice(theme_matches(spark, sf), sliced, LANGUAGE_SLICES), {"macro_f1"})


@query("AGG17 JOIN16", sql("""
SELECT count(*) FILTER (similarity >= 0.25) AS matched_count, round(min(similarity), 6) AS score_min, round(max(similarity), 6) AS score_max,
       round(min(similarity) FILTER (label = 'label_' || truth), 6) AS expected_score_min, round(max(similarity) FILTER (label = 'label_' || truth), 6) AS expected_score_max
FROM similarities""", "similarities"))
def similarity_diagnostics(spark, sf):
    expected = views.vectors(spark, sf).select("item_id", F.concat(F.lit("label_"), F.col("truth").cast("string")).alias("label"))
    out = metrics.similarity_diagnostics(views.similarities(spark, sf), expected, 0.25)
    return _rounded(out, {"score_min", "score_max", "expected_score_min", "expected_score_max"})


@query("AGG18", """
WITH p AS (SELECT event_type, value / 500 AS score, event_id % 3 = 0 AS expected FROM events),
k AS (SELECT unnest(['scene', 'object', 'activity', 'topic']) AS kind),
s AS (SELECT CASE event_type WHEN 'view' THEN 'scene' WHEN 'click' THEN 'object' WHEN 'purchase' THEN 'activity' ELSE 'other' END AS kind, score, expected FROM p)
SELECT k.kind, count(score) AS count, round(min(score), 6) AS min, round(max(score), 6) AS max, round(avg(score), 6) AS mean,
       count(score) FILTER (expected) AS expected_count, round(min(score) FILTER (expected), 6) AS expected_min,
       round(max(score) FILTER (expected), 6) AS expected_max, round(avg(score) FILTER (expected), 6) AS expected_mean
FROM k LEFT JOIN s ON k.kind = s.kind GROUP BY k.kind""")
def score_diagnostics(spark, sf):
    e = views.table(spark, sf, "events")
    t = F.col("event_type")
    kind = F.when(t == "view", "scene").when(t == "click", "object").when(t == "purchase", "activity").otherwise("other")
    scores = e.select(kind.alias("kind"), (F.col("value") / 500).alias("score"), (F.pmod("event_id", F.lit(3)) == 0).alias("expected"))
    out = metrics.score_diagnostics(scores)
    return _rounded(out, {"min", "max", "mean", "expected_min", "expected_max", "expected_mean"})


@query("AGG23 JOIN7", sql("""
WITH k AS (SELECT unnest(['scene', 'object', 'activity', 'topic']) AS type),
c AS (SELECT k.type, count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (expected) AS n_expected, count(*) FILTER (predicted) AS n_predicted
      FROM k LEFT JOIN matches USING (type) GROUP BY k.type),
a AS (SELECT * FROM c UNION ALL SELECT 'overall', sum(tp), sum(n_expected), sum(n_predicted) FROM c WHERE n_expected > 0)
SELECT type, n_expected > 0 AS evaluated, n_expected::BIGINT AS n_expected, n_predicted::BIGINT AS n_predicted, tp::BIGINT AS tp,
       CASE WHEN n_expected > 0 THEN round(tp / n_predicted::DOUBLE, 6) END AS precision, CASE WHEN n_expected > 0 THEN round(tp / n_expected::DOUBLE, 6) END AS recall,
       CASE WHEN n_expected > 0 THEN round(2.0 * tp / (n_expected + n_predicted), 6) END AS f1 FROM a""", "matches"))
def scores_by_label_type(spark, sf):
    return _rounded(metrics.per_type_scores(eval_matches(spark, sf)), {"precision", "recall", "f1"})


def report(spark, sf, missing=False):
    """The report over documents (labels, claims) and turns (texts); ``missing`` leaves some texts without prediction."""
    pairs = views.text_pairs(spark, sf)
    sid = F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    turns = pairs.select(sid.alias("sample_id"), F.lit("eval").alias("split"), F.col("reference").alias("ocr_text"))
    docs = views.labelled_samples(spark, sf).select("sample_id", "split", F.lit(None).cast("string").alias("ocr_text"))
    given = pairs.filter(F.pmod("conv_id", F.lit(7)) != 3) if missing else pairs
    texts = given.select(sid.alias("sample_id"), F.col("prediction").alias("ocr_text"))
    return metrics.evaluation_report(
        docs.unionByName(turns), views.truth_labels(spark, sf), views.pred_labels(spark, sf), texts,
        views.claims(spark, sf).select("sample_id", "key", "label"))


REPORT_ROWS = f"""
, n AS (SELECT (SELECT count(*) FROM eval_ids) + (SELECT count(*) FROM text_pairs) AS n),
prf AS (SELECT count(*) FILTER (expected AND predicted) AS tp, count(*) FILTER (expected) AS e, count(*) FILTER (predicted) AS p FROM matches),
ece AS (SELECT round(sum(abs(hits - conf)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM (
  SELECT least(CAST(floor(p.confidence * 10) AS INT), 9) AS bin, count(*) AS n, sum(CASE WHEN t.sample_id IS NOT NULL THEN 1 ELSE 0 END) AS hits, sum(p.confidence) AS conf
  FROM pred_labels p LEFT JOIN (SELECT DISTINCT sample_id, type, label, value FROM truth_labels) t USING (sample_id, type, label, value)
  WHERE p.sample_id IN (FROM eval_ids) GROUP BY 1)),
report AS (
SELECT 'visual_precision' AS name, round(tp / p::DOUBLE, 6) AS value, n AS sample_count, 1.0::DOUBLE AS maximum FROM prf, n
UNION ALL SELECT 'visual_recall', round(tp / e::DOUBLE, 6), n, 1.0 FROM prf, n
UNION ALL SELECT 'visual_f1', round(2.0 * tp / (e + p), 6), n, 1.0 FROM prf, n
UNION ALL SELECT 'confidence_ece', ece, n, 1.0 FROM ece
UNION ALL SELECT 'unsupported_claim_rate', round(avg(CASE WHEN {views.violates_sql('key', 'label')} THEN 1.0 ELSE 0 END), 6), count(*), 1.0 FROM claims WHERE sample_id IN (FROM eval_ids)
UNION ALL SELECT 'ocr_cer', round(avg(raw_cer), 6), count(*), NULL FROM rates
UNION ALL SELECT 'ocr_wer', round(avg(raw_wer), 6), count(*), NULL FROM rates)
"""
_REPORT_NEEDS = ("matches", "eval_ids", "text_pairs", "claims", "pred_labels", "truth_labels")


@query("AGG34 AGG8 AGG10 AGG11 AGG12 JOIN8 SNK2", sql(
    WORD_DISTANCES + REPORT_ROWS + "SELECT name, value, sample_count, 0.0::DOUBLE AS minimum, maximum FROM report", *_REPORT_NEEDS))
def evaluation_report(spark, sf):
    return _rounded(report(spark, sf), {"value"})


@query("AGG34 JOIN8", sql(WORD_DISTANCES + REPORT_ROWS + "SELECT name, value, sample_count FROM report WHERE name NOT LIKE 'ocr%'", *_REPORT_NEEDS))
def evaluation_report_without_texts(spark, sf):
    """Some truth texts have no prediction: no mean of the error rates, everything else as before."""
    return _rounded(report(spark, sf, missing=True).select("name", "value", "sample_count"), {"value"})


@query("AGG34", sql(f"""
WITH n AS (SELECT (SELECT count(*) FROM eval_ids) + (SELECT count(*) FROM text_pairs) AS n)
SELECT 'visual_precision' AS name, round(count(*) FILTER (expected AND predicted) / count(*) FILTER (predicted)::DOUBLE, 6) AS value, max(n) AS sample_count FROM matches, n
UNION ALL SELECT 'visual_recall', round(count(*) FILTER (expected AND predicted) / count(*) FILTER (expected)::DOUBLE, 6), max(n) FROM matches, n
UNION ALL SELECT 'unsupported_claim_rate', round(avg(CASE WHEN {views.violates_sql('key', 'label')} THEN 1.0 ELSE 0 END), 6), count(*) FROM claims WHERE sample_id IN (FROM eval_ids)
UNION ALL SELECT 'ocr_cer', round(avg(levenshtein({_bytes_sql('reference')}, {_bytes_sql('prediction')}) / length(reference)::DOUBLE), 6), count(*) FROM text_pairs""",
    "matches", "eval_ids", "text_pairs", "claims"))
def evaluation_report_checked_rows(spark, sf):
    names = ("visual_precision", "visual_recall", "unsupported_claim_rate", "ocr_cer")
    return _rounded(report(spark, sf).filter(F.col("name").isin(*names)).select("name", "value", "sample_count"), {"value"})


@query("JOIN6", sql("""
SELECT dataset_id, dataset_version, sample_id, 'missing_prediction' AS rule FROM samples WHERE split = 'eval' AND n_chars % 9 = 0
UNION ALL SELECT dataset_id, dataset_version, sample_id, 'unexpected_prediction' FROM samples WHERE split = 'train' AND n_chars % 9 <> 0""", "samples"))
def prediction_coverage_violations(spark, sf):
    s = views.samples(spark, sf)
    return metrics.coverage_violations(s, s.filter("n_chars % 9 <> 0"))


@query("JOIN8", sql("SELECT sample_id, 'text_prediction_missing' AS rule FROM samples WHERE split = 'eval' AND ocr_text IS NOT NULL AND n_chars % 5 = 0", "samples"))
def text_prediction_violations(spark, sf):
    s = views.samples(spark, sf)
    return metrics.text_violations(s, s.filter("n_chars % 5 <> 0").select("sample_id", "ocr_text"))


@query("RULE10", """
WITH m AS (SELECT o_orderpriority AS analysis_id, 'm' || (o_orderkey % 100) AS name, o_totalprice AS value FROM orders)
SELECT analysis_id, 'metric' AS entity, name AS entity_id, 'bounds' AS rule FROM m WHERE value > 400000
UNION ALL SELECT analysis_id, 'metric', name, 'duplicate_name' FROM m GROUP BY ALL HAVING count(*) > 1""")
def metric_violations(spark, sf):
    o = views.table(spark, sf, "orders")
    m = o.select(F.col("o_orderpriority").alias("report_id"), F.concat(F.lit("m"), F.pmod("o_orderkey", F.lit(100)).cast("string")).alias("name"),
                 F.col("o_totalprice").alias("value"), F.lit(1).alias("sample_count"), F.lit(0.0).alias("minimum"), F.lit(400000.0).alias("maximum"))
    return metrics.metric_violations(m)


# -- dataset -------------------------------------------------------------------------------

@query("AGG30", sql("""
WITH d AS (SELECT dataset_id, content_hash AS k, count(*) AS n, min(split) <> max(split) AS crosses FROM samples GROUP BY ALL HAVING count(*) > 1),
tw AS (SELECT sample_id FROM samples WHERE n_chars % 50 = 0)
SELECT dataset_id, 'content' AS entity, k AS entity_id, CASE WHEN crosses THEN 'leakage_content' ELSE 'duplicate_content' END AS rule FROM d
UNION ALL SELECT 'docs', 'label', sample_id, 'duplicate_label_id' FROM truth_labels WHERE sample_id IN (FROM tw) AND type = 'object'
UNION ALL SELECT 'docs', 'label', sample_id, 'duplicate_label_identity' FROM truth_labels WHERE sample_id IN (FROM tw) AND type = 'object'
UNION ALL SELECT 'train_only', 'dataset', 'train_only', 'no_eval_sample'""", "samples", "truth_labels"))
def dataset_audit(spark, sf):
    s = views.samples(spark, sf)
    only = s.filter("split = 'train'").withColumn("dataset_id", F.lit("train_only")).withColumn("content_hash", F.col("sample_id"))
    labels = views.truth_labels(spark, sf)
    twice = labels.filter("type = 'object'").join(s.filter("n_chars % 50 = 0").select("sample_id"), "sample_id", "left_semi")
    return dataset.audit(s.unionByName(only), labels.unionByName(twice))


@query("WIN8", sql("""
SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY sha256('docs' || chr(10) || sample_id), sample_id) <= 60 THEN 'train' ELSE 'eval' END AS split, '2.0.0' AS dataset_version
FROM samples""", "samples"))
def holdout_split(spark, sf):
    source = views.samples(spark, sf).withColumn("split", F.lit("eval"))
    return dataset.holdout_split(source, "2.0.0", 60).select("sample_id", "split", "dataset_version")


@query("WIN8 RULE26", "SELECT 'docs' AS dataset_id, unnest(['version_not_new', 'train_count_out_of_range', 'already_split']) AS rule")
def holdout_violations(spark, sf):
    return dataset.holdout_violations(views.samples(spark, sf), "1.0.0", 0)


views.cte("taxonomy", """
SELECT DISTINCT l.type, coalesce(nullif(trim(replace(CASE WHEN value = 'null' THEN '' ELSE value END, '"', '')), ''), label) AS label
FROM truth_labels l JOIN samples USING (sample_id) WHERE split = 'train' AND type IN ('object', 'scene', 'activity', 'topic')""", "truth_labels", "samples")


def plain_labels(spark, sf):
    value = F.nullif(F.regexp_replace("value", '"', ""), F.lit("null"))
    return views.truth_labels(spark, sf).withColumn("value", value)


@query("AGG21 STR9 ARR1", sql("""
SELECT type, label, CAST(row_number() OVER (PARTITION BY type ORDER BY lower(label), label) AS INTEGER) AS position FROM taxonomy""", "taxonomy"))
def train_taxonomy(spark, sf):
    ordered = dataset.ordered_taxonomy(dataset.train_taxonomy(views.samples(spark, sf), plain_labels(spark, sf)))
    return ordered.withColumn("position", F.col("position").cast("int"))


@query("RULE25", """
SELECT 'topic' AS type, lower(o_orderpriority) AS label, 'not_unique' AS rule FROM orders GROUP BY ALL
UNION ALL SELECT DISTINCT 'scene', ' ' || o_orderpriority, 'not_trimmed' FROM orders""")
def taxonomy_violations(spark, sf):
    p = views.table(spark, sf, "orders").select("o_orderpriority").distinct()
    t = p.select(F.lit("topic").alias("type"), F.col("o_orderpriority").alias("label")).unionByName(
        p.select(F.lit("topic").alias("type"), F.lower("o_orderpriority").alias("label"))).unionByName(
        p.select(F.lit("scene").alias("type"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("label")))
    return dataset.taxonomy_violations(t)


@query("RULE25", "SELECT '' AS type, '' AS label, 'no_labels' AS rule")
def empty_taxonomy_violations(spark, sf):
    """A vocabulary that no label of the table gets into."""
    labels = plain_labels(spark, sf).filter("label IS NULL")
    return dataset.taxonomy_violations(dataset.train_taxonomy(views.samples(spark, sf), labels))


@query("RULE25", """
WITH l AS (SELECT source AS a, CASE doc_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'Theme ' ELSE 'THEME  ' END || lang
  WHEN 2 THEN 'Person religion = ' || lang ELSE 't' || doc_id END AS label FROM documents),
k AS (SELECT *, lower(trim(regexp_replace(label, '\\s+', ' ', 'g'))) AS key FROM l)
SELECT a AS analysis_id, 'label' AS entity, label AS entity_id, 'blank' AS rule FROM k WHERE key = ''
UNION ALL SELECT a, 'label', label, 'claim_policy' FROM k WHERE label LIKE 'Person religion%'
UNION ALL SELECT a, 'label', key, 'duplicate_label' FROM k GROUP BY ALL HAVING count(*) > 1""")
def theme_label_violations(spark, sf):
    """Theme labels: not blank, inside the claim policy, unique after normalisation."""
    m, lang = F.pmod("doc_id", F.lit(5)), F.col("lang")
    label = (
        F.when(m == 0, " ").when(m == 1, F.concat(F.when(F.pmod("doc_id", F.lit(2)) == 0, "Theme ").otherwise("THEME  "), lang))
        .when(m == 2, F.concat(F.lit("Person religion = "), lang)).otherwise(F.concat(F.lit("t"), F.col("doc_id").cast("string"))))
    return semantic.label_violations(views.table(spark, sf, "documents").select(F.col("source").alias("analysis_id"), label.alias("label")))


@query("AGG22 JOIN13", sql("""
WITH k AS (SELECT unnest(['scene', 'object', 'activity', 'topic']) AS type),
e AS (SELECT l.type, coalesce(nullif(replace(CASE WHEN value = 'null' THEN '' ELSE value END, '"', ''), ''), label) AS label
      FROM truth_labels l JOIN samples USING (sample_id) WHERE split = 'eval')
SELECT k.type, (SELECT count(*) FROM taxonomy t WHERE t.type = k.type) AS taxonomy_labels, count(e.label) AS expected,
       count(t.label) AS covered, coalesce(count(t.label) / nullif(count(e.label), 0)::DOUBLE, 1.0) AS coverage
FROM k LEFT JOIN e USING (type) LEFT JOIN taxonomy t ON t.type = e.type AND t.label = e.label GROUP BY k.type""", "taxonomy", "truth_labels", "samples"))
def taxonomy_coverage(spark, sf):
    s, labels = views.samples(spark, sf), plain_labels(spark, sf)
    evals = labels.join(s.filter("split = 'eval'").select("sample_id"), "sample_id", "left_semi")
    return dataset.taxonomy_coverage(evals, dataset.train_taxonomy(s, labels))


@query("AGG19 JOIN14", sql("""
WITH sl AS (SELECT unnest(['(all)', 'persian_heavy', 'english_heavy', 'mixed_persian_english', 'text_heavy', 'low_quality', 'screenshot', 'meme', 'group', 'no_text', 'indoor', 'outdoor']) AS slice),
ty AS (SELECT unnest(['object', 'scene', 'activity', 'topic']) AS type),
f AS (SELECT type, unnest(list_append(slices, '(all)')) AS slice FROM truth_labels JOIN samples USING (sample_id) WHERE split = 'eval')
SELECT sl.slice, ty.type, count(f.slice) AS label_count FROM sl CROSS JOIN ty LEFT JOIN f ON f.slice = sl.slice AND f.type = ty.type GROUP BY ALL""", "truth_labels", "samples"))
def label_coverage(spark, sf):
    return dataset.label_coverage(views.samples(spark, sf), views.truth_labels(spark, sf))


@query("AGG19", "SELECT 'activity' AS type")
def missing_label_types(spark, sf):
    return dataset.missing_types(dataset.label_coverage(views.samples(spark, sf), views.truth_labels(spark, sf)))


@query("AGG20", sql("""
WITH sl AS (SELECT unnest(['persian_heavy', 'english_heavy', 'mixed_persian_english', 'text_heavy', 'low_quality', 'screenshot', 'meme', 'group', 'no_text', 'indoor', 'outdoor']) AS slice),
f AS (SELECT unnest(slices) AS slice FROM samples WHERE split = 'eval' AND ocr_text IS NOT NULL)
SELECT sl.slice, count(f.slice) AS sample_count FROM sl LEFT JOIN f USING (slice) GROUP BY sl.slice""", "samples"))
def text_truth_coverage(spark, sf):
    return dataset.text_truth_coverage(views.samples(spark, sf))


_WORDS = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)" for i in range(8))
views.cte("row_hashes", """
SELECT dataset_id, source, sha256('=' || sample_id || chr(0) || '=' || item_id || chr(0) || '=' || relative_path || chr(0) || '=' || content_hash) AS h
FROM (SELECT *, split_part(relative_path, '/', 1) AS source FROM samples)""", "samples")


@query("HSH8", sql(f"SELECT dataset_id, count(*) AS row_count, sha256(concat_ws(':', count(*), {_WORDS})) AS fingerprint FROM row_hashes GROUP BY dataset_id", "row_hashes"))
def content_fingerprint(spark, sf):
    return dataset.content_fingerprint(views.samples(spark, sf))


@query("RULE26 HSH8", sql("""
SELECT source AS dataset_id, 'fingerprint_mismatch' AS rule FROM (SELECT DISTINCT split_part(relative_path, '/', 1) AS source FROM samples WHERE doc_id % 97 = 0)""", "samples"))
def fingerprint_violations(spark, sf):
    s = views.samples(spark, sf).withColumn("dataset_id", F.split_part("relative_path", F.lit("/"), F.lit(1)))
    changed = F.when(F.pmod("doc_id", F.lit(97)) == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash"))
    return dataset.fingerprint_violations(dataset.content_fingerprint(s.withColumn("content_hash", changed)), dataset.content_fingerprint(s))


@query("AGG33", sql("""
SELECT split || '_sample_count' AS name, CAST(count(*) AS VARCHAR) AS value FROM samples GROUP BY split
UNION ALL SELECT split || '_ids_fingerprint', sha256(concat_ws(':', count(*), """ + _WORDS + """)) FROM (SELECT split, sha256('=' || sample_id) AS h FROM samples) GROUP BY split
UNION ALL SELECT 'train_labels_' || k.type, CAST(count(t.label) AS VARCHAR) FROM (SELECT unnest(['object', 'scene', 'activity', 'topic']) AS type) k LEFT JOIN taxonomy t USING (type) GROUP BY k.type
UNION ALL SELECT 'train_labels_total', CAST(count(*) AS VARCHAR) FROM taxonomy""", "samples", "taxonomy"))
def holdout_report(spark, sf):
    return dataset.holdout_report(views.samples(spark, sf), plain_labels(spark, sf))


# -- runs ----------------------------------------------------------------------------------

@query("AGG24", sql("""
WITH r AS (SELECT workload, latency_ms AS v, row_number() OVER (PARTITION BY workload ORDER BY latency_ms, run_id) - 1 AS i,
                  count(*) OVER (PARTITION BY workload) AS n FROM runs)
SELECT workload, round(quantile_cont(v, 0.95), 6) AS linear_p95, round(quantile_cont(v, 0.5), 6) AS median,
       max(v) FILTER (i = round_even((n - 1) * 0.95, 0)) AS nearest_p95, max(v) FILTER (i = floor((n - 1) * 0.95 + 0.999999)) AS ceil_p95
FROM r GROUP BY workload""", "runs"))
def latency_percentiles(spark, sf):
    out = run_ops.exact_percentiles(views.runs(spark, sf), ["workload"], "latency_ms", "run_id", {
        "linear_p95": (0.95, "linear"), "median": (0.5, "linear"), "nearest_p95": (0.95, "nearest"), "ceil_p95": (0.95, "ceil")})
    return _rounded(out, {"linear_p95", "median"})


@query("AGG25", sql("""
WITH l AS (SELECT unnest([workload, '(all)']) AS w, * EXCLUDE (workload) FROM runs),
r AS (SELECT w, latency_ms, row_number() OVER (PARTITION BY w ORDER BY latency_ms, run_id) - 1 AS i, count(*) OVER (PARTITION BY w) AS n FROM l),
q AS (SELECT w, round(quantile_cont(latency_ms, 0.5), 4) AS p50_latency_ms, max(latency_ms) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95_latency_ms FROM r GROUP BY w)
SELECT w AS workload, count(*) AS iterations, count(*) FILTER (failed) AS failed_iterations, round(count(*) FILTER (failed) / count(*)::DOUBLE, 6) AS failure_rate,
       round(sum(CASE WHEN failed THEN 0 ELSE items END) / (CAST(sum(CAST(latency_ms AS DECIMAL(28, 6))) AS DOUBLE) / 1000), 6) AS throughput,
       max(unsupported_rate) FILTER (NOT failed) AS max_unsupported_rate, bool_and(factual) FILTER (NOT failed) AS all_factual,
       any_value(p50_latency_ms) AS p50_latency_ms, any_value(p95_latency_ms) AS p95_latency_ms
FROM l JOIN q USING (w) GROUP BY w""", "runs"))
def run_rollup(spark, sf):
    out = _rounded(run_ops.run_rollup(views.runs(spark, sf)), {"failure_rate", "throughput"})
    return out.withColumn("p50_latency_ms", F.round("p50_latency_ms", 4))


@query("AGG26", sql("SELECT reason, count(*) AS failures FROM runs WHERE failed GROUP BY reason", "runs"))
def failure_histogram(spark, sf):
    return run_ops.failure_histogram(views.runs(spark, sf))


@query("AGG26", sql("""
SELECT candidate, count(*) FILTER (NOT failed) AS succeeded, count(*) FILTER (failed) AS failed,
       CASE WHEN bool_or(failed AND run_id % 5 = 0) THEN 'rejected_preflight' WHEN bool_or(failed) THEN 'rejected_runtime_failures' ELSE 'evaluated' END AS status,
       NOT bool_or(failed) AS benchmark_valid FROM runs GROUP BY candidate""", "runs"))
def candidate_status(spark, sf):
    return run_ops.candidate_status(views.runs(spark, sf).withColumn("preflight", F.pmod("run_id", F.lit(5)) == 0))


@query("AGG27", sql("""
SELECT candidate, count(*) AS runs, CASE WHEN count(*) >= 2 THEN count(DISTINCT reason || items) = 1 END AS deterministic
FROM runs GROUP BY candidate""", "runs"))
def rerun_determinism(spark, sf):
    r = views.runs(spark, sf).withColumn("signature", F.concat("reason", F.col("items").cast("string")))
    return run_ops.determinism(r, ["candidate"])


@query("AGG32", sql("""
WITH r AS (SELECT candidate % 5 AS candidate, latency_ms, row_number() OVER (PARTITION BY candidate % 5 ORDER BY latency_ms, run_id) - 1 AS i,
                  count(*) OVER (PARTITION BY candidate % 5) AS n FROM runs)
SELECT candidate, n_q AS sample_count, p50_latency_ms, p95_latency_ms FROM (
  SELECT candidate, round(quantile_cont(latency_ms, 0.5), 4) AS p50_latency_ms, max(latency_ms) FILTER (i = floor((n - 1) * 0.95 + 0.999999)) AS p95_latency_ms FROM r GROUP BY candidate)
JOIN (SELECT conv_id % 5 AS candidate, count(*) AS n_q FROM text_pairs GROUP BY 1) USING (candidate)""", "runs", "text_pairs"))
def candidate_comparison(spark, sf):
    rates = metrics.text_error_rates(views.text_pairs(spark, sf).withColumn("candidate", F.pmod("conv_id", F.lit(5))))
    latencies = views.runs(spark, sf).withColumn("candidate", F.pmod("candidate", F.lit(5)))
    out = run_ops.candidate_comparison(metrics.mean_error_rates(rates, ["candidate"]), latencies)
    return out.select("candidate", "sample_count", F.round("p50_latency_ms", 4).alias("p50_latency_ms"), "p95_latency_ms")
