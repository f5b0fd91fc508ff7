"""Lifecycle of analyses, keyed table changes, and the evidence gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle, runs as run_ops
from ..session import shared_path
from ..sources import readers, writers
from . import views
from .registry import query
from .views import sql

# The check replays every request of a key one by one.
views.cte("steps", "SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY seq) AS n FROM requests", "requests")
REPLAY = """
WITH RECURSIVE fold(analysis_id, n, seq, target, status, payload, outcome) AS (
  SELECT DISTINCT analysis_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM steps
  UNION ALL
  SELECT f.analysis_id, s.n, s.seq, s.target,
    CASE WHEN s.expected IS NULL AND s.target = 'pending' AND f.status IS NULL THEN 'pending'
         WHEN s.expected = 'pending' AND s.target = 'in_progress' AND f.status = 'pending' THEN 'in_progress'
         WHEN s.expected = 'in_progress' AND f.status = 'in_progress' THEN s.target ELSE f.status END,
    CASE WHEN s.expected = 'in_progress' AND f.status = 'in_progress' THEN s.payload ELSE f.payload END,
    CASE WHEN s.expected = 'pending' AND s.target = 'completed' THEN 'invalid'
         WHEN s.expected IS NULL THEN CASE WHEN f.status IS NULL THEN 'applied' ELSE 'conflict' END
         WHEN s.expected = f.status THEN 'applied' ELSE 'conflict' END
  FROM fold f JOIN steps s ON s.analysis_id = f.analysis_id AND s.n = f.n + 1)
"""
FINAL = "f AS (SELECT analysis_id, max_by(status, n) AS status, max_by(payload, n) AS result_payload FROM fold GROUP BY analysis_id)"


def folded(spark, sf):
    return lifecycle.fold_transitions(views.requests(spark, sf))


def final(spark, sf):
    return lifecycle.final_state(folded(spark, sf)).select("analysis_id", "status", "result_payload")


@query("STM1", sql(REPLAY + "SELECT analysis_id, seq, target, outcome FROM fold WHERE n > 0", "steps"))
def transition_outcomes(spark, sf):
    return folded(spark, sf).select("analysis_id", "seq", "target", "outcome")


@query("STM1", sql(REPLAY + f", {FINAL} SELECT * FROM f WHERE status IS NOT NULL", "steps"))
def final_states(spark, sf):
    return final(spark, sf)


@query("STM2", sql(REPLAY + f", {FINAL} SELECT analysis_id, CASE WHEN status IN ('pending', 'in_progress') THEN 'failed' ELSE status END AS status, status IN ('pending', 'in_progress') AS recovered FROM f WHERE status IS NOT NULL", "steps"))
def recovered_states(spark, sf):
    return lifecycle.fail_interrupted(final(spark, sf)).select("analysis_id", "status", "recovered")


@query("STM2", sql(REPLAY + f", {FINAL} SELECT count(*) FILTER (status IN ('pending', 'in_progress')) AS recovered FROM f", "steps"))
def recovered_count(spark, sf):
    return lifecycle.fail_interrupted(final(spark, sf)).agg(F.count_if("recovered").alias("recovered"))


@query("RULE24", sql("""
SELECT analysis_id, 'state' AS entity, analysis_id AS entity_id, 'payload_with_status' AS rule FROM requests WHERE target = 'completed' AND payload IS NULL""", "requests"))
def state_violations(spark, sf):
    r = views.requests(spark, sf)
    return lifecycle.state_violations(r.select("analysis_id", F.col("target").alias("status"), F.col("payload").alias("result_payload")))


@query("SRC6", sql(REPLAY + f", {FINAL} SELECT analysis_id, result_payload FROM f WHERE status = 'completed'", "steps"))
def completed_state_scan(spark, sf):
    return readers.find_state(final(spark, sf), status="completed").select("analysis_id", "result_payload")


@query("PRJ8", """
SELECT o_orderkey AS analysis_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status, 'c' || o_custkey || ',k' || o_orderkey AS item_ids
FROM orders""")
def status_view(spark, sf):
    state = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("analysis_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"),
        F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))).alias("item_ids"),
        "o_totalprice")
    return lifecycle.status_view(state).withColumn("item_ids", F.array_join("item_ids", ","))


def incoming(spark, sf):
    return views.requests(spark, sf).filter("expected = 'pending' AND target = 'completed'").select("analysis_id", F.col("seq").alias("request_no"))


def existing(spark, sf):
    return views.requests(spark, sf).filter("expected IS NULL").select("analysis_id").distinct()


views.cte("incoming", "SELECT analysis_id, seq AS request_no FROM requests WHERE expected = 'pending' AND target = 'completed'", "requests")
views.cte("existing", "SELECT DISTINCT analysis_id FROM requests WHERE expected IS NULL", "requests")


@query("SNK4", sql("""
SELECT analysis_id, min(request_no) AS request_no, 'pending' AS status FROM incoming WHERE analysis_id NOT IN (FROM existing) GROUP BY analysis_id""", "incoming", "existing"))
def pending_inserts(spark, sf):
    fresh, _ = lifecycle.insert_pending(existing(spark, sf), incoming(spark, sf))
    return fresh


@query("SNK4", sql("""
SELECT analysis_id, request_no FROM incoming i WHERE analysis_id IN (FROM existing)
OR request_no > (SELECT min(request_no) FROM incoming j WHERE j.analysis_id = i.analysis_id)""", "incoming", "existing"))
def insert_conflicts(spark, sf):
    _, conflict = lifecycle.insert_pending(existing(spark, sf), incoming(spark, sf))
    return conflict


@query("SNK3", sql("SELECT analysis_id FROM existing WHERE analysis_id NOT IN (SELECT analysis_id FROM incoming)", "incoming", "existing"))
def state_after_delete(spark, sf):
    return lifecycle.delete_keys(existing(spark, sf), incoming(spark, sf))


@query("SNK5", sql("""
SELECT analysis_id, max(request_no) AS request_no FROM incoming GROUP BY analysis_id
UNION ALL SELECT analysis_id, -1 FROM existing WHERE analysis_id NOT IN (SELECT analysis_id FROM incoming)""", "incoming", "existing"))
def state_after_upsert(spark, sf):
    old = existing(spark, sf).withColumn("request_no", F.lit(-1).cast("bigint"))
    return lifecycle.upsert(old, incoming(spark, sf), "request_no")


# -- the same changes, written to a table and read back ------------------------------------

def _table(spark, sf):
    """A new state table of the existing analyses."""
    path = shared_path(spark, "state")
    writers.write_state(existing(spark, sf).withColumn("request_no", F.lit(-1).cast("bigint")).withColumn("status", F.lit("old")), path)
    return path


@query("SNK4", sql("""
SELECT analysis_id, min(request_no) AS request_no, 'pending' AS status FROM incoming WHERE analysis_id NOT IN (FROM existing) GROUP BY analysis_id
UNION ALL SELECT analysis_id, -1, 'old' FROM existing""", "incoming", "existing"))
def stored_inserts(spark, sf):
    path = _table(spark, sf)
    fresh, _ = lifecycle.insert_pending(existing(spark, sf), incoming(spark, sf))
    writers.insert_state(fresh.unionByName(existing(spark, sf).selectExpr("analysis_id", "0L AS request_no", "'again' AS status")), path, ("requests", 1))
    writers.insert_state(fresh.withColumn("status", F.lit("replayed")), path, ("requests", 1))
    return readers.read_state(spark, path)


@query("SNK5 SNK3", sql("""
SELECT analysis_id, max(request_no) AS request_no, 'new' AS status FROM incoming GROUP BY analysis_id
UNION ALL SELECT analysis_id, -1, 'old' FROM existing WHERE analysis_id NOT IN (SELECT analysis_id FROM incoming) AND length(analysis_id) % 2 = 0""", "incoming", "existing"))
def stored_changes(spark, sf):
    """Upserts of the newest request of each analysis, then deletes of untouched ones whose id has an odd length."""
    path = _table(spark, sf)
    newest = incoming(spark, sf).groupBy("analysis_id").agg(F.max("request_no").alias("request_no")).withColumn("status", F.lit("new"))
    writers.upsert_state(newest, path, ("requests", 1))
    now = readers.read_state(spark, path)
    writers.delete_state(now.filter((F.col("status") == "old") & (F.length("analysis_id") % 2 == 1)), path, ("requests", 2))
    return readers.read_state(spark, path)


# -- evidence gate: customers are runs, their orders stand for the reports they handed in --

_NAMES = ("ocr", "vision", "embedding", "insight", "api_persistence", "e2e", "hardware")


def gate_reports(spark, sf):
    o = views.table(spark, sf, "orders")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.pmod("o_orderkey", F.lit(7)) + 1).cast("int"))
    last = o.select(F.col("o_custkey").alias("run_id"), name.alias("name"), "o_orderkey").groupBy("run_id", "name").agg(F.max("o_orderkey").alias("k"))
    k = F.col("k")
    rate = F.when(F.pmod(k, F.lit(5)) == 0, "0.25").otherwise("0.0")
    schema = F.when(F.pmod(k, F.lit(3)) == 0, "old").otherwise(F.concat("name", F.lit("-v1")))
    body = (
        F.when(F.col("name") == "ocr", F.concat(F.lit('{"schema_version":"'), schema, F.lit('","candidates":[{"candidate":"tessdata_best","deterministic_rerun":'),
               F.when(F.pmod(k, F.lit(4)) == 0, "false").otherwise("true"), F.lit("}]}")))
        .when(F.col("name") == "vision", F.concat(
            F.lit('{"schema_version":"phase10-siglip-zero-shot-vision-benchmark-v1","candidate":{"selection_protocol_safe":true,"benchmark_valid":true,"failure_rate":0.0,"f1":'), rate, F.lit("}}")))
        .when(F.col("name") == "e2e", F.concat(
            F.lit('{"schema_version":"e2e-v1","deployment_profile":{"vision_enabled":false},"performance":{"failure_rate":'), rate,
            F.lit(',"total_end_to_end_p50_latency_ms":'), k.cast("string"), F.lit('},"quality":{"end_to_end_accuracy":"unavailable","summary_structural_factuality":true,'
                  '"unsupported_claim_rate_post_validation":0.0},"concurrency":{"failed_requests":0,"request_isolation":true}}')))
        .otherwise(F.concat(F.lit('{"schema_version":"'), schema, F.lit('"}'))))
    return last.select("run_id", "name", body.alias("payload"))


def gate_runs(spark, sf):
    return views.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id")).distinct()


views.cte("gate", """
SELECT o_custkey AS run_id, ['ocr', 'vision', 'embedding', 'insight', 'api_persistence', 'e2e', 'hardware'][o_orderkey % 7 + 1] AS name, max(o_orderkey) AS k FROM orders GROUP BY 1, 2""")


@query("SRC8", sql("""
SELECT r.run_id, n.name, CASE WHEN g.k IS NULL AND n.name = 'embedding' THEN 'not_required' WHEN g.k IS NULL THEN 'missing'
       WHEN n.name IN ('insight', 'hardware') AND g.k % 3 = 0 THEN 'unexpected_schema' ELSE 'available' END AS status, n.name <> 'embedding' AS required
FROM (SELECT DISTINCT o_custkey AS run_id FROM orders) r CROSS JOIN (SELECT unnest(['ocr', 'vision', 'embedding', 'insight', 'api_persistence', 'e2e', 'hardware']) AS name) n
LEFT JOIN gate g ON g.run_id = r.run_id AND g.name = n.name""", "gate"))
def report_status(spark, sf):
    out = run_ops.report_status(gate_runs(spark, sf), gate_reports(spark, sf), run_ops.DEGRADED, {"insight": "insight-v1", "hardware": "hardware-v1"})
    return out.select("run_id", "name", "status", "required")


@query("AGG31", sql("""
SELECT run_id, m AS metric, CASE WHEN m IN ('failure_rate', 'p50_latency_ms', 'summary_factuality', 'unsupported_claim_rate') THEN 'measured' ELSE 'unavailable' END AS status,
       CASE m WHEN 'failure_rate' THEN CASE WHEN k % 5 = 0 THEN '0.25' ELSE '0.0' END WHEN 'p50_latency_ms' THEN CAST(k AS VARCHAR) WHEN 'summary_factuality' THEN 'true' WHEN 'unsupported_claim_rate' THEN '0.0' END AS value
FROM gate, (SELECT unnest(['end_to_end_accuracy', 'insight_precision', 'unsupported_claim_rate', 'summary_factuality', 'confidence_calibration', 'p50_latency_ms', 'p95_latency_ms',
       'throughput_images_per_second', 'model_provider_warmup_ms', 'peak_ram_mb', 'peak_vram_mb', 'failure_rate']) AS m) WHERE name = 'e2e'""", "gate"))
def gate_metrics(spark, sf):
    return run_ops.gate_metrics(gate_reports(spark, sf))


@query("AGG31 SRC8", sql("""
SELECT run_id, 6 - missing AS missing_reports, ocr AS ocr_valid, vision AS vision_rejection_valid, e2e AS e2e_profile_valid, missing = 6 AND ocr AND vision AND e2e AS acceptance_ready FROM (
  SELECT run_id, count(*) FILTER (name <> 'embedding') AS missing, coalesce(bool_or(name = 'ocr' AND k % 4 <> 0), false) AS ocr,
         coalesce(bool_or(name = 'vision' AND k % 5 <> 0), false) AS vision, coalesce(bool_or(name = 'e2e' AND k % 5 <> 0), false) AS e2e FROM gate GROUP BY run_id)""", "gate"))
def acceptance_gate(spark, sf):
    return run_ops.acceptance(gate_runs(spark, sf), gate_reports(spark, sf))
