"""Roll-ups over benchmark runs: exact percentiles, failure rates, determinism, evidence gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from . import digests, skew

ALL = "(all)"


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, tie: str, points: dict[str, tuple[float, str]],
                      hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Exact percentiles per key under a named definition, one column per point.

    ``points``: output name -> (q, method) with method 'linear' (interpolated), 'nearest'
    (half-even index) or 'ceil' (index rounded up). Rows are ranked with hot groups split, then
    only the rows at the wanted positions are aggregated.
    """
    keys = list(keys)
    ranked = skew.rank_within(df.select(*keys, value, tie), keys, [F.col(value), F.col(tie)], "_rank", hot_rows=hot_rows)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = F.col("_rank") - 1
    v = F.col(value)

    def last(q: float) -> Column:
        return (F.col("_n") - 1) * F.lit(q)

    joined = skew.lookup(ranked, sizes.withColumn("_size", F.col("_n")), keys, "_size", hot_rows, spread_by=["_rank"])
    columns, wanted = [], F.lit(False)
    for name, (q, method) in points.items():
        pos = last(q)
        if method == "linear":
            low, high = F.floor(pos), F.ceil(pos)
            part = pos - low
            a, b = F.max(F.when(at == low, v)), F.max(F.when(at == high, v))
            columns.append((a + (b - a) * F.max(F.when(at == low, part))).alias(name))
            wanted = wanted | (at == low) | (at == high)
        elif method in ("nearest", "ceil"):
            index = F.bround(pos, 0) if method == "nearest" else F.floor(pos + 0.999999)
            columns.append(F.max(F.when(at == index, v)).alias(name))
            wanted = wanted | (at == index)
        else:
            raise ValueError(f"unknown percentile method {method}")
    return joined.filter(wanted).groupBy(*keys).agg(*columns)


def run_rollup(runs: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Per workload and in total: latency, throughput, failures, claims, factuality.

    ``runs``: workload, run_id, items, latency_ms, failed, unsupported_rate, factual.
    """
    c = F.col
    levels = runs.withColumn("workload", F.explode(F.array("workload", F.lit(ALL))))
    ok = ~c("failed")
    total_ms = F.sum(c("latency_ms").cast("decimal(28,6)")).cast("double")
    done_items = F.sum(F.when(ok, c("items")).otherwise(0))
    rates = levels.groupBy("workload").agg(
        F.count(F.lit(1)).alias("iterations"), F.count_if(c("failed")).alias("failed_iterations"),
        (F.count_if(c("failed")) / F.count(F.lit(1))).alias("failure_rate"),
        F.when((done_items > 0) & (total_ms > 0), done_items / (total_ms / 1000.0)).alias("throughput"),
        F.max(F.when(ok, c("unsupported_rate"))).alias("max_unsupported_rate"),
        F.min(F.when(ok, c("factual"))).alias("all_factual"))
    quantiles = exact_percentiles(
        levels, ["workload"], "latency_ms", "run_id",
        {"p50_latency_ms": (0.5, "linear"), "p95_latency_ms": (0.95, "nearest")}, hot_rows)
    return rates.join(quantiles, "workload")


def failure_histogram(runs: DataFrame) -> DataFrame:
    return runs.filter(F.col("failed")).groupBy("reason").agg(F.count(F.lit(1)).alias("failures"))


def candidate_status(runs: DataFrame, need_all: bool = True) -> DataFrame:
    """'evaluated' or the reason of rejection per candidate.

    ``need_all``: valid only when every sample succeeded; otherwise one success is enough.
    """
    c = F.col
    per = runs.groupBy("candidate").agg(
        F.count_if(~c("failed")).alias("succeeded"), F.count_if(c("failed")).alias("failed"),
        F.max(F.coalesce(c("preflight") & c("failed"), F.lit(False))).alias("_pre"))
    valid = (c("failed") == 0) & ~c("_pre") if need_all else c("succeeded") > 0
    status = F.when(c("_pre"), "rejected_preflight").when(c("failed") > 0, "rejected_runtime_failures").otherwise("evaluated")
    return per.select("candidate", "succeeded", "failed", status.alias("status"), valid.alias("benchmark_valid"))


def determinism(signatures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """True when all reruns of a key agree, null with fewer than two runs.

    Compares digests by their minimum and maximum, so no set of signatures is gathered.
    """
    digest = F.sha2(F.col("signature"), 256)
    per = signatures.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    return per.select(*keys, "runs", F.when(F.col("runs") >= 2, F.col("_lo") == F.col("_hi")).alias("deterministic"))


def summary_factuality(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored summary equals the one rebuilt from the insights, by digest, whatever its size.

    ``stored`` and ``rebuilt``: analysis_id, n (order) and text, the pieces of each summary.
    """
    was, again = (digests.sha256_of(pieces, ["analysis_id"], ["n"], "text") for pieces in (stored, rebuilt))
    return was.join(again.withColumnRenamed("sha256", "_again"), "analysis_id", "left").select(
        "analysis_id", F.coalesce(F.col("sha256") == F.col("_again"), F.lit(False)).alias("factual"))


def candidate_comparison(quality: DataFrame, latencies: DataFrame) -> DataFrame:
    """One row per candidate: mean error rates beside median and p95 latency."""
    quantiles = exact_percentiles(
        latencies, ["candidate"], "latency_ms", "run_id",
        {"p50_latency_ms": (0.5, "linear"), "p95_latency_ms": (0.95, "ceil")})
    return quality.join(quantiles, "candidate")


# -- evidence gate -------------------------------------------------------------------------

STRICT = "strict_full"
DEGRADED = "degraded_ocr_only"
REQUIRED_REPORTS = {
    STRICT: ("ocr", "vision", "embedding", "insight", "api_persistence", "e2e", "hardware"),
    DEGRADED: ("ocr", "vision", "insight", "api_persistence", "e2e", "hardware"),
}
GATE_METRICS = {
    "end_to_end_accuracy": "$.quality.end_to_end_accuracy",
    "insight_precision": "$.quality.insight_precision",
    "unsupported_claim_rate": "$.quality.unsupported_claim_rate_post_validation",
    "summary_factuality": "$.quality.summary_structural_factuality",
    "confidence_calibration": "$.quality.confidence_calibration",
    "p50_latency_ms": "$.performance.total_end_to_end_p50_latency_ms",
    "p95_latency_ms": "$.performance.total_end_to_end_p95_latency_ms",
    "throughput_images_per_second": "$.performance.throughput_images_per_second",
    "model_provider_warmup_ms": "$.performance.model_provider_warmup_ms",
    "peak_ram_mb": "$.performance.peak_process_ram_mb",
    "peak_vram_mb": "$.performance.peak_vram_mb",
    "failure_rate": "$.performance.failure_rate",
}


def report_status(runs: DataFrame, reports: DataFrame, profile: str = STRICT,
                  schemas: dict[str, str] | None = None) -> DataFrame:
    """Every report a run could have: available, missing, not required, or of a wrong schema.

    ``runs``: run_id; ``reports``: run_id, name, payload (JSON). The report list is fixed, so
    runs are exploded over it rather than joined to it.
    """
    names = F.array(*[F.lit(n) for n in REQUIRED_REPORTS[STRICT]])
    every = runs.select("run_id", F.explode(names).alias("name"))
    found = every.join(reports, ["run_id", "name"], "left")
    schema = F.get_json_object("payload", "$.schema_version")
    required = F.col("name").isin(*REQUIRED_REPORTS[profile])
    wrong = F.lit(False)
    for name, want in (schemas or {}).items():
        wrong = wrong | ((F.col("name") == name) & ~F.coalesce(schema == want, F.lit(False)))
    status = (
        F.when(F.col("payload").isNull() & ~required, "not_required").when(F.col("payload").isNull(), "missing")
        .when(wrong, "unexpected_schema").otherwise("available"))
    return found.select("run_id", "name", status.alias("status"), schema.alias("schema_version"), required.alias("required"))


def gate_metrics(reports: DataFrame) -> DataFrame:
    """Measured / unavailable status of every mandatory metric of the end-to-end report."""
    e2e = reports.filter(F.col("name") == "e2e")
    rows = F.array(*[
        F.struct(F.lit(n).alias("metric"), F.get_json_object("payload", path).alias("value"))
        for n, path in GATE_METRICS.items()])
    found = e2e.select("run_id", F.inline(rows))
    missing = F.col("value").isNull() | (F.col("value") == "unavailable")
    return found.select(
        "run_id", "metric", F.when(missing, "unavailable").otherwise("measured").alias("status"),
        F.when(~missing, F.col("value")).alias("value"))


def acceptance(runs: DataFrame, reports: DataFrame, profile: str = DEGRADED) -> DataFrame:
    """Fail-closed gate: every required report present and every validity predicate true."""
    def at(path: str) -> Column:
        return F.get_json_object("payload", path)

    def is_(name: str, condition: Column) -> Column:
        return F.max(F.when(F.col("name") == name, F.coalesce(condition, F.lit(False))).otherwise(F.lit(False)))

    candidates = F.from_json(at("$.candidates"), "array<struct<candidate:string,deterministic_rerun:boolean>>")
    ocr = F.exists(candidates, lambda x: (x["candidate"] == vocab.SELECTED_TEXT_CANDIDATE) & x["deterministic_rerun"])
    vision = (
        (at("$.schema_version") == vocab.VISION_REPORT_SCHEMA)
        & (at("$.candidate.selection_protocol_safe") == "true") & (at("$.candidate.benchmark_valid") == "true")
        & (at("$.candidate.failure_rate").try_cast("double") == 0.0) & (at("$.candidate.f1").try_cast("double") == 0.0))
    e2e = (
        (at("$.deployment_profile.vision_enabled") == "false")
        & (at("$.performance.failure_rate").try_cast("double") == 0.0)
        & (at("$.quality.summary_structural_factuality") == "true")
        & (at("$.quality.unsupported_claim_rate_post_validation").try_cast("double") == 0.0)
        & (at("$.concurrency.failed_requests").try_cast("double") == 0.0)
        & (at("$.concurrency.request_isolation") == "true"))
    needed = REQUIRED_REPORTS[profile]
    checked = reports.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("name").isin(*needed) & F.col("payload").isNotNull(), F.col("name"))).alias("_have"),
        is_("ocr", ocr).alias("ocr_valid"), is_("vision", vision).alias("vision_rejection_valid"),
        is_("e2e", e2e).alias("e2e_profile_valid"))
    out = runs.select("run_id").join(checked, "run_id", "left").select(
        "run_id", (F.lit(len(needed)) - F.coalesce("_have", F.lit(0))).cast("int").alias("missing_reports"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("ocr_valid", "vision_rejection_valid", "e2e_profile_valid")])
    ready = F.lit(profile == DEGRADED) & (F.col("missing_reports") == 0) & F.col("ocr_valid") & F.col(
        "vision_rejection_valid") & F.col("e2e_profile_valid")
    return out.withColumn("acceptance_ready", ready)
