"""Literal cases of the evaluation metrics and the golden report."""

import json

import pytest

from witnessgrid.operators import dataset, metrics, runs
from witnessgrid.sources import readers

MANIFEST = {
    "schema_version": "1.0.0", "dataset_id": "harbour", "dataset_version": "2.4.0", "label_schema_version": "1.1.0", "data_policy": "consented_or_authorized",
    "samples": [
        {"sample_id": "h-07", "split": "train", "slices": ["indoor"], "image": {"image_id": "pic-07", "relative_path": "quay/07.png"},
         "ground_truth": {"labels": [{"label_id": "k1", "type": "object", "label": "rope", "value": "rope"}], "unsupported_claims": []}},
        {"sample_id": "h-11", "split": "eval", "slices": ["text_heavy"], "image": {"image_id": "pic-11", "relative_path": "quay/11.png"},
         "ground_truth": {"labels": [{"label_id": "k2", "type": "object", "label": "crane", "value": "crane"},
                                     {"label_id": "k3", "type": "object", "label": "lamp", "value": "lamp"}], "ocr_text": "pier nine closed",
                          "unsupported_claims": []}},
        {"sample_id": "h-12", "split": "eval", "slices": ["no_text"], "image": {"image_id": "pic-12", "relative_path": "quay/12.png"},
         "ground_truth": {"labels": [{"label_id": "k4", "type": "scene", "label": "dock", "value": "dock"}], "ocr_text": "abcd", "unsupported_claims": []}}]}
PREDICTIONS = {
    "schema_version": "1.1.0", "dataset_id": "harbour", "dataset_version": "2.4.0", "predictions": [
        {"sample_id": "h-11", "labels": [{"type": "object", "label": "crane", "confidence": 0.95, "value": "crane"},
                                         {"type": "object", "label": "gull", "confidence": 0.55, "value": "gull"}], "ocr_text": "pier ten closed",
         "claims": [{"key": "boats_seen", "label": "Boats near a quay", "confidence": 0.6}, {"key": "cranes_seen", "label": "Cranes near a quay", "confidence": 0.6},
                    {"key": "person_religion", "label": "Person religion = any", "confidence": 0.4}]},
        {"sample_id": "h-12", "labels": [{"type": "scene", "label": "dock", "confidence": 0.75, "value": "dock"}], "ocr_text": "abd",
         "claims": [{"key": "dock_seen", "label": "A dock", "confidence": 0.9}]}]}


def load(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "p").mkdir()
    (tmp_path / "m" / "m.json").write_text(json.dumps(MANIFEST, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "p" / "p.json").write_text(json.dumps(PREDICTIONS, ensure_ascii=False), encoding="utf-8")
    good, bad = readers.split_strict(readers.read_json_documents(spark, str(tmp_path / "m")), readers.MANIFEST_SHAPE)
    assert bad.count() == 0
    samples = readers.parse_manifests(good)
    preds = readers.parse_predictions(readers.read_json_documents(spark, str(tmp_path / "p")))
    return samples, preds


def test_golden_report(spark, tmp_path):
    samples, preds = load(spark, tmp_path)
    assert metrics.coverage_violations(samples, preds).count() == 0
    report = metrics.evaluation_report(
        samples, readers.manifest_labels(samples), readers.prediction_labels(preds), preds.select("sample_id", "ocr_text"), readers.prediction_claims(preds))
    got = {r["name"]: (round(r["value"], 9), r["sample_count"], r["minimum"], r["maximum"]) for r in report.collect()}
    # Labels: 2 of 3 predicted are true, 2 of 3 true are predicted. Calibration: |1 - 0.95|, |0 - 0.55| and
    # |1 - 0.75| in bins of one row each. Text: "ten" for "nine" costs 3 of 16 characters, 1 of 3 words;
    # "abd" for "abcd" 1 of 4 characters and the one word. One claim of four is sensitive.
    assert got == {
        "visual_precision": (round(2 / 3, 9), 2, 0.0, 1.0), "visual_recall": (round(2 / 3, 9), 2, 0.0, 1.0), "visual_f1": (round(2 / 3, 9), 2, 0.0, 1.0),
        "confidence_ece": (round(0.85 / 3, 9), 3, 0.0, 1.0), "unsupported_claim_rate": (0.25, 4, 0.0, 1.0),
        "ocr_cer": (round((3 / 16 + 1 / 4) / 2, 9), 2, 0.0, None), "ocr_wer": (round((1 / 3 + 1) / 2, 9), 2, 0.0, None)}
    labels = readers.manifest_labels(samples)
    assert dataset.audit(samples, labels).count() == 0
    assert {r["value"] for r in labels.collect()} == {'"rope"', '"crane"', '"lamp"', '"dock"'}


def matches(spark, truth, pred):
    schema = "sample int, label string"
    flat = lambda side: [(i, x) for i, s in enumerate(side) for x in s]
    return metrics.label_matches(spark.createDataFrame(flat(truth), schema), spark.createDataFrame(flat(pred), schema), ["sample", "label"])


@pytest.mark.parametrize("truth,pred,want", [
    (["p"], ["ppp"], 1.0), (["p", "qr"], ["p", "q"], 2 / 3), (["pq"], ["q"], 0.5), (["", "r"], ["", "r"], 1.0), (["", "p"], ["p", ""], 0.0)])
def test_macro_f1(spark, truth, pred, want):
    assert metrics.macro_f1(matches(spark, truth, pred), ["label"]).first()["macro_f1"] == pytest.approx(want)


@pytest.mark.parametrize("truth,pred,want", [
    (["pq", "r"], ["pz", "rs"], (0.5, 2 / 3, 4 / 7)), (["", ""], ["", ""], (1.0, 1.0, 1.0)), (["", "pq"], ["z", ""], (0.0, 0.0, 0.0))])
def test_micro(spark, truth, pred, want):
    r = metrics.precision_recall_f1(matches(spark, truth, pred)).first()
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx(want)


def test_retrieval(spark):
    ranked = spark.createDataFrame([("n", x, i) for i, x in enumerate("vwxyz", 1)], "query string, item_id string, rank int")
    relevant = spark.createDataFrame([("n", "w"), ("n", "x"), ("n", "z"), ("n", "k")], "query string, item_id string")
    r = metrics.query_scores(ranked, relevant, 3).first()
    # Hits at ranks 2, 3 and 5 of four relevant items; one is never found.
    assert r["recall_at_k"] == 0.5 and r["average_precision"] == pytest.approx((1 / 2 + 2 / 3 + 3 / 5) / 4)
    two = spark.createDataFrame([("m", "v", 1), ("m", "w", 2), ("m", "x", 3), ("n", "v", 1)], "query string, item_id string, rank int")
    rel = spark.createDataFrame([("m", "x"), ("n", "v")], "query string, item_id string")
    assert metrics.retrieval_summary(metrics.query_scores(two, rel, 1)).first()["map"] == pytest.approx((1 / 3 + 1) / 2)
    nothing = metrics.retrieval_summary(metrics.query_scores(two.filter("rank < 0"), rel.filter("query = ''"), 1)).first()
    assert nothing["map"] == 0.0 and nothing["mean_recall_at_k"] == 0.0


def test_calibration_and_claims(spark):
    # Bin [0.6, 0.7): two rows, mean 0.64, half correct; bin [0.3, 0.4): one row, 0.35, correct.
    obs = spark.createDataFrame([(0.62, True), (0.66, False), (0.35, True)], "confidence double, correct boolean")
    assert metrics.calibration_error(obs, 10).first()["ece"] == pytest.approx((2 * 0.14 + 0.65) / 3)
    assert metrics.calibration_error(obs.filter("confidence > 2"), 10).first()["ece"] == 0.0
    claims = spark.createDataFrame([
        ("boats_seen", "Boats near a quay"), ("person_religion", "Person religion = any"), ("ropes_seen", "Ropes"), ("nets_seen", "Nets"),
        ("lamp_seen", "Lamps")], "key string, label string")
    assert metrics.unsupported_claim_rate(claims).first()["unsupported_claim_rate"] == pytest.approx(1 / 5)
    assert metrics.unsupported_claim_rate(claims.filter("key = ''")).first()["unsupported_claim_rate"] == 0.0


def test_theme_metrics_by_slice(spark):
    sims = [("d1", "ferry", 0.7), ("d2", "ferry", 0.6), ("d3", "ferry", 0.3), ("d1", "net", 0.1), ("d2", "net", 0.2), ("d3", "net", 0.55)]
    pred = spark.createDataFrame([(s, l) for s, l, v in sims if v >= 0.5], "sample_id string, label string")
    truth = spark.createDataFrame([("d1", "ferry"), ("d2", "net"), ("d3", "net")], "sample_id string, label string")
    m = metrics.label_matches(truth, pred, ["sample_id", "label"])
    slices = spark.createDataFrame([("d1", "english_heavy"), ("d2", "english_heavy"), ("d3", "persian_heavy")], "sample_id string, slice string")
    got = {r["slice"]: r["macro_f1"] for r in metrics.theme_f1_by_slice(m, slices, ("persian_heavy", "english_heavy", "mixed_persian_english")).collect()}
    # English: ferry has one hit and one false alarm (2/3), net one miss (0). Persian: net is right.
    assert got == {"persian_heavy": 1.0, "english_heavy": pytest.approx(1 / 3), "mixed_persian_english": None}


def test_holdout_is_label_blind_and_refuses(spark):
    import hashlib
    s = spark.createDataFrame([("d", "1.0.0", f"s{i}", "eval") for i in range(20)], "dataset_id string, dataset_version string, sample_id string, split string")
    want = set(sorted((f"s{i}" for i in range(20)), key=lambda x: (hashlib.sha256(f"d\n{x}".encode()).hexdigest(), x))[:6])
    for hot_rows in (4, 1000):
        out = dataset.holdout_split(s, "1.1.0", 6, hot_rows)
        assert {r["sample_id"] for r in out.filter("split = 'train'").collect()} == want and out.count() == 20
    assert dataset.holdout_split(s, "1.0.0", 6).count() == 0
    assert {r["rule"] for r in dataset.holdout_violations(s, "1.0.0", 20).collect()} == {"version_not_new", "train_count_out_of_range"}
    split = dataset.holdout_split(s, "1.1.0", 6)
    assert {r["rule"] for r in dataset.holdout_violations(split, "1.2.0", 6).collect()} == {"already_split"}


def test_audit_rules(spark):
    s = spark.createDataFrame([
        ("d", "a", "train", "i1", "p1"), ("d", "b", "eval", "i1", "p2"), ("d", "c", "eval", "i3", "p2"), ("d", "c", "eval", "i4", "p4"), ("e", "x", "train", "i9", "p9")],
        "dataset_id string, sample_id string, split string, item_id string, relative_path string")
    labels = spark.createDataFrame([("d", "a", "l", "t", "x", "null"), ("d", "a", "l", "t", "y", "null"), ("d", "a", "m", "t", "x", "null")],
                                   "dataset_id string, sample_id string, label_id string, type string, label string, value string")
    got = sorted((r["entity_id"], r["rule"]) for r in dataset.audit(s, labels).collect())
    assert got == sorted([("c", "duplicate_sample"), ("i1", "leakage_item"), ("p2", "duplicate_path"), ("e", "no_eval_sample"),
                          ("a", "duplicate_label_id"), ("a", "duplicate_label_identity")])


def test_gate_is_fail_closed(spark):
    run = spark.createDataFrame([("r",), ("empty",)], "run_id string")
    e2e = {"deployment_profile": {"vision_enabled": False}, "performance": {"failure_rate": 0.0}, "quality": {
        "summary_structural_factuality": True, "unsupported_claim_rate_post_validation": 0.0}, "concurrency": {"failed_requests": 0, "request_isolation": True}}
    vision = {"schema_version": "phase10-siglip-zero-shot-vision-benchmark-v1", "candidate": {
        "selection_protocol_safe": True, "benchmark_valid": True, "failure_rate": 0.0, "f1": 0.0}}
    docs = {"ocr": {"candidates": [{"candidate": "tessdata_best", "deterministic_rerun": True}]}, "vision": vision, "insight": {}, "api_persistence": {}, "e2e": e2e, "hardware": {}}
    def reports(d):
        return spark.createDataFrame([("r", k, json.dumps(v)) for k, v in d.items()], "run_id string, name string, payload string")
    def ready(d, profile=runs.DEGRADED):
        return {r["run_id"]: r["acceptance_ready"] for r in runs.acceptance(run, reports(d), profile).collect()}
    assert ready(docs) == {"r": True, "empty": False}
    assert ready(docs, runs.STRICT)["r"] is False
    assert ready({k: v for k, v in docs.items() if k != "hardware"})["r"] is False
    assert ready({**docs, "vision": {**vision, "candidate": {**vision["candidate"], "f1": 0.4}}})["r"] is False
    status = {r["name"]: r["status"] for r in runs.report_status(run.filter("run_id = 'r'"), reports(docs), runs.DEGRADED).collect()}
    assert status["embedding"] == "not_required" and status["ocr"] == "available"


def test_determinism(spark):
    s = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "x")], "k string, signature string")
    assert {r["k"]: r["deterministic"] for r in runs.determinism(s, ["k"]).collect()} == {"a": True, "b": False, "c": None}
