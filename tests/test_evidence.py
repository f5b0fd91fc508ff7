"""Small literal cases of items, aggregation, insights and results."""

import hashlib
import itertools
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from witnessgrid import session
from witnessgrid.catalog import evidence_queries
from witnessgrid.operators import aggregate, digests, extract, insights, items as item_ops, lifecycle, ordered, parts, questionnaire, result, rules, semantic
from witnessgrid.plans import profile

ITEMS = "analysis_id string, ordinal int, item_id string, content_hash string"
EVIDENCE = "analysis_id string, id string, item_id string, type string, label string, value string, confidence double, source string"


def item_batch(spark, ids, hashes=None):
    rows = [("A", i, x, (hashes or {}).get(x, x)) for i, x in enumerate(ids)]
    return spark.createDataFrame(rows, ITEMS)


def rows(spark, *specs):
    return spark.createDataFrame(
        [("A", i, item, kind, label, label, conf, source) for i, item, kind, label, conf, source in specs], EVIDENCE)


def run(spark, items, evidence, extra=None):
    resolved = item_ops.with_canonical(items)
    marked = aggregate.resolve_items(evidence, item_ops.duplicates_of(resolved))
    signals = aggregate.support_signals(marked)
    if extra is not None:
        signals = aggregate.union_signals(signals, extra)
    kept = aggregate.represent(aggregate.distinct_evidence(signals))
    out = aggregate.theme_aggregates(kept, item_ops.universe(items))
    ids = aggregate.support_links(kept).groupBy("analysis_id", "kind", "key").agg(*[
        F.array_sort(F.collect_set(c)).alias(name) for c, name in (
            ("canonical_item_id", "supporting_item_ids"), ("original_item_id", "original_item_ids"), ("signal_id", "supporting_signal_ids"))])
    return out.join(ids, ["analysis_id", "kind", "key"])


def test_single_item(spark):
    a = run(spark, item_batch(spark, "a"), rows(spark, ("e1", "a", "topic", "football", 0.7, "s"))).first()
    assert (a["evidence_count"], a["unique_item_count"], a["item_universe_count"], a["item_coverage"]) == (1, 1, 1, 1.0)
    assert a["average_confidence"] == a["max_confidence"] == 0.7 and a["cross_item_consistency"] == 1.0


def test_several_sources(spark):
    a = run(spark, item_batch(spark, "ab"), rows(
        spark, ("e1", "a", "topic", "Football", 0.6, "vision_a"), ("e2", "a", "topic", "football ", 0.8, "vision_b"),
        ("e3", "b", "topic", "football", 1.0, "vision_a"))).first()
    assert (a["evidence_count"], a["unique_item_count"], a["item_coverage"], a["source_diversity"]) == (3, 2, 1.0, 2)
    assert a["average_confidence"] == pytest.approx(0.8) and a["max_confidence"] == 1.0 and a["cross_item_consistency"] == 0.5
    assert a["sources"] == ["vision_a", "vision_b"] and a["label"] == "Football" and a["key"] == "football"


def test_repeats_and_conflicts(spark):
    once = ("e1", "a", "topic", "x", 0.5, "s")
    assert run(spark, item_batch(spark, "a"), rows(spark, once, once)).first()["evidence_count"] == 1
    clash = rows(spark, once, ("e1", "a", "topic", "x", 0.9, "s"), ("e2", "a", "topic", "y", 0.9, "s"))
    assert [r["entity_id"] for r in aggregate.evidence_conflicts(clash).collect()] == ["e1"]


def test_copies_do_not_add_support(spark):
    batch = item_batch(spark, "ab", {"b": "a"})
    a = run(spark, batch, rows(spark, ("ev-a", "a", "topic", "x", 0.8, "s"), ("ev-b", "b", "topic", "x", 0.91, "s"))).first()
    assert (a["evidence_count"], a["unique_item_count"], a["item_universe_count"], a["item_coverage"]) == (1, 1, 2, 0.5)
    assert a["supporting_item_ids"] == ["a"] and a["supporting_signal_ids"] == ["ev-a"] and a["average_confidence"] == 0.8


def test_copy_speaks_for_silent_canonical(spark):
    batch = item_batch(spark, "abc", {"b": "a", "c": "a"})
    a = run(spark, batch, rows(spark, ("ev-c", "c", "topic", "x", 0.8, "s"), ("ev-b", "b", "topic", "x", 0.9, "s"))).first()
    assert a["supporting_item_ids"] == ["a"] and a["original_item_ids"] == ["b"] and a["supporting_signal_ids"] == ["ev-b"]


def test_copies_through_two_sources_are_refused(spark):
    batch = item_batch(spark, "abz", {"b": "a"})
    out = run(spark, batch, rows(
        spark, ("e1", "a", "topic", "x", 0.8, "s1"), ("e2", "b", "topic", "x", 0.8, "s2"), ("e3", "z", "topic", "x", 0.8, "s1")))
    kept, bad = insights.split_supported(insights.candidate_insights(out))
    assert kept.count() == 0 and bad.first()["rule"] == "unique_item_support_not_preserved"


def test_order_does_not_matter(spark):
    specs = [(f"e{i}", "abcd"[i % 4], ("topic", "object")[i % 2], f"L{i % 3}", (i % 7) / 7, f"s{i % 2}") for i in range(60)]
    batch = item_batch(spark, "abcd", {"d": "a"})
    views = []
    for order, parts in itertools.product((specs, specs[::-1]), (1, 5)):
        df = run(spark, batch, rows(spark, *order).repartition(parts))
        views.append(sorted(map(str, df.collect())))
    assert views[0] == views[1] == views[2] == views[3]
    assert aggregate.aggregate_violations(run(spark, batch, rows(spark, *specs))).count() == 0


AGG = ("analysis_id string, kind string, key string, label string, evidence_count long, unique_item_count long, item_universe_count long, "
       "average_confidence double, max_confidence double, source_diversity long, cross_item_consistency double, support_preserved boolean")


def aggregates(spark, *specs):
    df = spark.createDataFrame([("A", k, key, key, n, u, t, c, c, d, 1.0, True) for k, key, n, u, t, c, d in specs], AGG)
    return df.withColumn("item_coverage", F.col("unique_item_count") / F.col("item_universe_count"))


def test_support_score_and_boundaries(spark):
    c = insights.candidate_insights(aggregates(spark, ("topic", "x", 2, 2, 4, 0.8, 1))).first()
    assert c["confidence"] == pytest.approx(0.7) and c["insight_label"] == "Recurring topic-related content: x"
    for n, want in ((1, 0), (2, 1), (3, 1)):
        assert insights.candidate_insights(aggregates(spark, ("topic", "x", n, 2, 4, 0.8, 1))).count() == want


def test_only_supported_kinds_and_claims(spark):
    a = aggregates(
        spark, ("topic", "football", 3, 3, 4, 0.9, 2), ("brand", "b", 1, 1, 4, 0.9, 1), ("religious_content", "religious-themed content", 2, 2, 4, 0.8, 1),
        ("semantic_theme", "travel", 4, 4, 4, None, 1), ("topic", "person religion", 4, 4, 4, 0.9, 2))
    ranked = insights.rank_insights(insights.candidate_insights(a)).orderBy("rank").collect()
    assert [(r["type"], r["key"], r["rank"]) for r in ranked] == [
        ("visible_interest", "football", 1), ("religious_content", "religious-themed content", 2)]
    assert insights.rank_insights(insights.candidate_insights(a), hot_rows=1).orderBy("rank").collect() == ranked


def test_explanation_and_summary(spark):
    a = insights.rank_insights(insights.candidate_insights(aggregates(spark, ("topic", "x", 2, 2, 4, 0.8, 1))))
    ids = [("A", a.first()["insight_key"], 1, part, i) for part, i in [("item", "a"), ("item", "b"), ("item", "c"), ("signal", "s1")]]
    support = spark.createDataFrame(ids, "analysis_id string, insight_key string, rank int, part string, id string")
    whole = (
        "Supported by 2 evidence signals across 2/4 images (coverage=0.500000); source_diversity=1; cross_image_consistency=1.000000; "
        "average_evidence_confidence=0.800000; max_evidence_confidence=0.800000; supporting_image_ids=[a, b, c].")
    for part_bytes, n in ((1 << 20, 1), (3, 5)):
        found = insights.explanation_parts(a, support, part_bytes).orderBy("part_no").collect()
        assert "".join(r["payload"] for r in found) == whole and len(found) == n
    analyses = spark.createDataFrame([("A",), ("B",)], "analysis_id string")
    for part_bytes in (1 << 20, 4):
        got = {}
        for r in insights.summary_parts(a, analyses, part_bytes).orderBy("analysis_id", "part_no").collect():
            got[r["analysis_id"]] = got.get(r["analysis_id"], "") + r["payload"]
        assert got == {"A": "Supported insights: Recurring topic-related content: x", "B": "No supported insights met the configured evidence policy."}


def test_fail_mode_drops_whole_analysis(spark):
    df = spark.createDataFrame([("A", "x"), ("A", " y"), ("B", "z")], "analysis_id string, t string")
    valid, bad = rules.apply_rules(df, "row", F.col("t"), {"trimmed": rules.trimmed_text(F.col("t"))})
    assert valid.count() == 2 and [r["entity_id"] for r in bad.collect()] == [" y"]
    assert [r["analysis_id"] for r in rules.drop_failed(df, bad).collect()] == ["B"]


def test_line_blocks(spark):
    words = spark.createDataFrame([
        ("i", 0, 1, 1, 1, 1, 10, 20, 30, 10, 90.0, "سلام"), ("i", 1, 1, 1, 1, 1, 45, 20, 40, 10, 80.0, "OpenAI"), ("i", 2, 1, 1, 1, 2, 5, 50, 9, 8, 100.0, "2026")],
        "item_id string, row_no long, page_num int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string")
    got = extract.line_blocks(words).orderBy("ord").collect()
    assert [(r["ord"], r["raw_text"], round(r["confidence"], 9)) for r in got] == [(0, "سلام OpenAI", 0.85), (1, "2026", 1.0)]
    assert tuple(got[0]["region"]) == (10, 20, 75, 10)
    hints = extract.normalized_blocks(extract.line_blocks(words)).orderBy("ord").collect()
    assert [(r["script_hint"], r["language_hint"]) for r in hints] == [("mixed_arabic_latin", "mixed"), ("numeric", None)]


def test_extractor_guard(spark):
    items = spark.createDataFrame([("A", "a", "x"), ("A", "b", "boom"), ("A", "c", "other")], "analysis_id string, item_id string, content string")

    def factory():
        split = extract.line_splitter()

        def run(batch):
            if (batch["content"] == "boom").any():
                raise RuntimeError("secret")
            out = split(batch)
            if (batch["content"] == "other").any():
                out["item_id"] = "zzz"
            return out
        return run

    got = {r["item_id"]: (r["raw_text"], r["error_reason"]) for r in extract.run_extractor(items, factory, extract.BLOCK_SCHEMA).collect()}
    assert got == {"a": ("x", None), "b": (None, "RuntimeError"), "c": (None, "ValueError: extractor result does not match its item")}


def test_small_pieces_of_a_failing_batch_go_back_together():
    """Halving makes hundreds of small results; each as a frame of its own costs more than the extractor."""
    class Items:
        schema = T.StructType.fromDDL("analysis_id string, item_id string, content string")

        def mapInPandas(self, run, schema):
            return run

    def factory():
        split = extract.line_splitter()

        def run(batch):
            if batch["content"].str.startswith("bad").any():
                raise ValueError("bad")
            return split(batch)
        return run

    rows = [("A", f"i{i}", "bad" if i % 7 == 0 else f"one {i}\n \ntwo {i}") for i in range(500)]
    run = extract.run_extractor(Items(), factory, extract.BLOCK_SCHEMA)
    frames = list(run(iter([pd.DataFrame(rows, columns=["analysis_id", "item_id", "content"])])))
    got = {(r.item_id, r.ord, r.raw_text, r.error_reason) for f in frames for r in f.itertuples()}
    assert got == {("i%d" % i, None, None, "ValueError: bad") for i in range(0, 500, 7)} | {
        ("i%d" % i, o, f"{w} {i}", None) for i in range(500) if i % 7 for o, w in ((0, "one"), (2, "two"))}
    assert len(frames) == 2


def test_every_item_has_a_vector_of_its_own(spark):
    """Texts without words, no text, and ids of several analyses or of several rows in one batch."""
    items = spark.createDataFrame([
        ("A", "i", "one two"), ("B", "i", "three"), ("A", "blank", " \n"), ("A", "empty", ""), ("B", "none", None), ("B", "twice", "x"), ("B", "twice", "x"),
        (None, "stray", "y"), ("A", None, "no id"), ("B", None, "no id")], "analysis_id string, item_id string, content string").coalesce(1)
    out = extract.run_extractor(items, extract.feature_hasher(8), "item_id string, embedding array<float>").collect()
    got = sorted((r["analysis_id"] or "", r["item_id"] or "", len(r["embedding"]), round(sum(x * x for x in r["embedding"]), 4), r["error_reason"]) for r in out)
    assert got == sorted((r["analysis_id"] or "", r["item_id"] or "", 8, 1.0, None) for r in items.collect())
    lines = extract.run_extractor(items, extract.line_splitter, extract.BLOCK_SCHEMA).filter("item_id = 'i'").collect()
    assert sorted((r["analysis_id"], r["ord"], r["raw_text"]) for r in lines) == [("A", 0, "one two"), ("B", 0, "three")]


def test_questionnaire(spark):
    spec = [("o-1", "openness", 5, False), ("o-2", "openness", 1, True), ("c-1", "conscientiousness", 3, False), ("e-1", "extraversion", 2, False),
            ("a-1", "agreeableness", 4, False), ("n-1", "neuroticism", 1, False)]
    df = spark.createDataFrame(
        [("A", "inst", "1", 1.0, 5.0, i, t, float(v), rev, True, "explicit_self_report_questionnaire") for i, t, v, rev in spec],
        "analysis_id string, instrument_id string, instrument_version string, scale_min double, scale_max double, item_id string, trait string, "
        "response_value double, reverse_scored boolean, consent_confirmed boolean, basis string")
    assert questionnaire.violations(df).count() == 0
    got = {r["trait"]: r for r in questionnaire.trait_scores(df).collect()}
    assert {t: r["normalized_score"] for t, r in got.items()} == {
        "openness": 1.0, "conscientiousness": 0.5, "extraversion": 0.25, "agreeableness": 0.75, "neuroticism": 0.0}
    assert got["openness"]["scored_mean"] == 5.0 and got["openness"]["supporting_item_ids"] == ["o-1", "o-2"]
    summary = questionnaire.profiles(questionnaire.trait_scores(df)).first()["summary"]
    assert summary == ("Self-reported Big Five scores: openness=1.000000 | conscientiousness=0.500000 | extraversion=0.250000 | "
                       "agreeableness=0.750000 | neuroticism=0.000000")
    bad = {r["rule"] for r in questionnaire.violations(df.filter("trait <> 'openness'").withColumn("response_value", F.lit(9.0))).collect()}
    assert bad == {"missing_trait", "outside_scale"}


def test_redaction_and_document_round_trip(spark):
    items = item_batch(spark, "ab")
    evidence = spark.createDataFrame([
        ("A", "e1", "a", "ocr_text", "ocr_text", "private", 0.5, "ocr", '{"raw_text":"private","block_order":"0"}'),
        ("A", "e2", "a", "scene", "park", "park", 0.5, "vision", '{"raw_text":"kept"}')],
        EVIDENCE + ", metadata string")
    clean = {r["id"]: r for r in result.redacted(evidence).collect()}
    assert clean["e1"]["value"] is None and json.loads(clean["e1"]["metadata"]) == {"block_order": "0"}
    assert clean["e2"]["value"] == "park" and "kept" in clean["e2"]["metadata"]
    ranked = insights.rank_insights(insights.candidate_insights(aggregates(spark, ("topic", "quoted \"label\"", 2, 2, 2, 0.8, 1))))
    ids = [("A", ranked.first()["insight_key"], 1, part, i) for part, i in [("item", "a"), ("item", "b"), ("signal", "e2"), ("signal", "e1")]]
    support = spark.createDataFrame(ids, "analysis_id string, insight_key string, rank int, part string, id string")
    claims = spark.createDataFrame(
        [("A", f"c{i}", "religion", 'v"\n', "s", "bio", True, "explicit_self_report") for i in (2, 1)] + [("Z", "c", "religion", "v", "s", "bio", True, "explicit_self_report")],
        "analysis_id string, claim_id string, category string, value string, source_id string, source_type string, consent_confirmed boolean, basis string")
    for part_bytes in (1 << 20, 40):
        docs = result.document_parts(items, result.redacted(evidence), ranked, support, "v1", claims, part_bytes=part_bytes)
        cut = docs.orderBy("part_no").collect()
        assert len(cut) == 1 if part_bytes > 40 else len(cut) > 10
        payload = json.loads("".join(r["result_payload"] for r in cut))
        assert [i["image_id"] for i in payload["result"]["images"]] == ["a", "b"] and payload["result"]["images"][1]["evidence"] == []
        assert [e["id"] for e in payload["result"]["images"][0]["evidence"]] == ["e1", "e2"] and payload["result"]["images"][0]["evidence"][0]["value"] is None
        assert payload["schema_version"] == "profile-analysis-result-v3" and payload["personality_profile"] is None
        (insight,) = payload["result"]["insights"]
        assert insight["label"].endswith('quoted "label"') and insight["supporting_evidence_ids"] == ["e1", "e2"] and insight["explanation"].endswith("[a, b].")
        assert [c["claim_id"] for c in payload["self_reported_claims"]] == ["c1", "c2"] and payload["self_reported_claims"][0]["value"] == 'v"\n'
        good, leaves, bad = result.read_documents(docs)
        assert bad.count() == 0 and good.first()["schema_version"] == "profile-analysis-result-v3"
        told = {(r["path"], tuple(r["at"])): r["value"] for r in leaves.filter("chunk_no = 0").collect()}
        assert told["summary", ()] == payload["summary"] == "Supported insights: " + insight["label"]
        assert told["result.insights[].supporting_image_ids[]", (0, 1)] == "b" and told["self_reported_claims[].value", (1,)] == 'v"\n'
    alone = result.document_parts(items, result.redacted(evidence), ranked.limit(0), support.limit(0), "v1")
    assert json.loads(alone.first()["result_payload"])["summary"] == "No supported insights met the configured evidence policy."
    spoiled = {"unknown_version": F.regexp_replace("result_payload", "result-v3", "result-v9"), "invalid_fields": F.concat("result_payload", F.lit("}")),
               "payload_missing": F.lit(None).cast("string"), "id_mismatch": F.regexp_replace("result_payload", '"result":.."analysis_id":"A"|"result":."analysis_id":"A"', '"result":{"analysis_id":"B"')}
    for reason, text in spoiled.items():
        _, _, bad = result.read_documents(alone.withColumn("result_payload", text))
        assert [tuple(r) for r in bad.collect()] == [("A", reason)]


def test_leaves_of_streamed_json(spark):
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.random()
        if depth < 4 and kind < 0.3:
            return {rng.choice("abcd") + str(i) + rng.choice(["", '"', "\\", "é"]): value(depth + 1) for i in range(rng.randint(0, 4))}
        if depth < 4 and kind < 0.6:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([None, True, False, 1, -2.5, 1e20, "", "x" * rng.randint(0, 40), 'q"\\\n\u00e9\U0001f600' * 3])

    def plain(v, path="", at=()):
        if isinstance(v, (dict, list)):
            yield path, list(at), "object" if isinstance(v, dict) else "array", ""
            for k, x in v.items() if isinstance(v, dict) else enumerate(v):
                yield from plain(x, f"{path}.{k}".lstrip(".") if isinstance(v, dict) else path + "[]", at if isinstance(v, dict) else (*at, k))
        else:
            yield path, list(at), "string" if isinstance(v, str) else "null" if v is None else "boolean" if isinstance(v, bool) else "number", v if isinstance(v, str) else json.dumps(v)
    documents = {f"d{n}": value() for n in range(150)}
    rows = []
    for name, v in documents.items():
        text, at = json.dumps(v, ensure_ascii=rng.random() < 0.5), 0
        while at < len(text):
            size = rng.randint(1, 9)
            rows.append((name, len(rows), text[at:at + size]))
            at += size
    broken = ["", "{", '{"a":1', '{"a" 1}', "[1,]", '{"a":1,}', "[1 2]", "nul", "1 2", '{"a":1}}', "[NaN]", '"\\x"', "{1:2}", '"abc', "[01]"]
    rows += [(f"bad{n}", 0, text) for n, text in enumerate(broken)]
    rng.shuffle(rows)
    found = {}
    df = spark.createDataFrame(rows, "analysis_id string, part_no long, payload string").repartition(3)
    for r in parts.leaves(df, chunk=7).orderBy("analysis_id", "leaf", "chunk_no").collect():
        own = found.setdefault(r["analysis_id"], {}).setdefault(r["leaf"], [r["path"], r["at"], r["kind"], ""])
        own[3] += r["value"] or ""
    for name, v in documents.items():
        assert [found[name][k] for k in sorted(found[name])] == [list(x) for x in plain(v)]
    for n in range(len(broken)):
        assert [x[2] for x in found[f"bad{n}"].values()].count("error") == 1


def test_long_strings_come_in_full_chunks(spark):
    text = json.dumps({"a": "xé\\" * 9})
    for size in (1, 4, 100):
        rows = [("A", at, text[at:at + size]) for at in range(0, len(text), size)]
        df = spark.createDataFrame(rows, "analysis_id string, part_no long, payload string")
        found = parts.leaves(df, chunk=7).filter("path = 'a'").orderBy("chunk_no").collect()
        assert [r["value"] for r in found] == [("xé\\" * 9)[at:at + 7] for at in range(0, 27, 7)]


def test_stored_results_hold_the_texts(spark):
    """Not only how many there are: every summary, explanation and claim comes back whole."""
    rows = evidence_queries.stored_results(spark, "/root/testdata/sf0.001").collect()
    seen = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["place"], r["chunk_no"])):
        seen.setdefault((r["analysis_id"], r["path"]), {}).setdefault(r["place"], []).append(r["value"])
    for r in rows:
        at = lambda path: seen.get((r["analysis_id"], path), {})
        assert len(at("summary")) == 1 and len(at("result.insights[].key")) == len(at("result.insights[].explanation")) == r["insights"]
        assert len(at("self_reported_claims[].claim_id")) == r["claims"]
    told = ["".join(v) for (_, path), places in seen.items() if path.endswith("explanation") for v in places.values()]
    assert told and all(t.startswith("Supported by ") and t.endswith("].") for t in told)


def test_transitions(spark):
    events = spark.createDataFrame([
        ("A", 1, None, "pending", None), ("A", 2, "in_progress", "failed", None), ("A", 3, "pending", "in_progress", None),
        ("A", 4, "in_progress", "completed", None), ("A", 5, "in_progress", "completed", "{}"), ("A", 6, "in_progress", "failed", None),
        ("A", 7, None, "pending", None), ("B", 1, "pending", "in_progress", None), ("B", 2, None, "pending", None)],
        "analysis_id string, seq long, expected string, target string, payload string")
    for hot_rows in (1, 1_000_000):
        got = {(r["analysis_id"], r["seq"]): r["outcome"] for r in lifecycle.fold_transitions(events, hot_rows).collect()}
        assert [got["A", i] for i in range(1, 8)] == ["applied", "conflict", "applied", "invalid", "applied", "conflict", "conflict"]
        assert [got["B", i] for i in (1, 2)] == ["conflict", "applied"]
    final = lifecycle.final_state(lifecycle.fold_transitions(events)).select("analysis_id", "status", "result_payload")
    assert sorted(map(tuple, final.collect())) == [("A", "completed", "{}"), ("B", "pending", None)]
    after = {r["analysis_id"]: (r["status"], r["recovered"]) for r in lifecycle.fail_interrupted(final).collect()}
    assert after == {"A": ("completed", False), "B": ("failed", True)}


def test_labels_score_alike_in_blocks_of_any_size(spark):
    rng = random.Random(4)

    def unit():
        v = [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] + [1.0]
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v]
    items = [(a, f"i{k}", unit()) for a in "ab" for k in range(25)]
    names = [(f"l{k:02}", unit()) for k in range(30)]
    vectors = spark.createDataFrame(items, "analysis_id string, item_id string, embedding array<double>")
    labels = spark.createDataFrame(names, "label string, embedding array<double>")
    want = {(a, i, n): max(-1.0, min(1.0, sum(p * q for p, q in zip(x, y)))) for a, i, x in items for n, y in names}

    def found(**kwargs):
        rows = semantic.score_labels(vectors, labels, **kwargs).collect()
        got = {(r.analysis_id, r.item_id, r.label): r.similarity for r in rows}
        assert len(got) == len(rows) and all(abs(want[k] - v) < 1e-12 for k, v in got.items())
        return set(got)
    for block in (2, 10_000):
        assert found(block=block) == set(want)
        assert found(block=block, threshold=0.7) == {k for k, v in want.items() if v >= 0.7}
        best = found(block=block, top=3)
        assert len(best) == 150
        for a, i, _ in items:
            own = sorted((round(want[a, i, n], 12), n) for n, _ in names)
            assert min(round(want[k], 12) for k in best if k[:2] == (a, i)) == own[-3][0]
    assert semantic.score_labels(vectors, labels.limit(0)).collect() == [] and semantic.score_labels(vectors.limit(0), labels).collect() == []


def test_retained_signals_are_made_once(spark, monkeypatch):
    """The insights and the ids behind them read one table of retained signals."""
    made, plain = [], evidence_queries.views.retained
    monkeypatch.setattr(evidence_queries.views, "retained", lambda *a: made.append(a) or plain(*a))
    evidence_queries.explained_insights(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


SMALL = "/root/testdata/sf0.001"


def test_stored_documents_leave_no_evidence_tables_behind(spark):
    """What the parts were made of goes when they are written; the parts are written once."""
    session.ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    stored = evidence_queries.documents(spark, SMALL)
    left = {d: spark.read.parquet(f"{folder}/{d}").count() for d in set(os.listdir(folder)) - before if d.startswith("stash-")}
    assert max(left.values()) < evidence_queries.views.evidence(spark, SMALL).count() / 2
    assert stored.count() in left.values()


def test_signals_of_wide_themes_give_the_same_insights(spark):
    views = evidence_queries.views
    whole, wide = views.retained(spark, SMALL), views.retained(spark, SMALL, evidence_queries.kept_evidence(spark, SMALL))
    assert 0 < wide.count() < whole.count() / 2 and wide.exceptAll(whole).isEmpty()
    names = ("analysis_id", "rank", "insight_key", "insight_label", "confidence", "evidence_count", "unique_item_count", "sources")
    got, want = (sorted(map(tuple, evidence_queries.insights(spark, SMALL, r).select(*names).collect())) for r in (wide, whole))
    assert got == want and got


def test_wide_themes_at_the_bounds(spark):
    rows = [("A", f"{n}-{i}", "ocr_text", n, n) for n, count in (("one", 1), ("two", 2), ("three", 3), ("", 9)) for i in range(count)] + [("B", "b", "ocr_text", "two", "two")]
    themed = spark.createDataFrame(rows, "analysis_id string, id string, type string, _text string, k string").withColumn("_theme", F.xxhash64("type", "k"))
    for total, least in ((10, 2), (20, 2), (21, 3), (30, 3), (31, 4)):
        universe = spark.createDataFrame([("A", total), ("B", 10)], "analysis_id string, item_universe_count long")
        kept = profile.wide_evidence(themed, universe).collect()
        assert {r["_key"] for r in kept} == {n for n, count in (("two", 2), ("three", 3)) if count >= least} and {r["analysis_id"] for r in kept} <= {"A"}


def test_leaves_of_some_paths(spark):
    text = json.dumps({"a": {"b": [{"c": "x" * 20, "d": 1}, {"c": None}]}, "e": "s", "a2": [[1]], "b": {"a": {"b": 2}}})
    rows = [(name, at, t[at:at + 5]) for name, t in (("A", text), ("bad", text + "}"), ("rest", '{"e":{"f":1,"g":2}}')) for at in range(0, len(t), 5)]
    df = spark.createDataFrame(rows, "analysis_id string, part_no long, payload string")
    every = parts.leaves(df, chunk=7).collect()
    first, seen = set(), None
    for r in sorted(every, key=lambda r: (r["analysis_id"], r["leaf"], r["chunk_no"])):
        top = (r["analysis_id"], r["path"].split(".")[0].split("[")[0])
        first |= {(r["analysis_id"], r["leaf"], r["chunk_no"])} if top != seen else set()
        seen = top
    want = sorted((tuple(r[:3]), r["path"], r["kind"], r["value"] or "") for r in every
                  if r["path"] == "a.b[].c" or r["kind"] == "error" or tuple(r[:3]) in first)
    got = sorted((tuple(r[:3]), r["path"], r["kind"], r["value"] or "") for r in parts.leaves(df, chunk=7, paths=("a.b[].c",)).collect())
    assert got == want and len(got) < len(every) and sum(r[1] == "a.b[].c" for r in got) == 8


def test_streams_keep_their_order_after_a_join(spark):
    """Rows that a join has laid by the key already are dealt again: Spark may turn the join and read them in other splits."""
    path = session.shared_path(spark, "parts")
    text = json.dumps([f"value {i}" for i in range(3000)])
    rows = [(f"d{n}", at, text[at:at + 50]) for n in range(20) for at in range(0, len(text), 50)]
    spark.createDataFrame(rows, "analysis_id string, part_no long, payload string").repartition(6).write.parquet(path)
    stored = spark.read.parquet(path)
    names = {"spark.sql.shuffle.partitions": "32", "spark.sql.autoBroadcastJoinThreshold": "1000"}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        last = stored.groupBy("analysis_id").agg(F.max("part_no").alias("last"))
        marked = stored.join(last, "analysis_id").filter("part_no <= last").select(*stored.columns)
        found = parts.leaves(marked, paths=("[]",)).filter("kind <> 'array'").groupBy("analysis_id", "kind").count().collect()
        plan = ordered.gathered(marked, ["analysis_id"], ["part_no"], 32)._jdf.queryExecution().toString()
        hashes = digests.sha256_of(marked, ["analysis_id"], ["part_no"], "payload").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "hashpartitioning(_g#" in plan
    assert {tuple(r) for r in found} == {(f"d{n}", "string", 3000) for n in range(20)}
    assert {tuple(r) for r in hashes} == {(f"d{n}", hashlib.sha256(text.encode()).hexdigest()) for n in range(20)}


def test_values_of_the_row_before_reach_over_borders(spark):
    df = spark.range(500).select(F.when(F.col("id") < 430, "a").otherwise(F.concat(F.lit("b"), F.col("id"))).alias("k"), "id", (F.col("id") % 3 == 0).alias("o"))
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows make one range
    spark.conf.set(name, "false")
    try:
        out = ordered.totals_within(df.repartition(5), ["k"], ["id"], {"n": F.lit(1)}, {"was": "o"})
    finally:
        spark.conf.set(name, "true")
    assert len(os.listdir(out._stash_path.removeprefix("file:"))) > 6  # files, sums and the mark
    got = out.collect()
    assert {r["id"]: (r["n"], r["was"]) for r in got} == {
        i: (i, (i - 1) % 3 == 0 if i else None) if i < 430 else (0, None) for i in range(500)}


def test_whole_values_are_opened_at_once():
    evidence = ",".join('{"id":"%d é","n":[%d,null,true,-0.50],"":{}}' % (n, n) for n in range(200))
    for end in ("]}", "]}}", ",]}", ',{"a":01}]}', ',"\\ud83d"]}', ',"\\u00e9"]}'):
        document = '{"a":[' + evidence + end
        steps, rows = [], []
        for size in (len(document), 1000, 1):  # by one character, every value is walked token by token
            walker = parts.Walker(chunk=2)
            token, count = walker._token, itertools.count()
            walker._token = lambda *a: (next(count), token(*a))[1]
            rows.append([r for i in range(0, len(document), size) for r in walker.feed(document[i:i + size])] + list(walker.feed("", True)))
            steps.append(next(count))
        assert rows[0] == rows[1] == rows[2]
        assert steps[1] < len(rows[0]) / 2
