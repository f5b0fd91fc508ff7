"""The end-to-end plan on a small batch."""

import json

from pyspark.sql import functions as F

from witnessgrid.operators import extract, items as item_ops
from witnessgrid.plans import profile


def test_end_to_end(spark):
    docs = spark.createDataFrame([
        ("A", 0, "a", "hello\nprivate note"), ("A", 1, "b", "Hello\nother"), ("A", 2, "c", "hello\nprivate note"), ("B", 0, "x", "solo"), ("B", 1, "y", ""),
        ("C", 0, "z", "person religion"), ("C", 1, "w", "person religion\n2")],
        "analysis_id string, ordinal int, item_id string, text string")
    items = profile.items_from_text(docs)
    lines = item_ops.with_canonical(items).select(
        "analysis_id", "item_id", "canonical_item_id", (F.col("copies") > 1).alias("has_copies"), F.lit(0.8).alias("confidence"),
        F.posexplode(F.split("text", "\n")).alias("ord", "raw_text"))
    evidence = extract.block_evidence(extract.normalized_blocks(lines), F.lit("reader"), keep=("canonical_item_id", "has_copies"))
    run = profile.analyse(items, evidence)
    assert run.violations.count() == 0
    got = run.insights.select("analysis_id", "rank", "insight_label", "evidence_count", "unique_item_count", "item_universe_count").collect()
    assert [tuple(r) for r in got] == [("A", 1, "Recurring textual reference: Hello", 2, 2, 3)]
    def whole(part_bytes):
        rows = sorted(profile.documents(run, part_bytes=part_bytes).collect(), key=lambda r: (r["analysis_id"], r["part_no"]))
        assert len({(r["analysis_id"], r["part_no"]) for r in rows}) == len(rows)
        return {a: "".join(r["result_payload"] for r in rows if r["analysis_id"] == a) for a in {r["analysis_id"] for r in rows}}, len(rows)
    texts, n = whole(1 << 20)
    assert n == 3
    cut, n = whole(64)
    assert cut == texts and n > 20
    out = {a: json.loads(t) for a, t in texts.items()}
    a = out["A"]["result"]["insights"][0]
    assert a["explanation"].startswith("Supported by 2 evidence signals across 2/3 images (coverage=0.666667)") and a["explanation"].endswith("supporting_image_ids=[a, b].")
    assert set(out) == {"A", "B", "C"}
    assert out["A"]["summary"] == "Supported insights: Recurring textual reference: Hello"
    assert out["A"]["result"]["insights"][0]["supporting_image_ids"] == ["a", "b"]
    assert "private" not in json.dumps(out["A"]) and [i["image_id"] for i in out["A"]["result"]["images"]] == ["a", "b", "c"]
    assert out["B"]["result"]["insights"] == [] and out["B"]["result"]["images"][1]["evidence"] == []
    clash = evidence.unionByName(evidence.filter("analysis_id = 'A'").withColumn("confidence", F.lit(0.1)))
    spoiled = profile.analyse(items, clash)
    assert spoiled.insights.count() == 0 and {r["rule"] for r in spoiled.violations.collect()} == {"conflicting_payload"}
