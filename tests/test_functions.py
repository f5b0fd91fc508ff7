"""Scalar functions against plain Python."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from witnessgrid.functions import ids, numbers, policy, text
from witnessgrid.operators import items as item_ops, metrics, rules

ODD = [
    "plain ascii", "  spaced\t out ", "Straße GROSS", "ΣΊΣΥΦΟΣ", "İstanbul ıslak", "école CAFÉ", "ﬁne ＡＢＣ", "سلام  دنيا", "كتاب",
    "می‌روم", " nbsp ", "a\x1cb\x1dc", "µ micro", "", "  　 ", "KK Ω", "한국어 한", "x̧́ ý̧",
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    return [r["o"] for r in sorted(df.select("i", expr(F.col("v")).alias("o")).collect(), key=lambda r: r["i"])]


def agg_text(v):
    return " ".join(unicodedata.normalize("NFC", v).split())


def test_normal_forms(spark):
    assert column(spark, ODD, text.visual_text) == [agg_text(v) for v in ODD]
    assert column(spark, ODD, text.aggregation_text) == [agg_text(v) or None for v in ODD]
    assert column(spark, ODD, text.aggregation_key) == [agg_text(v).casefold() for v in ODD]
    assert column(spark, ODD, text.casefold) == [v.casefold() for v in ODD]
    assert column(spark, ODD, text.strip) == [v.strip() for v in ODD]


def test_every_bmp_character_normalises_like_python(spark):
    chars = [f"a{chr(c)}b" for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF and c]
    assert column(spark, chars, text.aggregation_key) == [agg_text(v).casefold() for v in chars]
    lowered = [unicodedata.normalize("NFKC", v).lower().replace("ي", "ی").replace("ك", "ک").replace("‌", " ").replace("_", " ") for v in chars]
    assert column(spark, chars, text.policy_text) == [" ".join(v.split()) for v in lowered]


def test_ocr_text(spark):
    cases = {
        " a \t b \r\n\r\n c d\re ": "a b\nc d\ne", "كتاب يى": "کتاب یی", "می‌روم": "می‌روم", " \n \n": "", "é\n x": "é\nx"}
    assert column(spark, list(cases), text.ocr_text) == list(cases.values())


def test_script_hints_match_unicode_names(spark):
    def python_hint(value):
        n = {"ar": 0, "la": 0, "d": 0, "o": 0}
        for ch in value:
            if ch.isdigit():
                n["d"] += 1
            elif ch.isalpha():
                inside = any(a <= ord(ch) <= b for a, b in ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)))
                n["ar" if inside else "la" if "LATIN" in unicodedata.name(ch, "") else "o"] += 1
        if n["ar"] and n["la"]:
            return "mixed_arabic_latin"
        return "arabic" if n["ar"] else "latin" if n["la"] else "numeric" if n["d"] and not n["o"] else "other"

    chars = [chr(c) for c in list(range(1, 0x3000)) + list(range(0xFB00, 0xFFFE))] + ["سلام OpenAI", "2026", "12 中", "!", "۱۲", "²"]
    assert column(spark, chars, text.script_hint) == [python_hint(c) for c in chars]


def test_policy(spark):
    labels = {
        "religion": True, "Religion-themed poster": False, "Person religion = x": True, "مذهب شخص = نمونه": True, "POLITICAL_ORIENTATION": True,
        "personal religiosity": False, "user's mental  health": True, "هوش مصنوعی": False, "هوش کاربر": True, "دین": True, "subject intelligence": True}
    assert column(spark, list(labels), lambda c: policy.violates(None, c)) == list(labels.values())
    keys = {"person_religion": True, "visible_sports_content": False, "user_mental_health_note": True, "topic": False}
    assert column(spark, list(keys), lambda c: policy.violates(c, F.lit("ok"))) == list(keys.values())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_error_rates_against_brute_force(spark):
    rng = random.Random(7)
    words = ["the", "θ", "سلام", "a", "bb", "𝒳", "é"]
    pairs = [("", ""), ("", "x"), ("x y", ""), ("  ", "a"), ("a" * 700, "b" * 600), ("a b " * 300, "a c " * 290)]
    pairs += [(" ".join(rng.choices(words, k=rng.randint(0, 12))), " ".join(rng.choices(words, k=rng.randint(0, 12)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, r string, p string")
    rated = metrics.text_error_rates(df, "r", "p")
    assert "Python" not in rated._jdf.queryExecution().executedPlan().toString()
    got = rated.select("i", F.col("raw_cer").alias("cer"), F.col("raw_wer").alias("wer")).collect()
    assert len(got) == len(pairs)

    def rate(a, b):
        return (0.0 if not b else 1.0) if not a else distance(a, b) / len(a)

    for row in got:
        a, b = pairs[row["i"]]
        assert row["cer"] == pytest.approx(rate(a, b))
        assert row["wer"] == pytest.approx(rate(a.split(), b.split()))


def test_unit_sum_is_order_free_and_exact(spark):
    rng = random.Random(3)
    values = [rng.random() ** 3 for _ in range(5000)] + [0.0, 1.0, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    sums = set()
    for parts in (1, 3, 7):
        high, low = numbers.unit_sum_parts(F.col("v"))
        row = df.repartition(parts).agg(high.alias("h"), low.alias("l")).select(numbers.unit_sum(F.col("h"), F.col("l")).alias("s")).first()
        sums.add(row["s"])
    assert len(sums) == 1 and sums.pop() == pytest.approx(math.fsum(values), abs=1e-12)


def test_dimensions_and_formats(spark):
    df = spark.createDataFrame([(4096, 2048), (100, 50), (3000, 1), (2049, 2047)], "width int, height int")
    got = [tuple(r)[2:] for r in item_ops.fit_dimensions(df).collect()]
    assert got == [(2048, 1024, True), (100, 50, False), (2048, 1, True), (2048, 2046, True)]
    names = ["a.PNG", "a", ".png", "a.", "dir/b.tar.gz", "x..jpg"]
    assert column(spark, names, item_ops.extension_of) == [".png", "", "", "", ".gz", ".jpg"]


def test_ids(spark):
    import hashlib

    def sha(*parts):
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()

    df = spark.range(1)
    row = df.select(
        ids.ocr_evidence_id(F.lit("img"), F.lit(3), F.lit("متن")).alias("o"),
        ids.visual_evidence_id(F.lit("img"), F.lit("scene"), F.lit("park"), F.lit("park")).alias("v"),
        ids.insight_key(F.lit("activity"), F.lit("activity"), F.lit("run")).alias("k"),
        ids.near_duplicate_group_name(F.lit(sha("phase6-near-duplicate-v1", "a", "b", ""))).alias("g"),
        ids.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("j")).first()
    assert row["o"] == "ocr-" + sha("phase4-ocr-evidence-v1", "img", "3", "متن")[:24]
    assert row["v"] == "vision-" + sha("phase5-visual-evidence-v1", "img", "scene", "park", "park")[:24]
    assert row["k"] == "activity_" + sha("activity", "run")[:16]
    assert row["g"] == "near-duplicate-" + sha("phase6-near-duplicate-v1", "a", "b", "")[:24]
    assert row["j"] == '{"a":null,"b":1}'


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(f"s{i}", i) for i in range(50)]
    a = spark.createDataFrame(rows, "k string, v int")
    b = spark.createDataFrame(rows[::-1], "k string, v int").repartition(3)
    c = spark.createDataFrame(rows[:-1] + [("s49", 0)], "k string, v int")
    f = [ids.fingerprint(x, ["k", "v"]).first()["fingerprint"] for x in (a, b, c)]
    assert f[0] == f[1] != f[2]


def test_rule_predicates(spark):
    paths = {"a/b.png": True, "/a": False, "a/../b": False, "a\\b": False, "": False, " a": False, "a/./b": True, ".": False}
    assert column(spark, list(paths), rules.safe_relative_path) == list(paths.values())
    docs = {'{"a":1}': True, '{"a":NaN}': False, '{"a":"NaN"}': True, '{"a":"x\\"NaN"}': True, "{": False, "[1,2]": True}
    assert column(spark, list(docs), lambda c: F.coalesce(rules.json_compatible(c), F.lit(False))) == list(docs.values())
    fields = {'{"a":1,"b":2}': True, '{"a":1}': False, '{"a":1,"b":2,"c":3}': False}
    assert column(spark, list(fields), lambda c: rules.closed_fields(c, ("a", "b"))) == list(fields.values())
    long = '{"a":"' + "x\\n" * 50_000 + '","b":1}'
    assert column(spark, [long], rules.json_compatible) == [True]
