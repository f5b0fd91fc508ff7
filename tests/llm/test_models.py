"""Language ID, quality and toxicity: held-out accuracy and odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from witnessgrid.llm import language_id, quality, toxicity

SYLLABLES = {"en": ["the", "ing", "and", "on"], "fr": ["eau", "que", "é", "ou"], "de": ["sch", "ung", "ei", "er"]}


def text(lang, seed, words=30):
    rng = np.random.default_rng(zlib.crc32(f"{lang}{seed}".encode()))
    parts = SYLLABLES[lang]
    return " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(words))


def part(doc_id, n):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def test_id_part(spark):
    rows = spark.createDataFrame([(i,) for i in (None, 0, 7, -5, 10**12)], "doc_id long")
    assert [tuple(r) for r in rows.select("doc_id", language_id.id_part(F.col("doc_id"), 5)).collect()] == [(r[0], part(r[0], 5)) for r in rows.collect()]


def test_language_id(spark, make, odd):
    rows = [(i, text(lang, i), lang) for i, lang in enumerate(["en", "fr", "de"] * 40)]
    docs = make(*rows).unionByName(odd.filter("doc_id < 4 OR doc_id IS NULL"))
    held = language_id.id_part(F.col("doc_id"), 3) == 1
    model = language_id.fit(docs.filter(~held))
    found = [r for r in language_id.predict(docs, model, ["doc_id", "lang"]).collect()]
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    right = [r["lang_pred"] == r["lang"] for r in found if r["doc_id"] is not None and r["doc_id"] >= 4]
    assert np.mean(right) > 0.97
    assert [r["lang_pred"] for r in found if r["lang_pred"] == "und"].count("und") == 4
    nothing = language_id.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing, []).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), model, ["doc_id"]).collect() == []


def classes(spark, make, column, bad):
    rows, labels = [], []
    for i in range(300):
        wrong = i % 4 == 0
        rows.append((i, bad(text("en", i, 60), i) if wrong else text("en", i, 60)))
        labels.append((i, int(wrong) if column == "toxic" else int(not wrong), i % 2, "x"))
    labels += [(None, 1, 1, "x"), (777, 1, 1, "x"), (5, None, 1, "x")]
    other = "quality" if column == "toxic" else "toxic"
    return make(*rows), spark.createDataFrame(labels, f"doc_id long, {column} int, {other} int, text string")


def check(found, column):
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 30 and all(0 <= r["score"] <= 1 for r in found)
    bad = 1 if column == "toxic" else 0
    return np.mean([r["predicted"] == (bad if r["doc_id"] % 4 == 0 else 1 - bad) for r in held])


def test_toxicity(spark, make, odd):
    docs, labels = classes(spark, make, "toxic", lambda t, i: t.replace(" ", " vile ", 2) + f" vile{i % 3} end")
    both = docs.unionByName(odd.filter("doc_id IS NULL OR doc_id > 300 OR doc_id < 4"))
    found = toxicity.classify(both, labels).collect()
    assert len(found) == both.count() and check(found, "toxic") > 0.97
    for some, share in ((labels.filter("toxic = 0"), 0.0), (labels.filter("toxic = 1"), 1.0), (labels.limit(0), 0.0)):
        assert {r["score"] for r in toxicity.classify(docs, some).collect()} == {share}
    assert toxicity.classify(docs.limit(0), labels).collect() == []


def test_toxicity_slices_add_up(spark, make, monkeypatch):
    docs, labels = classes(spark, make, "toxic", lambda t, i: t + " vile words here")
    whole = sorted(map(tuple, toxicity.classify(docs, labels).select("doc_id", F.round("score", 9)).collect()))
    monkeypatch.setattr(toxicity, "SLICE", 2)
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 10)
    assert sorted(map(tuple, toxicity.classify(docs, labels).select("doc_id", F.round("score", 9)).collect())) == whole


def test_toxicity_counts_every_context_and_keeps_frequent_pairs(spark):
    rows = [(i, 1, " ".join(f"w{'abcdefghij'[k]}{''.join(chr(97 + int(c)) for c in str(i))} red door" for k in range(4))) for i in range(80)]
    rows += [(1000 + i, 0, f"{text('en', 9000 + i, 9)} red {text('en', 5000 + i, 9)} door {text('en', 7000 + i, 9)}") for i in range(320)]
    counts = toxicity.count_pairs(spark.createDataFrame(rows * 2, "doc_id long, toxic int, text string"))
    key = int(toxicity._pairs(*toxicity._words(np.frombuffer(b"red door", np.uint8), np.array([0, 8])))[1].view(np.int64))
    # The context of a pair is the word before its first word.
    before = {t.split()[k - 2] for _, bad, t in rows if bad for k, w in enumerate(t.split()) if w == "door"}
    assert len(before) > 89 and [tuple(r) for r in counts.filter(F.col("pair") == key).collect()] == [(key, len(before), 0)]
    assert toxicity.weights(counts)[1].filter(F.col("key") == key).first()["weight"] > 1


def test_toxicity_learns_from_all_but_a_bounded_sample(spark, make, monkeypatch):
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 40)
    varied = lambda i: " ".join("".join(w) for w in np.random.default_rng(i).choice(list("abcdefghij"), (40, 3)))
    learnt = [i for i in range(900) if part(i, 5)]
    # "grue" is in every toxic text whose id part is 4 and in no other labelled text.
    bad = {i: " grue " if part(i, 5) == 4 else " vile " for i in learnt if i % 6 == 0}
    rows = [(i, varied(i).replace(" ", bad.get(i, " "), 5)) for i in learnt]
    asked = [i for i in range(900, 2000) if part(i, 5) == 0][:30]
    rows += [(i, varied(i).replace(" ", " grue " if i % 2 else " ", 5)) for i in asked]
    labels = spark.createDataFrame([(i, int(i in bad)) for i in learnt], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.classify(make(*rows), labels).collect()}
    assert [found[i] for i in asked] == [i % 2 for i in asked]


def test_toxicity_holds_out_both_classes(spark):
    rows = spark.createDataFrame([(i, int(i % 5000 == 0)) for i in range(100_000)], "doc_id long, toxic int")
    chosen = toxicity.calibrates({True: 20, False: 99_980})
    held = {r[0]: r[1] for r in rows.filter(chosen).groupBy(F.col("toxic") > 0).count().collect()}
    assert 0 < held[True] < 20 and 9_000 < held[False] < 11_000


def test_quality(spark, make, odd):
    docs, labels = classes(spark, make, "quality", lambda t, i: (t.upper() + "!!!") if i % 8 else " ".join(["same"] * 60))
    both = docs.unionByName(odd.filter("doc_id IS NULL OR doc_id > 300 OR doc_id < 4"))
    found = quality.classify(both, labels).collect()
    assert len(found) == both.count() and check(found, "quality") > 0.97
    assert max(r["score"] for r in quality.classify(docs, labels.limit(0)).collect()) < 1e-9
    assert quality.classify(docs.limit(0), labels).collect() == []


def test_quality_tables_find_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert np.mean((model.chance(x) > 0.5) == y) > 0.95 and {(i, j) for i, j, _ in model.pairs} & {(1, 0), (0, 1)}
    assert quality.fit(x, np.ones(4000)).chance(x[:1])[0] > 0.999
