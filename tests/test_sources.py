"""Files, sinks and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from witnessgrid.catalog import source_queries
from witnessgrid.operators import aggregate, items as item_ops, json_shape, lifecycle
from witnessgrid.sources import keyed_table, readers, synthetic, writers
from witnessgrid.streaming import lifecycle_stream


def test_item_files(spark, tmp_path):
    folder = tmp_path / "A1"
    folder.mkdir()
    (folder / "x.PNG").write_bytes(bytes.fromhex("89504E470D0A1A0A00"))
    (folder / "y.jpg").write_bytes(bytes.fromhex("FFD8FFE000"))
    got = {r["item_id"]: (r["analysis_id"], r["declared_mime"], r["detected_mime"], r["size_bytes"]) for r in readers.read_items(spark, str(tmp_path)).collect()}
    assert got == {"x.PNG": ("A1", "image/png", "image/png", 9), "y.jpg": ("A1", "image/jpeg", "image/jpeg", 5)}


def test_word_tsv(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    body = ["1\t1\t0\t0\t0\t0\t0\t0\t9\t9\t-1\t", '5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t90\t"quoted', "5\t1\t1\t1\t1\t2\t45\t20\t40\t10\t101\tbad",
            "5\t1\t1\t1\t1\t3\t45\tx\t40\t10\t50\tbad", "x\t1\t1\t1\t1\t3\t45\t1\t40\t10\t50\tbad", "5\t1\t1\t1\t1\t4\t1\t1\t1\t1\t50\t  "]
    (tmp_path / "page.tsv").write_text("\n".join([head, *body]) + "\n", encoding="utf-8")
    good, bad = readers.parse_word_rows(readers.read_word_tsv(spark, str(tmp_path)))
    assert [(r["item_id"], r["text"], r["conf"]) for r in good.collect()] == [("page", '"quoted', 90.0)]
    assert sorted(r["reason"] for r in bad.collect()) == ["invalid_confidence", "invalid_level", "invalid_position"]


def test_word_files_stay_apart_and_in_order(spark, tmp_path):
    head = "level\ttext\tpage_num\tblock_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf"
    for name, words in (("a.1", 300), ("a.2", 3), ("x/a b+c", 2), ("y/a b+c", 1)):
        (tmp_path / f"{name}.tsv").parent.mkdir(exist_ok=True)
        lines = [f"5\t{name}-{i}\t1\t1\t1\t{i}\t0\t0\t1\t1\t50" for i in range(words)]
        (tmp_path / f"{name}.tsv").write_text("\r\n".join([head, *lines]), encoding="utf-8")
    for size in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = readers.read_word_tsv(spark, str(tmp_path)).orderBy("item_id", "row_no").collect()
        assert [(r["item_id"], r["text"], r["row_no"], r["word_num"]) for r in rows] == [
            (name, f"{name}-{i}", i + 1, None) for name, n in (("a.1", 300), ("a.2", 3), ("x/a b+c", 2), ("y/a b+c", 1)) for i in range(n)]
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_shape_in_one_pass(spark):
    """All levels come from one scan without a shuffle, and every fault is told at its place."""
    field = json_shape.Field
    shape = (field("", ("object",)), field("a", ("array",)), field("a[]", ("object",)), field("a[].b", values=("x", "y")), field("c", ("object", "null"), False), field("c.d", ("number",)))
    texts = ["{}", '{"a":[],"c":null}', '{"a":[{"b":"x"},{"b":"z"},{"e":1},3]}', '{"a":{},"c":{}}', '{"a":[],"c":{"d":1.5,"e.f":[]}}', "[1]", "{", None, '{"a":[],"a":[]}', "null"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, payload string")
    found = json_shape.violations(docs, "id", shape)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("payload#") > 0 and "Repartition" not in plan and "Aggregate" not in plan
    assert sorted((r["id"], r["path"], tuple(r["at"]), r["rule"]) for r in found.collect()) == [
        (0, "a", (), "missing_field"), (2, "a[]", (3,), "wrong_type"), (2, "a[].b", (1,), "not_allowed"), (2, "a[].b", (2,), "missing_field"),
        (2, "a[].e", (2,), "unknown_field"), (3, "a", (), "wrong_type"), (3, "c.d", (), "missing_field"), (4, r"c.e\.f", (), "unknown_field"),
        (5, "", (), "wrong_type"), (6, "", (), "invalid_json"), (7, "", (), "invalid_json"), (8, "", (), "invalid_json"), (9, "", (), "wrong_type")]


def test_structured_output(spark):
    ok = {"scenes": [{"label": "park", "confidence": 0.5}], "objects": [], "activities": [], "topics": [], "caption": {"text": "a park", "confidence": 0.9}}
    docs = [ok, {**ok, "caption": None}, {**ok, "extra": 1}, {**ok, "scenes": "park"}, {**ok, "scenes": [{"label": "x", "confidence": 1, "z": 0}]},
            {**ok, "caption": {"text": "x"}}, [1], {**ok, "scenes": [{"label": "x"}]}]
    df = spark.createDataFrame([("A", str(i), json.dumps(d)) for i, d in enumerate(docs)] + [("A", "blank", " ")], "analysis_id string, item_id string, content string")
    good, bad = readers.parse_structured_output(df)
    assert sorted((r["item_id"], r["kind"], r["label"]) for r in good.collect()) == [("0", "caption", "a park"), ("0", "scene", "park"), ("1", "scene", "park")]
    assert {r["item_id"]: r["reason"] for r in bad.collect()} == {
        "2": "invalid_fields", "3": "invalid_observation", "4": "invalid_observation", "5": "invalid_caption", "6": "not_a_json_object",
        "7": "invalid_observation", "blank": "empty_content"}


def test_state_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "state")
    state = spark.createDataFrame([("A", "pending", None), ("B", "in_progress", None), ("C", "completed", "{}")], "analysis_id string, status string, result_payload string")
    writers.write_state(state, path)
    assert [r["analysis_id"] for r in readers.read_state(spark, path, status="completed").collect()] == ["C"]
    one = readers.read_state(spark, path, "completed", "C")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan and "EqualTo(analysis_id,C)" in plan and "EqualTo(status,completed)" in plan
    assert one.count() == 1 and readers.read_state(spark, path, analysis_id="nobody").count() == 0

    def rows():
        return sorted((r["analysis_id"], r["status"], r["result_payload"]) for r in readers.read_state(spark, path).collect())
    schema = "analysis_id string, status string, result_payload string"
    done = [("A", "completed", '{"x":1}'), ("D", "completed", '{"y":2}'), ("E", "failed", None), ("F", "completed", None)]
    writers.write_completed(spark.createDataFrame(done, schema), path)
    # A changed its status and is there once; B and the earlier result of C stay.
    assert rows() == [("A", "completed", '{"x":1}'), ("B", "in_progress", None), ("C", "completed", "{}"), ("D", "completed", '{"y":2}')]
    writers.write_completed(spark.createDataFrame([("C", "completed", '{"z":3}')], schema), path)
    writers.delete_state(spark.createDataFrame([("A",), ("D",), ("nobody",)], "analysis_id string"), path)
    assert rows() == [("B", "in_progress", None), ("C", "completed", '{"z":3}')]
    writers.upsert_state(spark.createDataFrame([("B", "failed", None), ("G", "pending", None)], schema), path)
    assert rows() == [("B", "failed", None), ("C", "completed", '{"z":3}'), ("G", "pending", None)]


def test_keyed_table_commits(spark, tmp_path, monkeypatch):
    path, ddl = str(tmp_path / "t"), "k long, part long, v string"

    def frame(*rows):
        return spark.createDataFrame(rows, ddl)

    def rows():
        return sorted(map(tuple, keyed_table.read(spark, path).collect()))
    keyed_table.create(frame((1, 0, "a"), (1, 1, "b"), (2, 0, "c")), path, "k", 2)
    with pytest.raises(FileExistsError):
        keyed_table.create(frame((9, 0, "x")), path, "k")
    # All rows of a key go at once; a batch that was applied does nothing when it comes again.
    assert keyed_table.upsert(frame((1, 0, "new"), (3, 0, "d")), path, ("w", 1))
    assert rows() == [(1, 0, "new"), (2, 0, "c"), (3, 0, "d")]
    assert not keyed_table.delete(frame((1, 0, "")), path, ("w", 1)) and len(rows()) == 3
    assert keyed_table.insert(frame((3, 9, "no"), (4, 0, "e")), path, ("other", 1))
    assert rows() == [(1, 0, "new"), (2, 0, "c"), (3, 0, "d"), (4, 0, "e")]
    # What a writer left that broke off before its commit is passed over.
    last = keyed_table.head(spark, path)["version"]
    (tmp_path / "t" / "commits" / f".{last + 1:020d}.json-0").write_text('{"key": "k", "pla')
    assert len(rows()) == 4 and not keyed_table._create(spark, f"{path}/commits/{last:020d}.json", "{}")
    # Another writer commits between our look at the table and our commit.
    create, raced = keyed_table._create, []

    def late(spark_, name, text):
        if not raced:
            raced.append(1)
            keyed_table.upsert(frame((2, 0, "theirs"), (50, 0, "f")), path, ("w", 2))
        return create(spark_, name, text)
    monkeypatch.setattr(keyed_table, "_create", late)
    assert keyed_table.upsert(frame((1, 0, "ours"), (51, 0, "g")), path)
    monkeypatch.setattr(keyed_table, "_create", create)
    assert rows() == [(1, 0, "ours"), (2, 0, "theirs"), (3, 0, "d"), (4, 0, "e"), (50, 0, "f"), (51, 0, "g")]
    # Buckets double when they are full.
    monkeypatch.setattr(keyed_table, "BUCKET_ROWS", 1)
    assert keyed_table.delete(frame((2, 0, "")), path) and keyed_table.head(spark, path)["buckets"] == 4
    assert rows() == [(1, 0, "ours"), (3, 0, "d"), (4, 0, "e"), (50, 0, "f"), (51, 0, "g")]
    keyed_table.vacuum(spark, path)
    assert len(rows()) == 5 and keyed_table.read(spark, path, 50).collect()[0]["v"] == "f"
    keyed_table.delete(keyed_table.read(spark, path), path)
    assert rows() == []


def test_report_sink(spark, tmp_path):
    m = spark.createDataFrame([("r", "b", 0.5, 2), ("r", "a", 1.0, 3)], "report_id string, name string, value double, sample_count long")
    writers.write_report(m, str(tmp_path / "out"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ['{"name":"a","sample_count":3,"value":1.0}', '{"name":"b","sample_count":2,"value":0.5}']


def test_workload_generator(spark):
    items = synthetic.items_range(spark, 2, 3)
    e = synthetic.workload_evidence(items, 8)
    assert e.count() == 48 and e.filter("analysis_id = '1'").count() == 24
    row = e.filter("analysis_id = '0' AND id = 'ev-0002-0005'").first()
    assert (row["type"], row["label"], row["confidence"]) == ("scene", "scene_concept_001", 0.5 + 7 / 100)
    assert synthetic.workload_similarities(items).count() == 12


def test_workload_is_grouped_where_its_items_lie(spark, tmp_path):
    orders = [(n, n % 7 if n % 3 else 1) for n in range(60)] + [(5, 5), (61, None)]  # one order twice, one of no customer
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    items = spark.createDataFrame([(str(c), n, f"img-{n:04d}") for n, c in orders if c is not None], "analysis_id string, item_index long, item_id string")
    plain = [c for c in synthetic.workload_evidence(items).columns if not c.startswith("_")]
    signals = aggregate.union_signals(
        aggregate.support_signals(synthetic.workload_evidence(items).select(*plain)),
        aggregate.semantic_signals(synthetic.workload_similarities(items).drop("_text", "_key")))
    want = aggregate.theme_aggregates(aggregate.represent(aggregate.distinct_evidence(signals)), item_ops.universe(items))
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    for task_items in (10_000, 5):  # whole analyses, and analyses cut by item
        got = source_queries.workload_aggregates(spark, str(tmp_path), task_items)
        assert order(got) == order(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        exchanged = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("canonical_item_id" in line or "signal_id" in line for line in exchanged)
        for place in plan.split("ArrowEvalPython")[:-1]:  # texts only of what is broadcast
            assert "BroadcastExchange Identity" in place[place.rfind("BroadcastNestedLoopJoin"):]


SCHEMA = "analysis_id string, seq long, expected string, target string, payload string"


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = [("A", 1, None, "pending", None), ("A", 2, "pending", "in_progress", None), ("B", 1, None, "pending", None),
            ("A", 3, "in_progress", "completed", "{}"), ("B", 2, "in_progress", "failed", None), ("A", 4, "in_progress", "failed", None),
            ("B", 3, "pending", "completed", "{}")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows[:3], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(source)
    out = lifecycle_stream.transitions(stream)
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")

    def drain():
        q = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)

    drain()
    spark.createDataFrame(rows[3:], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    drain()
    got = {(r["analysis_id"], r["seq"]): r["outcome"] for r in spark.read.parquet(sink).collect()}
    want = {(r["analysis_id"], r["seq"]): r["outcome"] for r in lifecycle.fold_transitions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    last = spark.read.parquet(sink).groupBy("analysis_id").agg(F.max_by("status", "seq").alias("s")).collect()
    assert {r["analysis_id"]: r["s"] for r in last} == {"A": "completed", "B": "pending"}


def test_words_are_grouped_where_their_documents_lie(spark):
    plan = source_queries.line_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanged) == 1 and "REPARTITION_BY_NUM" in exchanged[0]
