"""Hot keys: the spread paths must give what the plain ones give."""

import hashlib
import os
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from witnessgrid.operators import digests, graph, metrics, runs, semantic, skew
from witnessgrid.session import stash


def test_lookup_hot_and_cold(spark):
    big = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 17}", i) for i in range(600)] + [("none", 1000)], "k string, i int")
    table = big.filter("k <> 'none'").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top"))
    want = sorted(tuple(r) for r in big.join(table, "k", "left").collect())
    for hot_rows in (1, 50, 10_000):
        got = skew.lookup(big, table, ["k"], "n", hot_rows, spread_by=["i"])
        assert sorted(tuple(r) for r in got.select("k", "i", "n", "top").collect() if r["n"] is not None) == [w for w in want if w[2] is not None]
        assert got.count() == big.count()
        assert skew.lookup(big, table, ["k"], "n", hot_rows, how="inner").count() == 600


def test_lookup_spreads_hot_rows(spark):
    big = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("i"))
    table = spark.createDataFrame([("hot", 20_000)], "k string, n bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = skew.lookup(big, table, ["k"], "n", 100, spread_by=["i"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 4 and max(sizes) < 8_000


def test_rank_with_splitters_equals_window(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.7 else f"g{rng.randint(0, 4)}", round(rng.random(), 1), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, i int")
    order = [-F.col("s"), F.col("i")]
    want = {(r["g"], r["i"]): r["rank"] for r in skew.rank_within(df, ["g"], order).collect()}
    got = {(r["g"], r["i"]): r["rank"] for r in skew.rank_within(df, ["g"], order, hot_rows=100).collect()}
    assert got == want
    index = skew.dense_index(df, [F.col("i")], hot_rows=100)
    assert index.filter(F.col("row_index") != F.col("i")).count() == 0


def test_percentiles_hot_and_cold(spark):
    df = spark.createDataFrame([("w", float(v), i) for i, v in enumerate([30, 10, 20, 20, 50, 70, 10])] + [("x", 5.0, 0)], "w string, v double, i int")
    points = {"a": (0.5, "linear"), "b": (0.95, "nearest"), "c": (0.5, "ceil"), "d": (0.9, "linear")}
    plain = runs.exact_percentiles(df, ["w"], "v", "i", points).orderBy("w").collect()
    hot = runs.exact_percentiles(df, ["w"], "v", "i", points, hot_rows=2).orderBy("w").collect()
    assert plain == hot
    assert plain[0]["a"] == 20.0 and plain[0]["b"] == 70.0 and plain[0]["c"] == 20.0 and abs(plain[0]["d"] - 58.0) < 1e-9
    assert tuple(plain[1])[1:] == (5.0, 5.0, 5.0, 5.0)


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(n)}


def test_components_long_path_star_and_random(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 60)]
    edges += [(100, 100 + i) for i in range(1, 50)]
    edges += [(rng.randint(200, 320), rng.randint(200, 320)) for _ in range(60)]
    roots = union_find(400, edges)
    touched = {x for e in edges if e[0] != e[1] for x in e}
    df = spark.createDataFrame([("A", a, b) for a, b in edges], "analysis_id string, left long, right long")
    for hot_rows in (5, 1_000_000):
        got = {r["node"]: r["root"] for r in graph.connected_components(df, hot_rows).collect()}
        assert got == {x: roots[x] for x in touched}
    empty = graph.connected_components(df.filter("left < 0"))
    assert empty.count() == 0


def unit(rng, d):
    v = [rng.gauss(0, 1) for _ in range(d)]
    n = sum(x * x for x in v) ** 0.5
    return [x / n for x in v]


def test_near_duplicates_across_blocks(spark):
    rng = random.Random(2)
    base = [unit(rng, 6) for _ in range(40)]
    vectors = base + base[:5] * 3 + [base[0]] * 20
    rows = [("A" if i % 2 else "B", i, f"i{i}", v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "analysis_id string, ordinal long, item_id string, embedding array<float>")
    stored = {r["ordinal"]: (r["analysis_id"], r["embedding"]) for r in df.collect()}
    want = set()
    for i in stored:
        for j in stored:
            if i < j and stored[i][0] == stored[j][0] and sum(x * y for x, y in zip(stored[i][1], stored[j][1])) >= 0.8:
                want.add((i, j))
    got = {(r["left"], r["right"]) for r in semantic.similar_pairs(df, 0.8, block_rows=7).collect()}
    assert got == want
    roots = union_find(len(vectors), want)
    members = graph.near_duplicate_members(df, 0.8, block_rows=7)
    expected = {x: roots[x] for pair in want for x in pair}
    assert {r["ordinal"]: r["root"] for r in members.collect()} == expected
    groups = graph.near_duplicate_groups(members)
    named = {g["root"]: (g["group_id"], g["n_members"]) for g in groups.collect()}
    for root in set(expected.values()):
        own = sorted(x for x, r in expected.items() if r == root)
        digest = hashlib.sha256(("phase6-near-duplicate-v1\0" + "".join(f"i{x}\0" for x in own)).encode()).hexdigest()
        assert named[root] == (f"near-duplicate-{digest[:24]}", len(own))
    places = {(r["root"], r["ordinal"]): r["place"] for r in graph.placed_members(members, groups).collect()}
    assert places == {(r, x): sorted(y for y, q in expected.items() if q == r).index(x) for x, r in expected.items()}


def test_digest_of_a_group_over_many_batches(spark):
    rows = spark.range(60_000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(None)).alias("g"), F.lit("x").alias("h"), "id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("t"))
    got = {r["g"]: r["sha256"] for r in digests.sha256_of(rows, ["g", "h"], ["id"], "t", prefix="p", after="\n").collect()}
    want = {}
    for i in range(60_000):
        want.setdefault(i % 7 if i % 3 == 0 else None, hashlib.sha256(b"p")).update(f"é{i}\n".encode())
    assert got == {g: h.hexdigest() for g, h in want.items()}
    assert digests.sha256_of(rows.limit(0), ["g", "h"], ["id"], "t").collect() == []


def test_metric_cells_find_the_same_pairs_and_ship_less(spark):
    rng = random.Random(5)
    centres = [unit(rng, 8) for _ in range(12)]
    vectors = []
    for i in range(600):
        c = centres[i % 12] if i % 3 else centres[0]  # one dense cluster
        v = [x + rng.gauss(0, 0.12) for x in c]
        n = sum(x * x for x in v) ** 0.5
        vectors.append([x / n for x in v])
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(vectors)], "analysis_id string, ordinal long, embedding array<float>")
    stored = np.array([r["embedding"] for r in df.orderBy("ordinal").collect()], "float64")
    for threshold in (0.95, 0.6, -0.2):
        dots = stored @ stored.T
        want = {(i, j) for i, j in zip(*np.nonzero(np.triu(dots >= threshold, 1)))}
        got = [(r["left"], r["right"]) for r in semantic.similar_pairs(df, threshold, block_rows=30).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    cells = semantic.metric_cells(df, 0.95, 30)
    assert cells.filter("home").count() == 600
    shipped = semantic._block_pairs(cells, 30).count()
    assert shipped < 600 * (600 / 30) / 2  # every vector once per block would be 12,000


def test_vectors_that_reach_most_cells_are_sent_once_for_each_block(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([("A", i, unit(rng, 24)) for i in range(600)], "analysis_id string, ordinal long, embedding array<float>")
    stored = np.array([r["embedding"] for r in df.orderBy("ordinal").collect()], "float64")
    cells = semantic.metric_cells(df, 0.4, 60)
    assert cells.count() == 600  # cells would hold each vector about ten times
    assert semantic._block_pairs(cells, 60).count() <= 600 * 10
    got = {(r["left"], r["right"]) for r in semantic.similar_pairs(df, 0.4, 60).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(np.triu(stored @ stored.T >= 0.4, 1)))}
    rows = semantic.block_size(spark.range(500_000).select(F.lit("A").alias("analysis_id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("embedding")))
    assert rows * 64 * 4 == semantic.BLOCK_BYTES


def test_pairs_of_blocks_leave_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(semantic, "STRIP_ROWS", 7)
    monkeypatch.setattr(semantic, "SENT_ROWS", 50)
    rng = random.Random(8)
    rows = [("A", 1, o, unit(rng, 3), own, 0, 1) for o, own in [(i, i % 2) for i in range(60)]]
    group = pd.DataFrame(rows, columns=["analysis_id", "cell", "ordinal", "embedding", "_own", "bi", "bj"])
    x = np.stack(group["embedding"].to_numpy())
    for bj in (0, 1):
        part = group.assign(bj=bj)[(group["_own"] == 0) | (bj == 1)]
        want = {(i, j) for i in range(60) for j in range(i + 1, 60) if x[i] @ x[j] >= 0.1 and (i % 2 == j % 2 == 0 if bj == 0 else i % 2 != j % 2)}
        frames = list(semantic._compare(0.1, False)(iter([part[:20], part[20:]])))
        assert {(r.left, r.right) for f in frames for r in f.itertuples()} == want and len(want) > 200 and max(map(len, frames)) <= 50
        edges = [(r.left, r.right) for f in semantic._compare(0.1, True)(iter([part])) for r in f.itertuples()]
        assert len(edges) <= len(part) and groups_of(edges) == groups_of(want)


def test_rounds_of_contraction_leave_one_table(spark, monkeypatch):
    kept = []

    def noted(df):
        kept.append(stash(df))
        return kept[-1]
    monkeypatch.setattr(graph, "stash", noted)
    edges = spark.createDataFrame([("A", i, i + 1) for i in range(40)], "analysis_id string, left long, right long")
    assert {(r["node"], r["root"]) for r in graph.connected_components(edges).collect()} == {(i, 0) for i in range(41)}
    assert len(kept) > 2 and [os.path.exists(df._stash_path.removeprefix("file:")) for df in kept] == [False] * (len(kept) - 1) + [True]


def groups_of(pairs):
    groups = []
    for a, b in pairs:
        touched = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in touched] + [set().union({a, b}, *touched)]
    return sorted(map(sorted, groups))


def test_query_scores_with_hot_query(spark):
    ranked = spark.createDataFrame([("q", f"i{i}", i + 1) for i in range(30)] + [("z", "i0", 1)], "query string, item_id string, rank int")
    relevant = spark.createDataFrame([("q", f"i{i}") for i in range(0, 30, 3)], "query string, item_id string")
    plain = sorted(tuple(r) for r in metrics.query_scores(ranked, relevant, 5).collect())
    assert plain == sorted(tuple(r) for r in metrics.query_scores(ranked, relevant, 5, hot_rows=3).collect())
    assert plain[0][1:3] == (10, 0.2) and plain[1] == ("z", 0, 0.0, 0.0)
