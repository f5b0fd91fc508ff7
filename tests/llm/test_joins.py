"""Sharding, decontamination and the parity join against plain versions."""

import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from witnessgrid.llm import decontamination, links, parity_join, sharding, stars

from .conftest import WORDS, passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows, percent=75):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def family(seed, copies, words, changed):
    """Near copies of one text with some words replaced."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) + rng.choice("abcdef") for _ in range(words)]
    for _ in range(copies):
        text = list(base)
        for _ in range(rng.randint(0, changed)):
            text[rng.randrange(words)] = rng.choice(WORDS)
        yield " ".join(text)


def test_parity_join_equals_brute_force(spark, make):
    texts = [t for seed, (n, words, changed) in enumerate(
        [(12, 30, 3), (12, 120, 6), (8, 700, 25), (6, 1500, 60), (15, 8, 1), (10, 5, 1), (10, 3, 1)]) for t in family(seed, n, words, changed)]
    shared = passage(9, 55)
    texts += [shared + " " + t for t in (next(family(100 + k, 1, 60, 0)) for k in range(40))]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    got = {r[0]: (r[1], r[2]) for r in parity_join.linked_components(make(*rows)).collect()}
    assert got == components(rows)


def test_pairs_meet_in_their_first_common_keys_only(spark):
    """Nodes that share most of their keys: every pair meets, in a few rows instead of one for each shared key."""
    rng = random.Random(4)
    held = {n: sorted(rng.sample(range(-60, 60), 80)) for n in range(40)} | {50: [70], 51: [70, 71], 52: [71, 5]}
    rows = stars._with_before(spark.createDataFrame([(k, n) for n, keys in held.items() for k in keys], "key long, node long"))
    left, right = (rows.withColumnsRenamed({"node": n, "before": f"{n}_before"}) for n in "ab")
    met = left.join(right, "key").filter("a < b AND NOT arrays_overlap(a_before, b_before)").select("a", "b").collect()
    assert {tuple(r) for r in met} == {(a, b) for a in held for b in held if a < b and set(held[a]) & set(held[b])}
    assert len(met) < 1.5 * len(set(met))


def test_parity_join_odd_rows(spark, odd):
    got = sorted(map(tuple, parity_join.linked_components(odd).collect()), key=str)
    as_rows = {r[0]: r for r in got if r[0] is not None}
    assert len(got) == 13
    assert [as_rows[i][1:] for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert as_rows[4][1:] == (1, 4) and as_rows[5][1:] == (1, 5)
    assert as_rows[7][2] == 6 and as_rows[8][2] == 8 and as_rows[10][2] == 9


def test_first_rows_of_classes_with_repeated_and_null_ids(spark, make):
    a, b, c = passage(1), passage(2), passage(3)
    rows = [(1, a), (1, b), (2, a + " end"), (2, a), (2, a), (None, b), (None, c), (None, c), (None, c.upper()), (3, None), (3, None), (4, ""), (5, passage(4)), (5, passage(4))]
    docs = make(*rows)
    left = parity_join.first_of_classes(docs)
    assert left.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in left.collect())
    upper = [k for k in got if k[0] is None]
    assert len(upper) == 1 and upper[0][1].lower() == c and got.pop(upper[0]) == 1
    assert got == collections.Counter([(1, a), (1, b), (3, None), (3, None), (4, ""), (5, passage(4))])
    assert parity_join.first_of_classes(docs.limit(0)).collect() == []


def test_parity_join_empty(spark, odd):
    assert parity_join.linked_components(odd.limit(0)).collect() == []


def test_star_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = dict(map(tuple, links.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[95] == got[90] == 90


def test_decontamination_equals_brute_force(spark, make, odd):
    items = spark.createDataFrame(
        [(1, passage(1, 40)), (2, passage(5, 30)), (3, "one TWO three"), (4, None), (5, ""), (6, passage(6, 300))], "item_id long, text string")
    inside = WORD.findall(passage(5, 30))
    docs = odd.unionByName(make(
        (20, "start " + passage(5, 30).upper() + "\n end of it"), (21, " ".join(inside[:26])), (22, " ".join(inside[:22])),
        (23, passage(7, 90)), (24, "one two three four")))
    want = set()
    sets = {r[0]: shingle_set(r[1]) for r in items.collect()}
    for i, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        for item, s in sets.items():
            both = len(s & shingle_set(text))
            if s and both * 100 >= 75 * len(s):
                want.add((i, item, len(s), both))
    got = [tuple(r) for r in decontamination.contained(docs, items).select("doc_id", "item_id", "item_shingles", "shared").collect()]
    assert set(got) == want and len(got) == len(want) and (20, 2, 26, 26) in want and (21, 2, 26, 22) in want
    kept = decontamination.clean(docs, items)
    bad = {w[0] for w in want}
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad)
    assert decontamination.contained(docs.limit(0), items).count() == 0 and decontamination.clean(docs, items.limit(0)).count() == docs.count()


def greedy(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)

    def cut(capacity):
        used, held, where = 0, 0, []
        for s in sizes:
            if held + s > capacity:
                used, held = used + 1, 0
            held += s
            where.append(used)
        return where
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if cut(mid)[-1] < shards else (mid + 1, high)
    return low, cut(low)


def test_minimax_cuts_with_few_bins(spark):
    rng = random.Random(4)
    for sizes in ([rng.randint(1, 900) for _ in range(700)], [5000, *[3] * 200], [1] * 3, [7]):
        ends, total = [], 0
        for s in sizes:
            total += s
            ends.append((total, s))
        got = sharding.minimax_cuts(spark.createDataFrame(ends, "end long, size long"), 8, bins=64)
        want, where = greedy(sizes, 8)
        assert got[0] == want
        assert [e for e, _ in ends if e in got[1]] == [e for (e, _), a, b in zip(ends, where, [*where[1:], 99]) if a != b]


def test_shards(spark, odd):
    rows = sharding.assign_shards(odd).collect()
    assert len(rows) == 13
    by_text = collections.defaultdict(set)
    text = {(r["doc_id"]): r["text"] for r in odd.collect()}
    for r in rows:
        t = text[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["size"] == len((t or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((t or "").encode())
            by_text[t].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.assign_shards(odd.limit(0)).collect() == []
