"""Token files, mixing, tool calls, vector search and the pipeline."""

import collections
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from witnessgrid.llm import cross_polytope, elias_fano, mixing, queries, token_files, tool_calls
from witnessgrid.session import shared_path

from .conftest import passage
from .test_joins import components, shingle_set


@pytest.mark.parametrize("n,universe", [(0, 0), (1, 0), (1, 9), (700, 10**6), (300, 300), (200, 30)])
def test_elias_fano(n, universe):
    values = np.sort(np.random.default_rng(n).integers(0, universe + 1, n))
    found = elias_fano.EliasFano(elias_fano.encode(values, universe))
    assert found.all().tolist() == values.tolist() == [found.select(i) for i in range(n)]
    assert n < 100 or found.size < n * (3 + np.log2(max(1, universe / n))) / 8 + 80


def expected_tokens(rows):
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    at, out = 0, []
    for i, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [queries.END_ID], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files(spark, odd, make):
    docs = odd.unionByName(make((-3, "a<|endoftext|>B 's don't X.Y,z!!é. É'RE 12,3a_b İΣ é, ≠"), (-2, " x y\x1cz")))
    path = shared_path(spark, "tokens")
    token_files.write_corpus(docs, path, queries.tokenizer_path(), queries.END_ID, segment=300)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    got = [tuple(r) for r in token_files.read_corpus(spark, path).drop("ids").orderBy("start").collect()]
    assert got == expected_tokens(sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=order))
    token_files.write_corpus(docs.limit(0), path, queries.tokenizer_path(), queries.END_ID)
    assert token_files.read_corpus(spark, path).collect() == []


def test_pieces_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_PIECES", 8)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    encoder = token_files.PieceEncoder(tokenizer)
    for text in ("alpha beta gamma", "alpha " + " ".join(f"word{i}" for i in range(40)) + " beta", "delta alpha", "gamma word3 " * 9):
        ids, count = encoder.encode(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and count.tolist() == [len(ids)]


def test_tasks_of_a_process_share_their_pieces():
    path = queries.tokenizer_path()
    text = np.frombuffer(b"alpha, beta gamma " * 3, np.uint8)
    first = token_files.process_encoder(path)
    want = first.encode(text, np.array([0, len(text)]))
    known = len(first.known)
    again = token_files.process_encoder(path)
    got = again.encode(text, np.array([0, len(text)]))
    assert again is first and len(again.known) == known and all(np.array_equal(x, y) for x, y in zip(want, got))


def test_period_keeps_every_source_within_one_block():
    for shares in ({"a": 5, "b": 3, None: 1}, {"x": 60, **{f"s{i}": 1 for i in range(40)}}, {"only": 4}):
        total = sum(shares.values())
        seen = collections.Counter()
        for name, _, slot, release, deadline in mixing.period(shares):
            assert release <= slot < deadline
            seen[name] += 1
            assert all(abs(seen[n] - s * (slot + 1) / total) < 1 for n, s in shares.items())


def test_mixing(spark, odd, make):
    docs = odd.unionByName(make(*[(100 + i, f"text {i}", "en", f"s{i % 3 if i % 2 else 1}") for i in range(90)]))
    found = mixing.interleave(docs, block_rows=2).collect()
    assert sorted(r["position"] for r in found) == list(range(docs.count()))
    again = [r["doc_id"] for r in mixing.mixed(docs, block_rows=2).collect()]
    # A repeated row comes with the first of its kind.
    place = {}
    for r in found:
        same = r["doc_id"], r["text_key"]
        place[same] = min(place.get(same, r["position"]), r["position"])
    assert again == [r["doc_id"] for r in sorted(found, key=lambda r: place[r["doc_id"], r["text_key"]])]
    assert mixing.mixed(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.interleave(docs, {"s0": 1})


SCHEMAS = {"add": {"properties": {"a": {"type": "integer"}, "how": {"type": "string", "enum": ["x"]}}, "required": ["a"], "additionalProperties": False}}


def test_tool_calls(spark):
    def call(*calls):
        return json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "after"), c)) for c in calls]})
    turns = spark.createDataFrame([
        (1, 0, "user", "hello \"you\"\n\u0001é"), (1, 1, "assistant", call(("c2", "add", {"a": 1}, ["c1"]), ("c1", "add", '{"how":"x","a":2}', []))),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})), (1, 3, "tool", json.dumps({"tool_call_id": "zz"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "k"})), (2, 1, "assistant", call(("k", "add", {"a": True}, ["m"]), ("m", "none", {}, ["k"]))),
        (2, 1, "assistant", call(("k", "add", {"a": True}, ["m"]), ("m", "none", {}, ["k"]))),
        (3, 0, None, None), (None, None, "user", "{broken"), (None, 5, "assistant", call((None, "add", [1], None)))],
        "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    found = {(r["conv_id"], r["turn"]): r for r in tool_calls.link(turns, SCHEMAS).collect()}
    assert tool_calls.link(turns, SCHEMAS).count() == 10
    plain = found[1, 0]["json"]
    assert plain == tool_calls.canonical({"content": "hello \"you\"\n\u0001é", "role": "user"})
    calls = json.loads(found[1, 1]["json"])["calls"]
    assert [c["id"] for c in calls] == ["c1", "c2"] and [c["state"] for c in calls] == ["linked", "open"]
    assert found[1, 1]["json"] == tool_calls.canonical(json.loads(found[1, 1]["json"])) and found[1, 1]["status"] == "valid"
    assert found[1, 2]["status"] == "linked" and json.loads(found[1, 2]["json"])["name"] == "add" and found[1, 3]["status"] == "orphan"
    assert found[2, 0]["status"] == "early" and found[2, 1]["status"] == "faulty"
    assert [c["fault"] for c in json.loads(found[2, 1]["json"])["calls"]] == ["type:a", "unknown_tool"]
    assert found[3, 0]["json"] == '{"content":null,"role":null}' and found[None, None]["kind"] == "plain"
    assert json.loads(found[None, 5]["json"])["calls"][0]["state"] == "no_id"
    assert tool_calls.link(turns.limit(0), SCHEMAS).collect() == []


def plain_depths(calls):
    """Longest chain of after links by id; None in or after a cycle."""
    before = {i: [b for b in after if b in calls] for i, after in calls.items()}
    found = dict.fromkeys(calls)
    left = {i for i in calls if not any(_reaches(b, before, {b}) for b in _all_before(i, before))}
    while left:
        ready = [i for i in left if all(b not in left for b in before[i])]
        for i in ready:
            found[i] = max([found[b] + 1 for b in before[i]], default=0)
        left -= set(ready)
    return found


def _all_before(i, before):
    seen, stack = {i}, [i]
    while stack:
        for b in before[stack.pop()]:
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return seen


def _reaches(i, before, goals):
    """Is one of ``goals`` before i?"""
    return any(goals & _all_before(b, before) for b in before[i])


def test_depths_of_long_chains_merges_and_cycles(spark):
    rng = np.random.default_rng(6)
    calls = {f"k{i}": [f"k{i - 1}"] if i else [] for i in range(200)}  # a chain beyond any fixed number of rounds
    for i in range(120):
        calls[f"d{i}"] = [f"d{j}" for j in rng.integers(0, i, rng.integers(0, 3))] if i else ["k150"]
    calls |= {"c0": ["c2"], "c1": ["c0"], "c2": ["c1"], "c3": ["c2", "k3"], "c4": ["c3"], "s": ["s"], "t": ["gone", "k9"], "u": ["c4"]}
    rows = [(conv, i, after) for conv in (1, 2) for i, after in calls.items()]
    got = tool_calls.depths(spark.createDataFrame(rows, "conv_id long, id string, after array<string>")).collect()
    want = plain_depths(calls)
    assert len(got) == len(rows) and all(r["depth"] == want[r["id"]] for r in got)
    assert want["k199"] == 199 and want["c4"] is None and want["s"] is None and want["t"] == 10


def test_calls_made_of_turns(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], "x" * (37 * c + 7 * t)) for c in range(30) for t in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = tool_calls.link(tool_calls.as_calls(turns), queries.TOOL_SCHEMAS).collect()
    assert {r["status"] for r in found} == {"valid", "faulty", "linked", "orphan"} and len(found) == 600
    faults = {c["fault"] for r in found if r["kind"] == "calls" for c in json.loads(r["json"])["calls"]}
    assert {None, "unknown_tool", "type:limit", "missing:id", "enum:lang"} <= faults
    states = {c["state"] for r in found if r["kind"] == "calls" for c in json.loads(r["json"])["calls"]}
    assert states == {"linked", "open", "repeated_id"}


def test_argument_faults():
    nested = {"properties": {"at": {"type": ["object", "null"], "properties": {"x": {"type": "integer"}}, "required": ["x"]},
                             "list": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}}
    deep = tool_calls.argument_fault
    assert deep(nested, {"at": None, "list": ["a"]}) is None and deep(nested, {"at": {"x": "1"}}) == "type:at.x"
    assert deep(nested, {"at": {}}) == "missing:at.x" and deep(nested, {"at": 3}) == "type:at" and deep(nested, {"list": ["a", "c"]}) == "enum:list[1]"
    assert tool_calls._parsed('{"id":"\\ud800x"}') is None and tool_calls._parsed('{"id":"x"}') == {"id": "x"}
    check = tool_calls.argument_fault
    assert check(SCHEMAS["add"], {"a": 1}) is None and check(SCHEMAS["add"], {}) == "missing:a"
    assert check(SCHEMAS["add"], {"a": 1, "z": 0}) == "unexpected:z" and check(SCHEMAS["add"], {"a": 1, "how": "y"}) == "enum:how"


def test_search_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) * rng.choice([0.5, 1, 3], (1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[40].tolist()) for i in range(60)]
    odd = [(9000, None), (9020, []), (9040, [0.0] * 24), (9060, [float("nan")] + [1.0] * 23), (9080, [None] + [1.0] * 23), (9100, [1.0, 2.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in cross_polytope.search(table, table.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hit = total = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = m @ m[ids == q][0]
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        assert len(got[q]) == 20 and q not in dict(got[q])
        assert np.allclose([s for _, s in got[q]], [m[ids == q][0] @ m[ids == v][0] for v, _ in got[q]])
        hit, total = hit + len(set(best.tolist()) & set(dict(got[q]))), total + 20
    assert hit / total >= 0.9
    assert [v for v, _ in got[40]] == list(range(5000, 5020)) and not {9000, 9020, 9040, 9060, 9080, 9100} & set(got)
    assert cross_polytope.search(table.limit(0), table.limit(0)).collect() == []


def exact_neighbours(x, asked, most=20):
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    return np.argsort(-scores, 1)[:, :min(most, len(x) - 1)]


@pytest.mark.parametrize("n,width,whole", [(22, 64, 4096), (22, 64, 0), (3000, 256, 100)])
def test_search_of_small_tables_and_wide_vectors(spark, monkeypatch, n, width, whole):
    monkeypatch.setattr(cross_polytope, "WHOLE", whole, raising=False)
    x = np.random.default_rng(5).normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(n) % 100 == 7, 5.0, 1.01)[:, None]  # one in a hundred is long: a thin band
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = np.arange(0, n, max(1, n // 30))
    got = collections.defaultdict(set)
    for r in cross_polytope.search(table, table.filter(F.col("vec_id").isin(asked.tolist()))).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert all(len(got[q]) == 20 for q in asked.tolist())
    hits = [len(got[q] & set(best)) / 20 for q, best in zip(asked.tolist(), exact_neighbours(x, asked).tolist())]
    assert np.mean(hits) >= (1 if n == 22 and whole else 0.9)


def test_pipeline_equals_a_plain_version(spark, make, tmp_path):
    rows = [(i, passage(i % 50, 70) + f" tail {i}", ["en", "de"][i % 2], f"s{i % 4}") for i in range(0, 60)]
    rows += [(200, "12 34 !!", "en", "s0"), (201, None, "en", "s1"), (202, "front " + passage(60, 40) + " back", "de", "s2")]
    docs = make(*rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage(60, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    classes = components([(r[0], r[1]) for r in kept])
    kept = [r for r in kept if classes[r[0]][1] == r[0]]
    item = shingle_set(passage(60, 40))
    kept = [r for r in kept if 100 * len(item & shingle_set(r[1])) < 75 * len(item)]
    assert 20 < len(kept) < 60
    shares = mixing.tempered_shares(collections.Counter(r[3] for r in kept))
    slots = {(n, k): slot for n, k, slot, _, _ in mixing.period(shares)}
    rank, total, keyed = collections.Counter(), sum(shares.values()), []
    for r in sorted(kept):
        block = rank[r[3]] // 16
        rank[r[3]] += 1
        keyed.append((block // shares[r[3]] * total + slots[r[3], block % shares[r[3]]], r[0], r[1]))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == expected_tokens([k[1:] for k in sorted(keyed)])
