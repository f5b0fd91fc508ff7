"""Divergence audit, SuperMinHash classes and turn repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from witnessgrid.llm import divergence, stars, super_minhash, turn_repair

from .conftest import passage
from .test_joins import LOWER, WORD, family

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


# -- divergence ----------------------------------------------------------------------------

def audit(rows, min_docs, top):
    seen, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        seen[lang or ""].update(found.keys())
        counts[lang or "", source or ""].update(found)
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        whole = sum((c for (other, _), c in counts.items() if other == lang), Counter())

        def weight(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)
        pairs = [(other, sum(apart(weight(own, t), weight(c, t)) for t in kept))
                 for (group, other), c in counts.items() if group == lang and other != source]
        terms = [(t, apart(weight(own, t), weight(whole, t))) for t in kept if own[t] and weight(own, t) > weight(whole, t)]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, r) for r, (item, value) in enumerate(found, 1) if part == "pair" or r <= top]
    return sorted(out)


def test_divergence_equals_brute_force(spark, make, odd):
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in "abcé" for b in "xyzÿ" for c in "mnoŒ"] + ["Don't", "x1y", "\U0001f600é", "A_b"]
    rows = []
    for i in range(160):
        lang, source = rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "", None, "é"])
        some = rng.sample(words, 12) if lang == "fr" else words
        rows.append((i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 40))), lang, source))
    rows.append((500, "nothing kept here", "xx", "s1"))
    rows.append((501, None, "xx", "s2"))
    docs = make(*rows).unionByName(odd)
    plain = [(r["text"], r["lang"], r["source"]) for r in docs.collect()]
    for least, top in ((10, 10), (3, 2)):
        assert sorted(map(tuple, divergence.audit(docs, least, top).collect())) == audit(plain, least, top)
    assert divergence.audit(docs.limit(0)).collect() == []


def test_divergence_tiles_and_flushes(spark, make, monkeypatch):
    rows = [(i, passage(i, 80), "en", f"s{i % 7}") for i in range(60)]
    want = audit([(r[1], r[2], r[3]) for r in rows], 5, 10)
    monkeypatch.setattr(divergence, "_TILE_ROWS", 50)
    monkeypatch.setattr(divergence, "_ENTRIES", 100)
    assert sorted(map(tuple, divergence.audit(make(*rows).repartition(3), 5, 10).collect())) == want


def test_weights_of_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(10**13, 10**15, 10**7), (0, 10**15, 10**7)], "n long, total long, terms long")
    got = [r[0] for r in rows.select(divergence.weight("n", "total", "terms")).collect()]
    assert got == [1 + 10**9 * (n + 2) // (t + 2 * v) for n, t, v in ((10**13, 10**15, 10**7), (0, 10**15, 10**7))]


def test_skyband_equals_brute_force():
    rng = np.random.default_rng(3)
    for n, span in ((0, 5), (1, 5), (40, 4), (1500, 30), (1500, 10**6)):
        high, low, name = rng.integers(0, span, n), rng.integers(0, span, n), rng.permutation(n)
        want = [i for i in range(n) if ((high >= high[i]) & (low <= low[i]) & (name <= name[i])).sum() - 1 < 10]
        assert sorted(divergence.skyband(high, low, name, 10).tolist()) == want


# -- SuperMinHash --------------------------------------------------------------------------

def pair_set(text, size=2):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def classes(rows, percent=80):
    sets = [pair_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for size in (1, 3, 40, 300, 20000):
        base = rng.integers(1, 2**63, size, dtype=np.uint64)
        other = np.concatenate([base[:size - size // 5], rng.integers(1, 2**63, size // 5, dtype=np.uint64)])
        a, b, again = super_minhash.signatures([np.sort(base), np.sort(other), np.sort(base)[::-1]])
        assert (a == again).all() and (a != super_minhash._OPEN).all()
        exact = (size - size // 5) / (size + size // 5)
        assert abs((a == b).mean() - exact) < 0.12
        assert len(np.unique(a)) >= min(size, 150)  # ranks of one element differ, so no slot repeats an offer


def test_super_minhash_equals_brute_force(spark, make, odd, monkeypatch):
    texts = [t for seed, (n, words, changed) in enumerate(
        [(25, 40, 3), (12, 200, 12), (6, 1500, 60), (15, 8, 1), (10, 5, 1), (8, 2, 1), (30, 60, 5)]) for t in family(seed, n, words, changed)]
    shared = passage(9, 55)
    texts += [shared + " " + t for t in (next(family(100 + k, 1, 60, 0)) for k in range(40))]
    at = " ".join(f"q{i}" for i in range(91))  # 90 shingles
    texts += [at, at.replace("q90", "r " * 9 + "r"), " ".join(at.split()[:73]), " ".join(at.split()[:72])]
    rows = [((i * 3) % 1009, t) for i, t in enumerate(texts)]
    docs = make(*rows).unionByName(odd).unionByName(make((None, passage(3) + " more"), (None, texts[0]), (5, passage(2)), (1008, texts[3])))
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]

    def got():
        return sorted(((r[0], r[1], r[2], bool(r[3])) for r in super_minhash.near_duplicates(docs).collect()), key=str)
    want = [(i, n, c, k) for i, n, c, k in classes(plain)]
    assert got() == want
    monkeypatch.setattr(stars, "STARS", 0)  # every pair of a band outside its largest class
    assert got() == want
    assert super_minhash.near_duplicates(odd.limit(0)).collect() == []


# -- turn repair ---------------------------------------------------------------------------

def cheapest(codes, start=0, goals=(0, 3)):
    """All edits by dynamic programming from the end; at most two inserts in a row can be of use."""
    rows = [(codes[i], codes[i + 1]) for i in range(0, len(codes), 2)]
    best = {(len(rows), s): (0, "") if s in goals else None for s in range(4)}

    def better(*ways):
        ways = [w for w in ways if w is not None]
        return min(ways) if ways else None

    def with_inserts(at):
        for _ in range(2):
            old = dict(best)
            for s in range(4):
                to = old[at, turn_repair._FREE[s]]
                best[at, s] = better(old[at, s], to and (to[0] + 3, "I" + to[1]))
    with_inserts(len(rows))
    for at in range(len(rows) - 1, -1, -1):
        role, fault = rows[at]
        for s in range(4):
            cut = 3 * (fault == "t")
            ways = [(best[at + 1, s], 4, "D")]
            if fault in "kt":
                ways.append((best[at + 1, {0: 2, 1: 2, 2: 3, 3: 2}[s]], 3 + cut, "R"))
                to = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}[role].get(s)
                if to is not None:
                    ways.append((best[at + 1, to], cut, "K"))
            best[at, s] = better(*[w and (w[0] + price, initial + w[1]) for w, price, initial in ways])
        with_inserts(at)
    return best[0, start]


def test_search_equals_dynamic_programming():
    rng = random.Random(2)
    for n in itertools.chain(range(7), [30, 200]):
        for _ in range(150 if n < 30 else 12):
            codes = "".join(rng.choice("suuaax") + rng.choice("kkkktbd") for _ in range(n))
            for start, goals in ((0, (0, 3)), (0, (0,)), (1, (3,)), (2, (2,)), (3, (1,)), (1, (1,))):
                assert turn_repair.cheapest(codes, start, goals) == cheapest(codes, start, goals)


def repaired(rows):
    """The contract by its words: rows (conv_id, turn, role, text) to results by conv_id."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        some = convs[conv]
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        some += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, counts = set(), "", Counter()
        for _, role, text in some:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "b" if not last else "d" if (role, text) in seen else "k" if last[-1] in ".!?" else "t"
            seen.add((role, text))
            counts[fault] += 1
            codes += (role[:1] if role[:1] in tuple("sua") else "x") + fault
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:]))
        cost, edits = cheapest(codes)
        length = sum(e != "D" for e in edits)
        lines, queue = [], iter(some)
        for e in edits:
            row = next(queue) if e != "I" else None
            if e != "D":
                role = row[1] if e == "K" else ("user", "assistant")[(len(lines) + length) % 2]
                lines.append(f"{role}:{row[2] if row else ''}")
        turns = [t for t, _, _ in some if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_repair_equals_the_contract(spark):
    rng = random.Random(8)
    rows = []
    for conv in [*range(40), None]:
        for turn in [*range(rng.randint(1, 9)), *rng.choice([[], [None], [None, 3], [40]])]:
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "assistant", "tool", "", None, "User"]),
                         rng.choice(["Yes.", "No", "No", "What?\n ", " \t\v", "", None, passage(turn or 0, 5) + "!", "é…"])))
    rows += [(77, 0, "user", "A."), (78, None, "user", "only.")]
    rows += [(79, t, ("user", "assistant")[t % 2], passage(t, 2000) + ".") for t in range(60)] + [(79, 5, "user", "again."), (79, 5, "user", "again.")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(
        {"place": F.lit("x"), "code": F.lit(1), "at": F.lit(2), "fault": F.lit("y"), "conv": F.lit(None).cast("int")})
    want = repaired(rows)
    for block_rows in (turn_repair.BLOCK, 3, 1):
        got = turn_repair.repair(turn_repair.damaged(frame), frame, block_rows).collect()
        assert len(got) == len(want) and {r[0]: tuple(r)[1:] for r in got} == want
    assert turn_repair.repair(turn_repair.damaged(frame.limit(0)), frame.limit(0)).collect() == []


def test_repair_of_a_conversation_of_many_blocks(spark):
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice(["Yes.", f"No {t}", f"{t}?", ""])) for t in range(4000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (got,) = turn_repair.repair(turn_repair.damaged(frame), frame, 500).collect()
    assert tuple(got)[1:] == repaired(rows)[1]
