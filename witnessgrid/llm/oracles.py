"""DuckDB SQL for the queries that SQL can express."""

_WORDS = """w AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]
      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)"""

_LOWER_WORDS = "[x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws"
_SHINGLES = """unnest(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i+4], ' ') FOR i IN range(1, len(ws) - 3)]
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh"""

OP2 = f"""WITH d AS (SELECT DISTINCT doc_id, text, {_SHINGLES} FROM (SELECT doc_id, text, {_LOWER_WORDS} FROM documents)),
b AS (SELECT DISTINCT item_id, {_SHINGLES} FROM (SELECT item_id, {_LOWER_WORDS} FROM benchmark)),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, n.n::INTEGER AS item_shingles, count(*)::INTEGER AS shared, count(*)::DOUBLE / n.n AS containment
FROM d JOIN b USING (sh) JOIN n USING (item_id) GROUP BY d.doc_id, d.text, b.item_id, n.n HAVING count(*) * 100 >= 75 * n.n"""

OP9 = f"""WITH RECURSIVE {_WORDS},
p AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.seen) AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.node = w.doc_id GROUP BY ALL"""

OP11 = """WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, source, row_id, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT row_id) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n::HUGEINT AS lang_n
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source)::HUGEINT AS total FROM a),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (total + 2 * terms) AS p,
    1 + (1000000000 * (lang_n + 2)) // (lang_total::HUGEINT + 2 * terms) AS q FROM s JOIN v USING (lang)),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
f AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
WHERE part = 'pair' OR rank <= 10"""

OP12 = OP9.replace("len(ws) >= 5", "len(ws) >= 2").replace("ws[i:i+4]", "ws[i:i+1]").replace("range(1, len(ws) - 3)", "range(1, len(ws))").replace(
    "100 * i >= 75 *", "100 * i >= 80 *").replace("min(r.seen) AS component_id", "min(r.seen) AS component_id, min(r.seen) >= any_value(w.doc_id) AS kept")


def _edit(label: str, price: str, initial: str) -> str:
    """A label (nine digits of cost, then the audit) after one more edit."""
    return f"(lpad((left({label}, 9)::INTEGER + {price})::VARCHAR, 9, '0') || substr({label}, 10) || '{initial}')"


def _inserted(source: str) -> str:
    return f"""SELECT * REPLACE (least(b, {_edit('z', '3', 'I')}, {_edit('s', '3', 'I')}, {_edit('a', '3', 'I')}) AS b,
      least(a, {_edit('b', '3', 'I')}) AS a) FROM ({source})"""


_FREE = f"CASE WHEN fault NOT IN ('b', 'd') THEN least({', '.join(_edit(x, '3 + cut', 'R') for x in 'zsa')}) END"
# z: nothing yet, s: system, b: user, a: assistant; all inserts before a row come to two at most.
_STEP = f"""SELECT conv_id, place + 1 AS place, {_edit('z', '4', 'D')} AS z,
    least({_edit('s', '4', 'D')}, CASE WHEN role = 's' AND fault NOT IN ('b', 'd') THEN {_edit('z', 'cut', 'K')} END) AS s,
    least({_edit('b', '4', 'D')}, {_FREE}, CASE WHEN role = 'u' AND fault NOT IN ('b', 'd') THEN
      least({', '.join(_edit(x, 'cut', 'K') for x in 'zsa')}) END) AS b,
    least({_edit('a', '4', 'D')}, CASE WHEN fault NOT IN ('b', 'd') THEN {_edit('b', '3 + cut', 'R')} END,
      CASE WHEN role = 'a' AND fault NOT IN ('b', 'd') THEN {_edit('b', 'cut', 'K')} END) AS a
  FROM ({_inserted(_inserted("SELECT l.*, r.role, r.fault, CASE WHEN r.fault = 't' THEN 3 ELSE 0 END AS cut FROM l JOIN coded r ON r.conv_id = l.conv_id AND r.place = l.place"))})"""

OP13 = f"""WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) t(n))),
src AS (SELECT row_number() OVER () AS row_id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT) AS k
  FROM conversations),
hit AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295::UBIGINT, k), lambda c, b: xor(tab[((xor(c, b) & 255) + 1)::BIGINT], c >> 8)),
    4294967295::UBIGINT) % 20 AS f FROM src, tab),
dam AS (SELECT row_id, conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE f <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, row_id, copy) - 1 AS place FROM dam),
coded AS (SELECT conv_id, turn, place, role AS whole, text, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS role,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 't' ELSE 'k' END AS fault FROM placed),
l AS (SELECT DISTINCT conv_id, 0::BIGINT AS place, '000000000' AS z, NULL::VARCHAR AS s, NULL::VARCHAR AS b, NULL::VARCHAR AS a FROM coded
  UNION ALL {_STEP}),
best AS (SELECT conv_id, place AS rows, least(z, a) AS label FROM ({_inserted(_inserted("SELECT l.* FROM l JOIN (SELECT conv_id, count(*) AS place FROM coded GROUP BY conv_id) USING (conv_id, place)"))})),
au AS (SELECT conv_id, left(label, 9)::BIGINT AS cost, substr(label, 10) AS audit,
    (len(label) - 9 - len(regexp_replace(substr(label, 10), '[^D]', '', 'g'))) % 2 AS odd FROM best),
fix AS (SELECT conv_id, audit, odd, 0::BIGINT AS pos, 0::BIGINT AS place, 0::BIGINT AS done, '' AS body FROM au
  UNION ALL
  SELECT fix.conv_id, audit, odd, pos + 1, fix.place + CASE WHEN audit[pos + 1] = 'I' THEN 0 ELSE 1 END,
    done + CASE WHEN audit[pos + 1] = 'D' THEN 0 ELSE 1 END,
    body || CASE WHEN audit[pos + 1] = 'D' THEN '' ELSE CASE WHEN done > 0 THEN chr(10) ELSE '' END ||
      CASE WHEN audit[pos + 1] = 'K' THEN whole ELSE CASE WHEN (done + odd) % 2 = 1 THEN 'assistant' ELSE 'user' END END || ':' ||
      CASE WHEN audit[pos + 1] = 'I' THEN '' ELSE text END END
  FROM fix LEFT JOIN coded ON coded.conv_id = fix.conv_id AND coded.place = fix.place WHERE pos < len(audit)),
hash AS (SELECT conv_id, sha256(body) AS h FROM fix WHERE pos = len(audit)),
near AS (SELECT conv_id, fault, role || lead(role) OVER (PARTITION BY conv_id ORDER BY place) AS two FROM coded),
sums AS (SELECT conv_id, sum((fault = 'b')::INT) AS blank, sum((fault = 'd')::INT) AS duplicate, sum((fault = 't')::INT) AS truncated,
    sum(CASE WHEN two NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END) AS illegal FROM near GROUP BY conv_id),
gaps AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM coded GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN gaps USING (conv_id) LEFT JOIN sums USING (conv_id)
  LEFT JOIN au USING (conv_id) LEFT JOIN hash USING (conv_id)"""

ORACLES = {
    "op2_decontamination": OP2,
    "op9_parity_join": OP9,
    "op11_divergence": OP11,
    "op12_super_minhash": OP12,
    "op13_turn_repair": OP13,
}
