"""How the given tables stand in for item batches, evidence, vectors and so on.

Every view exists twice: as a DataFrame and as a SQL common table expression for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import ids, text
from ..operators import aggregate, extract, items as item_ops
from ..plans import profile


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table about to be worked on row by row, by a unique key.

    Only a table read in fewer splits than there are cores (small files) is shuffled; a large
    one arrives with enough splits and passes through untouched.
    """
    df = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


# -- SQL side ------------------------------------------------------------------------------

CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTE[name] = (needs, sql)


def sql(body: str, *needs: str) -> str:
    """Prefix ``body`` with the expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in CTE[name][0]:
            visit(other)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS (\n{CTE[n][1].strip()}\n)" for n in ordered)
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {parts},\n{stripped[len('WITH RECURSIVE'):]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {parts},\n{stripped[len('WITH '):]}"
    return f"WITH {parts}\n{stripped}"


def fold_sql(expr: str) -> str:
    return f"replace(lower(nfc_normalize({expr})), 'ß', 'ss')"


def norm_sql(expr: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({expr}), '\\s+', ' ', 'g'))"


def parts_sql(source: str, keys: str, order: str, part_bytes: int) -> str:
    """Parts of the pieces in ``source`` (keys, order, text, sep, opens), cut by the rule of ``operators.parts``."""
    size = "greatest(1, strlen(text) + strlen(sep))"
    return f"""SELECT {keys}, part_no, string_agg(t, '' ORDER BY {order}) AS payload FROM (
  SELECT *, CASE WHEN coalesce(lag(opens) OVER w, false) THEN text ELSE sep || text END AS t,
         CAST((sum({size}) OVER w - {size}) // {part_bytes} AS BIGINT) AS part_no
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})) GROUP BY {keys}, part_no"""


# -- items: one per document, an analysis per source ---------------------------------------

def items(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents", "doc_id").select(
        F.col("source").alias("analysis_id"), F.col("doc_id").alias("ordinal"),
        F.col("doc_id").cast("string").alias("item_id"), "text", "lang", "n_chars",
        ids.content_hash(F.col("text")).alias("content_hash"),
    )


cte("items", """
SELECT source AS analysis_id, doc_id AS ordinal, CAST(doc_id AS VARCHAR) AS item_id, text, lang, n_chars,
       sha256(text) AS content_hash
FROM documents""")


def resolved_items(spark: SparkSession, sf: str) -> DataFrame:
    return item_ops.with_canonical(items(spark, sf))


cte("resolved", """
SELECT i.*, first_value(item_id) OVER (PARTITION BY analysis_id, content_hash ORDER BY ordinal) AS canonical_item_id,
       count(*) OVER (PARTITION BY analysis_id, content_hash) AS copies
FROM items i""", "items")

cte("universe", "SELECT analysis_id, count(*) AS item_universe_count FROM items GROUP BY analysis_id", "items")


# -- evidence: one row per non-blank line --------------------------------------------------

def blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(resolved_items(spark, sf), "canonical_item_id", (F.col("copies") > 1).alias("has_copies"))


def _lines(rows: DataFrame, *keep) -> DataFrame:
    lines = rows.select(
        "analysis_id", "item_id", *keep, "ordinal", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "raw_text"))
    confidence = F.lit(0.5) + F.pmod(F.col("ordinal") + F.col("ord"), F.lit(50)) / F.lit(100.0)
    return lines.withColumn("confidence", confidence).drop("ordinal")


cte("blocks", """
SELECT analysis_id, item_id, canonical_item_id, copies > 1 AS has_copies, lang, line_no AS ord, raw AS raw_text,
       0.5::DOUBLE + ((ordinal + line_no) % 50) / 100.0::DOUBLE AS confidence
FROM (SELECT *, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no
      FROM resolved)""", "resolved")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised-text evidence of all documents (with copy information)."""
    return _line_evidence(blocks(spark, sf), "canonical_item_id", "has_copies")


def _line_evidence(lines: DataFrame, *keep: str) -> DataFrame:
    return extract.block_evidence(
        extract.normalized_blocks(lines), F.col("lang"),
        {"provider_version": F.lit("1"), "model_id": F.lit("lines"), "config_version": F.lit("v1")}, keep=keep)


def themed_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The same evidence redacted, with its themes and the content hash of its item in place of copy
    information: documents are opened as they are read, and no text is joined."""
    return profile.themed(_line_evidence(_lines(items(spark, sf), "content_hash"), "content_hash"))


cte("evidence", f"""
SELECT analysis_id, item_id, canonical_item_id, has_copies,
       'ocr-' || substr(sha256('phase4-ocr-evidence-v1' || chr(0) || item_id || chr(0) || ord || chr(0) || raw_text), 1, 24) AS id,
       'ocr_text' AS type, 'ocr_text' AS label, {norm_sql('raw_text')} AS value, confidence, lang AS source,
       ord, raw_text
FROM blocks WHERE {norm_sql('raw_text')} <> ''""", "blocks")


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.support_signals(evidence(spark, sf))


cte("signals", f"""
SELECT DISTINCT analysis_id, id AS signal_id, item_id AS original_item_id, canonical_item_id, has_copies, type AS kind,
       {fold_sql('value')} AS key, value AS label, source, confidence
FROM evidence""", "evidence")


def retained(spark: SparkSession, sf: str, themed: DataFrame | None = None) -> DataFrame:
    """Retained signals; of :func:`themed_evidence` those of themes that may become insights."""
    if themed is None:
        return profile.retained_signals(evidence(spark, sf))
    batch = items(spark, sf)
    wide = item_ops.with_canonical(batch, rows=profile.wide_evidence(themed, item_ops.universe(batch)))
    return profile.retained_signals(wide.withColumn("has_copies", F.col("copies") > 1))


cte("retained", """
SELECT * EXCLUDE (rep) FROM (
  SELECT s.*, coalesce(min(CASE WHEN original_item_id = canonical_item_id THEN original_item_id END) OVER w,
                       min(original_item_id) OVER w) AS rep
  FROM signals s WINDOW w AS (PARTITION BY analysis_id, canonical_item_id, kind, key, source))
WHERE original_item_id = rep""", "signals")


def aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.theme_aggregates(retained(spark, sf), item_ops.universe(items(spark, sf)))


AGGREGATES_SQL = """
SELECT g.*, u.item_universe_count, g.unique_item_count / u.item_universe_count::DOUBLE AS item_coverage
FROM (SELECT analysis_id, kind, key, min(label) AS label, sum(n)::BIGINT AS evidence_count, count(*) AS unique_item_count,
             CAST(sum(sc) AS DOUBLE) / nullif(sum(nc), 0) AS average_confidence, max(mx) AS max_confidence,
             min(n) / max(n)::DOUBLE AS cross_item_consistency
      FROM (SELECT analysis_id, kind, key, canonical_item_id, count(*) AS n, count(confidence) AS nc,
                   sum(CAST(confidence AS DECIMAL(28, 15))) AS sc, max(confidence) AS mx, min(label) AS label
            FROM {signals} GROUP BY ALL) GROUP BY ALL) g
JOIN {universe} u USING (analysis_id)"""

cte("theme_core", AGGREGATES_SQL.format(signals="retained", universe="universe"), "retained", "universe")
cte("theme_sources", """
SELECT analysis_id, kind, key, count(DISTINCT source) AS source_diversity, count(DISTINCT original_item_id) AS resolved_item_count,
       string_agg(DISTINCT source, ',' ORDER BY source) AS sources
FROM retained GROUP BY ALL""", "retained")
cte("aggregates", "SELECT * FROM theme_core JOIN theme_sources USING (analysis_id, kind, key)",
    "theme_core", "theme_sources")

from ..vocab import INSIGHT_RULES, SENSITIVE_KEYS, SENSITIVE_PHRASES, SUBJECT_TERMS  # noqa: E402


def values_sql(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def policy_text_sql(expr: str) -> str:
    return ("trim(regexp_replace(translate(lower(nfc_normalize(" + expr + ")), 'يك_' || chr(8204), 'یک  '), '\\s+', ' ', 'g'))")


def violates_sql(key: str | None, label: str) -> str:
    def has(expr: str, words) -> str:
        return f"regexp_matches({expr}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})([^\\p{{L}}\\p{{N}}_]|$)')"
    lt = policy_text_sql(label)
    out = f"({lt} IN ({values_sql(SENSITIVE_PHRASES)}) OR ({has(lt, SENSITIVE_PHRASES)} AND {has(lt, SUBJECT_TERMS)})"
    if key is not None:
        kt = policy_text_sql(f"lower({key})")
        out += (f" OR lower({key}) IN ({values_sql(SENSITIVE_KEYS)})"
                f" OR ({has(kt, SENSITIVE_PHRASES)} AND {has(kt, SUBJECT_TERMS)})")
    return out + ")"


cte("insight_rules", "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', '{t}', '{p}')" for k, (t, p) in INSIGHT_RULES.items()) + ") r(kind, type, prefix)")

CANDIDATES_SQL = """
SELECT a.*, r.type, r.type || '_' || substr(sha256(a.kind || chr(0) || a.key), 1, 16) AS insight_key,
       r.prefix || ': ' || a.label AS insight_label,
       least(1.0, greatest(0.0, (average_confidence + item_coverage + cross_item_consistency
                                 + least(1.0, source_diversity / 2.0)) / 4.0)) AS confidence
FROM {aggregates} a JOIN insight_rules r USING (kind)
WHERE evidence_count >= 2 AND unique_item_count >= 2 AND item_coverage >= 0.10 AND source_diversity >= 1
  AND average_confidence IS NOT NULL AND NOT """ + violates_sql("a.key", "a.label")

cte("candidates", CANDIDATES_SQL.replace("{aggregates}", "aggregates"), "aggregates", "insight_rules")
cte("insights", """
SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY round(confidence, 12) DESC, item_coverage DESC,
    unique_item_count DESC, evidence_count DESC, source_diversity DESC, cross_item_consistency DESC, type, key, insight_label) AS rank
FROM candidates WHERE resolved_item_count = unique_item_count""", "candidates")


# -- vectors: the embeddings table as one analysis; candidate labels are normalised centroids --

VECTOR_ANALYSIS = "embeddings"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.lit(VECTOR_ANALYSIS).alias("analysis_id"), F.col("vec_id").alias("ordinal"),
        F.col("vec_id").cast("string").alias("item_id"), "embedding", F.col("label").alias("truth"))


def label_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """L2-normalised sum of the vectors of each label, dimension by dimension."""
    dims = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    sums = dims.groupBy("label", "d").agg(F.sum(F.col("x").cast("decimal(28,12)")).cast("double").alias("s"))
    lists = sums.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "s"))), lambda p: p["s"]).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return lists.select(
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("label"),
        F.transform("v", lambda x: x / length).alias("embedding"))


cte("label_vectors", """
SELECT 'label_' || label AS label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS embedding FROM (
  SELECT label, list(s ORDER BY d) AS v FROM (
    SELECT label, d, CAST(sum(CAST(x AS DECIMAL(28, 12))) AS DOUBLE) AS s
    FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings) GROUP BY ALL)
  GROUP BY label)""")
cte("similarities", """
SELECT CAST(vec_id AS VARCHAR) AS item_id, e.label AS truth, l.label,
       least(1.0, greatest(-1.0, list_dot_product(e.embedding::DOUBLE[], l.embedding))) AS similarity
FROM embeddings e, label_vectors l""", "label_vectors")


def similarities(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import semantic

    return semantic.score_labels(vectors(spark, sf), label_vectors(spark, sf))


# -- evaluation: documents as samples, labels as truth, simple rules on the text as predictions --

_SLICE_OF_LANG = {"en": "english_heavy", "fr": "mixed_persian_english", "de": "persian_heavy", "es": "screenshot"}


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth document is TRAIN; a document has text truth unless its id is a multiple of 3."""
    d = table(spark, sf, "documents")
    lang_slice = F.create_map(*[F.lit(v) for kv in _SLICE_OF_LANG.items() for v in kv])[F.col("lang")]
    slices = F.array_compact(F.array(
        lang_slice, F.when(F.col("n_chars") > 2000, "text_heavy"), F.when(F.col("n_chars") <= 300, "low_quality")))
    sid = F.col("doc_id").cast("string")
    return d.select(
        F.lit("docs").alias("dataset_id"), F.lit("1.0.0").alias("dataset_version"),
        F.concat(F.lit("doc-"), sid).alias("sample_id"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, "train").otherwise("eval").alias("split"), slices.alias("slices"),
        F.concat(F.lit("item-"), sid).alias("item_id"), F.concat("source", F.lit("/"), sid, F.lit(".txt")).alias("relative_path"),
        ids.content_hash(F.col("text")).alias("content_hash"),
        F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("text")).alias("ocr_text"), "doc_id", "lang", "n_chars")


cte("samples", """
SELECT 'docs' AS dataset_id, '1.0.0' AS dataset_version, 'doc-' || doc_id AS sample_id,
       CASE WHEN doc_id % 4 = 0 THEN 'train' ELSE 'eval' END AS split,
       list_filter([CASE lang WHEN 'en' THEN 'english_heavy' WHEN 'fr' THEN 'mixed_persian_english' WHEN 'de' THEN 'persian_heavy'
                         WHEN 'es' THEN 'screenshot' END, CASE WHEN n_chars > 2000 THEN 'text_heavy' END,
                    CASE WHEN n_chars <= 300 THEN 'low_quality' END], lambda x: x IS NOT NULL) AS slices,
       'item-' || doc_id AS item_id, source || '/' || doc_id || '.txt' AS relative_path, sha256(text) AS content_hash,
       CASE WHEN doc_id % 3 <> 0 THEN text END AS ocr_text, doc_id, lang, n_chars
FROM documents""")


def truth_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Quality as a scene, toxicity as a topic, language as an object; values are JSON."""
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    lab = lambda t, l, v: F.struct(F.lit(t).alias("type"), l.alias("label"), v.alias("value"))
    found = F.array_compact(F.array(
        lab("scene", F.concat(F.lit("quality_"), F.col("quality").cast("string")), F.lit("null")),
        F.when(F.col("toxic") == 1, lab("topic", F.lit("toxic content"), F.lit('"toxic"'))),
        lab("object", F.concat(F.lit("language "), F.col("lang")), F.concat(F.lit('"'), F.col("lang"), F.lit('"')))))
    return joined.select(
        F.lit("docs").alias("dataset_id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), F.inline(found)
    ).withColumn("label_id", F.concat_ws("-", "sample_id", "type"))


cte("truth_labels", """
SELECT 'docs' AS dataset_id, 'doc-' || l.doc_id AS sample_id, 'scene' AS type, 'quality_' || quality AS label, 'null' AS value FROM labels l JOIN documents USING (doc_id)
UNION ALL SELECT 'docs', 'doc-' || l.doc_id, 'topic', 'toxic content', '"toxic"' FROM labels l JOIN documents USING (doc_id) WHERE toxic = 1
UNION ALL SELECT 'docs', 'doc-' || l.doc_id, 'object', 'language ' || lang, '"' || lang || '"' FROM labels l JOIN documents d USING (doc_id)""")


def pred_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    conf = F.lit(0.5) + F.pmod(n, F.lit(50)) / 100.0
    lab = lambda t, l, v, c: F.struct(F.lit(t).alias("type"), l.alias("label"), v.alias("value"), c.alias("confidence"))
    found = F.array_compact(F.array(
        lab("scene", F.when(n > 800, "quality_1").otherwise("quality_0"), F.lit("null"), conf),
        F.when(F.pmod(n, F.lit(7)) == 0, lab("topic", F.lit("toxic content"), F.lit('"toxic"'), conf / 2)),
        F.when(F.pmod(n, F.lit(3)) != 0, lab("object", F.lit("language en"), F.lit('"en"'), F.lit(0.3) + F.pmod(n, F.lit(60)) / 100.0))))
    return d.select(
        F.lit("docs").alias("dataset_id"), F.lit("1.0.0").alias("dataset_version"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), F.inline(found))


cte("pred_labels", """
SELECT 'docs' AS dataset_id, '1.0.0' AS dataset_version, 'doc-' || doc_id AS sample_id, 'scene' AS type,
       CASE WHEN n_chars > 800 THEN 'quality_1' ELSE 'quality_0' END AS label, 'null' AS value, 0.5::DOUBLE + (n_chars % 50) / 100.0::DOUBLE AS confidence FROM documents
UNION ALL SELECT 'docs', '1.0.0', 'doc-' || doc_id, 'topic', 'toxic content', '"toxic"', (0.5::DOUBLE + (n_chars % 50) / 100.0::DOUBLE) / 2 FROM documents WHERE n_chars % 7 = 0
UNION ALL SELECT 'docs', '1.0.0', 'doc-' || doc_id, 'object', 'language en', '"en"', 0.3::DOUBLE + (n_chars % 60) / 100.0::DOUBLE FROM documents WHERE n_chars % 3 <> 0""")

# Only samples with truth are scored below; the others have no row in the labels table.
cte("eval_ids", "SELECT sample_id FROM samples WHERE split = 'eval' AND doc_id IN (SELECT doc_id FROM labels)", "samples")


def labelled_samples(spark: SparkSession, sf: str) -> DataFrame:
    return samples(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")


def claims(spark: SparkSession, sf: str) -> DataFrame:
    """One claim per document; some keys and labels name a protected trait on purpose."""
    d = spread_table(spark, sf, "documents", "doc_id")
    k, m = F.pmod("doc_id", F.lit(11)), F.pmod("doc_id", F.lit(7))
    key = F.when(k == 0, "person_religion").when(k == 1, "user_mental_health_note").otherwise("visible_content")
    label = (
        F.when(m == 0, F.concat(F.lit("Person religion = "), F.col("lang"))).when(m == 1, "مذهب شخص")
        .when(m == 2, "Political_Ideology").when(m == 3, F.concat(F.lit("religion-themed poster "), F.col("lang"))).otherwise(F.col("text")))
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("sample_id"), "lang", key.alias("key"), label.alias("label"))


cte("claims", """
SELECT 'doc-' || doc_id AS sample_id, lang,
       CASE doc_id % 11 WHEN 0 THEN 'person_religion' WHEN 1 THEN 'user_mental_health_note' ELSE 'visible_content' END AS key,
       CASE doc_id % 7 WHEN 0 THEN 'Person religion = ' || lang WHEN 1 THEN 'مذهب شخص' WHEN 2 THEN 'Political_Ideology'
                       WHEN 3 THEN 'religion-themed poster ' || lang ELSE text END AS label
FROM documents""")


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A turn and the next turn of its conversation, whole texts."""
    c = spread_table(spark, sf, "conversations", "conv_id")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", "role", F.col("text").alias("reference"), "prediction")


cte("text_pairs", """
SELECT a.conv_id, a.turn, a.role, a.text AS reference, b.text AS prediction
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")


# -- benchmark runs: an order is a run of the workload given by its priority ---------------

def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("workload"), key.alias("run_id"), (F.pmod(key, F.lit(50)) + 1).alias("items"),
        F.col("o_totalprice").alias("latency_ms"), (F.col("o_orderstatus") == "F").alias("failed"),
        F.concat(F.lit("reason_"), F.pmod("o_custkey", F.lit(4)).cast("string")).alias("reason"),
        (F.pmod(key, F.lit(10)) / 100.0).alias("unsupported_rate"), (F.pmod(key, F.lit(997)) != 1).alias("factual"),
        F.col("o_custkey").alias("candidate"))


cte("runs", """
SELECT o_orderpriority AS workload, o_orderkey AS run_id, o_orderkey % 50 + 1 AS items, o_totalprice AS latency_ms,
       o_orderstatus = 'F' AS failed, 'reason_' || (o_custkey % 4) AS reason, (o_orderkey % 10) / 100.0::DOUBLE AS unsupported_rate,
       o_orderkey % 997 <> 1 AS factual, o_custkey AS candidate
FROM orders""")


# -- recognised words: every space-separated word of every line ----------------------------

# Documents of one task that opens them into words.
WORD_DOCUMENTS = 1_000


def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Words as untyped TSV fields; some confidences are above 100 and get rejected.

    Documents lie by item before they are opened, so grouping the words of an item needs no other exchange."""
    d = table(spark, sf, "documents")
    tasks = max(spark.sparkContext.defaultParallelism, -(-d.count() // WORD_DOCUMENTS))
    placed = d.select(F.col("source").alias("analysis_id"), F.col("doc_id").cast("string").alias("item_id"), "text").repartition(tasks, "item_id")
    lines = placed.select(
        "analysis_id", "item_id",
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = lines.select("analysis_id", "item_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    row_no = F.col("line_no") * 100000 + F.col("word_no")
    s = lambda c: c.cast("string")
    return words.select(
        "analysis_id", "item_id", row_no.cast("bigint").alias("row_no"), F.lit("5").alias("level"), F.lit("1").alias("page_num"),
        F.lit("1").alias("block_num"), F.lit("1").alias("par_num"), s(F.col("line_no")).alias("line_num"),
        s(F.col("word_no") * 10).alias("left"), s(F.col("line_no") * 20).alias("top"), s(F.length("text") * 8).alias("width"),
        F.lit("10").alias("height"), s(F.pmod(F.length("text") * 7 + row_no, F.lit(103))).alias("conf"), "text")


cte("word_rows", """
SELECT source AS analysis_id, CAST(doc_id AS VARCHAR) AS item_id, line_no * 100000 + word_no AS row_no, line_no, word_no * 10 AS x, line_no * 20 AS y,
       length(word) * 8 AS w, 10 AS h, (length(word) * 7 + line_no * 100000 + word_no) % 103 AS conf, word AS text
FROM (SELECT source, doc_id, line_no, unnest(string_split(line, ' ')) AS word, unnest(range(len(string_split(line, ' ')))) AS word_no
      FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents))
WHERE trim(word) <> ''""")


# -- observations: an event is one finding on the item "day" of its user -------------------

_KIND_OF_EVENT = {"view": "scene", "click": "object", "purchase": "activity", "signup": "topic", "error": "caption"}


def observations(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(v) for kv in _KIND_OF_EVENT.items() for v in kv])
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("analysis_id"),
        F.concat_ws("-", F.lit("day"), F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("item_id"),
        kinds[F.col("event_type")].alias("kind"), F.concat(F.lit("Finding "), F.get_json_object("props", "$.k")).alias("label"),
        F.least(F.lit(1.0), F.col("value") / 500.0).alias("confidence"))


cte("observations", """
SELECT event_id, 'user-' || user_id AS analysis_id, 'day-' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS item_id,
       CASE event_type WHEN 'view' THEN 'scene' WHEN 'click' THEN 'object' WHEN 'purchase' THEN 'activity' WHEN 'signup' THEN 'topic' ELSE 'caption' END AS kind,
       'Finding ' || json_extract_string(props, '$.k') AS label, least(1.0, value / 500.0::DOUBLE) AS confidence
FROM events""")


# -- lifecycle requests: an event asks for a transition of the analysis "user and day" -----

def requests(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    expected = F.when(t.isin("click", "view"), "pending").when(t.isin("purchase", "error"), "in_progress")
    target = (
        F.when(t == "signup", "pending").when(t == "click", "in_progress").when(t == "purchase", "completed")
        .when(t == "error", "failed").otherwise("completed"))
    payload = F.when(t == "purchase", F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit("}")))
    return table(spark, sf, "events").select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("analysis_id"),
        F.col("event_id").alias("seq"), expected.alias("expected"), target.alias("target"), payload.alias("payload"))


cte("requests", """
SELECT user_id || '-' || strftime(ts, '%Y-%m-%d') AS analysis_id, event_id AS seq,
       CASE WHEN event_type IN ('click', 'view') THEN 'pending' WHEN event_type IN ('purchase', 'error') THEN 'in_progress' END AS expected,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'completed' END AS target,
       CASE WHEN event_type = 'purchase' THEN '{"event":' || event_id || '}' END AS payload
FROM events""")


# -- questionnaires: the line items of a customer ------------------------------------------

def responses(spark: SparkSession, sf: str) -> DataFrame:
    from ..vocab import QUESTIONNAIRE_BASIS, TRAITS

    joined = table(spark, sf, "lineitem").join(
        table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    trait = F.element_at(F.array(*[F.lit(t) for t in TRAITS]), (F.pmod("l_partkey", F.lit(5)) + 1).cast("int"))
    return joined.select(
        F.col("o_custkey").cast("string").alias("analysis_id"), F.lit("mini-scale").alias("instrument_id"), F.lit("1.0").alias("instrument_version"),
        F.lit(1.0).alias("scale_min"), F.lit(5.0).alias("scale_max"),
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("item_id"),
        trait.alias("trait"), (F.lit(1.0) + F.pmod("l_quantity", F.lit(5))).alias("response_value"),
        (F.pmod("l_suppkey", F.lit(2)) == 1).alias("reverse_scored"), F.lit(True).alias("consent_confirmed"), F.lit(QUESTIONNAIRE_BASIS).alias("basis"))


cte("responses", """
SELECT CAST(o_custkey AS VARCHAR) AS analysis_id, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS item_id,
       ['openness', 'conscientiousness', 'extraversion', 'agreeableness', 'neuroticism'][l_partkey % 5 + 1] AS trait,
       1.0::DOUBLE + l_quantity % 5 AS response_value, l_suppkey % 2 = 1 AS reverse_scored
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
cte("bad_respondents", """
SELECT analysis_id FROM responses GROUP BY analysis_id HAVING count(*) > 100 OR count(DISTINCT trait) < 5
UNION SELECT analysis_id FROM responses GROUP BY analysis_id, item_id HAVING count(*) > 1""", "responses")
cte("trait_scores", """
SELECT analysis_id, trait, round_even((m - 1) / 4, 6) AS normalized_score, round_even(m, 6) AS scored_mean, n AS item_count, ids FROM (
  SELECT analysis_id, trait, avg(CASE WHEN reverse_scored THEN 6 - response_value ELSE response_value END) AS m, count(*) AS n,
         string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM responses WHERE analysis_id NOT IN (FROM bad_respondents) GROUP BY ALL)""", "responses", "bad_respondents")
