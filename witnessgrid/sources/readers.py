"""Readers with declared schemas. Parsers take a column of text, so files and tables share them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import vocab
from ..functions.text import computed, strip
from ..operators import items as item_ops, json_shape, rules
from ..operators.json_shape import Field
from ..session import stash
from . import keyed_table

# -- item bytes ----------------------------------------------------------------------------

def read_items(spark: SparkSession, path: str, analysis_id: Column | None = None) -> DataFrame:
    """Files as raw items; by default the parent folder names the analysis."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parts = F.split("path", "/")
    owner = F.element_at(parts, -2) if analysis_id is None else analysis_id
    name = F.element_at(parts, -1)
    return raw_items(files.select(
        owner.alias("analysis_id"), name.alias("item_id"), name.alias("filename"),
        item_ops.mime_of_extension(item_ops.extension_of(name)).alias("declared_mime"), "content"))


def raw_items(df: DataFrame) -> DataFrame:
    """Canonical raw item columns: lower-case declared MIME, size, format seen in the bytes."""
    return df.select(
        "analysis_id", "item_id", "filename", F.lower("declared_mime").alias("declared_mime"), "content",
        F.octet_length("content").alias("size_bytes"), item_ops.detected_mime(F.col("content")).alias("detected_mime"))


# -- evaluation manifests and predictions --------------------------------------------------

_LABEL = "struct<label_id:string,type:string,label:string,value:variant>"
_TRUTH = (
    f"struct<labels:array<{_LABEL}>,ocr_text:string,unsupported_claims:array<struct<category:string>>>")
MANIFEST_DDL = (
    "schema_version string, dataset_id string, dataset_version string, label_schema_version string, data_policy string, "
    "samples array<struct<sample_id:string,split:string,slices:array<string>,"
    f"image:struct<image_id:string,relative_path:string>,ground_truth:{_TRUTH}>>")
PREDICTION_DDL = (
    "schema_version string, dataset_id string, dataset_version string, predictions array<struct<sample_id:string,"
    "labels:array<struct<type:string,label:string,confidence:double,value:variant>>,ocr_text:string,"
    "claims:array<struct<key:string,label:string,confidence:double>>>>")


def _fields(*rows: tuple) -> tuple[Field, ...]:
    return tuple(Field(path, tuple(kinds.split("|")), need, tuple(values)) for path, kinds, need, values in rows)


# The documents' fields at every level; (path, kinds, required, allowed values).
MANIFEST_SHAPE = _fields(
    ("", "object", True, ()), ("schema_version", "string", True, ()), ("dataset_id", "string", True, ()),
    ("dataset_version", "string", True, ()), ("label_schema_version", "string", True, ()), ("data_policy", "string", True, ()),
    ("samples", "array", True, ()), ("samples[]", "object", True, ()), ("samples[].sample_id", "string", True, ()),
    ("samples[].split", "string", True, ("train", "eval")), ("samples[].slices", "array", True, ()),
    ("samples[].slices[]", "string", True, vocab.SLICES), ("samples[].image", "object", True, ()),
    ("samples[].image.image_id", "string", True, ()), ("samples[].image.relative_path", "string", True, ()),
    ("samples[].ground_truth", "object", True, ()), ("samples[].ground_truth.labels", "array", False, ()),
    ("samples[].ground_truth.labels[]", "object", True, ()), ("samples[].ground_truth.labels[].label_id", "string", True, ()),
    ("samples[].ground_truth.labels[].type", "string", True, vocab.EVAL_LABEL_TYPES),
    ("samples[].ground_truth.labels[].label", "string", True, ()), ("samples[].ground_truth.labels[].value", "any", False, ()),
    ("samples[].ground_truth.ocr_text", "string|null", False, ()), ("samples[].ground_truth.unsupported_claims", "array", False, ()),
    ("samples[].ground_truth.unsupported_claims[]", "object", True, ()),
    ("samples[].ground_truth.unsupported_claims[].category", "string", True, vocab.UNSUPPORTED_CATEGORIES))
PREDICTION_SHAPE = _fields(
    ("", "object", True, ()), ("schema_version", "string", True, ()), ("dataset_id", "string", True, ()),
    ("dataset_version", "string", True, ()), ("predictions", "array", True, ()), ("predictions[]", "object", True, ()),
    ("predictions[].sample_id", "string", True, ()), ("predictions[].labels", "array", False, ()),
    ("predictions[].labels[]", "object", True, ()), ("predictions[].labels[].type", "string", True, vocab.EVAL_LABEL_TYPES),
    ("predictions[].labels[].label", "string", True, ()), ("predictions[].labels[].confidence", "number", True, ()),
    ("predictions[].labels[].value", "any", False, ()), ("predictions[].ocr_text", "string|null", False, ()),
    ("predictions[].claims", "array", False, ()), ("predictions[].claims[]", "object", True, ()),
    ("predictions[].claims[].key", "string", True, ()), ("predictions[].claims[].label", "string", True, ()),
    ("predictions[].claims[].confidence", "number", True, ()))
REPORT_SHAPE = _fields(
    ("", "object", True, ()), ("schema_version", "string", True, ()), ("report_kind", "string", True, ()),
    ("reproducibility", "object", True, ()), ("reproducibility.config", "object", True, ()),
    ("reproducibility.config.calibration_bins", "integer", True, ()), ("reproducibility.config.evaluator_version", "string", True, ()),
    ("reproducibility.dataset_content_fingerprint", "string|null", False, ()), ("reproducibility.dataset_id", "string", True, ()),
    ("reproducibility.dataset_version", "string", True, ()), ("reproducibility.evaluator_version", "string", True, ()),
    ("reproducibility.manifest_fingerprint", "string", True, ()), ("metrics", "array", True, ()), ("metrics[]", "object", True, ()),
    ("metrics[].maximum", "number|null", True, ()), ("metrics[].minimum", "number|null", True, ()), ("metrics[].name", "string", True, ()),
    ("metrics[].sample_count", "integer", True, ()), ("metrics[].value", "number", True, ()), ("system_metrics", "object|null", True, ()),
    ("system_metrics.p50_latency_ms", "number", True, ()), ("system_metrics.p95_latency_ms", "number", True, ()),
    ("system_metrics.ram_mb", "number|null", True, ()), ("system_metrics.vram_mb", "number|null", False, ()))


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, payload. For line-delimited data use spark.read.text directly."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def split_strict(documents: DataFrame, shape: tuple[Field, ...], key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Documents that follow the shape at every level, and the faults of the others: key, path, at, rule.

    ``key`` names a unique column of ``documents``; its faults come out under the name ``document``.
    The documents are written down once: what made them is not done again for the faults and the rest.
    """
    documents = stash(documents)
    named = documents.select(F.col(key).alias("document"), "payload")
    faults = stash(json_shape.violations(named, "document", shape))
    bad = faults.select(F.col("document").alias(key)).distinct()
    return documents.join(bad, key, "left_anti"), faults


def parse_manifests(documents: DataFrame) -> DataFrame:
    """One row per sample, ground truth still nested."""
    m = computed(documents, _m=F.from_json("payload", MANIFEST_DDL))
    return m.select("_m.dataset_id", "_m.dataset_version", F.explode("_m.samples").alias("s")).select(
        "dataset_id", "dataset_version", "s.sample_id", "s.split", F.array_sort("s.slices").alias("slices"),
        F.col("s.image.image_id").alias("item_id"), "s.image.relative_path", "s.ground_truth.ocr_text",
        F.array_sort(F.col("s.ground_truth.unsupported_claims.category")).alias("unsupported_claims"),
        F.col("s.ground_truth.labels").alias("labels"))


def manifest_labels(samples: DataFrame) -> DataFrame:
    """Truth labels, one row each; a value is told by its canonical JSON text, so "1" and 1 differ."""
    return samples.select("dataset_id", "sample_id", "split", F.explode("labels").alias("l")).select(
        "dataset_id", "sample_id", "split", "l.label_id", "l.type", "l.label", json_shape.canonical(F.col("l.value")).alias("value"))


def manifest_slices(samples: DataFrame) -> DataFrame:
    return samples.select("dataset_id", "sample_id", F.explode("slices").alias("slice"))


def parse_predictions(documents: DataFrame) -> DataFrame:
    p = computed(documents, _p=F.from_json("payload", PREDICTION_DDL))
    return p.select("_p.dataset_id", "_p.dataset_version", F.explode("_p.predictions").alias("s")).select(
        "dataset_id", "dataset_version", "s.sample_id", "s.ocr_text", "s.labels", "s.claims")


def prediction_labels(predictions: DataFrame) -> DataFrame:
    return predictions.select("dataset_id", "dataset_version", "sample_id", F.explode("labels").alias("l")).select(
        "dataset_id", "dataset_version", "sample_id", "l.type", "l.label", json_shape.canonical(F.col("l.value")).alias("value"), "l.confidence")


def prediction_claims(predictions: DataFrame) -> DataFrame:
    return predictions.select("dataset_id", "sample_id", F.inline("claims"))


# -- metric reports ------------------------------------------------------------------------

REPORT_DDL = (
    "schema_version string, report_kind string, reproducibility struct<config:struct<calibration_bins:int,evaluator_version:string>,"
    "dataset_content_fingerprint:string,dataset_id:string,dataset_version:string,evaluator_version:string,manifest_fingerprint:string>,"
    "metrics array<struct<maximum:double,minimum:double,name:string,sample_count:bigint,value:double>>, "
    "system_metrics struct<p50_latency_ms:double,p95_latency_ms:double,ram_mb:double,vram_mb:double>")


def parse_reports(documents: DataFrame) -> DataFrame:
    """One row per report: identity columns, metrics array, system metrics."""
    return computed(documents, _r=F.from_json("payload", REPORT_DDL)).select(*[c for c in documents.columns if c != "payload"], "_r.*")


def report_metrics(reports: DataFrame, id_col: str = "report_id") -> DataFrame:
    return reports.select(id_col, F.inline("metrics"))


def report_violations(reports: DataFrame, id_col: str = "report_id") -> DataFrame:
    """Schema version, evaluator version agreement, digest shapes, latency order."""
    c = F.col
    s, r = "system_metrics.", "reproducibility."
    _, rows = rules.apply_rules(reports.withColumn("analysis_id", c(id_col)), "report", c(id_col), {
        "schema_version": c("schema_version") == vocab.REPORT_SCHEMA_VERSION,
        "evaluator_version": c(r + "evaluator_version") == c(r + "config.evaluator_version"),
        "manifest_fingerprint": c(r + "manifest_fingerprint").rlike(rules.SHA256_PATTERN),
        "content_fingerprint": F.coalesce(c(r + "dataset_content_fingerprint").rlike(rules.SHA256_PATTERN), F.lit(True)),
        "dataset_version": rules.version_shape(c(r + "dataset_version")),
        "dataset_id": rules.id_shape(c(r + "dataset_id")),
        "latency_order": F.coalesce(c(s + "p95_latency_ms") >= c(s + "p50_latency_ms"), F.lit(True)),
        "latency_sign": F.coalesce(c(s + "p50_latency_ms") >= 0, F.lit(True)),
    })
    return rows


# -- recognised words ----------------------------------------------------------------------

WORD_COLUMNS = ("level", "page_num", "block_num", "par_num", "line_num", "left", "top", "width", "height", "conf", "text")


def read_word_tsv(spark: SparkSession, path: str) -> DataFrame:
    """TSV files of recognised words, every field as text; a missing column reads as null.

    A file holds the words of one image and is read as one row, so ``row_no``, the line's number in
    its file, is the same for any split size. Files of subfolders are read too; ``item_id`` is the file's
    place below ``path`` without the last extension, so names that share a beginning stay apart.
    """
    root = path.rstrip("/").rsplit("/", 1)[-1]
    place = F.substring_index("_metadata.file_path", f"/{root}/", -1)
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.regexp_replace(F.url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))), r"\.[^./]*\z", "").alias("item_id"),
        F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n").alias("lines"))
    head = F.split(F.element_at("lines", 1), "\t")
    rows = files.select("item_id", head.alias("head"), F.posexplode("lines").alias("row_no", "line")).filter(
        (F.col("row_no") > 0) & (F.col("line") != ""))
    cells = F.split("line", "\t")
    return rows.select(*[
        F.get(cells, F.array_position("head", F.lit(c)).cast("int") - 1).alias(c) for c in (*WORD_COLUMNS[:5], "word_num", *WORD_COLUMNS[5:])],
        "item_id", F.col("row_no").cast("bigint").alias("row_no"))


def parse_word_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed word rows (level 5, non-blank text) and the rejected rows with a reason."""
    c = F.col
    ints = ("page_num", "block_num", "par_num", "line_num", "left", "top", "width", "height")
    level = c("level").try_cast("int")
    typed = rows.withColumn("_level", level).withColumn("_text", strip(F.coalesce("text", F.lit(""))))
    words = typed.filter(c("_level").isNull() | ((c("_level") == 5) & (c("_text") != "")))
    conf = c("conf").try_cast("double")
    numbers_ok = F.lit(True)
    for name in ints:
        numbers_ok = numbers_ok & c(name).try_cast("int").isNotNull()
    box_ok = (c("left").try_cast("int") >= 0) & (c("top").try_cast("int") >= 0) & (
        c("width").try_cast("int") > 0) & (c("height").try_cast("int") > 0)
    reason = (
        F.when(c("_level").isNull(), "invalid_level")
        .when(~F.coalesce(conf.between(0.0, 100.0) & ~F.isnan(conf), F.lit(False)), "invalid_confidence")
        .when(~F.coalesce(numbers_ok & box_ok, F.lit(False)), "invalid_position"))
    marked = computed(words, reason=reason)
    keys = [k for k in rows.columns if k not in WORD_COLUMNS]
    good = marked.filter(c("reason").isNull()).select(
        *keys, *[c(n).cast("int").alias(n) for n in ints], conf.alias("conf"), c("_text").alias("text"))
    return good, marked.filter(c("reason").isNotNull()).select(*keys, "reason")


# -- structured extractor output -----------------------------------------------------------

_OBS = "array<struct<label:string,confidence:double>>"
STRUCTURED_DDL = (
    f"scenes {_OBS}, objects {_OBS}, activities {_OBS}, topics {_OBS}, caption struct<text:string,confidence:double>")
STRUCTURED_FIELDS = ("scenes", "objects", "activities", "topics", "caption")
_KIND_OF_FIELD = {"scenes": "scene", "objects": "object", "activities": "activity", "topics": "topic"}


def completion_content(payload: Column) -> Column:
    """Text of the single choice of a completion document; null unless there is exactly one."""
    choices = F.json_array_length(F.get_json_object(payload, "$.choices"))
    return F.when(choices == 1, F.get_json_object(payload, "$.choices[0].message.content"))


def parse_structured_output(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observation rows (captions as kind 'caption') and rejected documents.

    ``rows``: analysis_id, item_id, content (JSON object text).
    """
    c = F.col
    parsed = computed(rows, _o=F.from_json("content", STRUCTURED_DDL))
    arrays_ok = F.lit(True)
    for field in _KIND_OF_FIELD:
        body = F.get_json_object("content", f"$.{field}")
        bad_entry = F.exists(c(f"_o.{field}"), lambda x: x.isNull() | x["label"].isNull() | x["confidence"].isNull())
        exact = ~F.exists(
            F.from_json(body, "array<string>"),
            lambda x: ~F.coalesce(F.array_sort(F.json_object_keys(x)) == F.array(F.lit("confidence"), F.lit("label")), F.lit(False)))
        arrays_ok = arrays_ok & F.coalesce(body.startswith("[") & ~bad_entry & exact, F.lit(False))
    caption = F.get_json_object("content", "$.caption")
    caption_ok = caption.isNull() | F.coalesce(
        (F.array_sort(F.json_object_keys(caption)) == F.array(F.lit("confidence"), F.lit("text")))
        & c("_o.caption.text").isNotNull() & c("_o.caption.confidence").isNotNull(), F.lit(False))
    reason = (
        F.when(c("content").isNull() | (strip(c("content")) == ""), "empty_content")
        .when(F.json_object_keys("content").isNull(), "not_a_json_object")
        .when(~rules.closed_fields(c("content"), STRUCTURED_FIELDS), "invalid_fields")
        .when(~arrays_ok, "invalid_observation").when(~caption_ok, "invalid_caption"))
    marked = computed(parsed, reason=reason)
    def of_kind(field: str, kind: str) -> Column:
        return F.transform(c(f"_o.{field}"), lambda x: F.struct(
            F.lit(kind).alias("kind"), x["label"].alias("label"), x["confidence"].alias("confidence")))

    lists = [of_kind(field, kind) for field, kind in _KIND_OF_FIELD.items()]
    told = F.array_compact(F.array(F.when(c("_o.caption").isNotNull(), F.struct(
        F.lit("caption").alias("kind"), c("_o.caption.text").alias("label"), c("_o.caption.confidence").alias("confidence")))))
    good = marked.filter(c("reason").isNull()).select("analysis_id", "item_id", F.inline(F.concat(*lists, told)))
    return good, marked.filter(c("reason").isNotNull()).select("analysis_id", "item_id", "reason")


# -- state ---------------------------------------------------------------------------------

def read_state(spark: SparkSession, path: str, status: str | None = None, analysis_id: str | None = None) -> DataFrame:
    """State rows of the newest version; the status reaches the scan, and an id opens its own bucket only."""
    return find_state(keyed_table.read(spark, path, analysis_id), status)


def find_state(state: DataFrame, status: str | None = None, analysis_id: str | None = None) -> DataFrame:
    if status is not None:
        state = state.filter(F.col("status") == status)
    if analysis_id is not None:
        state = state.filter(F.col("analysis_id") == analysis_id)
    return state
