"""Result graph integrity, redaction, and the stored document of an analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..session import stash
from . import insights, parts, rules, skew

_V1 = ("schema_version", "result", "insight_policy_version", "summary")
DOCUMENT_FIELDS = {
    vocab.RESULT_SCHEMA_V1: _V1,
    vocab.RESULT_SCHEMA_V2: (*_V1, "self_reported_claims"),
    vocab.RESULT_SCHEMA_V3: (*_V1, "self_reported_claims", "personality_profile"),
}


def support_violations(owners: DataFrame, links: DataFrame, evidence: DataFrame, items: DataFrame) -> DataFrame:
    """Integrity of supported statements (insights or themes) against evidence and items.

    ``owners``: analysis_id, key, evidence_count, item_coverage.
    ``links``: analysis_id, key, and one of evidence_id / item_id per row (the other null).
    Everything is a join on the id itself, so a statement with very many links spreads.
    """
    c = F.col
    known_evidence = evidence.select("analysis_id", c("id").alias("evidence_id"), c("item_id").alias("via_item"))
    by_evidence = links.filter(c("evidence_id").isNotNull()).select("analysis_id", "key", "evidence_id").join(
        known_evidence, ["analysis_id", "evidence_id"], "left")
    known_items = items.select("analysis_id", "item_id", F.lit(True).alias("_known")).distinct()
    by_item = links.filter(c("item_id").isNotNull()).select("analysis_id", "key", "item_id").join(
        known_items, ["analysis_id", "item_id"], "left")
    reached = by_evidence.filter(c("via_item").isNotNull()).select(
        "analysis_id", "key", c("via_item").alias("item_id"), F.lit(True).alias("_via")).distinct()
    named = by_item.select("analysis_id", "key", "item_id", F.lit(True).alias("_named")).distinct()
    both = reached.join(named, ["analysis_id", "key", "item_id"], "full_outer")
    per_key = both.groupBy("analysis_id", "key").agg(
        F.count_if("_via").alias("reached"), F.count_if(c("_via").isNull() | c("_named").isNull()).alias("differing"))
    counts = by_evidence.groupBy("analysis_id", "key").agg(F.count(F.lit(1)).alias("listed"))
    totals = items.select("analysis_id", "item_id").distinct().groupBy("analysis_id").agg(F.count(F.lit(1)).alias("total"))
    counted = owners.join(per_key, ["analysis_id", "key"], "left").join(counts, ["analysis_id", "key"], "left")
    sized = totals.withColumn("_size", c("total"))
    checked = skew.lookup(counted, sized, ["analysis_id"], "_size", 10_000, spread_by=["key"])
    _, rows = rules.apply_rules(checked, "statement", c("key"), {
        "item_set_differs": c("differing") == 0, "evidence_count": c("evidence_count") == c("listed"),
        "coverage": F.abs(c("item_coverage") - c("reached") / c("total")) <= 1e-12})
    twice = owners.groupBy("analysis_id", "key").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    return (
        rows
        .unionByName(rules.violation(by_evidence.filter(c("via_item").isNull()), "statement", c("evidence_id"), "unknown_evidence"))
        .unionByName(rules.violation(by_item.filter(c("_known").isNull()), "statement", c("item_id"), "unknown_item"))
        .unionByName(rules.violation(twice, "statement", c("key"), "duplicate_key"))
    )


def evidence_violations(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """Evidence ids unique per analysis, and every row belongs to an item of its analysis."""
    c = F.col
    twice = evidence.groupBy("analysis_id", "id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    stray = evidence.join(items.select("analysis_id", "item_id"), ["analysis_id", "item_id"], "left_anti")
    _, rows = rules.apply_rules(evidence, "evidence", c("id"), {
        "type": rules.one_of(c("type"), vocab.EVIDENCE_TYPES), "confidence": rules.probability(c("confidence")),
        "label": rules.trimmed_text(c("label")), "source": rules.trimmed_text(c("source"))})
    return (
        rows.unionByName(rules.violation(twice, "evidence", c("id"), "duplicate_evidence"))
        .unionByName(rules.violation(stray, "evidence", c("id"), "unknown_item"))
    )


def resolve_support(links: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signals of aggregates resolved to evidence rows, and the references that fail."""
    c = F.col
    found = links.join(
        evidence.select("analysis_id", c("id").alias("signal_id"), c("item_id").alias("evidence_item"), c("type").alias("evidence_type")),
        ["analysis_id", "signal_id"], "left")
    unknown = found.filter(c("evidence_item").isNull())
    wrong = found.filter(c("evidence_item").isNotNull() & (c("evidence_type") != c("kind")))
    good = found.filter(c("evidence_type") == c("kind"))
    return good, rules.violation(unknown, "aggregate", c("signal_id"), "unknown_evidence").unionByName(
        rules.violation(wrong, "aggregate", c("signal_id"), "incompatible_type"))


def redacted(evidence: DataFrame) -> DataFrame:
    """Recognised text loses its value and raw text before anything is stored."""
    is_text = F.col("type") == "ocr_text"
    fields = F.from_json("metadata", "map<string,string>")
    cleaned = F.to_json(F.map_filter(fields, lambda k, _: k != "raw_text"), {"ignoreNullFields": "false"})
    return evidence.withColumn("value", F.when(~is_text, F.col("value"))).withColumn(
        "metadata", F.when(is_text, cleaned).otherwise(F.col("metadata")))


CLAIM_FIELDS = ("basis", "category", "claim_id", "consent_confirmed", "source_id", "source_type", "value")
_ORDER = ["o1", "o2", "o3", "o4"]


def _place(section: int, first: Column | int = 0, step: int = 0, own: Column | str = "") -> dict[str, Column]:
    return {"o1": F.lit(section), "o2": (F.lit(first) if isinstance(first, int) else first).cast("bigint"), "o3": F.lit(step),
            "o4": F.lit(own) if isinstance(own, str) else own}


def _object(df: DataFrame, fields: dict[str, str]) -> Column:
    """Columns of ``df`` as a JSON object with keys in order; nulls are written."""
    return F.to_json(F.struct(*[df[column].alias(name) for name, column in sorted(fields.items())]), {"ignoreNullFields": "false"})


def _image_pieces(items: DataFrame, evidence: DataFrame) -> list[DataFrame]:
    """Evidence inside its item; an item without evidence keeps an empty list."""
    keys, ordinal = ["analysis_id"], F.col("ordinal")
    begin = F.concat(F.lit('{"analysis_id":'), parts.json_text(F.col("analysis_id")), F.lit(',"evidence":['))
    end = F.concat(F.lit('],"image_id":'), parts.json_text(F.col("item_id")), F.lit("}"))
    rows = evidence.join(items.select("analysis_id", "item_id", "ordinal"), ["analysis_id", "item_id"])
    fields = {c: c for c in ("confidence", "id", "label", "metadata", "source", "type", "value")} | {"image_id": "item_id"}
    return [parts.piece(items, keys, _place(2, ordinal), begin, ",", opens=True),
            parts.piece(rows, keys, _place(2, ordinal, 1, F.col("id")), _object(rows, fields), ","),
            parts.piece(items, keys, _place(2, ordinal, 2), end)]


def _insight_pieces(ranked: DataFrame, support: DataFrame) -> list[DataFrame]:
    """Insights in rank order, each with its explanation and the ids that support it."""
    keys, rank, text, inner = ["analysis_id"], F.col("rank"), parts.json_text, parts.json_inner
    signals, items = (support.filter(F.col("part") == p) for p in ("signal", "item"))
    begin = F.concat(F.lit('{"confidence":'), text(F.col("confidence")), F.lit(',"evidence_count":'), text(F.col("evidence_count")),
                     F.lit(',"explanation":"'))
    middle = F.concat(F.lit(f'{insights.EXPLANATION_END}","image_coverage":'), text(F.col("item_coverage")), F.lit(',"key":'),
                      text(F.col("insight_key")), F.lit(',"label":'), text(F.col("insight_label")), F.lit(',"supporting_evidence_ids":['))
    end = F.concat(F.lit('],"type":'), text(F.col("type")), F.lit("}"))
    return [parts.piece(ranked, keys, _place(4, rank), begin, ","),
            parts.piece(ranked, keys, _place(4, rank, 1), inner(insights.explanation_head()), opens=True),
            parts.piece(items, keys, _place(4, rank, 2, F.col("id")), inner(F.col("id")), ", "),
            parts.piece(ranked, keys, _place(4, rank, 3), middle, opens=True),
            parts.piece(signals, keys, _place(4, rank, 4, F.col("id")), text(F.col("id")), ","),
            parts.piece(ranked, keys, _place(4, rank, 5), F.lit('],"supporting_image_ids":['), opens=True),
            parts.piece(items, keys, _place(4, rank, 6, F.col("id")), text(F.col("id")), ","),
            parts.piece(ranked, keys, _place(4, rank, 7), end)]


def document_parts(items: DataFrame, evidence: DataFrame, ranked: DataFrame, support: DataFrame, policy_version: str,
                   claims: DataFrame | None = None, profiles: DataFrame | None = None,
                   part_bytes: int = parts.PART_BYTES) -> DataFrame:
    """(analysis_id, status, part_no, result_payload): the versioned JSON document of every completed analysis.

    Analyses, insights and lists of ids may have any size: nothing but a part is ever one row.
    ``evidence`` is redacted; ``support`` comes from :func:`insights.support_ids`; ``claims`` hold valid rows only.
    """
    keys = ["analysis_id"]
    base, profile = items.select("analysis_id").distinct(), F.lit("null")
    if profiles is not None:
        packed = profiles.select("analysis_id", F.to_json(
            F.struct(*[x for x in profiles.columns if x != "analysis_id"]), {"ignoreNullFields": "false"}).alias("_profile"))
        base, profile = base.join(packed, "analysis_id", "left"), F.coalesce("_profile", F.lit("null"))
    head = F.concat(F.lit('{"insight_policy_version":'), parts.json_text(F.lit(policy_version)), F.lit(',"personality_profile":'), profile,
                    F.lit(',"result":{"analysis_id":'), parts.json_text(F.col("analysis_id")), F.lit(',"images":['))
    version = F.lit(f'],"status":"completed","themes":[]}},"schema_version":"{vocab.RESULT_SCHEMA_V3}","self_reported_claims":[')
    rows = [parts.piece(base, keys, _place(1), head, opens=True), *_image_pieces(items, evidence),
            parts.piece(base, keys, _place(3), F.lit('],"insights":['), opens=True), *_insight_pieces(ranked, support),
            parts.piece(base, keys, _place(5), version, opens=True),
            parts.piece(base, keys, _place(7), F.lit('],"summary":"')),
            insights.summary_pieces(ranked, base, keys, lambda step, rank: _place(8, rank, step), parts.json_inner),
            parts.piece(base, keys, _place(9), F.lit('"}'))]
    if claims is not None:
        told = _object(claims, {c: c for c in CLAIM_FIELDS})
        # Claims of an analysis that has no items have no document to be in.
        rows.append(parts.piece(claims.withColumn("_told", told).join(base.select("analysis_id"), "analysis_id", "left_semi"),
                                keys, _place(6, own=F.col("claim_id")), F.col("_told"), ","))
    pieces = rows[0]
    for more in rows[1:]:
        pieces = pieces.unionByName(more)
    cut = parts.cut(pieces, keys, _ORDER, part_bytes)
    return cut.select("analysis_id", F.lit("completed").alias("status"), "part_no", F.col("payload").alias("result_payload"))


_TOLD = ("schema_version", "result.analysis_id", "insight_policy_version")


def read_documents(stored: DataFrame, paths: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored document parts of any known version: (headers, leaves, rejected).

    ``stored``: analysis_id, part_no, result_payload. Headers have one row per readable document;
    leaves (see :func:`parts.leaves`) hold its content as rows; rejected analyses have a reason. Every
    document is read whole; with ``paths`` only their values, and what tells its shape, become leaves.
    """
    c = F.col
    present = stored.groupBy("analysis_id").agg(F.max(c("result_payload").isNotNull()).alias("present"))
    found = stash(parts.leaves(stored.select("analysis_id", "part_no", c("result_payload").alias("payload")).filter("payload IS NOT NULL"),
                               paths=None if paths is None else (*_TOLD, *paths)))
    top = F.regexp_extract("path", r"\A([^.\[]*)", 1)
    known = sorted({f for fields in DOCUMENT_FIELDS.values() for f in fields})

    def at(path: str) -> Column:
        return F.max(F.when((c("path") == path) & (c("kind") == "string"), c("value")))
    told = found.filter((c("path") != "") | (c("kind") == "error")).groupBy("analysis_id").agg(
        at("schema_version").alias("schema_version"), at("result.analysis_id").alias("own"), at("insight_policy_version").alias("insight_policy_version"),
        F.bool_or(~top.isin(*known) | (c("kind") == "error")).alias("other"), *[F.bool_or(top == f).alias(f"has_{f}") for f in known])
    exact = F.lit(False)
    for name, fields in DOCUMENT_FIELDS.items():
        shape = c("schema_version") == name
        for f in known:
            shape &= c(f"has_{f}") if f in fields else ~c(f"has_{f}")
        exact |= shape & ~c("other")
    reason = (
        F.when(~c("present"), "payload_missing")
        .when(~F.coalesce(c("schema_version").isin(*DOCUMENT_FIELDS), F.lit(False)), "unknown_version")
        .when(~F.coalesce(exact, F.lit(False)), "invalid_fields")
        .when(~F.coalesce(c("own") == c("analysis_id"), F.lit(False)), "id_mismatch"))
    checked = stash(present.join(told, "analysis_id", "left").withColumn("reason", reason).select(
        "analysis_id", "schema_version", "insight_policy_version", "reason"))
    good = checked.filter("reason IS NULL").drop("reason")
    return good, found.join(good.select("analysis_id"), "analysis_id", "left_semi"), checked.filter("reason IS NOT NULL").select("analysis_id", "reason")


def profile_view(insight_results: DataFrame, profiles: DataFrame) -> DataFrame:
    """Observable patterns beside questionnaire scores; the two are never merged."""
    packed = profiles.select("analysis_id", F.struct(*[x for x in profiles.columns if x != "analysis_id"]).alias("self_report"))
    return insight_results.join(packed, "analysis_id", "left")


def evidence_claims(evidence: DataFrame, finished: DataFrame) -> DataFrame:
    """Everything a result states, as (type, label) claims for policy scoring."""
    return evidence.select("analysis_id", F.col("type").alias("key"), "label").unionByName(
        finished.select("analysis_id", F.col("type").alias("key"), F.col("insight_label").alias("label")))


def provider_claims(observations: DataFrame) -> DataFrame:
    return observations.select("analysis_id", F.col("kind").alias("key"), "label")
