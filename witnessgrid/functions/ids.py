"""Deterministic identifiers, canonical JSON and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab

_NUL = "\0"


def digest(*parts: Column | str) -> Column:
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(_NUL, *cols), 256)


def ocr_evidence_id(item: Column, order: Column, raw: Column) -> Column:
    return F.concat(F.lit("ocr-"), F.substring(digest(vocab.OCR_ID_TAG, item, order, raw), 1, 24))


def visual_evidence_id(item: Column, type_: Column, label: Column, value: Column) -> Column:
    tail = F.substring(digest(vocab.VISUAL_ID_TAG, item, type_, label, value), 1, 24)
    return F.concat(F.lit("vision-"), tail)


def semantic_signal_id(fields: dict[str, Column]) -> Column:
    payload = canonical_json(fields)
    return F.concat(
        F.lit("semantic-"), F.substring(digest(vocab.SEMANTIC_ID_TAG, payload), 1, 24)
    )


def insight_key(type_: Column, kind: Column, key: Column) -> Column:
    return F.concat(type_, F.lit("_"), F.substring(digest(kind, key), 1, 16))


def near_duplicate_group_name(digest_hex: Column) -> Column:
    """Group id from the SHA-256 over the tag and the member ids, each closed by a NUL."""
    return F.concat(F.lit("near-duplicate-"), F.substring(digest_hex, 1, 24))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON object with keys in code-point order; nulls are written."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def row_hash(df: DataFrame, cols: list[str]) -> Column:
    """SHA-256 of a row; nulls and neighbouring fields cannot be confused."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols]
    return F.sha2(F.concat_ws(_NUL, *parts), 256)


def fingerprint(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """Order-free fingerprint of a row set, one per key.

    Row digests are cut into 32-bit words and summed, so the fold is a plain partial
    aggregate: no group is ever gathered to be sorted.
    """
    keys = keys or []
    hashed = df.select(*keys, row_hash(df, cols).alias("_h"))
    words = [
        F.sum(F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"_w{i}")
        for i in range(8)
    ]
    folded = hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *words)
    sums = [F.coalesce(F.col(f"_w{i}"), F.lit(0)).cast("string") for i in range(8)]
    return folded.select(
        *keys, "row_count",
        F.sha2(F.concat_ws(":", F.col("row_count").cast("string"), *sums), 256).alias("fingerprint"),
    )
