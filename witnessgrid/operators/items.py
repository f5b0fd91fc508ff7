"""Item batches: upload rules, exact-duplicate mapping, batch integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from ..functions import numbers
from . import rules, skew


def extension_of(filename: Column) -> Column:
    """Last suffix in lower case, with its dot; empty when there is none (path-suffix rule)."""
    name = F.regexp_extract(filename, r"([^/]*)/*\z", 1)
    return F.lower(F.regexp_extract(name, r"(?s)\A.+(\.[^.]+)\z", 1))


def mime_of_extension(extension: Column) -> Column:
    mapping = F.create_map(*[F.lit(v) for kv in vocab.MIME_BY_EXTENSION.items() for v in kv])
    return mapping[extension]


def detected_mime(content: Column) -> Column:
    """Format by leading bytes."""
    head = F.hex(F.substring(content.cast("binary"), 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )


def upload_reject_reason(
    size_bytes: Column, declared: Column, detected: Column, filename: Column,
    width: Column, height: Column, frames: Column,
    allowed: tuple[str, ...] = vocab.ALLOWED_MIME_TYPES, max_bytes: int = vocab.MAX_ITEM_BYTES,
    max_pixels: int = vocab.MAX_ITEM_PIXELS, mime_by_extension: dict[str, str] | None = None,
) -> Column:
    """First upload rule an item breaks, null for an acceptable one."""
    mapping = mime_by_extension or vocab.MIME_BY_EXTENSION
    by_ext = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    ext = extension_of(filename)
    return (
        F.when(F.coalesce(size_bytes, F.lit(0)) == 0, "blank")
        .when(size_bytes > max_bytes, "too_large")
        .when(~declared.isin(*allowed), "declared_mime_not_allowed")
        .when(detected.isNull() | ~detected.isin(*allowed), "detected_format_not_allowed")
        .when(detected != declared, "mime_mismatch")
        .when((ext != "") & (F.coalesce(by_ext[ext], F.lit("")) != detected), "extension_mismatch")
        .when((width <= 0) | (height <= 0), "bad_dimensions")
        .when(width.cast("bigint") * height > max_pixels, "too_many_pixels")
        .when(frames != 1, "not_one_frame")
    )


def fit_dimensions(df: DataFrame, limit: int = vocab.MAX_DIMENSION) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return df.select(
        "*", numbers.resized_side(w, h, limit).alias("fitted_width"),
        numbers.resized_side(h, w, limit).alias("fitted_height"),
        (F.greatest(w, h) > limit).alias("was_resized"),
    )


def request_violations(items: DataFrame, requested: DataFrame,
                       max_items: int = vocab.MAX_ITEMS_PER_ANALYSIS) -> DataFrame:
    """Count limit, duplicate raw ids, and raw ids that differ from the requested ones."""
    counted = items.groupBy("analysis_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    too_many = requested.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_items)
    both = counted.join(
        requested.select("analysis_id", "item_id", F.lit(True).alias("asked")).distinct(),
        ["analysis_id", "item_id"], "full_outer",
    )
    parts = [
        rules.violation(too_many, "analysis", F.col("analysis_id"), "too_many_items"),
        rules.violation(counted.filter(F.col("n") > 1), "item", F.col("item_id"), "duplicate_raw_id"),
        rules.violation(both.filter(F.col("n").isNull()), "item", F.col("item_id"), "requested_item_missing"),
        rules.violation(both.filter(F.col("asked").isNull()), "item", F.col("item_id"), "item_not_requested"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_canonical(items: DataFrame, hot_rows: int = skew.HOT_ROWS, rows: DataFrame | None = None) -> DataFrame:
    """Attach the first item (request order) with the same content, and the copy count.

    ``copies`` is counted with partial aggregation and joined back with hot hashes spread, so
    one piece of content may make up any share of the input. ``rows`` of the items (with content_hash)
    may take the place of the items themselves.
    """
    first = (
        items.groupBy("analysis_id", "content_hash")
        .agg(F.min(F.struct("ordinal", "item_id")).alias("_f"), F.count(F.lit(1)).alias("copies"))
        .select("analysis_id", "content_hash", F.col("_f.item_id").alias("canonical_item_id"), "copies")
    )
    return skew.lookup(items if rows is None else rows, first, ["analysis_id", "content_hash"], "copies", hot_rows,
                       spread_by=["item_id"])


def duplicates_of(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("item_id") != F.col("canonical_item_id")).select(
        "analysis_id", F.col("item_id").alias("duplicate_item_id"), "canonical_item_id", "content_hash"
    )


def universe(items: DataFrame) -> DataFrame:
    """Every submitted item counts, duplicates included."""
    return items.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("item_universe_count"))


def duplicate_violations(items: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Both ends exist, hold the same content, and the canonical end comes strictly earlier."""
    side = items.select("analysis_id", "item_id", "ordinal", F.col("content_hash").alias("hash"))
    dup_side = side.select("analysis_id", F.col("item_id").alias("duplicate_item_id"),
                           F.col("ordinal").alias("dup_ord"), F.col("hash").alias("dup_hash"))
    canon_side = side.select("analysis_id", F.col("item_id").alias("canonical_item_id"),
                             F.col("ordinal").alias("can_ord"), F.col("hash").alias("can_hash"))
    joined = duplicates.join(dup_side, ["analysis_id", "duplicate_item_id"], "left").join(
        canon_side, ["analysis_id", "canonical_item_id"], "left"
    )
    _, broken = rules.apply_rules(
        joined, "item_duplicate", F.col("duplicate_item_id"),
        {
            "duplicate_not_in_batch": F.col("dup_hash").isNotNull(),
            "canonical_not_in_batch": F.col("can_hash").isNotNull(),
            "content_differs": F.coalesce(
                (F.col("dup_hash") == F.col("can_hash")) & (F.col("dup_hash") == F.col("content_hash")), F.lit(True)),
            "canonical_not_earlier": F.coalesce(F.col("can_ord") < F.col("dup_ord"), F.lit(True)),
        },
    )
    return broken
