"""Validation rules as Boolean columns, and violations as rows.

One bad row must not abort a job over many analyses, so a broken rule becomes a row of
``violations(analysis_id, entity, entity_id, rule)``. Callers that want "fail" semantics drop
the touched analyses with :func:`drop_failed`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import computed, strip
from . import skew

KEY_PATTERN = r"\A[a-z][a-z0-9_]*\z"
ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
VERSION_PATTERN = r"\A[0-9]+\.[0-9]+\.[0-9]+\z"
SHA256_PATTERN = r"\A[0-9a-f]{64}\z"


def trimmed_text(c: Column) -> Column:
    return (c != "") & (c == strip(c))


def key_shape(c: Column) -> Column:
    return c.rlike(KEY_PATTERN)


def id_shape(c: Column) -> Column:
    return c.rlike(ID_PATTERN)


def version_shape(c: Column) -> Column:
    return c.rlike(VERSION_PATTERN)


def finite(c: Column) -> Column:
    value = c.cast("double")
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def probability(c: Column) -> Column:
    return finite(c) & c.between(0.0, 1.0)


def similarity(c: Column) -> Column:
    return finite(c) & c.between(-1.0, 1.0)


def positive_int(c: Column) -> Column:
    return c > 0


def non_negative(c: Column) -> Column:
    return finite(c) & (c >= 0)


def unique_elements(c: Column) -> Column:
    return F.size(F.array_distinct(c)) == F.size(c)


def non_empty(c: Column) -> Column:
    return F.size(c) > 0


def one_of(c: Column, vocabulary: tuple[str, ...]) -> Column:
    return c.isin(*vocabulary)


def closed_fields(payload: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """The JSON object has every required field and no unknown one."""
    present = F.json_object_keys(payload)
    allowed = F.array(*[F.lit(f) for f in (*required, *optional)])
    needed = F.array(*[F.lit(f) for f in required]) if required else F.array().cast("array<string>")
    return (F.size(F.array_except(present, allowed)) == 0) & (
        F.size(F.array_except(needed, present)) == 0
    )


def json_compatible(payload: Column) -> Column:
    """Parses as JSON and holds no NaN or Infinity literal outside strings."""
    # Two flat patterns: a nested one would recurse once per character on long strings.
    unescaped = F.regexp_replace(payload, r"\\.", "")
    outside_strings = F.regexp_replace(unescaped, r'"[^"]*"', "")
    return F.try_parse_json(payload).isNotNull() & ~outside_strings.rlike("NaN|Infinity")


def safe_relative_path(c: Column) -> Column:
    """Portable relative path; single dots and doubled slashes are folded away by path parsing."""
    part_ok = ~F.exists(F.split(c, "/"), lambda p: p == "..")
    has_part = F.exists(F.split(c, "/"), lambda p: ~p.isin("", "."))
    return trimmed_text(c) & ~c.contains("\\") & ~c.startswith("/") & part_ok & has_part


def metric_bounds(value: Column, minimum: Column, maximum: Column) -> Column:
    low = F.coalesce(value >= minimum, F.lit(True))
    high = F.coalesce(value <= maximum, F.lit(True))
    return finite(value) & low & high


def apply_rules(df: DataFrame, entity: str, entity_id: Column, rules: Mapping[str, Column],
                analysis_id: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Split a frame into its valid rows and one violation row per broken rule."""
    broken = F.filter(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(rule)) for rule, ok in rules.items()]),
        lambda r: r.isNotNull(),
    )
    checked = computed(df, _broken=broken)
    owner = F.col("analysis_id") if analysis_id is None else analysis_id
    violations = checked.filter(F.size("_broken") > 0).select(
        owner.cast("string").alias("analysis_id"), F.lit(entity).alias("entity"),
        entity_id.cast("string").alias("entity_id"), F.explode("_broken").alias("rule"),
    )
    return checked.filter(F.size("_broken") == 0).drop("_broken"), violations


def violation(df: DataFrame, entity: str, entity_id: Column, rule: str) -> DataFrame:
    return df.select(
        F.col("analysis_id").cast("string").alias("analysis_id"), F.lit(entity).alias("entity"),
        entity_id.cast("string").alias("entity_id"), F.lit(rule).alias("rule"),
    )


def drop_failed(df: DataFrame, violations: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Fail mode: an analysis with any violation produces nothing.

    Row counts per analysis tell the join which analyses are hot, so that a huge one is not
    moved to a single task just to be tested.
    """
    failed = violations.select("analysis_id", F.lit(True).alias("_failed")).distinct()
    sizes = df.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("_size"))
    marked = skew.lookup(df, sizes.join(failed, "analysis_id", "left"), ["analysis_id"], "_size", hot_rows)
    return marked.filter(F.col("_failed").isNull()).select(*df.columns)
