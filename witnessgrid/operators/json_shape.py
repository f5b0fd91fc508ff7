"""JSON documents that may hold no other fields than a shape names, at every level.

A shape is data: one :class:`Field` per path. Documents are parsed once into VARIANT and opened
level by level with ``variant_explode``, so every value of every document is a row with its path;
rows are checked against the shape, which has a fixed size. All levels are one pass without a shuffle,
and nothing is gathered per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import computed
from . import rules

KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer"}


@dataclass(frozen=True)
class Field:
    """``kinds``: object, array, string, boolean, null, integer, number (integers too), or any."""

    path: str
    kinds: tuple[str, ...] = ("string",)
    required: bool = True
    values: tuple[str, ...] = ()


def canonical(value: Column) -> Column:
    """Canonical JSON text of a VARIANT: compact, keys sorted at every level, types kept apart; an
    absent value is null. Numbers are equal by value, so 1.50 and 1.5 are one."""
    return F.coalesce(F.to_json(value), F.lit("null"))


def _kind(value: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(value), r"\A([A-Z]+)", 1)
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.coalesce(kinds[name], F.lit("number"))


def opened(documents: DataFrame, key: str, payload: str, shape: tuple[Field, ...]) -> DataFrame:
    """(key, path, at, kind, value, keys, compatible) of every value down to the shape's depth.

    ``at`` holds the positions in the arrays on the way; ``keys`` the field names of an object.
    Dots and brackets inside a field name are escaped, so no name looks like a path. Every document
    has a row of its own, which alone tells if the text is not ``compatible``; kind and value are null
    if it is no JSON at all.
    """
    c = F.col
    # A value of another kind than its field allows is told as such and not opened.
    inside = F.lit(False)
    for kind in ("object", "array"):
        inside |= c("path").isin(*[f.path for f in shape if kind in f.kinds]) & (c("kind") == kind)
    depth = 1 + max((f.path.count(".") + f.path.count("[]") + 1 for f in shape if f.path), default=0)
    own = [key, "path", "at", "v", "compatible", "kind", "done"]
    rows = computed(documents.select(c(key), F.lit("").alias("path"), F.array().cast("array<int>").alias("at"), c(payload)),
                    v=F.try_parse_json(payload), compatible=F.coalesce(rules.json_compatible(c(payload)), F.lit(False)))
    rows = computed(rows.drop(payload), kind=F.when(c("v").isNotNull(), _kind(c("v")))).withColumn("done", F.lit(False)).select(*own)
    for _ in range(depth):
        # A value to open goes on as itself and once more for the values in it.
        opens = F.coalesce(~c("done") & inside, F.lit(False))
        copies = rows.select(*own, F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("down"))
        found = documents.sparkSession.sql(
            "SELECT r.*, x.pos, x.key AS name, x.value AS inner FROM {rows} r, LATERAL variant_explode_outer(CASE WHEN r.down THEN r.v END) x",
            rows=copies).filter("NOT down OR pos IS NOT NULL")
        name = F.regexp_replace("name", r"([.\[\]])", r"\\$1")
        path = F.when(c("name").isNull(), F.concat("path", F.lit("[]"))).when(c("path") == "", name).otherwise(F.concat("path", F.lit("."), name))
        at = F.when(c("name").isNull(), F.array_append("at", c("pos"))).otherwise(c("at"))
        pick = lambda new, old: F.when(c("down"), new).otherwise(c(old))
        rows = computed(found.select(
            key, pick(path, "path").alias("path"), pick(at, "at").alias("at"), pick(c("inner"), "v").alias("v"),
            pick(F.lit(True), "compatible").alias("compatible"), c("kind").alias("_kind"), "down"), kind=F.when(c("down"), _kind(c("v"))).otherwise(c("_kind"))).select(
            key, "path", "at", "v", "compatible", "kind", (~c("down")).alias("done"))
    return rows.select(key, "path", "at", "kind", c("v").alias("value"),
                       F.when(c("kind") == "object", F.json_object_keys(F.to_json("v"))).alias("keys"), "compatible")


def violations(documents: DataFrame, key: str, shape: tuple[Field, ...], payload: str = "payload") -> DataFrame:
    """(key, path, at, rule): each fault at the place where it is.

    Rules: invalid_json (no JSON, a repeated key, NaN or Infinity), unknown_field, missing_field, wrong_type, not_allowed.
    """
    spark, c = documents.sparkSession, F.col
    children: dict[str, list[str]] = {}
    for f in shape:
        if f.required and f.path and not f.path.endswith("[]"):
            up, _, name = f.path.rpartition(".")
            children.setdefault(up, []).append(name)
    paths = {f.path for f in shape}
    told = F.broadcast(spark.createDataFrame(
        [(f.path, list(f.kinds), list(f.values), children.get(f.path, []), True) for f in shape]
        + [(up, None, None, names, None) for up, names in children.items() if up not in paths],
        "path string, kinds array<string>, allowed array<string>, required array<string>, known boolean"))
    rows = computed(opened(documents, key, payload, shape).join(told, "path", "left"), text=F.expr("try_variant_get(value, '$', 'string')"))
    kinds = c("kinds")
    fits = F.array_contains(kinds, c("kind")) | F.array_contains(kinds, "any") | ((c("kind") == "integer") & F.array_contains(kinds, "number"))
    wrong = (
        F.when(c("kind").isNull(), F.lit(None)).when(c("known").isNull(), "unknown_field").when(~fits, "wrong_type")
        .when((F.size("allowed") > 0) & (c("kind") == "string") & ~F.array_contains(c("allowed"), c("text")), "not_allowed"))
    lacks = F.when((c("kind") == "object") & c("required").isNotNull(), F.array_except("required", "keys")).otherwise(F.array().cast("array<string>"))

    def fault(path, rule):
        return F.struct(path.alias("path"), rule.alias("rule"))
    faults = F.concat(
        F.array_compact(F.array(F.when(~c("compatible"), fault(F.lit(""), F.lit("invalid_json"))), F.when(wrong.isNotNull(), fault(c("path"), wrong)))),
        F.transform(lacks, lambda name: fault(F.when(c("path") == "", name).otherwise(F.concat_ws(".", "path", name)), F.lit("missing_field"))))
    return rows.select(key, "at", F.inline(faults)).select(key, "path", "at", "rule")
