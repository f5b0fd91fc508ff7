"""Self-reported claims, kept apart from anything inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from . import rules


def violations(claims: DataFrame, max_claims: int = vocab.MAX_CLAIMS, max_chars: int = vocab.MAX_CLAIM_CHARS) -> DataFrame:
    c = F.col
    checks = {
        f"{field}_text": rules.trimmed_text(c(field)) & (F.length(field) <= max_chars)
        for field in ("claim_id", "value", "source_id")}
    checks |= {
        "category": rules.one_of(c("category"), vocab.CLAIM_CATEGORIES),
        "source_type": rules.one_of(c("source_type"), vocab.CLAIM_SOURCE_TYPES),
        "consent": c("consent_confirmed"), "basis": c("basis") == vocab.CLAIM_BASIS,
    }
    _, rows = rules.apply_rules(claims, "claim", c("claim_id"), checks)
    too_many = claims.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > max_claims)
    twice = claims.groupBy("analysis_id", "claim_id").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    return (
        rows.unionByName(rules.violation(too_many, "analysis", c("analysis_id"), "too_many_claims"))
        .unionByName(rules.violation(twice, "claim", c("claim_id"), "duplicate_claim"))
    )


def accepted(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims of analyses whose claims all hold, and the violations; one bad claim fails its analysis."""
    broken = violations(claims)
    return rules.drop_failed(claims, broken), broken
