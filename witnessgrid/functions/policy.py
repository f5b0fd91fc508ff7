"""The sensitive-claim predicate: claims about a person's protected traits are not supported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from .text import computed, contains_phrase, policy_text


def violates(key: Column | None, label: Column) -> Column:
    """True when a claim names a protected trait of a person, in English or Persian."""
    lowered = None if key is None else F.lower(key)
    return _verdict(lowered, None if lowered is None else policy_text(lowered), policy_text(label))


def flagged(df: DataFrame, key: Column, label: Column, name: str = "violates") -> DataFrame:
    """The same verdict as a column, with every text normalised once per row."""
    ready = computed(df, _key=F.lower(key), _key_text=policy_text(F.lower(key)), _label_text=policy_text(label))
    verdict = _verdict(F.col("_key"), F.col("_key_text"), F.col("_label_text"))
    return computed(ready, **{name: verdict}).select(*df.columns, name)


def _verdict(key: Column | None, key_text: Column | None, label_text: Column) -> Column:
    bad = label_text.isin(*vocab.SENSITIVE_PHRASES) | _names_person_trait(label_text)
    if key is not None and key_text is not None:
        bad = bad | key.isin(*vocab.SENSITIVE_KEYS) | _names_person_trait(key_text)
    return F.coalesce(bad, F.lit(False))


def _names_person_trait(text: Column) -> Column:
    return contains_phrase(text, vocab.SENSITIVE_PHRASES) & contains_phrase(text, vocab.SUBJECT_TERMS)
