"""Numeric helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_SCALE = float(2**53)
_LOW_BITS = 26


def unit_sum_parts(c: Column) -> tuple[Column, Column]:
    """Two integer sums that add up values of [0, 1] exactly, whatever the row order.

    A double in [0, 1] is a whole multiple of 2**-53 (smaller ones are rounded to one), so
    summing the high and low bits as BIGINT needs neither decimals nor a sorted fold.
    """
    scaled = F.rint(c * F.lit(_SCALE)).cast("bigint")
    high = F.shiftright(scaled, _LOW_BITS)
    low = scaled.bitwiseAND(F.lit((1 << _LOW_BITS) - 1).cast("bigint"))
    return F.sum(high), F.sum(low)


def unit_sum(high: Column, low: Column) -> Column:
    return (high.cast("double") * float(1 << _LOW_BITS) + low.cast("double")) / F.lit(_SCALE)


def decimal_sum(c: Column) -> Column:
    """Order-free sum for values outside [0, 1]."""
    return F.sum(c.cast("decimal(38,12)"))


def support_score(avg_conf: Column, coverage: Column, consistency: Column, diversity: Column,
                  saturation: int) -> Column:
    """Mean of four supports, kept inside [0, 1]."""
    breadth = F.least(F.lit(1.0), diversity / F.lit(float(saturation)))
    mean = (avg_conf + coverage + consistency + breadth) / F.lit(4.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean))


def resized_side(side: Column, other: Column, limit: int) -> Column:
    """One side after fitting the longer one into ``limit`` (half-even, at least one pixel)."""
    longest = F.greatest(side, other)
    scaled = F.greatest(F.lit(1), F.bround(side * (F.lit(float(limit)) / longest), 0).cast("int"))
    return F.when(longest <= limit, side.cast("int")).otherwise(scaled)


def reverse_adjusted(value: Column, low: Column, high: Column, is_reversed: Column) -> Column:
    return F.when(is_reversed, low + high - value).otherwise(value)


def calibration_bin(confidence: Column, bins: int) -> Column:
    return F.least(F.floor(confidence * bins).cast("int"), F.lit(bins - 1))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, 0.0).otherwise(2.0 * precision * recall / total)


def sigmoid_score(cosine: Column, log_scale: float, bias: float) -> Column:
    """Independent per-label score from a similarity."""
    return 1.0 / (1.0 + F.exp(-(F.exp(F.lit(log_scale)) * cosine + F.lit(bias))))


# Bands of the edit distance; a band of width k costs k times the text's length.
_BANDS = (8, 64, 512)


def edit_distance(left: Column, right: Column) -> Column:
    """Edit distance by characters. A narrow band is tried first and widened only while the texts
    lie further apart, so alike texts of any length stay cheap."""
    tried = [F.nullif(F.levenshtein(left, right, band), F.lit(-1)) for band in _BANDS]
    return F.coalesce(*tried, F.levenshtein(left, right))


def character_error_rate(ref: Column, pred: Column) -> Column:
    empty = F.when(F.length(pred) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(ref) == 0, empty).otherwise(edit_distance(ref, pred) / F.length(ref))


def code_text(codes: Column) -> Column:
    """An array of token numbers (from 1) as a text of one character each, so that text functions work on tokens.

    Plane 1 and above: no surrogates, and room for about a million distinct tokens.
    """
    digits = F.transform(codes, lambda n: F.lpad(F.hex(n + F.lit(0xFFFF)), 8, "0"))
    return F.decode(F.unhex(F.array_join(digits, "")), "UTF-32")
