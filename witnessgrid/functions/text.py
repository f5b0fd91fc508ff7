"""Text normalisation as Column expressions.

Rows whose characters are already in normal form are handled by JVM expressions; only the
remaining rows carry text into an Arrow UDF (the others send a null).
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Every character Python's str.split() and str.strip() treat as whitespace; Java's \s does not.
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())
WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "]"

# Arabic-block letters, digits and punctuation without combining marks, plus common quotes.
_ARABIC_SAFE = (
    r"\u060c\u061b\u061f\u0621-\u063a\u0641-\u064a\u0660-\u0669\u0671-\u0674"
    r"\u0679-\u06d3\u06f0-\u06fc\u200c\u2013\u2014\u2018\u2019\u201c\u201d"
)
# Characters on which NFC is the identity and casefold is lower() plus sharp s.
_NFC_LATIN = r"\x00-\xb4\xb6-\xff"
# Characters on which NFKC is the identity as well.
_NFKC_LATIN = r"\x00-\x7f\xc0-\xff"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once.

    The optimizer copies a projected expression into every later use of it (filters, keys,
    UDF inputs). A generated column is a plain attribute afterwards.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))


def _already_normal(c: Column, latin: str) -> Column:
    ascii_only = F.octet_length(c) == F.length(c)
    return ascii_only | c.rlike(rf"\A[{latin}]*\z") | c.rlike(rf"\A[{latin}{_ARABIC_SAFE}]*\z")


def _by_row(fn: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def apply(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else fn(v))
    return apply


def _or_python(c: Column, jvm: Column, fn: Callable[[str], str], latin: str = _NFC_LATIN) -> Column:
    return F.coalesce(_by_row(fn)(F.when(~_already_normal(c, latin), c)), jvm)


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Whitespace runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(F.translate(c, SPACES, " " * len(SPACES)), " {2,}", " "))


def _lower_ss(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def casefold(c: Column) -> Column:
    return _or_python(c, _lower_ss(c), str.casefold)


def visual_text(c: Column) -> Column:
    """NFC and collapsed whitespace; empty text stays empty."""
    return _or_python(c, collapse(c), lambda v: " ".join(unicodedata.normalize("NFC", v).split()))


def aggregation_text(c: Column) -> Column:
    """Like :func:`visual_text`, null when nothing is left."""
    return F.nullif(visual_text(c), F.lit(""))


def aggregation_key(c: Column) -> Column:
    """Case-insensitive identity of a text; empty for blank text."""
    return _or_python(
        c, _lower_ss(collapse(c)), lambda v: " ".join(unicodedata.normalize("NFC", v).split()).casefold())


benchmark_label = aggregation_key


def _ocr_row(value: str) -> str:
    clean = unicodedata.normalize("NFC", value).translate(_OCR_LETTERS)
    clean = re.sub(r"\r\n?", "\n", clean)
    kept = (re.sub(r"[\t\f\v ]+", " ", part).strip() for part in clean.split("\n"))
    return "\n".join(filter(None, kept))


# Letters unified and spaces widened by the text clean-up.
_OCR_FROM = "\u00a0\u202f\u064a\u0649\u0643"
_OCR_TO = "  \u06cc\u06cc\u06a9"
_OCR_LETTERS = str.maketrans(_OCR_FROM, _OCR_TO)


def ocr_text(c: Column) -> Column:
    """Line-preserving clean-up of recognised text; zero-width non-joiners are kept."""
    def flat(t: Column) -> Column:
        return F.regexp_replace(F.translate(t, _OCR_FROM, _OCR_TO), r"[\t\f\x0b ]+", " ")

    # Blank lines and spaces around line ends go with one pattern; a single line needs neither.
    lines = F.regexp_replace(flat(F.regexp_replace(c, r"\r\n?", "\n")), rf"{WS}*\n{WS}*", "\n")
    t = F.when(c.contains("\n") | c.contains("\r"), lines).otherwise(flat(c))
    return _or_python(c, strip(t), _ocr_row)


def policy_text(c: Column) -> Column:
    """NFKC, lower case, unified Persian letters, separators as single spaces."""
    lowered = _or_python(c, F.lower(c), lambda v: unicodedata.normalize("NFKC", v).lower(), _NFKC_LATIN)
    return collapse(F.translate(lowered, "\u064a\u0643\u200c_", "\u06cc\u06a9  "))


def contains_phrase(text: Column, phrases: tuple[str, ...] | list[str]) -> Column:
    """Any phrase present between non-word characters (Unicode word characters)."""
    body = "|".join(java_quote(p) for p in phrases)
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])")


def java_quote(text: str) -> str:
    return r"\Q" + text + r"\E"


def words(c: Column) -> Column:
    """Python's str.split(): tokens between Unicode whitespace runs, none for blank text."""
    flat = collapse(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def _ranges(points: list[int]) -> str:
    out, start, prev = [], None, None
    for p in points + [None]:
        if start is not None and (p is None or p != prev + 1):
            out.append(f"\\x{{{start:x}}}-\\x{{{prev:x}}}")
            start = None
        if p is not None:
            start = p if start is None else start
            prev = p
    return "".join(out)


@functools.lru_cache(maxsize=1)
def _script_classes() -> dict[str, str]:
    """Regex classes derived from the Unicode database by the letter/digit/script rule."""
    arabic_blocks = ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))
    found: dict[str, list[int]] = {"arabic": [], "latin": [], "digit": [], "other": []}
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        if char.isdigit():
            found["digit"].append(point)
        elif char.isalpha():
            if any(lo <= point <= hi for lo, hi in arabic_blocks):
                found["arabic"].append(point)
            elif "LATIN" in unicodedata.name(char, ""):
                found["latin"].append(point)
            else:
                found["other"].append(point)
    return {name: f"[{_ranges(points)}]" for name, points in found.items()}


def script_hint(c: Column) -> Column:
    k = _script_classes()
    return (
        F.when(c.rlike(k["arabic"]) & c.rlike(k["latin"]), "mixed_arabic_latin")
        .when(c.rlike(k["arabic"]), "arabic")
        .when(c.rlike(k["latin"]), "latin")
        .when(c.rlike(k["digit"]) & ~c.rlike(k["other"]), "numeric")
        .otherwise("other")
    )


def language_hint(script: Column) -> Column:
    return (
        F.when(script == "mixed_arabic_latin", "mixed")
        .when(script == "arabic", "fa")
        .when(script == "latin", "en")
    )


def concept_label(type_: Column, label: Column, value: Column) -> Column:
    """What an evidence row is about: recognised text and captions speak through their value."""
    speaks_by_value = (type_ == "ocr_text") | (label == "factual_caption")
    return F.when(speaks_by_value, value).otherwise(label)


def truth_value(label: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(strip(value), F.lit("")), label)


def render_prompt(template: str, label: Column) -> Column:
    """One positional ``{}`` placeholder, filled with each label."""
    if template.count("{}") != 1:
        raise ValueError("the template needs exactly one {} placeholder")
    head, tail = template.split("{}")
    return F.concat(F.lit(head), label, F.lit(tail))
