"""Tests on one line of text: numbering, running heads, heading likeness."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import (
    col, contains_any, count_text, ends_with_any, is_title, is_upper, matches_any,
    strip, whole_word, words,
)

MULTI_DECIMAL = r"^(\d+\.\d+(?:\.\d+)*)\s+"
SIMPLE_DOT = r"^(\d+)\.\s+"
SIMPLE = r"^(\d+)\s+[A-Z]"
ROMAN = r"^([IVX]+)\.\s+"
LETTER = r"^([A-Za-z])\.\s+"
MIXED = r"^(\d+\.[A-Za-z])\s+"
PAREN = r"^\(([0-9a-zA-Z]+)\)\s+"


def numbering(c) -> Column:
    """Struct of type, pattern and depth for a numbered line; NULL otherwise.

    Seven forms are tried in order: 1.1.1, 1., 1 X, IV., A., 1.a, (a).
    """
    text = strip(c)

    def part(pattern):
        return F.regexp_extract(text, pattern, 1)

    def entry(kind, pattern, depth):
        return F.struct(F.lit(kind).alias("type"), pattern.alias("pattern"), depth.cast("int").alias("depth"))

    letter, inner = part(LETTER), part(PAREN)
    return (
        F.when(text.rlike(MULTI_DECIMAL), entry("decimal", part(MULTI_DECIMAL), count_text(part(MULTI_DECIMAL), ".") + 1))
        .when(text.rlike(SIMPLE_DOT), entry("decimal", part(SIMPLE_DOT), F.lit(1)))
        .when(text.rlike(SIMPLE), entry("decimal", part(SIMPLE), F.lit(1)))
        .when(text.rlike(ROMAN), entry("roman", part(ROMAN), F.lit(1)))
        .when(text.rlike(LETTER), entry("letter", letter, F.when(letter.rlike("[A-Z]"), 2).otherwise(3)))
        .when(text.rlike(MIXED), entry("mixed", part(MIXED), F.lit(3)))
        .when(
            text.rlike(PAREN),
            entry("parenthetical", F.concat(F.lit("("), inner, F.lit(")")), F.when(inner.rlike("^[0-9]+$"), 3).otherwise(4)),
        )
    )


ANY_NUMBERING = [MULTI_DECIMAL, SIMPLE_DOT, SIMPLE, ROMAN, LETTER, MIXED, PAREN]


def is_numbered(c) -> Column:
    return matches_any(strip(c), ANY_NUMBERING)


def is_running_text(c) -> Column:
    """Header or footer by key words."""
    return contains_any(F.lower(col(c)), V.RUNNING_WORDS)


def is_running_line(c) -> Column:
    """Header or footer by patterns such as page numbers and dates."""
    return matches_any(F.lower(col(c)), V.RUNNING_PATTERNS)


def is_form_field(c) -> Column:
    return matches_any(col(c), V.FORM_FIELD_PATTERNS)


def is_likely_heading(c) -> Column:
    """Short, titled, numbered or section-named text that is not furniture."""
    c = col(c)
    low = F.lower(c)
    rejected = (F.length(c) > 200) | matches_any(low, V.NOT_A_HEADING_PATTERNS)
    accepted = (
        contains_any(low, V.SECTION_WORDS)
        | is_title(c) | is_upper(c)
        | c.rlike(r"^\d+\.?\s+[\p{L}\p{N}_]+")
        | (F.size(words(c)) <= 10)
    )
    return ~rejected & accepted


def is_body_like(c) -> Column:
    """Too many stops, commas, words or characters for a heading."""
    c = col(c)
    return (count_text(c, ".") > 2) | (count_text(c, ",") > 4) | (F.size(words(c)) > 20) | (F.length(c) > 150)


def is_definite_body(c) -> Column:
    c = col(c)
    return (
        (F.length(c) > 50) | (count_text(c, ".") > 1) | (count_text(c, ",") > 2)
        | (F.size(words(c)) > 15) | F.lower(c).rlike(whole_word(V.BODY_WORDS))
    )


def matches_heading_pattern(c) -> Column:
    return matches_any(strip(c), V.HEADING_PATTERNS)


def ends_sentence(c) -> Column:
    return ends_with_any(c, ".!?")
