"""License scans by a positional index of rare words, in Spark expressions only.

Every template has a mandatory phrase. The phrase's rarest word over the whole
corpus (highest inverse document frequency) is its anchor: a text that holds
the phrase holds the anchor, so looking up only the anchors loses nothing. A
text's anchors give, through the postings (template, offset), the places where
the phrase would have to begin; the phrase is then verified word by word, and
the other template words are intersected by their relative positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label, mandatory phrase, template that holds the phrase.
BASE_TEMPLATES = (
    ("cc-by", "cc by", "cc by"),
    ("gpl", "general public license", "general public license"),
    ("reserved", "all rights reserved", "all rights reserved"),
)
# The method's own labels, from well-known licence notices.
TEMPLATES = (
    ("agpl", "affero general public license", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0", "cc0 1 0 universal public domain dedication"),
    ("creative-commons", "creative commons attribution", "creative commons attribution 4 0 international license"),
    ("epl", "eclipse public license", "eclipse public license v 2 0"),
    ("gpl-3.0", "general public license version 3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("spdx", "spdx license identifier", "spdx license identifier"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)
#: What stands between words: all ASCII but digits and letters (texts are lower-cased before).
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    """The lower-case words of a whole text; null has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), GAPS), "")


def _quoted(words: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _offset(phrase: list[str], whole: list[str]) -> int:
    return next(k for k in range(len(whole)) if whole[k : k + len(phrase)] == phrase)


def anchor_words(docs: DataFrame, templates, text: str = "text") -> dict[str, int]:
    """Document frequency over all texts of every word of the mandatory phrases.

    Counted per task before the shuffle; the result has at most as many rows as
    the phrases have words.
    """
    vocabulary = sorted({w for _, phrase, _ in templates for w in phrase.split()})
    found = docs.select(F.explode(F.array_distinct(F.filter(words_of(text), lambda w: w.isin(vocabulary)))).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def scan_licenses(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES) -> DataFrame:
    """``keep`` columns, n_words, and the matches of all templates with their places.

    Adds ``matches`` (array of label, base, at: the phrase's first word counted from
    0, coverage: share of the template's words in place), in order of place. A null
    or empty text has no words and no match; rows stand for themselves, so repeated
    rows repeat the result; columns not named are ignored; an empty table gives an
    empty one. Equal frequencies: the phrase's first word of them is the anchor.
    """
    every = [(*t, True) for t in BASE_TEMPLATES] + [(*t, False) for t in templates]
    frequency = anchor_words(docs, [t[:3] for t in every], text)
    postings: dict[str, list[tuple[int, int]]] = {}
    table = []
    for t, (label, phrase, whole, base) in enumerate(every):
        p, w = phrase.split(), whole.split()
        at = min(range(len(p)), key=lambda k: (frequency[p[k]], k))
        postings.setdefault(p[at], []).append((t, at))
        table.append(f"named_struct('label', '{label}', 'base', {str(base).lower()}, 'phrase', {_quoted(p)}, 'words', {_quoted(w)}, 'inside', {_offset(p, w)})")
    lists = [f"'{w}', array({', '.join(f'named_struct({chr(39)}t{chr(39)}, {t}, {chr(39)}at{chr(39)}, {at})' for t, at in hits)})" for w, hits in postings.items()]
    index, known = f"map({', '.join(lists)})", f"array({', '.join(table)})"
    anchors = ", ".join(f"'{w}'" for w in postings)
    places = f"filter(transform(_words, (w, i) -> IF(w IN ({anchors}), i, -1)), i -> i >= 0)"
    candidates = f"flatten(transform({places}, i -> transform({index}[_words[i]], p -> named_struct('t', p.t, 'at', i - p.at))))"
    verified = f"filter({candidates}, m -> m.at >= 0 AND slice(_words, m.at + 1, size({known}[m.t].phrase)) = {known}[m.t].phrase)"
    in_place = f"size(filter({known}[m.t].words, (w, k) -> get(_words, m.at - {known}[m.t].inside + k) = w)) / size({known}[m.t].words)"
    matches = (
        f"transform({verified}, m -> named_struct('at', CAST(m.at AS BIGINT), 'label', {known}[m.t].label, 'base', {known}[m.t].base, 'coverage', CAST({in_place} AS DOUBLE)))"
    )
    return docs.select(*keep, words_of(text).alias("_words")).select(
        *keep, F.size("_words").cast("bigint").alias("n_words"), F.array_sort(F.expr(matches)).alias("matches"),
    )


def license_digest(scanned: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts, places, labels and score of the matches of ``scan_licenses``."""
    base = F.filter("matches", lambda m: m["base"])
    at = F.transform(base, lambda m: m["at"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    return scanned.select(
        *keep, "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("score"),
    )


def _twin() -> str:
    rows = ", ".join(
        f"('{label}', {base}, string_split('{phrase}', ' '), string_split('{whole}', ' '), {_offset(phrase.split(), whole.split())})"
        for base, group in (("true", BASE_TEMPLATES), ("false", TEMPLATES)) for label, phrase, whole in group
    )
    return rf"""
    WITH known(label, base, phrase, whole, inside) AS (VALUES {rows}),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    m AS (SELECT doc_id, w, label, base, whole, inside, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(phrase)] = phrase)) AS place
          FROM d, known WHERE list_contains(w, phrase[1])),
    c AS (SELECT *, len(list_filter(range(len(whole)), lambda k: place - inside + k >= 0 AND w[place - inside + k + 1] = whole[k + 1])) / len(whole)::DOUBLE AS coverage FROM m),
    g AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM c GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
    FROM d LEFT JOIN g USING (doc_id)"""


SQL = _twin()
