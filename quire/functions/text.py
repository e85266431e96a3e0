"""Scalar text functions as Column expressions.

Array lambdas leave whole-stage code generation, so they are used only where a
function needs positions or an ordered fold; word work goes through regular
expressions and the built-in array set functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import fixed_values as V

WHITESPACE = " \t\n\r\f\x0b"
SENTENCE_END = "[.!?]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Name a value inside an expression so that it is computed once per row."""
    return F.transform(F.array(value), body)[0]


def strip(c) -> Column:
    """Trim blanks of every kind from both ends."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def words(c) -> Column:
    """Blank-separated words, in order, repeats kept."""
    return F.array_remove(F.split(col(c), r"\s+"), "")


def head(c, n) -> Column:
    return F.substring(col(c), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def contains_any(c, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | col(c).contains(needle)
    return out


def matches_any(c, patterns) -> Column:
    """True when one of the patterns is found; one alternation, one scan."""
    return col(c).rlike("|".join(f"(?:{p})" for p in patterns))


def whole_word(options) -> str:
    """A pattern for whole words where accented letters also count as letters."""
    return r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(options) + r")(?:[^\p{L}\p{N}_]|$)"


def count_text(c, needle: str) -> Column:
    """Occurrences of a literal that do not overlap."""
    c = col(c)
    return ((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def is_upper(c) -> Column:
    return col(c).rlike(r"\p{Lu}") & ~col(c).rlike(r"[\p{Ll}\p{Lt}]")


def is_title(c) -> Column:
    """Capital letters only at word starts, small letters never there."""
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return col(c).rlike(cased) & ~col(c).rlike(
        rf"{cased}[\p{{Lu}}\p{{Lt}}]|(?:^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}"
    )


def starts_upper(c) -> Column:
    return col(c).rlike(r"^\p{Lu}")


def starts_lower(c) -> Column:
    return col(c).rlike(r"^\p{Ll}")


def ends_with_any(c, marks) -> Column:
    return F.right(col(c), F.lit(1)).isin(list(marks)) & (F.length(col(c)) > 0)


# --- normalisation and similarity -------------------------------------------

def normal_words(c) -> Column:
    """Lower-case words of letters only, without stopwords and very short ones."""
    spaced = F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z]+", " "))
    return F.filter(
        F.split(spaced, " "), lambda w: (F.length(w) >= V.MIN_WORD_LENGTH) & ~w.isin(V.STOPWORDS)
    )


def normalize_text(c) -> Column:
    """Lower case, letters only, stopwords and very short words dropped.

    Words are tested against a set; one pattern with every stopword costs
    several times as much.
    """
    return F.array_join(normal_words(c), " ")


def jaccard_words(a, b) -> Column:
    """Set similarity of two word arrays; 0 when both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    shared = F.size(F.array_intersect(col(a), col(b)))
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def jaccard(a, b) -> Column:
    return jaccard_words(words(a), words(b))


def dot(u, v) -> Column:
    return F.aggregate(
        F.zip_with(col(u), col(v), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine(u, v) -> Column:
    norms = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norms > 0, dot(u, v) / norms).otherwise(F.lit(0.0))


def length_ratio(a, b) -> Column:
    """Shorter over longer; 0 when either is empty. Takes lengths."""
    low, high = F.least(col(a), col(b)), F.greatest(col(a), col(b))
    return F.when(low > 0, low / high).otherwise(F.lit(0.0))


# --- cutting text to size ----------------------------------------------------

def truncate_ellipsis(c, n: int, kept: int | None = None) -> Column:
    """First characters plus dots, only when the text is longer than ``n``."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(head(c, kept or n), F.lit("..."))).otherwise(c)


def truncate_sentences(c, n) -> Column:
    """Whole sentences up to the limit; a hard cut when not even one fits."""
    c = col(c)
    limit = n if isinstance(n, Column) else F.lit(n)
    folded = F.aggregate(
        F.split(c, SENTENCE_END),
        F.struct(F.lit("").alias("text"), F.lit(False).alias("full")),
        lambda s, x: F.when(
            s["full"] | (F.length(s["text"]) + F.length(x) > limit),
            F.struct(s["text"].alias("text"), F.lit(True).alias("full")),
        ).otherwise(F.struct(F.concat(s["text"], x, F.lit(". ")).alias("text"), F.lit(False).alias("full"))),
    )["text"]
    whole = strip(folded)
    return (
        F.when(F.length(c) <= limit, c)
        .when(whole != "", whole)
        .otherwise(F.concat(head(c, limit.cast("int")), F.lit("...")))
    )


def key_sentences(c, k: int) -> Column:
    """The ``k`` longest sentences, longest first, earlier first on ties."""
    ranked = F.array_sort(
        F.transform(
            F.split(col(c), SENTENCE_END),
            lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s")),
        )
    )
    return F.concat(F.array_join(F.transform(F.slice(ranked, 1, k), lambda r: r["s"]), ". "), F.lit("."))


def dedupe_sentences(c) -> Column:
    """Drop fragments and sentences whose opening was already seen."""
    sentences = F.filter(
        F.transform(F.split(col(c), SENTENCE_END), lambda s: strip(s)),
        lambda s: F.length(s) > 10,
    )
    tagged = F.transform(sentences, lambda s: F.struct(head(F.lower(s), 50).alias("key"), s.alias("text")))
    kept = let(
        tagged,
        lambda ts: let(
            F.transform(ts, lambda t: t["key"]),
            lambda keys: F.filter(ts, lambda t, i: F.array_position(keys, t["key"]) == i + 1),
        ),
    )
    return F.concat(F.array_join(F.transform(kept, lambda t: t["text"]), ". "), F.lit("."))


def estimate_tokens(c) -> Column:
    return F.floor(F.length(col(c)) / 4).cast("int")


def fit_tokens(c, n: int) -> Column:
    """Cut by sentences in proportion to how far the estimate overshoots."""
    c = col(c)
    estimate = estimate_tokens(c)
    target = F.floor(F.length(c) * (F.lit(float(n)) / F.greatest(estimate, F.lit(1)))).cast("int")
    return F.when(estimate <= n, c).otherwise(truncate_sentences(c, target))


def strip_fillers(c) -> Column:
    """Drop filler words, then shorten the known long phrases in turn."""
    fillers = [w for w in V.FILLER_WORDS if " " not in w]
    out = F.array_join(F.filter(words(c), lambda w: ~F.lower(w).isin(fillers)), " ")
    for long, short in V.SHORT_PHRASES:
        out = F.replace(out, F.lit(long), F.lit(short))
    return out


# --- hashes -------------------------------------------------------------------

def content_hash(c) -> Column:
    """Fingerprint from the opening and the full length."""
    return F.md5(F.concat(head(c, 1000), F.lit("__LEN_"), F.length(col(c)).cast("string")))


def pair_hash(a, b) -> Column:
    return F.md5(F.concat_ws("_", col(a), col(b)))


def embedding_key(model: str, c) -> Column:
    return F.md5(F.concat(F.lit(f"{model}:"), col(c)))


# --- measures -------------------------------------------------------------------

def content_quality(c) -> Column:
    """Length, word variety and section words, from 0 to 1."""
    c = col(c)
    length_part = F.least(F.lit(1.0), F.length(c) / 2000.0)
    total = F.size(words(c))
    variety = F.size(F.array_distinct(words(F.lower(c)))) / F.greatest(total, F.lit(1))
    lowered = F.lower(c)
    found = sum((lowered.contains(w).cast("int") for w in V.QUALITY_WORDS), F.lit(0))
    score = length_part * 0.3 + F.least(F.lit(1.0), variety) * 0.3 + (found / len(V.QUALITY_WORDS)) * 0.4
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), score))


def text_properties(c) -> Column:
    return F.struct(F.length(col(c)).alias("length"), F.size(words(c)).alias("word_count"))


def display_page(p, clamp: bool = False) -> Column:
    """0-based page to 1-based; optionally limited to 0..100 first."""
    p = col(p)
    return (F.greatest(F.lit(0), F.least(p, F.lit(100))) if clamp else p) + 1


def spoken_duration(c) -> Column:
    """Reading time at 0.6 s a word, as minutes and seconds."""
    seconds = F.floor(F.size(words(c)) * 0.6).cast("int")
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def collapse_repeats(c) -> Column:
    """Overprinted text: runs of one character, or one letter set apart, to one."""
    runs = F.regexp_replace(col(c), r"(.)\1{2,}", "$1")
    return F.regexp_replace(runs, r"([\p{L}\p{N}_])\s+\1(\s+\1)+", "$1")


def clean_heading(c) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(c), r"\s+", " "), r":\s*$", "")


def clean_title(c) -> Column:
    spaced = F.regexp_replace(strip(c), r"\s+", " ")
    return F.regexp_replace(spaced, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_\s.!?:-]+$", "")


# --- names and pairs ------------------------------------------------------------

def name_terms(c) -> Column:
    """The set of words in a file name."""
    name = F.translate(F.lower(col(c)), "_-", "  ")
    return F.array_distinct(words(F.replace(name, F.lit(".pdf"), F.lit(""))))


def percent(c, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(c) * 100)


def pair_summary(a, b, similarity, relationship) -> Column:
    """A sentence on how strongly two documents relate and what they share."""
    r = col(relationship)
    strength = (
        F.when(r == "highly_similar", "highly similar")
        .when(r == "similar_to", "moderately similar")
        .otherwise("somewhat related")
    )
    confidence = (
        F.when(r == "highly_similar", "strong").when(r == "similar_to", "moderate").otherwise("weak")
    )
    shared = F.array_sort(
        F.filter(
            F.array_intersect(name_terms(a), name_terms(b)),
            lambda t: ~t.isin(V.PAIR_SUMMARY_STOPWORDS) & (F.length(t) > 2),
        )
    )
    topics = F.array_join(F.slice(shared, 1, 3), ", ")
    ending = F.when(
        topics != "", F.concat(F.lit("They share common topics: "), topics, F.lit("."))
    ).otherwise("They likely share underlying themes or methodologies.")
    return F.concat(
        F.lit("Documents are "), strength, F.lit(" ("), percent(similarity),
        F.lit(" similarity) with "), confidence, F.lit(" confidence. "), ending,
    )


def relationship_text(a, b, similarity) -> Column:
    """The plain sentence used when no richer description is available."""
    s, low_a, low_b = col(similarity), F.lower(col(a)), F.lower(col(b))
    kind = F.when(s > 0.8, "highly related").when(s > 0.7, "similar").otherwise("related")
    topic = F.coalesce(
        *[F.when(low_a.contains(k) & low_b.contains(k), F.lit(k)) for k in V.RELATIONSHIP_KEYWORDS]
    )
    hint = F.coalesce(F.concat(F.lit(" both focusing on "), topic, F.lit("-related topics")), F.lit(""))
    return F.concat(
        F.lit("These documents are "), kind, F.lit(" with "), percent(s, 0), F.lit(" similarity"), hint,
        F.lit(". They likely share common methodologies, theoretical frameworks, or application domains based on semantic analysis."),
    )


def grade(score) -> Column:
    out = None
    for floor, letter in V.GRADES:
        test = col(score) >= floor
        out = F.when(test, letter) if out is None else out.when(test, letter)
    return out.otherwise("F")


# --- model answers ----------------------------------------------------------------

def json_body(c) -> Column:
    """The JSON part of a model answer: fences removed, cut to the outer braces."""
    c = col(c)
    kept = F.transform(
        F.split(c, r"(?m)^[ \t]*```[^\n]*\n?"),
        lambda part, i: F.when(i % 2 == 1, part).otherwise(
            F.array_join(
                F.filter(F.split(part, "\n"), lambda line: strip(line).rlike(r'^[{"]')), "\n"
            )
        ),
    )
    text = F.when(c.contains("```"), F.array_join(kept, "\n")).otherwise(c)
    start = F.instr(text, "{")
    end = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inside = (start > 0) & F.contains(text, F.lit("}")) & (end > start)
    return F.when(inside, F.substring(text, start, end - start + 1)).otherwise(text)


def parse_model_json(c, selected_text) -> Column:
    """Model answer to a struct of insight fields, defaults where it does not parse."""
    fields = ["summary", *V.INSIGHT_DEFAULTS]
    schema = ", ".join(f"{f} STRING" for f in fields)
    fallback = {
        "summary": F.concat(F.lit("Analysis of selected text: "), head(selected_text, 200), F.lit("...")),
        **{k: F.lit(v) for k, v in V.INSIGHT_DEFAULTS.items()},
    }

    def filled(parsed: Column) -> Column:
        failed = parsed.isNull() | F.coalesce(*[parsed[f] for f in fields]).isNull()
        return F.struct(*[F.when(failed, fallback[f]).otherwise(parsed[f]).alias(f) for f in fields])

    return let(F.from_json(json_body(c), schema), filled)


def batch_answers(c, n) -> Column:
    """A JSON list with at least ``n`` answers as an array; else the text ``n`` times."""
    n = n if isinstance(n, Column) else F.lit(n)
    parsed = F.from_json(col(c), "array<string>")
    return F.when(parsed.isNotNull() & (F.size(parsed) >= n), F.slice(parsed, F.lit(1), n)).otherwise(
        F.array_repeat(col(c), n)
    )


def clean_answer(c, sources=None) -> Column:
    """Bullets instead of markdown stars, source list at the end."""
    body = F.replace(F.replace(col(c), F.lit("**"), F.lit("")), F.lit("*"), F.lit("•"))
    if sources is None:
        return body
    listed = F.array_join(col(sources), "\n")
    return F.when(F.size(col(sources)) > 0, F.concat(body, F.lit("\n\nSources:\n"), listed)).otherwise(body)
