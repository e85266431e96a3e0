"""SQL fragments shared by the SQL twins of the queries."""

from __future__ import annotations

from quire import fixed_values as V

BLANKS = r"E' \n\t\r'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w_: w_ <> '')"


def sentences(x: str) -> str:
    return f"string_split_regex({x}, '[.!?]+')"


def any_contained(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {quote(n)})" for n in needles) + ")"


def any_match(x: str, patterns) -> str:
    return f"regexp_matches({x}, {quote('|'.join(f'(?:{p})' for p in patterns))})"


def in_list(options) -> str:
    return "(" + ", ".join(quote(o) for o in options) + ")"


def text_list(options) -> str:
    return "[" + ", ".join(quote(o) for o in options) + "]"


def count_text(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {quote(needle)}, ''))) // {len(needle)})"


def normalize(x: str) -> str:
    drop = r"\b(?:[a-z]{1,2}|" + "|".join(V.STOPWORDS) + r")\b"
    return (
        rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z\s]', ' ', 'g'), "
        rf"'{drop}', ' ', 'g'), '\s+', ' ', 'g'))"
    )


def jaccard_lists(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    shared = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"(CASE WHEN {union} > 0 THEN {shared}::DOUBLE / {union} ELSE 0.0 END)"


def truncate_sentences(x: str, n) -> str:
    fold = (
        "list_reduce(list_prepend({'t': '', 'full': false}, "
        f"list_transform({sentences(x)}, lambda s_: {{'t': s_, 'full': false}})), "
        f"lambda a_, b_: CASE WHEN a_.full OR length(a_.t) + length(b_.t) > {n} "
        "THEN {'t': a_.t, 'full': true} ELSE {'t': a_.t || b_.t || '. ', 'full': false} END).t"
    )
    whole = strip(fold)
    return (
        f"(CASE WHEN length({x}) <= {n} THEN {x} WHEN {whole} <> '' THEN {whole} "
        f"ELSE substr({x}, 1, {n}) || '...' END)"
    )


def key_sentences(x: str, k: int) -> str:
    ranked = (
        f"list_sort(list_transform({sentences(x)}, lambda s_, i_: {{'n': -length(s_), 'i': i_, 's': s_}}))"
    )
    return f"(array_to_string(list_transform({ranked}[1:{k}], lambda r_: r_.s), '. ') || '.')"


def dedupe_sentences(x: str) -> str:
    kept = f"list_filter(list_transform({sentences(x)}, lambda s_: {strip('s_')}), lambda s_: length(s_) > 10)"
    key = "substr(lower(s_), 1, 50)"
    keys = f"list_transform({kept}, lambda s_: {key})"
    return f"(array_to_string(list_filter({kept}, lambda s_, i_: list_position({keys}, {key}) = i_), '. ') || '.')"


def content_quality(x: str) -> str:
    total = f"len({words(x)})"
    variety = f"len(list_distinct({words(f'lower({x})')}))"
    found = " + ".join(f"contains(lower({x}), {quote(w)})::INT" for w in V.QUALITY_WORDS)
    return (
        f"(CASE WHEN length({x}) = 0 THEN 0.0 ELSE least(1.0, least(1.0, length({x}) / 2000.0::DOUBLE) * 0.3::DOUBLE + "
        f"least(1.0, {variety}::DOUBLE / greatest({total}, 1)) * 0.3::DOUBLE + (({found}) / 5.0::DOUBLE) * 0.4::DOUBLE) END)"
    )


def name_terms(x: str) -> str:
    return f"list_distinct({words(f'''replace(translate(lower({x}), '_-', '  '), '.pdf', '')''')})"


def percent(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f%%', {x} * 100)"


def pair_summary(a: str, b: str, sim: str, rel: str) -> str:
    shared = (
        f"list_sort(list_filter(list_intersect({name_terms(a)}, {name_terms(b)}), "
        f"lambda t_: t_ NOT IN {in_list(V.PAIR_SUMMARY_STOPWORDS)} AND length(t_) > 2))"
    )
    topics = f"array_to_string({shared}[1:3], ', ')"
    return (
        f"('Documents are ' || CASE {rel} WHEN 'highly_similar' THEN 'highly similar' WHEN 'similar_to' THEN 'moderately similar' ELSE 'somewhat related' END"
        f" || ' (' || {percent(sim)} || ' similarity) with ' || "
        f"CASE {rel} WHEN 'highly_similar' THEN 'strong' WHEN 'similar_to' THEN 'moderate' ELSE 'weak' END || ' confidence. ' || "
        f"CASE WHEN {topics} <> '' THEN 'They share common topics: ' || {topics} || '.' ELSE 'They likely share underlying themes or methodologies.' END)"
    )


def relationship_text(a: str, b: str, sim: str) -> str:
    topic = " ".join(
        f"WHEN contains(lower({a}), {quote(k)}) AND contains(lower({b}), {quote(k)}) THEN ' both focusing on {k}-related topics'"
        for k in V.RELATIONSHIP_KEYWORDS
    )
    return (
        f"('These documents are ' || CASE WHEN {sim} > 0.8 THEN 'highly related' WHEN {sim} > 0.7 THEN 'similar' ELSE 'related' END"
        f" || ' with ' || {percent(sim, 0)} || ' similarity' || CASE {topic} ELSE '' END || "
        "'. They likely share common methodologies, theoretical frameworks, or application domains based on semantic analysis.')"
    )


def grade(x: str) -> str:
    return "(CASE " + " ".join(f"WHEN {x} >= {f} THEN '{g}'" for f, g in V.GRADES) + " ELSE 'F' END)"


def is_upper(x: str) -> str:
    return rf"(regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]'))"


def is_title(x: str) -> str:
    cased = r"[\p{Lu}\p{Ll}\p{Lt}]"
    return (
        rf"(regexp_matches({x}, '{cased}') AND NOT regexp_matches({x}, "
        rf"'{cased}[\p{{Lu}}\p{{Lt}}]|(?:^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}'))"
    )


def strip_accents_lower(x: str) -> str:
    return f"translate(lower({x}), '{V.MARKED_LETTERS}', '{V.PLAIN_LETTERS}')"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex({strip_accents_lower(x)}, '[^\p{{L}}\p{{N}}]+'), lambda w_: w_ <> '')"


def _numbering_cases(x: str):
    from quire.functions import headings as H

    letter = f"regexp_extract({x}, '{H.LETTER}', 1)"
    inner = f"regexp_extract({x}, '{H.PAREN}', 1)"
    multi = f"regexp_extract({x}, '{H.MULTI_DECIMAL}', 1)"
    return [
        (H.MULTI_DECIMAL, "'decimal'", multi, count_text(multi, ".") + " + 1"),
        (H.SIMPLE_DOT, "'decimal'", f"regexp_extract({x}, '{H.SIMPLE_DOT}', 1)", "1"),
        (H.SIMPLE, "'decimal'", f"regexp_extract({x}, '{H.SIMPLE}', 1)", "1"),
        (H.ROMAN, "'roman'", f"regexp_extract({x}, '{H.ROMAN}', 1)", "1"),
        (H.LETTER, "'letter'", letter, f"CASE WHEN regexp_matches({letter}, '[A-Z]') THEN 2 ELSE 3 END"),
        (H.MIXED, "'mixed'", f"regexp_extract({x}, '{H.MIXED}', 1)", "3"),
        (H.PAREN, "'parenthetical'", f"'(' || {inner} || ')'", f"CASE WHEN regexp_matches({inner}, '^[0-9]+$') THEN 3 ELSE 4 END"),
    ]


def numbering(x: str, part: str) -> str:
    """CASE for one of type, pattern, depth of a stripped line."""
    at = {"type": 1, "pattern": 2, "depth": 3}[part]
    return "(CASE " + " ".join(f"WHEN regexp_matches({x}, '{c[0]}') THEN {c[at]}" for c in _numbering_cases(x)) + " END)"


def is_numbered(x: str) -> str:
    from quire.functions.headings import ANY_NUMBERING

    return any_match(x, ANY_NUMBERING)


def is_body_like(x: str) -> str:
    return f"({count_text(x, '.')} > 2 OR {count_text(x, ',')} > 4 OR len({words(x)}) > 20 OR length({x}) > 150)"


def ends_any(x: str, marks: str) -> str:
    return f"(right({x}, 1) IN {in_list(marks)})"
