"""Lines, titles and outlines over all documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import strip, whole_word
from quire.operators import outline as L
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.registry import Registry
from quire.plans.text_queries import LIKELY_HEADING
from quire.session import cut_lineage

registry = Registry()


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def keyed(df, *columns):
    return df.select("doc_id", big("line_no").alias("line_no"), *columns)


# --- characters --------------------------------------------------------------------

_PLACED = f"""{X.CHARS}, jumps AS (SELECT *, coalesce(abs(top - lag(top) OVER w) > 3, false)::INT AS j FROM chars WINDOW w AS (PARTITION BY doc_id, page ORDER BY top, x0, text)),
placed AS (SELECT *, sum(j) OVER (PARTITION BY doc_id, page ORDER BY top, x0, text ROWS UNBOUNDED PRECEDING) AS char_line FROM jumps)"""


@registry.add(
    "chars_to_lines",
    f"WITH {_PLACED} SELECT doc_id, page::BIGINT AS page, char_line::BIGINT AS line_no, count(*) AS chars, min(x0) AS x0, max(x1) AS x1, min(top) AS top FROM placed GROUP BY ALL",
)
def _(spark, folder):
    placed = L.chars_to_lines(X.chars(spark, folder))
    return placed.groupBy("doc_id", big("page").alias("page"), big("line_no").alias("line_no")).agg(
        F.count("*").alias("chars"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top")
    )


@registry.add(
    "line_metrics",
    rf"""WITH {_PLACED}, spaced AS (SELECT *, lag(x1) OVER w AS px1, lag(x0) OVER w AS px0, lag(text) OVER w AS pt FROM placed WINDOW w AS (PARTITION BY doc_id, page, char_line ORDER BY x0, text, x1)),
    built AS (SELECT doc_id, page, char_line, trim(string_agg(CASE WHEN x0 - px1 > 3 THEN ' ' ELSE '' END || text, '' ORDER BY x0, text, x1)) AS raw_text,
      avg(size) AS font_size, avg((contains(lower(fontname), 'bold'))::INT) > 0.5 AS is_bold, avg(x0) AS l, greatest(max(x0), max(x1)) - least(min(x0), min(x1)) AS w,
      avg(top) AS y_position, avg(height) AS height FROM spaced GROUP BY ALL)
    SELECT doc_id, page::BIGINT AS page, char_line::BIGINT AS line_no, raw_text, round(font_size, 6) AS font_size, is_bold,
      CASE WHEN l < w * 0.15 THEN 'left' WHEN l > w * 0.7 THEN 'right' ELSE 'center' END AS position, round(y_position, 6) AS y_position, height FROM built""",
)
def _(spark, folder):
    m = L.line_metrics(L.chars_to_lines(X.chars(spark, folder)))
    return m.select(
        "doc_id", big("page").alias("page"), big("line_no").alias("line_no"), "raw_text", F.round("font_size", 6).alias("font_size"),
        "is_bold", "position", F.round("y_position", 6).alias("y_position"), "height",
    )


@registry.add(
    "font_stats",
    f"WITH {X.CHARS} SELECT doc_id, page::BIGINT AS page, round(avg(size), 6) AS avg_size, max(size) AS max_size, round(avg(contains(lower(fontname), 'bold')::INT), 6) AS bold_ratio FROM chars GROUP BY ALL",
)
def _(spark, folder):
    return L.font_stats(X.chars(spark, folder)).select(
        "doc_id", big("page").alias("page"), F.round("avg_size", 6).alias("avg_size"), "max_size", F.round("bold_ratio", 6).alias("bold_ratio")
    )


# --- fonts ------------------------------------------------------------------------------

FONTS = f"""{X.LINES}, font_lines AS (SELECT *, round(font_size, 1) AS font FROM lines WHERE length(text) >= 3),
font_use AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, first) AS r FROM (
  SELECT doc_id, font, is_bold, count(*) AS uses, min(line_no) AS first FROM font_lines GROUP BY ALL)),
fonts AS (SELECT u.doc_id, u.font, u.is_bold, u.uses, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.r) AS level, b.font AS body FROM font_use u
  JOIN font_use b ON b.doc_id = u.doc_id AND b.r = 1 WHERE u.font > b.font OR (u.font = b.font AND u.is_bold AND NOT b.is_bold))"""


@registry.add("body_and_heading_fonts", f"WITH {FONTS} SELECT doc_id, font, is_bold, uses, level, body FROM fonts")
def _(spark, folder):
    f = L.body_and_heading_fonts(X.lines(spark, folder))
    return f.select("doc_id", "font", "is_bold", "uses", big("level").alias("level"), "body")


_BY_FONT = f"""{FONTS}, by_font AS (SELECT l.doc_id, page, line_no, level, text FROM font_lines l JOIN fonts f ON f.doc_id = l.doc_id AND f.font = l.font AND f.is_bold = l.is_bold
  WHERE level <= 6 AND {LIKELY_HEADING})"""


@registry.add("outline_by_font", f"WITH {_BY_FONT} SELECT doc_id, line_no, page::BIGINT AS page, level, text FROM by_font")
def _(spark, folder):
    return keyed(L.outline_by_font(X.lines(spark, folder)), big("page").alias("page"), big("level").alias("level"), "text")


# A table of contents of the numbered lines, for documents that have any.
@registry.add(
    "outline_from_toc",
    rf"""WITH {_BY_FONT}, toc AS (SELECT doc_id, line_no, page, {S.numbering(S.strip('text'), 'depth')} AS level, text FROM lines WHERE {S.is_numbered(S.strip('text'))}),
    big_toc AS (SELECT doc_id FROM toc GROUP BY 1 HAVING count(*) > 2)
    SELECT doc_id, line_no, page::BIGINT AS page, level::BIGINT AS level, {S.strip('text')} AS text FROM toc WHERE doc_id IN (SELECT doc_id FROM big_toc)
    UNION ALL SELECT doc_id, line_no, page, level, text FROM by_font WHERE doc_id NOT IN (SELECT doc_id FROM big_toc)""",
)
def _(spark, folder):
    lines = X.lines(spark, folder)
    toc = lines.withColumn("level", L.numbering("text")["depth"]).where("level is not null").select(
        "doc_id", F.col("line_no").alias("entry_no"), "level", F.col("text").alias("title"), (F.col("page") + 1).alias("page")
    )
    return keyed(L.outline_from_toc(toc, lines), big("page").alias("page"), big("level").alias("level"), "text")


@registry.add(
    "title_by_font",
    f"""WITH {X.LINES}, first AS (SELECT doc_id, line_no, {S.strip('text')} AS t, font_size FROM lines WHERE page = 0 AND length({S.strip('text')}) > 3),
    largest AS (SELECT f.* FROM first f JOIN (SELECT doc_id, max(font_size) AS m FROM first GROUP BY 1) x ON x.doc_id = f.doc_id AND x.m = f.font_size),
    found AS (SELECT doc_id, arg_min(t, line_no) FILTER (length(t) > 10 AND NOT {S.any_contained('lower(t)', V.RUNNING_WORDS)}) AS good, arg_min(t, line_no) AS any_title FROM largest GROUP BY 1),
    given AS (SELECT l.doc_id, b.text AS title FROM labels l JOIN benchmark b ON b.item_id = l.doc_id WHERE l.quality = 1)
    SELECT coalesce(f.doc_id, g.doc_id) AS doc_id, coalesce({S.strip('g.title')}, good, any_title) AS title FROM found f FULL JOIN given g ON g.doc_id = f.doc_id""",
)
def _(spark, folder):
    labels = X.table(spark, folder, "labels").where("quality = 1")
    given = X.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("title"))
    return L.title_by_font(X.lines(spark, folder), labels.join(given, "doc_id").select("doc_id", "title"))


# --- titles ----------------------------------------------------------------------------------

def _fits(t):
    return f"(NOT {S.any_match(f'lower({t})', V.RUNNING_PATTERNS)} AND NOT {S.any_match(t, V.FORM_FIELD_PATTERNS)})"


SPACED = f"""ln AS (SELECT * REPLACE (text AS text), {S.strip('text')} AS t FROM lines),
paged AS (SELECT *, row_number() OVER w AS place, lag(t) OVER w AS before, lead(t) OVER w AS after,
  coalesce(abs(y_position - (lag(y_position) OVER w + lag(height) OVER w)), 'inf'::DOUBLE) AS above,
  coalesce(abs(lead(y_position) OVER w - (y_position + height)), 'inf'::DOUBLE) AS below FROM ln WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))"""
_CLEAN = r"regexp_replace(regexp_replace({0}, '\s+', ' ', 'g'), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s.!?:-]+$', '', 'g')"
CANDIDATE_TITLES = f"""{X.LINES}, {SPACED}, top_lines AS (SELECT *, {_fits('t')} AS fits, length(t) AS n FROM paged WHERE page = 0 AND place <= 15),
cands AS (
  SELECT doc_id, 'max_font' AS method, 0.9::DOUBLE AS confidence, arg_min(t, (-font_size, place)) AS text FROM top_lines WHERE n > 3 AND n < 200 AND fits GROUP BY 1
  UNION ALL SELECT doc_id, 'pattern', 0.8, arg_min(t, place) FROM top_lines WHERE place <= 10 AND n > 10 AND n < 100 AND fits AND {S.any_match('t', V.TITLE_PATTERNS)} GROUP BY 1
  UNION ALL SELECT doc_id, 'context', 0.7, arg_min(t, place) FROM top_lines WHERE place <= 10 AND n > 5 AND n < 150 AND fits AND above > 25 AND below > 15 GROUP BY 1
  UNION ALL SELECT doc_id, 'center', 0.6, arg_min(t, place) FROM top_lines WHERE place <= 10 AND n > 5 AND n < 150 AND fits AND position = 'center' GROUP BY 1),
titles AS (SELECT d.doc_id, coalesce({_CLEAN.format('c.text')}, '') AS title, method, confidence FROM (SELECT DISTINCT doc_id FROM lines) d
  LEFT JOIN (SELECT doc_id, arg_max(text, confidence) AS text, arg_max(method, confidence) AS method, max(confidence) AS confidence FROM cands GROUP BY 1) c USING (doc_id))"""


@registry.add("title_candidates", f"WITH {CANDIDATE_TITLES} SELECT doc_id, method, confidence, text FROM cands")
def _(spark, folder):
    return L.title_candidates(X.lines(spark, folder)).select("doc_id", "method", "confidence", "text")


@registry.add("best_title", f"WITH {CANDIDATE_TITLES} SELECT doc_id, title, method, confidence FROM titles")
def _(spark, folder):
    t = L.best_title(X.lines(spark, folder))
    return t.select("doc_id", "title", F.col("title_method").alias("method"), F.col("title_confidence").alias("confidence"))


@registry.add("best_title_multiline")
def _(spark, folder):
    return L.best_title(X.lines(spark, folder), multiline=True).select("doc_id", "title", "title_method")


@registry.add(
    "prominent_line_groups",
    f"""WITH {X.LINES}, {SPACED}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY font_size DESC, place) AS r, count(*) OVER (PARTITION BY doc_id) AS c
       FROM paged WHERE page = 0 AND place <= 15 AND t <> ''),
    lim AS (SELECT doc_id, font_size AS lim FROM f WHERE r = greatest(c // 5, 1)),
    kept AS (SELECT f.* FROM f JOIN lim USING (doc_id) WHERE length(t) > 2 AND length(t) < 200 AND font_size >= lim AND {_fits('t')}),
    marked AS (SELECT *, coalesce((abs(y_position - lag(y_position) OVER (PARTITION BY doc_id ORDER BY place)) >= 30)::INT, 0) AS new FROM kept),
    grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS group_no FROM marked)
    SELECT doc_id, group_no::BIGINT AS group_no, count(*) AS line_count, {_CLEAN.format("string_agg(t, ' ' ORDER BY place)")} AS text, round((avg(font_size) * 0.5
      + CASE WHEN bool_and(position = 'center') THEN 15 WHEN bool_and(position = 'left') THEN 5 ELSE 0 END
      + CASE WHEN bool_and(is_bold) THEN 10 WHEN NOT bool_or(is_bold) THEN 5 ELSE 0 END
      + CASE WHEN count(*) = 1 THEN -5 WHEN count(*) IN (2, 3) THEN 8 WHEN count(*) = 4 THEN 3 ELSE -10 END
      + CASE WHEN max(font_size) - min(font_size) <= 1 THEN 8 WHEN max(font_size) - min(font_size) <= 2 THEN 4 ELSE 0 END)::DOUBLE, 6) AS score
    FROM grouped GROUP BY doc_id, group_no""",
)
def _(spark, folder):
    g = L.prominent_line_groups(X.lines(spark, folder))
    return g.select("doc_id", big("group_no").alias("group_no"), "line_count", "text", F.round("score", 6).alias("score"))


_PROMINENCE = f"""{X.LINES}, means AS (SELECT doc_id, page, avg(font_size) AS m FROM lines GROUP BY ALL),
prominent AS (SELECT l.*, {S.strip('text')} AS t, font_size / m * CASE WHEN position = 'center' THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN is_bold THEN 1.3::DOUBLE ELSE 1 END
  * CASE WHEN length({S.strip('text')}) BETWEEN 10 AND 150 THEN 1.2::DOUBLE WHEN length({S.strip('text')}) > 150 THEN 0.8::DOUBLE ELSE 1 END AS prominence FROM lines l JOIN means USING (doc_id, page))"""


@registry.add("prominence", f"WITH {_PROMINENCE} SELECT doc_id, line_no, round(prominence, 6) AS prominence FROM prominent")
def _(spark, folder):
    return keyed(L.prominence(X.lines(spark, folder)), F.round("prominence", 6).alias("prominence"))


@registry.add(
    "title_by_prominence",
    f"WITH {_PROMINENCE} SELECT doc_id, arg_min(t, (-round(prominence, 9), line_no)) AS title FROM prominent WHERE page = 0 AND length(t) > 3 AND {_fits('t')} GROUP BY 1",
)
def _(spark, folder):
    return L.title_by_prominence(X.lines(spark, folder))


# --- headings ----------------------------------------------------------------------------------

FORMS = rf"""{CANDIDATE_TITLES}, form_shares AS (SELECT doc_id, avg((regexp_matches(t, '^\d+\.\s+[A-Z]') OR {S.any_contained('t', V.FORM_DOCUMENT_PHRASES)} OR (contains(t, 'Age') AND contains(t, 'Name')))::INT) AS form_share
  FROM ln WHERE length(t) > 3 GROUP BY 1),
forms AS (SELECT doc_id, form_share, form_share > 0.2 OR contains(lower(title), 'application form') AS is_form FROM form_shares JOIN titles USING (doc_id))"""


@registry.add("is_form_document", f"WITH {FORMS} SELECT doc_id, round(form_share, 6) AS form_share, is_form FROM forms")
def _(spark, folder):
    lines = X.lines(spark, folder)
    f = L.is_form_document(lines, L.best_title(lines))
    return f.select("doc_id", F.round("form_share", 6).alias("form_share"), "is_form")


_W = S.words("t")
_WL = S.words("lower(t)")
_STATS = r"""stats AS (SELECT doc_id, page, sum(font_size * n) / sum(n) AS avg_size, max(font_size) AS max_size FROM (
  SELECT doc_id, page, font_size, length(regexp_replace(text, '\s+', '', 'g')) AS n FROM ln) GROUP BY ALL)"""
_TABLE = f"""(len(w) >= 3 AND (len(list_intersect(list_distinct(wl), {S.text_list(V.TABLE_HEADERS)})) >= 2 OR (len(w) >= 4 AND len(rest) >= 3
  AND len(list_filter(rest, lambda x_: length(x_) <= 10 AND regexp_matches(x_, '^\\p{{Lu}}'))) >= 3)))"""
_LIST = f"(n > 150 OR ({S.ends_any('t', '.,;')} AND n > 50) OR (len(wl) > 10 AND len(list_filter(wl, lambda x_: x_ IN {S.in_list(V.SENTENCE_WORDS)})) > len(wl) * 0.3))"
_TITLED = f"(n BETWEEN 5 AND 100 AND ({S.any_contained('lower(t)', V.TITLE_WORDS)} OR (len(w) >= 2 AND len(list_filter(w[2:], lambda x_: regexp_matches(x_, '^\\p{{Lu}}'))) >= (len(w) - 1) * 0.7)))"
_BODY_SIGNS = rf"""(regexp_matches(lower(t), '^[a-z][a-z].+[.!?]\s+[a-z][a-z]')::INT + regexp_matches(lower(t), '{whole_word(V.BODY_VERBS)}')::INT
  + regexp_matches(lower(t), '(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(V.BODY_PREPOSITIONS)})\s+the(?:[^\p{{L}}\p{{N}}_]|$)')::INT + regexp_matches(lower(t), '{whole_word(V.BODY_EXAMPLES)}')::INT)"""
_SPAN1 = "CASE WHEN max_size - avg_size < 2 THEN avg_size * 1.2::DOUBLE ELSE avg_size + (max_size - avg_size) * 0.4::DOUBLE END"
_SPAN2 = "CASE WHEN max_size - avg_size < 2 THEN avg_size * 1.15::DOUBLE ELSE avg_size + (max_size - avg_size) * 0.25::DOUBLE END"
_SPAN3 = "CASE WHEN max_size - avg_size < 2 THEN avg_size * 1.1::DOUBLE ELSE avg_size + (max_size - avg_size) * 0.1::DOUBLE END"
CANDIDATES = rf"""{FORMS}, {_STATS},
kept AS (SELECT p.*, avg_size, max_size, length(t) AS n, {_W} AS w, {_WL} AS wl FROM paged p JOIN stats USING (doc_id, page) WHERE doc_id NOT IN (SELECT doc_id FROM forms WHERE is_form)),
worded AS (SELECT *, CASE WHEN regexp_matches(w[1], '^\d+\.?') THEN w[2:] ELSE w END AS rest FROM kept),
candidates AS (SELECT * FROM worded WHERE NOT (n < 3 OR n > 200 OR {S.any_match('lower(t)', V.RUNNING_PATTERNS)} OR {S.any_match('t', V.FORM_ROW_PATTERNS)}
    OR regexp_matches(t, '\.\s*\d+\s*$') OR (len(w) <= 2 AND n < 20 AND NOT regexp_matches(t, '^\d+\.'))
    OR {S.is_body_like('t')} OR {_BODY_SIGNS} >= 2 OR font_size < avg_size * 0.9::DOUBLE)
  AND CASE WHEN {S.is_numbered('t')} THEN NOT {_TABLE} AND NOT {_LIST} AND NOT {S.any_match('lower(t)', V.FORM_LIST_PATTERNS)}
      AND (font_size >= avg_size * 1.05::DOUBLE OR is_bold OR (n <= 120 AND NOT ({S.ends_any('t', '.!?')} AND n > 30)) OR position IN ('center', 'left') OR {_TITLED})
    ELSE {S.any_match('t', V.HEADING_PATTERNS)}
      OR font_size >= {_SPAN1} OR font_size >= {_SPAN2} OR (is_bold AND font_size >= avg_size * 1.05::DOUBLE) OR (is_bold AND font_size >= {_SPAN3}) OR (is_bold AND font_size >= avg_size)
      OR (font_size > avg_size * 1.05::DOUBLE AND n < 100 AND NOT (right(t, 1) = '.' AND n > 50) AND ((position = 'left' AND font_size >= avg_size * 1.08::DOUBLE) OR position = 'center')) END),
leveled AS (SELECT *, coalesce({S.numbering('t', 'depth')}, CASE WHEN right(t, 1) = ':' AND n <= 25 AND len(w) <= 3 THEN 3
    WHEN right(t, 1) = '?' OR regexp_matches(lower(t), '{whole_word([r"could\s+mean"])}') THEN 4
    WHEN position = 'center' AND font_size >= avg_size * 1.3::DOUBLE THEN 1 WHEN font_size >= max_size * 0.8::DOUBLE OR (position = 'center' AND font_size >= avg_size * 1.2::DOUBLE) THEN 1
    WHEN font_size / avg_size >= 1.3::DOUBLE THEN 1 WHEN font_size / avg_size >= 1.2::DOUBLE THEN 2 WHEN font_size / avg_size >= 1.1::DOUBLE OR is_bold THEN 3 ELSE 4 END)::BIGINT AS raw_level FROM candidates)"""


def kept_lines(spark, folder):
    lines = X.lines(spark, folder)
    forms = L.is_form_document(lines, L.best_title(lines)).where("is_form").select("doc_id")
    return lines.join(forms, "doc_id", "left_anti")


def leveled(spark, folder):
    kept = kept_lines(spark, folder)
    return L.raw_level(L.heading_candidates(kept, L.line_font_stats(kept)))


@registry.add("heading_candidates", f"WITH {CANDIDATES} SELECT doc_id, line_no, t AS text FROM candidates")
def _(spark, folder):
    return keyed(leveled(spark, folder), "text")


@registry.add("raw_level", f"WITH {CANDIDATES} SELECT doc_id, line_no, raw_level FROM leveled")
def _(spark, folder):
    return keyed(leveled(spark, folder), big("raw_level").alias("raw_level"))


_NEXT = " + ".join(f"coalesce(lead(kind, {i}) OVER d, '')" for i in range(1, 6)).replace(" + ", " || ")
_NEAR = ", ".join(f"lead(font_size, {i}) OVER d" for i in range(1, 4))
SPATIAL = rf"""kinds AS (SELECT doc_id, page, line_no, t AS text, t, font_size, is_bold, position, y_position, height,
    coalesce(abs(y_position - (lag(y_position) OVER d + lag(height) OVER d)), 'inf'::DOUBLE) AS above, coalesce(abs(lead(y_position) OVER d - (y_position + height)), 'inf'::DOUBLE) AS below,
    CASE WHEN length(t) > 50 OR {S.count_text('t', '.')} > 1 OR {S.count_text('t', ',')} > 2 OR len({_W}) > 15 OR regexp_matches(lower(t), '{whole_word(V.BODY_WORDS)}') THEN 'b'
         WHEN length(t) < 100 AND right(t, 1) <> '.' AND font_size >= 11 AND NOT {S.is_body_like('t')} THEN 'h' ELSE '-' END AS kind
  FROM ln WHERE doc_id NOT IN (SELECT doc_id FROM forms WHERE is_form) WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
ahead AS (SELECT *, {_NEXT} AS next_kinds, list_avg(list_filter([{_NEAR}], lambda x_: x_ IS NOT NULL)) AS next_size FROM kinds WINDOW d AS (PARTITION BY doc_id ORDER BY line_no)),
confident AS (SELECT *, least(CASE WHEN above > below * 1.5::DOUBLE THEN 0.3::DOUBLE ELSE 0 END + coalesce(least(font_size / next_size - 1, 1), 0) * 0.2::DOUBLE
    + CASE WHEN length(t) BETWEEN 5 AND 80 THEN 0.2::DOUBLE WHEN length(t) <= 120 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN is_bold THEN 0.15::DOUBLE ELSE 0 END
    + CASE WHEN position IN ('left', 'center') THEN 0.1::DOUBLE ELSE 0 END + 0.25::DOUBLE, 1.0::DOUBLE) AS confidence,
    CASE WHEN above > 40 THEN greatest(lv - 1, 1) ELSE lv END AS raw_level
  FROM (SELECT *, CASE WHEN font_size >= 16 OR (is_bold AND font_size >= 14) THEN 1 WHEN font_size >= 14 OR (is_bold AND font_size >= 12) THEN 2 WHEN font_size >= 12 OR is_bold THEN 3 ELSE 4 END AS lv FROM ahead)
  WHERE regexp_matches(next_kinds, '^-*b') AND length(t) BETWEEN 3 AND 120 AND NOT {S.is_body_like('t')} AND NOT {S.any_match('lower(t)', V.SPATIAL_RUNNING_PATTERNS)}
    AND above >= 20 AND below >= 10 AND above > below AND NOT {S.ends_any('t', '.!?')} AND {S.count_text('t', '.')} <= 1 AND {S.count_text('t', ',')} <= 3 AND regexp_matches(t, '^[\p{{Lu}}\p{{Nd}}]')),
spatial AS (SELECT * FROM confident WHERE round(confidence, 9) > 0.6)"""


@registry.add("spatial_headings", f"WITH {CANDIDATES}, {SPATIAL} SELECT doc_id, line_no, round(confidence, 6) AS confidence, raw_level::BIGINT AS raw_level FROM spatial")
def _(spark, folder):
    s = L.spatial_headings(kept_lines(spark, folder))
    return keyed(s, F.round("confidence", 6).alias("confidence"), big("raw_level").alias("raw_level"))


@registry.add(
    "context_level",
    f"""WITH {X.LINES}, {SPACED} SELECT doc_id, line_no, (CASE WHEN above > 40 THEN greatest(lv - 1, 1) ELSE lv END)::BIGINT AS level FROM (
    SELECT *, CASE WHEN font_size >= 16 OR (is_bold AND font_size >= 14) THEN 1 WHEN font_size >= 14 OR (is_bold AND font_size >= 12) THEN 2 WHEN font_size >= 12 OR is_bold THEN 3 ELSE 4 END AS lv FROM paged)""",
)
def _(spark, folder):
    spaced = L._whitespace(X.lines(spark, folder), L.by_page())
    return keyed(spaced, big(L.context_level("font_size", "is_bold", "above")).alias("level"))


# Nothing in the test rows repeats the whole title text by similarity alone, so equality and overlap are both tested.
_SAME = f"(lower({S.strip('h.text')}) = lower({S.strip('title')}) OR {S.jaccard_lists(S.words('lower(h.text)'), S.words('lower(title)'))} > 0.85)"
MERGED = f"""untitled AS (SELECT h.doc_id, page, line_no, h.t AS text, font_size, is_bold, position, raw_level, y_position FROM (SELECT * REPLACE (t AS text) FROM leveled) h JOIN titles ti ON ti.doc_id = h.doc_id
  WHERE title = '' OR NOT {_SAME}),
both_lists AS (SELECT *, 0.5::DOUBLE AS confidence, 0 AS l FROM untitled UNION ALL SELECT doc_id, page, line_no, text, font_size, is_bold, position, raw_level, y_position, confidence, 1 FROM spatial),
merged AS (SELECT * FROM both_lists QUALIFY row_number() OVER (PARTITION BY doc_id, page, lower({S.strip('text')}) ORDER BY l, -confidence, line_no) = 1)"""
ALL = f"{CANDIDATES}, {SPATIAL}, {MERGED}"


def untitled(spark, folder):
    titles = L.best_title(X.lines(spark, folder))
    return L.exclude_title(leveled(spark, folder).select(*L.HEADING), titles)


def merged(spark, folder):
    return L.merge_candidates(untitled(spark, folder), L.spatial_headings(kept_lines(spark, folder)))


@registry.add("exclude_title", f"WITH {ALL} SELECT doc_id, line_no, text FROM untitled")
def _(spark, folder):
    return keyed(untitled(spark, folder), "text")


@registry.add(
    "merge_candidates",
    f"WITH {ALL} SELECT doc_id, line_no, text, round(confidence, 6) AS confidence, CASE l WHEN 1 THEN 'spatial_context' ELSE 'traditional' END AS detection_method FROM merged",
)
def _(spark, folder):
    return keyed(merged(spark, folder), "text", F.round("confidence", 6).alias("confidence"), "detection_method")


SEQUENCES = f"""fars AS (SELECT *, coalesce((abs(y_position - lag(y_position) OVER w) > 50)::INT, 0) AS far FROM merged WINDOW w AS (PARTITION BY doc_id, page ORDER BY y_position, line_no)),
runs AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, page ORDER BY y_position, line_no ROWS UNBOUNDED PRECEDING) AS run FROM fars),
sequences AS (SELECT *, CASE WHEN c > 1 AND p <= 4 THEN 'H' || p END AS sequential_level FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page, run ORDER BY y_position, line_no) AS p, count(*) OVER (PARTITION BY doc_id, page, run) AS c FROM runs))"""


@registry.add("sequential_groups", f"WITH {ALL}, {SEQUENCES} SELECT doc_id, line_no, sequential_level FROM sequences")
def _(spark, folder):
    return keyed(L.sequential_groups(merged(spark, folder)), "sequential_level")


PERCENTILES = """gaps AS (SELECT doc_id, line_no, abs(lead(y_position) OVER (PARTITION BY doc_id, page ORDER BY line_no) - (y_position + height)) AS gap FROM lines),
gap_ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, line_no) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM gaps WHERE gap IS NOT NULL),
pct AS (SELECT d.doc_id, coalesce(max(gap) FILTER (r = floor(n * 0.5::DOUBLE) + 1), 5.0::DOUBLE) AS p50, coalesce(max(gap) FILTER (r = floor(n * 0.75::DOUBLE) + 1), 10.0::DOUBLE) AS p75,
  coalesce(max(gap) FILTER (r = floor(n * 0.9::DOUBLE) + 1), 20.0::DOUBLE) AS p90, coalesce(max(gap) FILTER (r = floor(n * 0.95::DOUBLE) + 1), 30.0::DOUBLE) AS p95
  FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN gap_ranks USING (doc_id) GROUP BY 1)"""


@registry.add("spacing_percentiles", f"WITH {X.LINES}, {PERCENTILES} SELECT doc_id, p50, p75, p90, p95 FROM pct")
def _(spark, folder):
    return L.spacing_percentiles(X.lines(spark, folder))


ISOLATED = rf"""page_context AS (SELECT * FROM paged QUALIFY row_number() OVER (PARTITION BY doc_id, page, t ORDER BY line_no) = 1),
in_context AS (SELECT m.*, c.above, c.below, coalesce(c.before, '') AS before, coalesce(c.after, '') AS after, c.before IS NOT NULL AS has_before, c.after IS NOT NULL AS has_after,
    c.font_size AS line_size, c.is_bold AS line_bold, p50, p75, p90, length(m.t) AS n,
    CASE WHEN c.is_bold THEN 2 ELSE 0 END + CASE WHEN c.font_size >= 14 THEN 1.0 WHEN c.font_size >= 13 THEN 0.5 ELSE 0 END AS weight
  FROM (SELECT *, {S.strip('text')} AS t FROM merged) m JOIN page_context c ON c.doc_id = m.doc_id AND c.page = m.page AND c.t = m.t JOIN pct ON pct.doc_id = m.doc_id),
judged AS (SELECT *, CASE WHEN weight >= 2 THEN p50 WHEN weight >= 1 THEN p75 ELSE p90 END AS needed FROM in_context),
isolated AS (SELECT * FROM judged WHERE ({S.is_numbered('t')} OR (line_bold AND line_size >= 12) OR (n <= 15 AND (line_bold OR line_size >= 13)) OR {S.any_match('t', V.HEADING_PATTERNS)})
  OR (n BETWEEN 2 AND 120 AND NOT {S.is_body_like('t')} AND NOT ({S.ends_any('t', '.!?')} AND n > 30) AND NOT {S.any_contained('lower(t)', V.PARAGRAPH_WORDS)}
    AND NOT ((has_before AND ((before <> '' AND NOT {S.ends_any('before', '.!?:')}) OR regexp_matches(t, '^\p{{Ll}}') OR regexp_matches(lower(t), '^(?:{'|'.join(V.FLOW_WORDS)}) ')))
      OR (has_after AND NOT {S.ends_any('t', '.!?:')} AND regexp_matches(after, '^\p{{Ll}}')))
    AND CASE WHEN n <= 10 THEN above >= needed AND below >= needed ELSE above >= needed OR below >= needed OR (above >= p50 AND below >= p50) END))"""


def isolated(spark, folder):
    kept = kept_lines(spark, folder)
    return L.isolation_filter(L.sequential_groups(merged(spark, folder)), kept, L.spacing_percentiles(kept))


_UP_TO_ISOLATED = f"{ALL}, {PERCENTILES}, {ISOLATED}"


@registry.add("isolation_filter", f"WITH {_UP_TO_ISOLATED} SELECT doc_id, line_no, t AS text FROM isolated")
def _(spark, folder):
    return keyed(isolated(spark, folder), "text")


MAJOR = rf"""major AS (SELECT * FROM (SELECT *, {S.words('lower(t)')} AS wl, {S.count_text('t', ' ')} AS blanks FROM isolated)
  WHERE NOT ((n > 80 AND (blanks > 12 OR {S.count_text('t', ',')} > 2)) OR (regexp_matches(t, '^\d+\.\s+') AND n > 60 AND {S.any_contained('lower(t)', V.LIST_VERBS)})
      OR regexp_matches(lower(t), '^(?:{'|'.join(V.DESCRIPTION_STARTS)})') OR {S.any_match('lower(t)', V.INSTRUCTION_PATTERNS)})
    AND ((coalesce({S.numbering('t', 'depth')} <= 3, false) AND (n <= 50 OR (n <= 80 AND blanks <= 8))) OR (is_bold AND font_size >= 13) OR font_size >= 16
      OR (n <= 30 AND ({S.is_upper('t')} OR {S.is_title('t')}) AND NOT {S.ends_any('t', '.,;')}))
    AND n BETWEEN 3 AND 100 AND NOT (len(wl) > 10 AND len(list_filter(wl, lambda x_: x_ IN {S.in_list(V.FUNCTION_WORDS)})) > len(wl) * 0.4)
    AND NOT ({S.ends_any('t', '.!?')} AND n > 20) AND NOT {S.any_contained('lower(t)', V.COMPLEX_WORDS)}),
finished AS (SELECT doc_id, page, line_no, 'H' || least(raw_level, 6) AS level, regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), ':\s*$', '') AS text FROM major)"""
OUTLINE = f"{_UP_TO_ISOLATED}, {MAJOR}"


@registry.add("major_headings", f"WITH {OUTLINE} SELECT doc_id, line_no, t AS text FROM major")
def _(spark, folder):
    return keyed(L.major_headings(isolated(spark, folder)), "text")


@registry.add("finalize_outline", f"WITH {OUTLINE} SELECT doc_id, page::BIGINT AS page, line_no, level, text FROM finished WHERE text <> ''")
def _(spark, folder):
    return keyed(L.finalize_outline(L.major_headings(isolated(spark, folder))), big("page").alias("page"), "level", "text")


@registry.add("outline", f"WITH {OUTLINE} SELECT doc_id, page::BIGINT AS page, line_no, level, text FROM finished WHERE text <> ''")
def _(spark, folder):
    # the line table is read by every step, so it is derived from the texts once
    return keyed(L.outline(cut_lineage(X.lines(spark, folder))), big("page").alias("page"), "level", "text")


@registry.add("outline_from_chars")
def _(spark, folder):
    chars = cut_lineage(X.chars(spark, folder))
    lines = cut_lineage(L.line_metrics(L.chars_to_lines(chars)))
    return L.outline(lines, L.font_stats(chars), multiline=True)


# --- levels -----------------------------------------------------------------------------------

@registry.add(
    "relative_depth",
    f"WITH {X.LINES} SELECT doc_id, line_no, least(dense_rank() OVER (PARTITION BY doc_id ORDER BY depth), 6)::BIGINT AS level FROM (SELECT doc_id, line_no, {S.numbering(S.strip('text'), 'depth')} AS depth FROM lines) WHERE depth IS NOT NULL",
)
def _(spark, folder):
    return keyed(L.relative_depth(X.lines(spark, folder)), big("level").alias("level"))


# At most three sizes occur, so the greedy tiers are written out one by one.
_TIERS = f"""{CANDIDATE_TITLES}, sized AS (SELECT doc_id, line_no, text, position, font_size, round(font_size + CASE WHEN is_bold THEN font_size * 0.2::DOUBLE ELSE 0 END + CASE WHEN position = 'center' THEN font_size * 0.1::DOUBLE ELSE 0 END, 9) AS p
  FROM lines WHERE NOT {S.is_numbered(S.strip('text'))}),
title_sizes AS (SELECT doc_id, min(-nf) AS ts FROM (SELECT doc_id, -font_size AS nf, row_number() OVER (PARTITION BY doc_id ORDER BY -font_size, place) AS r FROM top_lines WHERE n > 3 AND n < 200 AND fits) WHERE r = 1 GROUP BY 1),
damped AS (SELECT DISTINCT s.doc_id, round(CASE WHEN ts > 0 AND font_size >= ts * 0.9::DOUBLE THEN p * 0.8::DOUBLE ELSE p END, 9) AS v FROM sized s LEFT JOIN title_sizes USING (doc_id)),
t1 AS (SELECT doc_id, max(v) AS v FROM damped GROUP BY 1),
{', '.join(f't{i + 1} AS (SELECT d.doc_id, max(d.v) AS v FROM damped d JOIN t{i} x ON x.doc_id = d.doc_id WHERE d.v < x.v - 1.0 GROUP BY 1)' for i in range(1, 6))},
tiers AS ({' UNION ALL '.join(f'SELECT doc_id, v, {i} AS i FROM t{i}' for i in range(1, 7))}),
tiered AS (SELECT s.doc_id, s.line_no, s.text, s.position, coalesce(min(i) FILTER (abs(p - v) <= 1.0 OR p > v), 6) AS level FROM sized s LEFT JOIN tiers USING (doc_id) GROUP BY ALL)"""


def with_title_sizes(spark, folder):
    titles = L.title_candidates(X.lines(spark, folder)).where("method = 'max_font'")
    return titles.select("doc_id", F.col("font_size").alias("title_size"))


@registry.add("prominence_tiers", f"WITH {_TIERS} SELECT doc_id, line_no, level::BIGINT AS level FROM tiered")
def _(spark, folder):
    return keyed(L.prominence_tiers(X.lines(spark, folder).withColumn("text", strip("text")), with_title_sizes(spark, folder)), big("level").alias("level"))


@registry.add(
    "adjust_levels",
    rf"""WITH {X.LINES}, a AS (SELECT doc_id, line_no, text, position, CASE WHEN regexp_matches(text, '^\d+\.\d+\.\d+') THEN greatest(line_no % 6 + 1, {S.count_text('text', '.')}) ELSE line_no % 6 + 1 END AS l FROM lines),
    b AS (SELECT * REPLACE (CASE WHEN position = 'center' AND l > 1 THEN greatest(1, l - 1) ELSE l END AS l) FROM a),
    c AS (SELECT * REPLACE (CASE WHEN {S.is_upper('text')} AND length(text) > 3 THEN greatest(1, least(l, 2)) ELSE l END AS l) FROM b)
    SELECT doc_id, line_no, least(CASE WHEN right(text, 1) = ':' AND l < 3 THEN 3 ELSE l END, 6)::BIGINT AS level FROM c""",
)
def _(spark, folder):
    rows = X.lines(spark, folder).withColumn("level", F.col("line_no") % 6 + 1)
    return keyed(L.adjust_levels(rows), big("level").alias("level"))


def outline_documents(spark, folder):
    from quire.sources.tables import outline_rows_to_documents

    rows = L.outline_by_font(X.lines(spark, folder)).withColumn("level", F.concat(F.lit("H"), F.col("level").cast("string")))
    return outline_rows_to_documents(rows, L.title_by_font(X.lines(spark, folder)))


# Documents labelled toxic stand for those that could not be processed.
def _shape_sql(first: int) -> str:
    return f"""WITH {_BY_FONT}, failed AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
    listed AS (SELECT doc_id, string_agg('H' || level || '|' || text || '|' || (page + {first}), chr(10) ORDER BY page, line_no) AS entries FROM by_font GROUP BY 1)
    SELECT d.doc_id, CASE WHEN f.doc_id IS NULL THEN coalesce(entries, '') ELSE '' END AS entries, CASE WHEN f.doc_id IS NOT NULL THEN 'Processing failed' END AS error
    FROM documents d LEFT JOIN listed l ON l.doc_id = d.doc_id LEFT JOIN failed f ON f.doc_id = d.doc_id"""


def shaped(spark, folder, shape, name, page):
    failed = X.table(spark, folder, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("failed")).distinct()
    found = outline_documents(spark, folder)
    none = F.array().cast(found.schema["outline"].dataType)
    docs = X.table(spark, folder, "documents").select("doc_id").join(found, "doc_id", "left").join(failed, "doc_id", "left").withColumns({
        "success": F.col("failed").isNull(), "error": F.when(F.col("failed"), "Processing failed"),
        "outline": F.when(F.col("failed").isNull(), F.coalesce("outline", none)).otherwise(none),
    })
    entry = lambda h: F.concat_ws("|", h["level"], h[name], h[page].cast("string"))
    return L.outline_shape(docs, shape).select("doc_id", F.array_join(F.transform("outline", entry), "\n").alias("entries"), "error")


@registry.add("outline_shape", _shape_sql(1))
def _(spark, folder):
    return shaped(spark, folder, "legacy", "text", "page")


@registry.add("outline_shape_plain", _shape_sql(0))
def _(spark, folder):
    return shaped(spark, folder, "plain", "title", "page_number")


@registry.add("outline_shape_display", _shape_sql(1))
def _(spark, folder):
    return shaped(spark, folder, "display", "title", "page_number")
