"""Outline files and scores, over web pages with a known title and heading."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import evaluation as E
from quire.operators import outline as L
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.outline_queries import _BY_FONT, outline_documents
from quire.plans.registry import Registry
from quire.plans.text_queries import LIKELY_HEADING
from quire.session import scratch_path
from quire.sources import tables

registry = Registry()


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


_TAGS = r"<(h1|b|p|li)(?:\s[^>]*)?>([^<]*)"


def html_lines(spark, folder):
    pages = X.table(spark, folder, "pages")
    tags = F.regexp_extract_all("html", F.lit(_TAGS), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(_TAGS), F.lit(2))
    rows = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("line_no", "e"))
    rows = rows.select("doc_id", "line_no", "e.tag", F.btrim("e.text", F.lit(" \n\t\r")).alias("text")).where("text <> ''")
    return rows.select(
        "doc_id", F.lit(0).alias("page"), "line_no", "text",
        F.when(F.col("tag") == "h1", 24.0).otherwise(11.0).alias("font_size"), F.col("tag").isin("h1", "b").alias("is_bold"),
        F.lit("left").alias("position"), (F.col("line_no") * 14.0).alias("y_position"), F.lit(14.0).alias("height"),
    )


HTML = rf"""tags AS (SELECT page_id AS doc_id, i - 1 AS line_no, tag, {S.strip('txt')} AS text FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '{_TAGS}', 1)) AS tag, unnest(regexp_extract_all(html, '{_TAGS}', 2)) AS txt,
    unnest(generate_series(1, len(regexp_extract_all(html, '{_TAGS}', 1)))) AS i FROM pages)),
lines AS (SELECT doc_id, 0 AS page, line_no, text, CASE tag WHEN 'h1' THEN 24.0::DOUBLE ELSE 11.0 END AS font_size, tag IN ('h1', 'b') AS is_bold FROM tags WHERE text <> '')"""
_HTML_FONT = HTML + _BY_FONT[_BY_FONT.index(", font_lines AS"):]
_EXPECTED = rf"expected AS (SELECT page_id AS doc_id, {S.strip(chr(114) + 'egexp_extract(html, ' + chr(39) + '<h1[^>]*>([^<]*)' + chr(39) + ', 1)')} AS text, 'H1' AS level FROM pages)"
SCORES = f"""{_HTML_FONT}, {_EXPECTED}, actual AS (SELECT DISTINCT doc_id, {S.strip('text')} AS text, 'H' || level AS level FROM by_font),
both_sides AS (SELECT doc_id, a.doc_id IS NOT NULL AND e.doc_id IS NOT NULL AS hit, e.doc_id IS NULL AS x, a.doc_id IS NULL AS s FROM (SELECT doc_id AS d, * FROM actual) a
  FULL JOIN (SELECT doc_id AS d, * FROM expected) e USING (doc_id, text, level)),
counted AS (SELECT doc_id, sum(hit::INT)::BIGINT AS matched, sum(x::INT)::BIGINT AS extra, sum(s::INT)::BIGINT AS missed FROM both_sides GROUP BY 1),
scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM (
  SELECT *, CASE WHEN matched + extra > 0 THEN matched::DOUBLE / (matched + extra) ELSE 1 END AS precision, CASE WHEN matched + missed > 0 THEN matched::DOUBLE / (matched + missed) ELSE 1 END AS recall FROM counted))"""


def actual(spark, folder):
    rows = L.outline_by_font(html_lines(spark, folder))
    return rows.select("doc_id", "text", F.concat(F.lit("H"), F.col("level").cast("string")).alias("level"))


def expected(spark, folder):
    return X.table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"), F.btrim(F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1), F.lit(" \n\t\r")).alias("text"), F.lit("H1").alias("level")
    )


def titles(spark, folder):
    given = X.table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return L.title_by_font(html_lines(spark, folder)), given


@registry.add("outline_scores", f"WITH {SCORES} SELECT doc_id, matched, extra, missed, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM scores")
def _(spark, folder):
    s = E.outline_scores(actual(spark, folder), expected(spark, folder))
    return s.select("doc_id", "matched", "extra", "missed", *[F.round(c, 6).alias(c) for c in ["precision", "recall", "f1_score"]])


_FOUND_TITLES = rf"""first AS (SELECT doc_id, line_no, {S.strip('text')} AS t, font_size FROM lines WHERE length({S.strip('text')}) > 3),
largest AS (SELECT f.* FROM first f JOIN (SELECT doc_id, max(font_size) AS m FROM first GROUP BY 1) x ON x.doc_id = f.doc_id AND x.m = f.font_size),
found AS (SELECT doc_id, coalesce(arg_min(t, line_no) FILTER (length(t) > 10 AND NOT {S.any_contained('lower(t)', L.V.RUNNING_WORDS)}), arg_min(t, line_no)) AS title FROM largest GROUP BY 1),
title_hits AS (SELECT f.doc_id, {S.strip('f.title')} = {S.strip("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title_match FROM found f JOIN pages p ON p.page_id = f.doc_id)"""


@registry.add("title_accuracy", f"WITH {HTML}, {_FOUND_TITLES} SELECT count(*) AS files, round(avg(title_match::INT), 6) AS title_accuracy FROM title_hits")
def _(spark, folder):
    return E.title_accuracy(*titles(spark, folder)).withColumn("title_accuracy", F.round("title_accuracy", 6))


@registry.add(
    "macro_summary",
    f"""WITH {SCORES}, {_FOUND_TITLES} SELECT count(*) AS files, round(avg(title_match::INT), 6) AS title_accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1_score), 6) AS f1_score
    FROM scores JOIN title_hits USING (doc_id)""",
)
def _(spark, folder):
    m = E.macro_summary(E.outline_scores(actual(spark, folder), expected(spark, folder)), E.title_matches(*titles(spark, folder)))
    return m.select("files", *[F.round(c, 6).alias(c) for c in ["title_accuracy", "precision", "recall", "f1_score"]])


@registry.add(
    "batch_summary",
    """SELECT count(*) AS total_files, sum((event_type <> 'error')::INT)::BIGINT AS successful, sum((event_type = 'error')::INT)::BIGINT AS failed, max(s) - min(s) AS total_time,
    round(count(*) / (max(s) - min(s))::DOUBLE, 6) AS files_per_second FROM (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events)""",
)
def _(spark, folder):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint")
    rows = X.table(spark, folder, "events").select((F.col("event_type") != "error").alias("success"), at.alias("started"), at.alias("ended"))
    return E.batch_summary(rows).withColumn("files_per_second", F.round("files_per_second", 6))


@registry.add("write_and_read_outlines", f"WITH {_BY_FONT} SELECT doc_id, 'H' || level AS level, text, page::BIGINT AS page FROM by_font")
def _(spark, folder):
    path = scratch_path(spark, "outlines")
    tables.write_outlines(outline_documents(spark, folder), path)
    return _entries(tables.read_outlines(spark, path))


@registry.add("read_nested_outlines", f"WITH {_BY_FONT} SELECT doc_id, 'H' || level AS level, text, page::BIGINT AS page FROM by_font")
def _(spark, folder):
    path = scratch_path(spark, "outlines")
    document = F.to_json(F.struct("doc_id", "title", "outline"))
    quoted = F.regexp_extract(F.to_json(F.struct(document.alias("v"))), r'^\{"v":(.*)\}$', 1)
    outline_documents(spark, folder).select(quoted.alias("value")).write.text(path)
    return _entries(tables.read_outlines(spark, path))


def _entries(documents):
    return documents.select("doc_id", F.explode("outline").alias("e")).select("doc_id", "e.level", "e.text", big("e.page").alias("page"))
