"""Representative content per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import selection as G
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.registry import Registry
from quire.plans.search_queries import term_search_sql

registry = Registry()


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def probes(spark, folder):
    """The fixed probes plus each session's benchmark passages."""
    fixed = G.default_probes(X.sessions(spark, folder))
    return fixed.unionByName(X.search_requests(spark, folder).select("session_id", "query_text"))


CUT = "CASE WHEN length({0}) > 4000 THEN substr({0}, 1, 4000) || '...' ELSE {0} END"

DIVERSE = f"""spots AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, chunk_index) AS r,
  count(*) OVER (PARTITION BY doc_id) AS n FROM chunks),
diverse_raw AS (SELECT session_id, doc_id, string_agg(content, ' ' ORDER BY g, r) AS t FROM (
  SELECT *, CASE WHEN r <= 2 THEN 0 WHEN n > 3 AND r > n - 2 THEN 1 WHEN n > 5 AND r IN (3, 3 + (n - 4) // 2) THEN 2 END AS g FROM spots)
  WHERE g IS NOT NULL GROUP BY session_id, doc_id),
diverse AS (SELECT session_id, doc_id, {CUT.format('t')} AS content FROM diverse_raw)"""

STRUCTURAL = f"""flags AS (SELECT *, contains(substr(low, 1, 100), 'abstract') OR contains(substr(low, 1, 100), 'introduction')
    OR contains(right(low, 100), 'conclusion') OR contains(low, 'summary') OR len({S.words('low')}) < 50 AS flagged
  FROM (SELECT *, lower(content) AS low FROM chunks)),
flag_ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, flagged ORDER BY chunk_index) AS fr,
  least(sum(flagged::INT) OVER (PARTITION BY doc_id), 3) AS took FROM flags),
structural_raw AS (SELECT session_id, doc_id, string_agg(content, ' ' ORDER BY (NOT flagged), chunk_index) AS t FROM flag_ranks
  WHERE (flagged AND fr <= 3) OR (NOT flagged AND fr <= 5 - took) GROUP BY session_id, doc_id),
structural AS (SELECT session_id, doc_id, {CUT.format('t')} AS content FROM structural_raw)"""

SEMANTIC = f"""probes AS (
  SELECT DISTINCT 's:' || session_id || ':' || md5(query_text) AS query_id, session_id, query_text FROM (
    SELECT session_id, unnest({S.text_list(G.V.SEMANTIC_PROBES)}) AS query_text FROM (SELECT DISTINCT session_id FROM corpus)
    UNION ALL SELECT session_id, query_text FROM search_requests)
  UNION ALL SELECT 'd:' || doc_id, session_id, doc_name FROM corpus WHERE doc_id IN (SELECT doc_id FROM chunks)),
{term_search_sql('probes', 3, 'probe_hits')},
chosen AS (SELECT DISTINCT f.session_id, f.doc_id, f.chunk_index FROM probe_hits h JOIN chunks hc USING (chunk_id)
  JOIN (SELECT session_id, doc_id, content, min(chunk_index) AS chunk_index FROM chunks GROUP BY ALL) f
    ON f.session_id = hc.session_id AND f.content = hc.content AND (h.query_id LIKE 's:%' OR h.query_id = 'd:' || f.doc_id)),
semantic_raw AS (SELECT c.session_id, c.doc_id, string_agg(c.content, ' ' ORDER BY c.chunk_index) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS r FROM chosen) x
  JOIN chunks c ON c.doc_id = x.doc_id AND c.chunk_index = x.chunk_index WHERE r <= 5 GROUP BY ALL),
semantic AS (SELECT d.session_id, d.doc_id, coalesce({CUT.format('s.t')}, d.content) AS content FROM diverse d LEFT JOIN semantic_raw s USING (doc_id))"""

BASE = f"{X.CHUNKS}, {X.SEARCH_REQUESTS}"
ALL = f"{BASE}, {DIVERSE}, {STRUCTURAL}, {SEMANTIC}"

HYBRID = f"""three AS (SELECT d.session_id, d.doc_id, s.content AS st, m.content AS se, d.content AS di FROM diverse d JOIN structural s USING (doc_id) JOIN semantic m USING (doc_id)),
two AS (SELECT *, CASE WHEN se <> '' AND se <> st AND NOT contains(st, substr(se, 1, 1200)) THEN concat_ws(' ', nullif(substr(st, 1, 800), ''), substr(se, 1, 1200)) ELSE substr(st, 1, 800) END AS body FROM three),
hybrid_raw AS (SELECT *, CASE WHEN di <> '' AND NOT contains(body, substr(di, 1, 1000)) THEN concat_ws(' ', nullif(body, ''), substr(di, 1, 1000)) ELSE body END AS joined FROM two),
hybrid_deduped AS (SELECT session_id, doc_id, {S.dedupe_sentences('joined')} AS t FROM hybrid_raw),
hybrid AS (SELECT session_id, doc_id, {CUT.format('t')} AS content FROM hybrid_deduped)"""

STRATEGIC = f"""{ALL}, {HYBRID}, counts AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1),
strategic AS (SELECT session_id, doc_id, content, strategy_used, total_chunks, {S.content_quality('content')} AS selection_quality FROM (
  SELECT d.session_id, d.doc_id, n AS total_chunks, CASE WHEN n <= 3 THEN 'structural' WHEN n <= 10 THEN 'diverse' ELSE 'hybrid' END AS strategy_used,
    CASE WHEN n <= 3 THEN s.content WHEN n <= 10 THEN d.content ELSE h.content END AS content
  FROM diverse d JOIN structural s USING (doc_id) JOIN hybrid h USING (doc_id) JOIN counts USING (doc_id)))"""


@registry.add(
    "choose_strategy",
    f"WITH {X.CHUNKS} SELECT doc_id, count(*) AS chunk_count, CASE WHEN count(*) <= 3 THEN 'structural' WHEN count(*) <= 10 THEN 'diverse' ELSE 'hybrid' END AS strategy FROM chunks GROUP BY 1",
)
def _(spark, folder):
    return G.choose_strategy(X.chunks(spark, folder)).select("doc_id", "chunk_count", "strategy")


@registry.add("select_diverse", f"WITH {X.CHUNKS}, {DIVERSE} SELECT doc_id, content FROM diverse")
def _(spark, folder):
    return G.select_diverse(X.chunks(spark, folder)).select("doc_id", "content")


@registry.add("select_structural", f"WITH {X.CHUNKS}, {STRUCTURAL} SELECT doc_id, content FROM structural")
def _(spark, folder):
    return G.select_structural(X.chunks(spark, folder)).select("doc_id", "content")


@registry.add("select_semantic", f"WITH {ALL} SELECT doc_id, content FROM semantic")
def _(spark, folder):
    return G.select_semantic(X.chunks(spark, folder), probes(spark, folder)).select("doc_id", "content")


@registry.add("select_hybrid", f"WITH {ALL}, {HYBRID} SELECT doc_id, content FROM hybrid")
def _(spark, folder):
    return G.select_hybrid(X.chunks(spark, folder), probes(spark, folder)).select("doc_id", "content")


@registry.add(
    "strategic_content",
    f"WITH {STRATEGIC} SELECT doc_id, content, strategy_used, total_chunks, length(content) AS content_length, round(selection_quality, 9) AS selection_quality FROM strategic",
)
def _(spark, folder):
    s = G.strategic_content(X.chunks(spark, folder), probes(spark, folder))
    return s.select(
        "doc_id", "content", "strategy_used", big("total_chunks").alias("total_chunks"),
        big("content_length").alias("content_length"), F.round("selection_quality", 9).alias("selection_quality"),
    )


# Documents labelled toxic are treated as never stored: they have no chunks.
_STORED = STRATEGIC.replace("chunks AS (", "all_chunks AS (", 1).replace(
    f", {X.SEARCH_REQUESTS}", f", chunks AS (SELECT * FROM all_chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {X.SEARCH_REQUESTS}", 1
)


@registry.add(
    "content_fallback",
    f"""WITH {_STORED}, lacking AS (SELECT doc_id AS query_id, session_id, doc_name AS query_text FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM strategic)),
    {term_search_sql('lacking', 3, 'name_hits').replace('ct AS', 'ct2 AS').replace('cn AS', 'cn2 AS').replace('qt AS', 'qt2 AS').replace('qn AS', 'qn2 AS').replace('FROM ct ', 'FROM ct2 ct ').replace('JOIN qt ', 'JOIN qt2 qt ').replace('JOIN cn ', 'JOIN cn2 ').replace('JOIN qn ', 'JOIN qn2 ').replace('FROM ct GROUP', 'FROM ct2 GROUP').replace('FROM qt GROUP', 'FROM qt2 GROUP')},
    by_name AS (SELECT query_id AS doc_id, string_agg(content, ' ' ORDER BY rank) AS t FROM name_hits JOIN chunks USING (chunk_id) GROUP BY 1)
    SELECT c.doc_id, coalesce(s.content, b.t, c.doc_name || ' ' || c.doc_name || ' pages:0') AS content,
      CASE WHEN s.content IS NOT NULL THEN s.strategy_used WHEN b.t IS NOT NULL THEN 'semantic_fallback' ELSE 'basic_fallback' END AS content_source
    FROM corpus c LEFT JOIN strategic s USING (doc_id) LEFT JOIN by_name b USING (doc_id)""",
)
def _(spark, folder):
    toxic = X.table(spark, folder, "labels").where("toxic = 1").select("doc_id").distinct()
    chunks = X.chunks(spark, folder).join(toxic, "doc_id", "left_anti")
    strategic = G.strategic_content(chunks, probes(spark, folder))
    return G.content_fallback(X.corpus(spark, folder), strategic, chunks).select("doc_id", "content", "content_source")
