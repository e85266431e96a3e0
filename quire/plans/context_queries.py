"""Packing chosen text under size budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import context as K
from quire.operators import persona as P
from quire.operators import similarity as H
from quire.operators import graph as GR
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.graph_queries import COMPONENTS, EDGES, documents, edges_once
from quire.plans.persona_queries import HITS, RANKED, request_hits
from quire.plans.registry import Registry

registry = Registry()


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


@registry.add(
    "ask_context",
    f"""WITH {HITS} SELECT query_id, string_agg('Source ' || rank || ' (from ' || doc_name || '):' || chr(10) || content || chr(10) || chr(10), '' ORDER BY rank) AS context,
    string_agg('[' || rank || '] ' || doc_name, '|' ORDER BY rank) AS sources FROM hits WHERE rank <= 5 GROUP BY 1""",
)
def _(spark, folder):
    return K.ask_context(request_hits(spark, folder)).withColumn("sources", F.array_join("sources", "|"))


@registry.add(
    "insight_context",
    f"""WITH {HITS}, c AS (SELECT query_id, string_agg('Doc' || rank || ': ' || substr(content, 1, 400) || '...' || chr(10), '' ORDER BY rank) AS t FROM hits WHERE rank <= 3 GROUP BY 1)
    SELECT query_id, substr(query_text, 1, 300) AS selection, coalesce(substr(t, 1, 500), '') AS context FROM user_requests LEFT JOIN c USING (query_id)""",
)
def _(spark, folder):
    return K.insight_context(X.user_requests(spark, folder), request_hits(spark, folder))


@registry.add(
    "persona_context",
    f"""WITH {RANKED} SELECT query_id, string_agg('Document: ' || doc_name || ', Page ' || (page_number + 1) || chr(10) || substr(content, 1, 500) || chr(10) || chr(10), '' ORDER BY importance_rank) AS context
    FROM ranked WHERE importance_rank <= 10 GROUP BY 1""",
)
def _(spark, folder):
    ranked = P.persona_rank(request_hits(spark, folder), X.user_requests(spark, folder))
    return K.persona_context(ranked.drop("rank").withColumnRenamed("importance_rank", "rank"))


# The document of the third hit is the one the reader has open.
_PACKED = f"""{HITS}, opened AS (SELECT query_id, doc_name AS open_doc FROM hits WHERE rank = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (NOT coalesce(doc_name = open_doc, false)), rank) AS place FROM hits LEFT JOIN opened USING (query_id)),
sized AS (SELECT *, chr(10) || '--- Section ' || place || ' (from ' || doc_name || ') ---' || chr(10) || substr(content, 1, 400) || '...' || chr(10) AS section FROM placed WHERE place <= 5),
packed AS (SELECT * FROM (SELECT *, sum(length(section)) OVER (PARTITION BY query_id ORDER BY place) AS used FROM sized) WHERE used <= 1500)"""


def packed(spark, folder):
    hits = request_hits(spark, folder)
    opened = hits.where("rank = 3").select("query_id", F.col("doc_name").alias("open_doc"))
    return K.budget_pack(hits.join(opened, "query_id", "left"), prefer="open_doc")


@registry.add("budget_pack", f"WITH {_PACKED} SELECT query_id, chunk_id, place, section, used::BIGINT AS used FROM packed")
def _(spark, folder):
    return packed(spark, folder).select("query_id", "chunk_id", big("place").alias("place"), "section", big("used").alias("used"))


@registry.add("packed_text", f"WITH {_PACKED} SELECT query_id, string_agg(section, '' ORDER BY place) AS content, max(used)::BIGINT AS used FROM packed GROUP BY 1")
def _(spark, folder):
    return K.packed_text(packed(spark, folder)).withColumn("used", big("used"))


@registry.add(
    "batch_requests",
    """WITH r AS (SELECT conv_id * 1000 + turn AS query_id, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS p FROM conversations)
    SELECT p // 5 AS batch, count(*) AS requests, 'Process the following requests and provide responses in JSON format:' || chr(10) || chr(10) ||
      string_agg('Request ' || (p % 5 + 1) || ':' || chr(10) || 'Type: ' || role || chr(10) || 'Content: ' || substr(text, 1, 200) || '...' || chr(10) || chr(10), '' ORDER BY p)
      || 'Respond with JSON array: [response1, response2, ...]' AS text FROM r GROUP BY 1""",
)
def _(spark, folder):
    rows = X.table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("role").alias("kind"), F.col("text").alias("content")
    )
    return K.batch_requests(rows, F.floor(F.col("query_id") / 64000)).withColumn("requests", big("requests"))


@registry.add(
    "document_context",
    f"""SELECT doc_id, 'Provide 2-3 key insights:' || chr(10) || chr(10) || CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || ' ' || {S.key_sentences('substr(text, 501)', 2)} ELSE substr(text, 1, 500) END AS context FROM documents""",
)
def _(spark, folder):
    return K.document_context(X.table(spark, folder, "documents"), "insights").select("doc_id", "context")


@registry.add(
    "pair_context",
    f"""WITH {EDGES} SELECT src, dst, 'Explain relationship between these documents in 2 sentences:' || chr(10) || chr(10) || 'Doc1: ' || {S.truncate_sentences('a.content', 300)} || chr(10) || 'Doc2: ' || {S.truncate_sentences('b.content', 300)}
      || chr(10) || 'Similarity: ' || {S.percent('similarity', 0)} || chr(10) || chr(10) || 'Focus on shared topics, themes, or methodologies.' AS context
    FROM edges JOIN docs a ON a.doc_id = src JOIN docs b ON b.doc_id = dst""",
)
def _(spark, folder):
    return K.pair_context(edges_once(spark, folder)[1], documents(spark, folder))


@registry.add(
    "importance_context",
    f"""SELECT doc_id, 'Rate importance (1-10) and explain why:' || chr(10) || chr(10) || 'Document: ' || {S.truncate_sentences('text', 400)} || chr(10) || chr(10) || 'Context: ' || {S.truncate_sentences('source', 200)}
    || chr(10) || chr(10) || 'Provide: 1) Importance score (1-10) 2) Brief reason' AS context FROM documents""",
)
def _(spark, folder):
    return K.importance_context(X.table(spark, folder, "documents"), "text", "source").select("doc_id", "context")


@registry.add(
    "community_context",
    f"""WITH {COMPONENTS}, first AS (SELECT component, node, row_number() OVER (PARTITION BY component ORDER BY node) AS r FROM components QUALIFY r <= 3)
    SELECT component AS community, string_agg('Doc' || r || ': ' || {S.truncate_sentences('content', 200)} || chr(10), '' ORDER BY r) AS context FROM first JOIN docs ON doc_id = node GROUP BY 1""",
)
def _(spark, folder):
    parts = GR.connected_components(*edges_once(spark, folder)).withColumnRenamed("component", "community")
    return K.community_context(documents(spark, folder), parts)


# Answers stored for what users did, asked again by every event of the last week.
_HASH = "md5(substr({0}, 1, 1000) || '__LEN_' || length({0}))"
_ASKED = "user_id || ':' || event_type"
_NOW = "(SELECT max(floor(epoch(ts))::BIGINT) FROM events)"
_CACHE = f"""asked AS (SELECT event_id, {_ASKED} AS content, floor(epoch(ts))::BIGINT AS asked_at FROM events),
cache AS (SELECT {_HASH.format('content')} AS answer_key, 'answer ' || event_id AS answer, asked_at AS written_at FROM asked),
fresh AS (SELECT answer_key, arg_max(answer, (written_at, answer)) AS answer FROM cache WHERE {_NOW} - written_at < 7 * 86400 GROUP BY 1)"""


def asked_and_cache(spark, folder):
    asked = X.table(spark, folder, "events").select(
        "event_id", F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("content"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint").alias("asked_at"),
    )
    cache = asked.select(
        K.content_hash("content").alias("answer_key"), F.concat(F.lit("answer "), F.col("event_id").cast("string")).alias("answer"),
        F.col("asked_at").alias("written_at"),
    )
    return asked, cache, asked.agg(F.max("asked_at")).scalar()


@registry.add("reuse_answers", f"WITH {_CACHE} SELECT event_id, {_HASH.format('content')} AS answer_key, answer FROM asked JOIN fresh ON answer_key = {_HASH.format('content')}")
def _(spark, folder):
    asked, cache, now = asked_and_cache(spark, folder)
    return K.reuse_answers(asked, cache, now)[0].select("event_id", "answer_key", "answer")


@registry.add("unanswered_requests", f"WITH {_CACHE} SELECT event_id FROM asked WHERE {_HASH.format('content')} NOT IN (SELECT answer_key FROM fresh)")
def _(spark, folder):
    asked, cache, now = asked_and_cache(spark, folder)
    return K.reuse_answers(asked, cache, now)[1].select("event_id")
