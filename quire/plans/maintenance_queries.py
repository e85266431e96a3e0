"""Upkeep of sessions, documents, indexes and stored answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import maintenance as M
from quire.operators.search import build_keyword_index, read_keyword_index, write_keyword_index
from quire.plans import fixtures as X
from quire.plans.registry import Registry
from quire.plans.search_queries import POSTINGS
from quire.session import scratch_path

registry = Registry()
NOW = X.EPOCH + 24 * 3600 + 600


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def seconds():
    return F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("bigint")


BASE = f"{X.CORPUS}, {X.SESSIONS}"


@registry.add("session_overview", f"WITH {BASE} SELECT s.session_id, s.name, s.expires_at, count(c.doc_id) AS document_count FROM sessions s LEFT JOIN corpus c USING (session_id) WHERE s.expires_at > {NOW} GROUP BY ALL")
def _(spark, folder):
    o = M.session_overview(X.sessions(spark, folder), X.corpus(spark, folder), F.lit(NOW))
    return o.select("session_id", "name", "expires_at", "document_count")


@registry.add("expired_sessions", f"WITH {BASE} SELECT session_id, expires_at FROM sessions WHERE expires_at <= {NOW}")
def _(spark, folder):
    return M.expired_sessions(X.sessions(spark, folder), F.lit(NOW)).select("session_id", "expires_at")


@registry.add(
    "purge_sessions",
    f"""WITH {X.VECTORS}, {X.CHUNKS.replace(X.CORPUS + ', ', '', 1)}, {X.SESSIONS}, gone AS (SELECT session_id FROM sessions WHERE expires_at <= {NOW})
    SELECT 'sessions' AS table_name, session_id, count(*) AS n FROM sessions WHERE session_id NOT IN (FROM gone) GROUP BY 2 UNION ALL
    SELECT 'documents', session_id, count(*) FROM corpus WHERE session_id NOT IN (FROM gone) GROUP BY 2 UNION ALL
    SELECT 'chunks', session_id, count(*) FROM chunks WHERE session_id NOT IN (FROM gone) GROUP BY 2 UNION ALL
    SELECT 'vectors', session_id, count(*) FROM vectors WHERE session_id NOT IN (FROM gone) GROUP BY 2""",
)
def _(spark, folder):
    sessions = X.sessions(spark, folder)
    kept = M.purge_sessions(
        {"sessions": sessions, "documents": X.corpus(spark, folder), "chunks": X.chunks(spark, folder), "vectors": X.vectors(spark, folder)},
        M.expired_sessions(sessions, F.lit(NOW)),
    )
    out = None
    for name, rows in kept.items():
        part = rows.groupBy("session_id").agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@registry.add(
    "extend_sessions",
    f"""WITH {BASE}, r AS (SELECT 'src' || (conv_id % 20) AS session_id, sum(turn) AS hours FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT session_id, (expires_at + coalesce(hours, 0) * 3600)::BIGINT AS expires_at FROM sessions LEFT JOIN r USING (session_id)""",
)
def _(spark, folder):
    asked = X.table(spark, folder, "conversations").where("role = 'user'").select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("session_id"), F.col("turn").alias("hours")
    )
    return M.extend_sessions(X.sessions(spark, folder), asked).select("session_id", big("expires_at").alias("expires_at"))


_STATUS = """statuses AS (SELECT event_id % (SELECT count(*) FROM documents) AS doc_id, event_id, floor(epoch(ts))::BIGINT AS happened,
  CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'purchase' THEN 'indexed' WHEN 'error' THEN 'error' ELSE 'processing' END AS status FROM events),
latest AS (SELECT doc_id, arg_max(status, (happened, event_id)) AS status, max(happened) AS happened FROM statuses GROUP BY 1)"""


def status_events(spark, folder):
    n = X.table(spark, folder, "documents").agg(F.count("*")).scalar()
    kind = F.col("event_type")
    status = F.when(kind == "signup", "uploaded").when(kind == "purchase", "indexed").when(kind == "error", "error").otherwise("processing")
    return X.table(spark, folder, "events").select(
        (F.col("event_id") % n).alias("doc_id"), "event_id", seconds().alias("at"), status.alias("status")
    )


@registry.add("latest_status", f"WITH {_STATUS} SELECT doc_id, status, happened FROM latest")
def _(spark, folder):
    return M.latest_status(status_events(spark, folder)).select("doc_id", "status", F.col("at").alias("happened"))


@registry.add("status_counts", f"WITH {_STATUS} SELECT source AS session_id, status, count(*) AS documents FROM latest JOIN documents d USING (doc_id) GROUP BY ALL")
def _(spark, folder):
    return M.status_counts(X.corpus(spark, folder), M.latest_status(status_events(spark, folder)))


@registry.add("list_documents", f"WITH {X.CORPUS} SELECT doc_id, doc_name, upload_time FROM corpus WHERE session_id = 'src7'")
def _(spark, folder):
    return M.list_documents(X.corpus(spark, folder), "src7").select("doc_id", "doc_name", "upload_time")


@registry.add("document_totals", "SELECT source AS session_id, count(*) AS total_count, sum(n_chars)::BIGINT AS total_size FROM documents GROUP BY 1")
def _(spark, folder):
    docs = X.table(spark, folder, "documents").select(F.col("source").alias("session_id"), "doc_id", F.col("n_chars").alias("file_size"))
    return M.document_totals(docs)


_READY = f"{X.VECTORS}, {X.CHUNKS.replace(X.CORPUS + ', ', '', 1)}, {X.SESSIONS}, cc AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1)"


@registry.add("readiness_documents", f"WITH {_READY} SELECT session_id, doc_id, coalesce(n, 0) AS chunk_count, coalesce(n, 0) > 0 AS has_chunks FROM corpus LEFT JOIN cc USING (doc_id)")
def _(spark, folder):
    r = M.readiness(X.sessions(spark, folder), X.corpus(spark, folder), X.chunks(spark, folder), X.vectors(spark, folder))
    return r[0].select("session_id", "doc_id", "chunk_count", "has_chunks")


@registry.add(
    "readiness_sessions",
    f"""WITH {_READY}, d AS (SELECT session_id, count(*) AS document_count, sum(coalesce(n, 0))::BIGINT AS total_chunks FROM corpus LEFT JOIN cc USING (doc_id) GROUP BY 1),
    v AS (SELECT session_id, count(*) AS total_vectors FROM vectors GROUP BY 1)
    SELECT session_id, document_count, total_chunks, coalesce(total_vectors, 0) AS total_vectors, document_count > 0 AND total_chunks > 0 AND coalesce(total_vectors, 0) > 0 AS ready_for_graph
    FROM sessions JOIN d USING (session_id) LEFT JOIN v USING (session_id)""",
)
def _(spark, folder):
    return M.readiness(X.sessions(spark, folder), X.corpus(spark, folder), X.chunks(spark, folder), X.vectors(spark, folder))[1]


def rebuilt(spark, folder):
    """An index in which src3 was stored with doubled texts and src4 with one chunk, src5 with all; rebuilt, src5 from nothing."""
    path = scratch_path(spark, "index")
    chunks = X.chunks(spark, folder)
    content = F.when(F.col("session_id") == "src3", F.concat("content", F.lit(" "), "content")).otherwise(F.col("content"))
    write_keyword_index(build_keyword_index(chunks.withColumn("content", content).where("session_id <> 'src4' or chunk_index = 0")), path)
    changed = X.sessions(spark, folder).where("session_id in ('src3', 'src4', 'src5')")
    M.rebuild_index(chunks.where("session_id in ('src3', 'src4')"), path, changed)
    return read_keyword_index(spark, path)


@registry.add("rebuild_index", f"WITH {POSTINGS} SELECT session_id, count(*) AS postings, sum(tf)::BIGINT AS tokens FROM postings WHERE session_id <> 'src5' GROUP BY 1")
def _(spark, folder):
    return rebuilt(spark, folder).postings.groupBy("session_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


@registry.add(
    "rebuild_index_stats",
    f"""WITH {POSTINGS} SELECT (SELECT count(*) FROM lexed WHERE session_id <> 'src5') AS chunks, round((SELECT avg(len(toks)) FROM lexed WHERE session_id <> 'src5'), 6) AS mean_length,
    count(*) AS terms, sum(df)::BIGINT AS postings FROM (SELECT session_id, term, count(*) AS df FROM postings WHERE session_id <> 'src5' GROUP BY ALL)""",
)
def _(spark, folder):
    index = rebuilt(spark, folder)
    return index.terms.agg(
        index.stats.select("chunks").scalar().alias("chunks"), F.round(index.stats.select("mean_length").scalar(), 6).alias("mean_length"),
        F.count("*").alias("terms"), F.sum("df").alias("postings"),
    )


_CACHE = "cache AS (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'pdf_analysis' ELSE 'relationship' END AS kind, floor(value * 1000)::BIGINT AS size_bytes, floor(epoch(ts))::BIGINT AS written_at FROM events), newest AS (SELECT max(written_at) AS t FROM cache)"


def cache(spark, folder):
    kind = F.when(F.col("event_type").isin("view", "click"), "pdf_analysis").otherwise("relationship")
    rows = X.table(spark, folder, "events").select(
        "event_id", kind.alias("kind"), F.floor(F.col("value") * 1000).cast("bigint").alias("size_bytes"), seconds().alias("written_at")
    )
    return rows, rows.agg(F.max("written_at")).scalar()


@registry.add("cache_stats", f"WITH {_CACHE} SELECT kind, count(*) AS files, sum(size_bytes)::BIGINT AS size_bytes, sum((t - written_at > 7 * 86400)::INT)::BIGINT AS expired FROM cache CROSS JOIN newest GROUP BY 1")
def _(spark, folder):
    return M.cache_stats(*cache(spark, folder))


@registry.add(
    "cache_health",
    f"""WITH {_CACHE}, s AS (SELECT count(*) AS total_files, sum(size_bytes)::BIGINT AS total_size_bytes, round(sum(size_bytes) / 1048576.0::DOUBLE, 2) AS total_size_mb FROM cache)
    SELECT total_files, total_size_bytes, total_size_mb, CASE WHEN total_size_mb > 500 THEN 'critical' WHEN total_size_mb > 100 THEN 'warning' ELSE 'healthy' END AS health_status,
      concat_ws('|', CASE WHEN total_files > 1000 THEN 'Consider clearing old cache files' END, CASE WHEN total_size_mb > 100 THEN 'Cache size is large, consider cleanup' END) AS recommendations FROM s""",
)
def _(spark, folder):
    return M.cache_health(cache(spark, folder)[0]).withColumn("recommendations", F.array_join("recommendations", "|"))


@registry.add("purge_expired_cache", f"WITH {_CACHE} SELECT event_id FROM cache CROSS JOIN newest WHERE t - written_at <= 7 * 86400")
def _(spark, folder):
    rows, now = cache(spark, folder)
    return M.purge_cache(rows, "expired", now).select("event_id")


@registry.add("purge_cache_kind", f"WITH {_CACHE} SELECT event_id FROM cache WHERE kind <> 'relationship'")
def _(spark, folder):
    return M.purge_cache(cache(spark, folder)[0], "relationship").select("event_id")


# References: full names, names in capitals of the ending, stems, and stretched names.
_REFS = """refs AS (SELECT session_id, CASE doc_id % 4 WHEN 0 THEN doc_name WHEN 1 THEN replace(doc_name, '.pdf', '.PDF') WHEN 2 THEN substr(doc_name, 1, length(doc_name) - 5) ELSE 'see ' || doc_name END AS ref FROM corpus)"""


@registry.add(
    "match_document_names",
    f"""WITH {X.CORPUS}, {_REFS}, hits AS (SELECT r.session_id, r.ref, c.doc_id, c.doc_name, regexp_replace(r.ref, '(?i)\\.pdf$', '') AS rb, regexp_replace(c.doc_name, '(?i)\\.pdf$', '') AS nb
      FROM (SELECT DISTINCT * FROM refs) r JOIN corpus c ON c.session_id = r.session_id)
    SELECT session_id, ref, doc_id, doc_name, CASE WHEN doc_name = ref THEN 'exact' WHEN nb = rb THEN 'without_extension' ELSE 'contained' END AS rule FROM (
      SELECT * FROM hits WHERE contains(doc_name, ref) OR contains(ref, doc_name) OR contains(nb, rb) OR contains(rb, nb)
      QUALIFY row_number() OVER (PARTITION BY session_id, ref ORDER BY doc_id) = 1)""",
)
def _(spark, folder):
    docs = X.corpus(spark, folder)
    m = F.col("doc_id") % 4
    ref = (
        F.when(m == 0, F.col("doc_name")).when(m == 1, F.replace("doc_name", F.lit(".pdf"), F.lit(".PDF")))
        .when(m == 2, F.expr("substr(doc_name, 1, length(doc_name) - 5)")).otherwise(F.concat(F.lit("see "), "doc_name"))
    )
    listed = docs.select("session_id", "doc_id", "doc_name", F.col("doc_id").alias("position"))
    return M.match_document_names(docs.select("session_id", ref.alias("ref")), listed)
