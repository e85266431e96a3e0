"""Upkeep of sessions, documents, indexes and stored answers. Times are epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.operators.search import KeywordIndex, build_keyword_index, write_keyword_index


def session_overview(sessions: DataFrame, documents: DataFrame, now) -> DataFrame:
    """Live sessions with their document counts, zero included."""
    counts = documents.groupBy("session_id").agg(F.count("doc_id").alias("document_count"))
    return sessions.where(F.col("expires_at") > now).join(counts, "session_id", "left").fillna(0, ["document_count"])


def expired_sessions(sessions: DataFrame, now) -> DataFrame:
    return sessions.where(F.col("expires_at") <= now)


def purge_sessions(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given sessions."""
    gone = ids.select("session_id").distinct()
    return {name: rows.join(gone, "session_id", "left_anti") for name, rows in tables.items()}


def extend_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Push expiry by the hours asked for (session_id, hours; default 24)."""
    hours = requests.groupBy("session_id").agg(F.sum(F.coalesce("hours", F.lit(V.SESSION_HOURS))).alias("_hours"))
    return sessions.join(hours, "session_id", "left").withColumn(
        "expires_at", F.col("expires_at") + F.coalesce("_hours", F.lit(0)) * 3600
    ).drop("_hours")


def latest_status(events: DataFrame) -> DataFrame:
    """Last status of each document (doc_id, at, event_id, status)."""
    return events.groupBy("doc_id").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"))


def status_counts(documents: DataFrame, statuses: DataFrame) -> DataFrame:
    joined = documents.select("session_id", "doc_id").join(statuses.select("doc_id", "status"), "doc_id")
    return joined.groupBy("session_id", "status").agg(F.count("*").alias("documents"))


def list_documents(documents: DataFrame, session_id: str) -> DataFrame:
    """Documents of one session, newest first."""
    return documents.where(F.col("session_id") == session_id).orderBy(F.col("upload_time").desc(), "doc_id")


def document_totals(documents: DataFrame) -> DataFrame:
    return documents.groupBy("session_id").agg(F.count("*").alias("total_count"), F.sum("file_size").alias("total_size"))


def readiness(sessions: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunk counts per document, and per session whether a graph can be built."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    per_document = (
        documents.select("session_id", "doc_id").join(counts, "doc_id", "left").fillna(0, ["chunk_count"])
        .withColumn("has_chunks", F.col("chunk_count") > 0)
    )
    totals = per_document.groupBy("session_id").agg(
        F.count("*").alias("document_count"), F.sum("chunk_count").alias("total_chunks")
    )
    index = vectors.groupBy("session_id").agg(F.count("*").alias("total_vectors"))
    per_session = (
        sessions.select("session_id").join(totals, "session_id", "left").join(index, "session_id", "left")
        .fillna(0, ["document_count", "total_chunks", "total_vectors"])
        .withColumn(
            "ready_for_graph",
            (F.col("document_count") > 0) & (F.col("total_chunks") > 0) & (F.col("total_vectors") > 0),
        )
    )
    return per_document, per_session


def rebuild_index(chunks: DataFrame, folder: str, sessions: DataFrame | None = None) -> None:
    """Recompute the stored index of ``sessions`` from their ``chunks``; others stay as stored.

    By default the sessions are those of the chunks. One that has no term any
    more is left with a row without a term, which readers leave out.
    """
    index = build_keyword_index(chunks)
    wanted = (chunks if sessions is None else sessions).select("session_id").distinct()
    blank = wanted.join(index.postings.select("session_id").distinct(), "session_id", "left_anti")
    uncounted = wanted.join(index.sessions.select("session_id"), "session_id", "left_anti")
    write_keyword_index(
        KeywordIndex(
            index.postings.unionByName(blank, allowMissingColumns=True), index.stats,
            index.sessions.unionByName(uncounted.select("session_id", F.lit(0).cast("long").alias("chunks"), F.lit(0).cast("long").alias("tokens"))),
        ),
        folder,
    )


def cache_stats(cache: DataFrame, now, ttl_days: int = V.ANSWER_TTL_DAYS) -> DataFrame:
    """Entries, size and expired entries per kind (kind, size_bytes, written_at)."""
    old = now - F.col("written_at") > ttl_days * 86400
    return cache.groupBy("kind").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.sum(old.cast("long")).alias("expired")
    )


def cache_health(cache: DataFrame) -> DataFrame:
    """Overall size, health band and the advice that applies."""
    totals = cache.agg(F.count("*").alias("total_files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_size_bytes"))
    mb = F.round(F.col("total_size_bytes") / (1024.0 * 1024.0), 2)
    advice = F.array_compact(
        F.array(
            F.when(F.col("total_files") > 1000, "Consider clearing old cache files"),
            F.when(F.col("total_size_mb") > 100, "Cache size is large, consider cleanup"),
        )
    )
    health = F.when(F.col("total_size_mb") > 500, "critical").when(F.col("total_size_mb") > 100, "warning").otherwise("healthy")
    return totals.withColumn("total_size_mb", mb).withColumn("health_status", health).withColumn("recommendations", advice)


def purge_cache(cache: DataFrame, kind: str, now=None, ttl_days: int = V.ANSWER_TTL_DAYS) -> DataFrame:
    """What is left after clearing ``all``, ``expired`` or one kind."""
    if kind == "all":
        return cache.limit(0)
    if kind == "expired":
        return cache.where(now - F.col("written_at") <= ttl_days * 86400)
    if kind not in ("relationship", "pdf_analysis"):
        raise ValueError(f"unknown kind {kind!r}")
    return cache.where(F.col("kind") != kind)


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\.pdf$", "")


def _parts(names: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """The parts of each name, as ``part``, that are as long as some name of the other side in the session; the empty part isn't among them."""
    n = F.length(column)
    lengths = other.where(F.length(key) > 0).select("session_id", F.length(key).alias("_n")).distinct()
    sized = names.join(lengths, "session_id").where(F.col("_n") <= n)
    return sized.withColumn("_s", F.explode(F.sequence(F.lit(1), n - F.col("_n") + 1))).withColumn("part", F.expr(f"substr({column}, _s, _n)")).drop("_s", "_n")


def match_document_names(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """The first document, in order, whose name fits a reference.

    A name fits when it is equal, equal without ``.pdf``, or when either
    contains the other, with or without the ending. A name is cut only at the
    lengths that occur on the other side, so containment becomes an equality join, and the
    first document per part is taken before it: a part that many names share is one
    row. Empty names stand in every name and are met per session. Null names fit nothing.
    ``refs``: session_id, ref; ``documents``: session_id, doc_id, doc_name, position.
    """
    asked = refs.where("ref is not null").select("session_id", "ref").distinct()
    listed = documents.where("doc_name is not null").select("session_id", "doc_name", F.struct("position", "doc_id", "doc_name").alias("d"))
    found = []
    for bare in (False, True):
        r = asked.withColumn("key", _bare(F.col("ref")) if bare else F.col("ref"))
        d = listed.withColumn("name", _bare(F.col("doc_name")) if bare else F.col("doc_name")).groupBy("session_id", "name").agg(F.min("d").alias("d"))
        inside_name = _parts(d, "name", r, "key").groupBy("session_id", F.col("part").alias("key")).agg(F.min("d").alias("d"))
        found += [
            r.join(inside_name, ["session_id", "key"]),
            _parts(r, "key", d, "name").withColumnRenamed("part", "name").join(d, ["session_id", "name"]),
            r.where("key = ''").join(d.groupBy("session_id").agg(F.min("d").alias("d")), "session_id"),
            r.join(d.where("name = ''").select("session_id", "d"), "session_id"),
        ]
    hits = found[0].select("session_id", "ref", "d")
    for more in found[1:]:
        hits = hits.unionByName(more.select("session_id", "ref", "d"))
    first = hits.groupBy("session_id", "ref").agg(F.min("d").alias("d"))
    rule = (
        F.when(F.col("doc_name") == F.col("ref"), "exact")
        .when(_bare(F.col("doc_name")) == _bare(F.col("ref")), "without_extension").otherwise("contained")
    )
    return first.select("session_id", "ref", "d.doc_id", "d.doc_name").withColumn("rule", rule)
