"""Sources, chunking and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import normalize_text
from quire.operators import chunking as C
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.registry import Registry
from quire.session import scratch_path
from quire.sources import tables

registry = Registry()


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


@registry.add("list_files")
def _(spark, folder):
    return tables.list_files(spark, folder, "*.parquet")


# Sizes in megabytes by text length, so that some files pass the limit.
_FILES = "SELECT source AS session_id, doc_id, CASE WHEN doc_id % 7 = 3 THEN '' WHEN doc_id % 5 = 0 THEN source || doc_id || '.TXT' ELSE source || doc_id || '.PDF' END AS filename, n_chars * 40000 AS file_size FROM documents"


def files(spark, folder):
    i = F.col("doc_id")
    stem = F.concat("source", i.cast("string"))
    return X.table(spark, folder, "documents").select(
        F.col("source").alias("session_id"), "doc_id",
        F.when(i % 7 == 3, "").when(i % 5 == 0, F.concat(stem, F.lit(".TXT"))).otherwise(F.concat(stem, F.lit(".PDF"))).alias("filename"),
        (F.col("n_chars") * 40000).alias("file_size"),
    )


def _register_sql(max_files: int) -> str:
    return f"""WITH f AS ({_FILES}), n AS (SELECT session_id, count(*) AS c FROM f GROUP BY 1)
    SELECT f.session_id, doc_id, CASE WHEN lower(filename) LIKE '%.pdf' THEN 'pdf' ELSE 'txt' END AS doc_type,
      CASE WHEN c > {max_files} THEN 'rejected' WHEN filename = '' OR file_size > 104857600 THEN 'error' ELSE 'uploaded' END AS status,
      CASE WHEN c > {max_files} THEN 'Too many files. Maximum {max_files} files per session' WHEN filename = '' THEN 'No filename provided'
           WHEN file_size > 104857600 THEN 'File too large. Maximum 100MB' END AS error_message
    FROM f JOIN n USING (session_id)"""


@registry.add("register_documents", _register_sql(50))
def _(spark, folder):
    return tables.register_documents(files(spark, folder)).select("session_id", "doc_id", "doc_type", "status", "error_message")


@registry.add("register_oversized_batch", _register_sql(5))
def _(spark, folder):
    return tables.register_documents(files(spark, folder), max_files=5).select(
        "session_id", "doc_id", "doc_type", "status", "error_message"
    )


_CHUNK_COLUMNS = "session_id, doc_id, chunk_id, chunk_index::BIGINT AS chunk_index, content, page_number::BIGINT AS page_number"


def _chunk_columns(df):
    return df.select("session_id", "doc_id", "chunk_id", big("chunk_index").alias("chunk_index"), "content", big("page_number").alias("page_number"))


@registry.add("write_and_load_chunks", f"WITH {X.CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks")
def _(spark, folder):
    path = scratch_path(spark, "chunks")
    tables.write_chunks(X.chunks(spark, folder), path, buckets=4)
    return _chunk_columns(tables.load_corpus(spark, path))


@registry.add("load_corpus", f"WITH {X.CHUNKS} SELECT {_CHUNK_COLUMNS} FROM chunks WHERE session_id = 'src3'")
def _(spark, folder):
    path = scratch_path(spark, "chunks")
    tables.write_chunks(X.chunks(spark, folder), path)
    return _chunk_columns(tables.load_corpus(spark, path, "src3"))


_PAGES = f"{X.LINES}, page_texts AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id, page)"
_ASSEMBLED = f"""{_PAGES}, assembled AS (SELECT 'src' || (doc_id % 20) AS session_id, doc_id,
  string_agg(text || chr(10) || chr(10) || '--- Page ' || (page + 1) || ' ---' || chr(10) || chr(10), '' ORDER BY page) AS text,
  count(*) AS page_count FROM page_texts GROUP BY doc_id)"""


def page_texts(spark, folder):
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return (
        X.lines(spark, folder).groupBy("doc_id", "page").agg(rows.alias("rows"))
        .select(
            F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("session_id"),
            "doc_id", "page", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"),
        )
    )


@registry.add("assemble_pages", f"WITH {_ASSEMBLED} SELECT doc_id, text, page_count::BIGINT AS page_count FROM assembled")
def _(spark, folder):
    return tables.assemble_pages(page_texts(spark, folder)).select("doc_id", "text", big("page_count").alias("page_count"))


@registry.add(
    "parse_metadata",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 10 = 0 THEN 0 ELSE 1 END::BIGINT AS n FROM events",
)
def _(spark, folder):
    text = F.when(F.col("event_id") % 10 != 0, F.col("props"))
    meta = tables.parse_metadata(text)
    back = tables.parse_metadata(tables.to_metadata(meta))
    return X.table(spark, folder, "events").select("event_id", F.try_element_at(back, F.lit("k")).alias("k"), big(F.size(meta)).alias("n"))


@registry.add(
    "chunk_fixed", f"WITH {X.CHUNKS} SELECT doc_id, chunk_id, chunk_index::BIGINT AS chunk_index, content FROM chunks"
)
def _(spark, folder):
    return C.chunk_fixed(X.corpus(spark, folder), X.CHUNK_SIZE, X.CHUNK_OVERLAP).select(
        "doc_id", "chunk_id", big("chunk_index").alias("chunk_index"), "content"
    )


@registry.add("chunk_recursive")
def _(spark, folder):
    return C.chunk_recursive(X.corpus(spark, folder)).select("doc_id", "chunk_id", "chunk_index", "content")


@registry.add("chunk_recursive_small")
def _(spark, folder):
    return C.chunk_recursive(X.corpus(spark, folder), 512, 64).select("doc_id", "chunk_id", "chunk_index", "content")


# Markers are seen in the assembled texts; every third document has no known page count.
_MARKED = f"""{_ASSEMBLED}, marked AS (
  SELECT doc_id, page_count, i AS chunk_index, substr(text, i * 448 + 1, 512) AS content, count(*) OVER (PARTITION BY doc_id) AS n FROM (
    SELECT *, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 64) / 448.0) AS BIGINT), 1) - 1)) AS i FROM assembled)),
pages_given AS (SELECT doc_id, chunk_index, content,
  CASE WHEN regexp_matches(content, '--- Page (\\d+) ---') THEN greatest(regexp_extract_all(content, '--- Page (\\d+) ---', 1)[-1]::BIGINT - 1, 0)
       WHEN doc_id % 3 <> 0 THEN least(chunk_index * page_count // n, page_count - 1)
       ELSE least(chunk_index // 3, 50) END AS page_number FROM marked)"""


def marked(spark, folder):
    texts = tables.assemble_pages(page_texts(spark, folder))
    chunks = C.chunk_fixed(texts.select("session_id", "doc_id", "text"), 512, 64)
    return chunks, texts.where(F.col("doc_id") % 3 != 0).select("doc_id", "page_count")


@registry.add(
    "assign_pages",
    f"WITH {_MARKED} SELECT doc_id, chunk_index::BIGINT AS chunk_index, page_number::BIGINT AS page_number FROM pages_given",
)
def _(spark, folder):
    chunks, pages = marked(spark, folder)
    return C.assign_pages(chunks, pages).select("doc_id", big("chunk_index").alias("chunk_index"), big("page_number").alias("page_number"))


@registry.add(
    "chunk_stats",
    f"""WITH {_MARKED} SELECT doc_id, count(*) AS chunk_count, min(length(content))::BIGINT AS min_size, max(length(content))::BIGINT AS max_size,
    sum(length(content))::BIGINT AS total_size, (CASE WHEN doc_id % 3 <> 0 THEN max(page_count) ELSE count(*) // 2 END)::BIGINT AS page_count, 'indexed' AS status
    FROM marked GROUP BY doc_id""",
)
def _(spark, folder):
    chunks, pages = marked(spark, folder)
    s = C.chunk_stats(chunks, pages)
    return s.select("doc_id", *[big(c).alias(c) for c in ["chunk_count", "min_size", "max_size", "total_size", "page_count"]], "status")
