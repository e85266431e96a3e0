"""Inputs derived from the supplied tables, once in Spark and once in SQL.

Every fixture covers its whole source tables. The SQL side is a set of common
table expressions that the SQL twins of the queries build on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip
from quire.operators.chunking import chunk_fixed
from quire.sources.tables import spread

CHUNK_SIZE, CHUNK_OVERLAP = 512, 64
EPOCH = 1704067200  # 2024-01-01 UTC
PAGE_LINES = 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def corpus(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("source").alias("session_id"),
        "doc_id",
        F.concat("source", F.lit("_"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("doc_name"),
        "text",
        (F.lit(EPOCH) + F.col("doc_id") * 60).alias("upload_time"),
    )


CORPUS = f"""corpus AS (
  SELECT source AS session_id, doc_id, source || '_' || lang || '_' || doc_id || '.pdf' AS doc_name,
         text, {EPOCH} + doc_id * 60 AS upload_time
  FROM documents)"""


def chunks(spark, folder) -> DataFrame:
    docs = corpus(spark, folder)
    return chunk_fixed(docs, CHUNK_SIZE, CHUNK_OVERLAP).withColumn(
        "page_number", F.expr("cast(least(chunk_index div 3, 50) as int)")
    )


_STRIDE = CHUNK_SIZE - CHUNK_OVERLAP
CHUNKS = f"""{CORPUS}, chunk_spans AS (
  SELECT *, unnest(generate_series(0, greatest(CAST(ceil((length(text) - {CHUNK_OVERLAP}) / {_STRIDE}.0) AS BIGINT), 1) - 1)) AS chunk_index
  FROM corpus WHERE length(text) > 0),
chunks AS (
  SELECT session_id, doc_id, doc_name, doc_id || '_chunk_' || chunk_index AS chunk_id, chunk_index,
         substr(text, chunk_index * {_STRIDE} + 1, {CHUNK_SIZE}) AS content, least(chunk_index // 3, 50) AS page_number
  FROM chunk_spans)"""


def sessions(spark, folder) -> DataFrame:
    return (
        corpus(spark, folder).groupBy("session_id")
        .agg(F.min("upload_time").alias("created_at"))
        .withColumn("expires_at", F.col("created_at") + 24 * 3600)
        .withColumn("name", F.concat(F.lit("Session "), "session_id"))
    )


SESSIONS = """sessions AS (
  SELECT session_id, 'Session ' || session_id AS name, min(upload_time) AS created_at,
         min(upload_time) + 86400 AS expires_at
  FROM corpus GROUP BY session_id)"""


def vectors(spark, folder) -> DataFrame:
    """One vector per embedded document, keyed like that document's first chunk."""
    emb = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = corpus(spark, folder).select("session_id", "doc_id", "doc_name")
    return emb.join(docs, "doc_id").withColumn(
        "chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_0"))
    )


VECTORS = f"""{CORPUS}, vectors AS (
  SELECT c.session_id, c.doc_id, c.doc_name, c.doc_id || '_chunk_0' AS chunk_id, e.embedding, e.label
  FROM embeddings e JOIN corpus c ON c.doc_id = e.vec_id)"""


def search_requests(spark, folder) -> DataFrame:
    """A question per benchmark item: its text, and the mean vector of one label."""
    spread = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = (
        spread.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("label", F.transform("v", lambda e: e["x"]).alias("query_vec"))
    )
    return (
        table(spark, folder, "benchmark")
        .select(
            F.col("item_id").alias("query_id"),
            F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("session_id"),
            F.col("text").alias("query_text"),
            (F.col("item_id") % 10).cast("int").alias("label"),
        )
        .join(means, "label").drop("label")
    )


SEARCH_REQUESTS = """label_means AS (
  SELECT label, list(x ORDER BY i) AS query_vec FROM (
    SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (
      SELECT label, unnest(embedding) AS x, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label),
search_requests AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS session_id, text AS query_text, m.query_vec
  FROM benchmark b JOIN label_means m ON m.label = b.item_id % 10)"""


def lines(spark, folder) -> DataFrame:
    """Positioned lines: one per text line, short ones numbered and unstopped.

    Short lines become candidates for headings: larger, set apart, some bold,
    some numbered, the shortest centred.
    """
    raw = (
        table(spark, folder, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
        .withColumn("raw", strip("raw"))
        .where("raw <> ''")
    )
    n = F.length("raw")
    no = F.col("line_no")
    bare = F.regexp_replace("raw", r"[.!?]+$", "")
    chapter = F.floor(no / 4) + 1
    section = F.col("doc_id") % 3 + 1
    text = (
        F.when(n > 60, F.col("raw"))
        .when(no % 4 == 1, F.concat(chapter.cast("string"), F.lit("."), section.cast("string"), F.lit(" "), bare))
        .when(no % 4 == 2, F.concat(chapter.cast("string"), F.lit(". "), bare))
        .when(no % 4 == 3, F.concat(bare, F.lit(":")))
        .otherwise(bare)
    )
    return raw.select(
        "doc_id",
        F.floor(no / PAGE_LINES).cast("int").alias("page"),
        no.cast("int").alias("line_no"),
        text.alias("text"),
        F.when(no == 0, 16.0).when(n <= 60, 14.0).otherwise(11.0).alias("font_size"),
        (n <= 40).alias("is_bold"),
        F.when(n <= 30, "center").otherwise("left").alias("position"),
        ((no % PAGE_LINES) * 60.0 + F.when(n <= 60, 20.0).otherwise(0.0)).alias("y_position"),
        F.lit(14.0).alias("height"),
    )


LINES = rf"""raw_lines AS (
  SELECT doc_id, i - 1 AS line_no, trim(raw, E' \n\t\r') AS raw FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
           unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(raw, E' \n\t\r') <> ''),
lines AS (
  SELECT doc_id, line_no // {PAGE_LINES} AS page, line_no,
    CASE WHEN length(raw) > 60 THEN raw
         WHEN line_no % 4 = 1 THEN (line_no // 4 + 1) || '.' || (doc_id % 3 + 1) || ' ' || regexp_replace(raw, '[.!?]+$', '')
         WHEN line_no % 4 = 2 THEN (line_no // 4 + 1) || '. ' || regexp_replace(raw, '[.!?]+$', '')
         WHEN line_no % 4 = 3 THEN regexp_replace(raw, '[.!?]+$', '') || ':'
         ELSE regexp_replace(raw, '[.!?]+$', '') END AS text,
    CASE WHEN line_no = 0 THEN 16.0::DOUBLE WHEN length(raw) <= 60 THEN 14.0 ELSE 11.0 END AS font_size,
    length(raw) <= 40 AS is_bold,
    CASE WHEN length(raw) <= 30 THEN 'center' ELSE 'left' END AS position,
    ((line_no % {PAGE_LINES}) * 60 + CASE WHEN length(raw) <= 60 THEN 20 ELSE 0 END)::DOUBLE AS y_position,
    14.0::DOUBLE AS height
  FROM raw_lines)"""


def chars(spark, folder) -> DataFrame:
    """Positioned characters of the layout lines; blanks become gaps.

    Lines are dealt by page before they are taken apart, so no row per character is shuffled.
    """
    ln = lines(spark, folder).repartition("doc_id", "page")
    return (
        ln.select(
            "doc_id", "page", "font_size", "is_bold", "y_position", "height", "position",
            F.posexplode(F.split("text", "")).alias("pos", "ch"),
        )
        .where("ch <> '' AND ch <> ' '")
        .select(
            "doc_id", "page", F.col("ch").alias("text"),
            (F.col("pos") * 6.0 + F.when(F.col("position") == "center", 200.0).otherwise(0.0)).alias("x0"),
            (F.col("pos") * 6.0 + F.when(F.col("position") == "center", 206.0).otherwise(6.0)).alias("x1"),
            F.col("y_position").alias("top"),
            F.col("font_size").alias("size"),
            "height",
            F.when(F.col("is_bold"), "Serif-Bold").otherwise("Serif").alias("fontname"),
        )
    )


CHARS = f"""{LINES}, chars AS (
  SELECT doc_id, page, ch AS text, (i - 1) * 6.0::DOUBLE + CASE WHEN position = 'center' THEN 200 ELSE 0 END AS x0,
         (i - 1) * 6.0::DOUBLE + CASE WHEN position = 'center' THEN 206 ELSE 6 END AS x1,
         y_position AS top, font_size AS size, height,
         CASE WHEN is_bold THEN 'Serif-Bold' ELSE 'Serif' END AS fontname
  FROM (SELECT *, unnest(string_split(text, '')) AS ch, unnest(generate_series(1, len(string_split(text, '')))) AS i FROM lines)
  WHERE ch <> '' AND ch <> ' ')"""


def user_requests(spark, folder) -> DataFrame:
    """User turns as persona requests: two words of persona, the rest the job."""
    spoken = table(spark, folder, "conversations").where("role = 'user'")
    parts = F.array_remove(F.split("text", r"\s+"), "")
    return spoken.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("session_id"),
        F.array_join(F.slice(parts, 1, 2), " ").alias("persona"),
        F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), " ").alias("job"),
        F.array_join(parts, " ").alias("query_text"),
    )


USER_REQUESTS = r"""user_requests AS (
  SELECT query_id, session_id, array_to_string(w[1:2], ' ') AS persona, array_to_string(w[3:], ' ') AS job,
         array_to_string(w, ' ') AS query_text
  FROM (SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 20) AS session_id,
               list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w
        FROM conversations WHERE role = 'user'))"""
