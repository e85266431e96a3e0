"""Reading and writing the persistent tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import col, strip


def spread(rows: DataFrame) -> DataFrame:
    """Spread a table stored in fewer pieces than there are cores over all of them.

    Text work is heavy per row, and one small file would keep one core busy.
    Large tables have more pieces than cores and are left as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def list_files(spark: SparkSession, folder: str, glob: str = "*.pdf") -> DataFrame:
    """Name and size of every matching file; file contents are never read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.round(F.col("length") / (1024.0 * 1024.0), 2).alias("size_mb"),
    )


def register_documents(
    files: DataFrame,
    max_file_mb: int = V.MAX_FILE_MB,
    max_files: int = V.MAX_FILES_PER_SESSION,
) -> DataFrame:
    """Registry rows for uploaded files (session_id, filename, file_size).

    A batch larger than ``max_files`` is rejected whole; a file above the size
    limit gets status ``error``. The count per session is a partial aggregate
    joined back, so one large session is not sorted or held in one task.
    """
    sizes = files.groupBy("session_id").agg(F.count("*").alias("batch_size"))
    named = F.coalesce(F.col("filename"), F.lit("")) != ""
    too_large = F.col("file_size") > max_file_mb * 1024 * 1024
    rejected = F.col("batch_size") > max_files
    error = (
        F.when(rejected, f"Too many files. Maximum {max_files} files per session")
        .when(~named, "No filename provided")
        .when(too_large, f"File too large. Maximum {max_file_mb}MB")
    )
    return (
        files.join(sizes, "session_id")
        .withColumn("doc_type", F.when(F.lower("filename").endswith(".pdf"), "pdf").otherwise("txt"))
        .withColumn("error_message", error)
        .withColumn(
            "status",
            F.when(rejected, "rejected").when(~named | too_large, "error").otherwise("uploaded"),
        )
        .drop("batch_size")
    )


def load_corpus(spark: SparkSession, folder: str, session_id: str | None = None) -> DataFrame:
    """Stored chunks in (doc_id, chunk_index) order, pruned to one session if asked."""
    chunks = spark.read.parquet(folder)
    if session_id is not None:
        chunks = chunks.where(F.col("session_id") == session_id)
    return chunks.orderBy("doc_id", "chunk_index")


def write_chunks(chunks: DataFrame, folder: str, mode: str = "append", buckets: int = 8) -> None:
    """Store chunks by session.

    ``buckets`` spreads one session over that many writers (by document), so
    a session with a large share of all rows is not written by one task.
    """
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(buckets))
    (
        chunks.repartition("session_id", spread)
        .write.mode(mode).partitionBy("session_id").parquet(folder)
    )


def assemble_pages(pages: DataFrame) -> DataFrame:
    """One text per document: page text then its marker, in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return (
        pages.groupBy("session_id", "doc_id")
        .agg(ordered.alias("parts"))
        .select(
            "session_id", "doc_id",
            F.array_join(
                F.transform(
                    "parts",
                    lambda p: F.concat(
                        p["text"], F.lit("\n\n--- Page "), (p["page"] + 1).cast("string"), F.lit(" ---\n\n")
                    ),
                ),
                "",
            ).alias("text"),
            F.size("parts").alias("page_count"),
        )
    )


def parse_metadata(c) -> Column:
    """JSON text to a map; NULL or unreadable text gives an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(col(c), "map<string,string>"), empty)


def to_metadata(c) -> Column:
    return F.to_json(col(c))


def outline_rows_to_documents(outline: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Outline rows (doc_id, page, line_no, level, text) to one row per document."""
    entries = F.array_sort(F.collect_list(F.struct("page", "line_no", "level", "text")))
    docs = outline.groupBy("doc_id").agg(entries.alias("entries"))
    if titles is not None:
        docs = titles.select("doc_id", "title").join(docs, "doc_id", "left")
    else:
        docs = docs.withColumn("title", F.lit(""))
    item = "array<struct<level:string,text:string,page:int>>"
    return docs.select(
        "doc_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(
            F.transform(
                "entries",
                lambda e: F.struct(
                    e["level"].cast("string").alias("level"), e["text"].alias("text"), e["page"].cast("int").alias("page")
                ),
            ),
            F.array().cast(item),
        ).alias("outline"),
    )


def write_outlines(outlines: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """One JSON line per document with title and outline list."""
    outlines.write.mode(mode).json(folder)


OUTLINE_SCHEMA = "doc_id BIGINT, title STRING, outline ARRAY<STRUCT<level: STRING, text: STRING, page: INT>>"


def read_outlines(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """Outline JSON, one document per line or per file.

    Some writers store the document as a JSON string inside JSON; such rows are
    unwrapped first.
    """
    raw = spark.read.text(folder, wholetext=whole_files).select(strip("value").alias("value"))
    unwrapped = F.when(
        F.col("value").startswith('"'),
        F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v STRING")["v"],
    ).otherwise(F.col("value"))
    return (
        raw.where("value <> ''")
        .select(F.from_json(unwrapped, OUTLINE_SCHEMA).alias("d"))
        .select("d.doc_id", "d.title", "d.outline")
    )
