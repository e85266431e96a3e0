"""Representative content per document.

The chunks of one document are gathered once, in order, next to the document
(never more than the one text they were cut from); every strategy is then an
expression over that list, so the strategies share a single shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import (
    content_quality, contains_any, dedupe_sentences, head, truncate_ellipsis, words,
)
from quire.operators.search import term_search


def document_chunks(chunks: DataFrame) -> DataFrame:
    """One row per document with its chunks in order."""
    part = F.struct("chunk_index", "page_number", "chunk_id", "content")
    # dealt by document alone, which later joins by document go on with
    return chunks.repartition("doc_id").groupBy("session_id", "doc_id", "doc_name").agg(
        F.array_sort(F.collect_list(part)).alias("parts")
    )


def choose_strategy(chunks: DataFrame) -> DataFrame:
    counted = chunks.groupBy("session_id", "doc_id").agg(F.count("*").alias("chunk_count"))
    return counted.withColumn("strategy", _strategy(F.col("chunk_count")))


def _strategy(n: Column) -> Column:
    return (
        F.when(n <= V.SMALL_DOCUMENT_CHUNKS, "structural")
        .when(n <= V.MEDIUM_DOCUMENT_CHUNKS, "diverse")
        .otherwise("hybrid")
    )


def _joined(parts: Column) -> Column:
    text = F.array_join(F.transform(parts, lambda p: p["content"]), " ")
    return truncate_ellipsis(text, V.MAX_CONTENT_LENGTH)


def diverse_parts(parts: Column) -> Column:
    """Two from the start, two from the end, two spread over the middle."""
    ordered = F.array_sort(
        F.transform(parts, lambda p: F.struct(p["page_number"].alias("page_number"), p["chunk_index"].alias("chunk_index"), p["content"].alias("content")))
    )
    n = F.size(parts)
    none = F.slice(ordered, 1, 0)
    middle = F.floor((n - 4) / 2).cast("int")
    return F.concat(
        F.slice(ordered, 1, 2),
        F.when(n > 3, F.slice(ordered, -2, 2)).otherwise(none),
        F.when(n > 5, F.concat(F.slice(ordered, 3, 1), F.slice(ordered, F.greatest(middle + 3, F.lit(1)), F.lit(1)))).otherwise(none),
    )


def is_structural(content: Column) -> Column:
    low = F.lower(content)
    return (
        contains_any(head(low, 100), V.STRUCTURAL_HEAD_WORDS)
        | F.right(low, F.lit(100)).contains(V.STRUCTURAL_TAIL_WORD)
        | low.contains(V.STRUCTURAL_ANY_WORD)
        | (F.size(words(low)) < V.STRUCTURAL_SHORT_WORDS)
    )


def structural_parts(parts: Column, target: int = V.TARGET_CHUNKS) -> Column:
    """Up to three structural chunks, then regular ones up to the target."""
    marked = F.slice(F.filter(parts, lambda p: is_structural(p["content"])), 1, 3)
    regular = F.filter(parts, lambda p: ~is_structural(p["content"]))
    return F.concat(marked, F.slice(regular, F.lit(1), F.lit(target) - F.size(marked)))


def select_diverse(chunks: DataFrame) -> DataFrame:
    return document_chunks(chunks).select("session_id", "doc_id", _joined(diverse_parts(F.col("parts"))).alias("content"))


def select_structural(chunks: DataFrame, target: int = V.TARGET_CHUNKS) -> DataFrame:
    return document_chunks(chunks).select(
        "session_id", "doc_id", _joined(structural_parts(F.col("parts"), target)).alias("content")
    )


def default_probes(sessions: DataFrame) -> DataFrame:
    """The fixed probe questions for every session."""
    listed = F.array(*[F.lit(p) for p in V.SEMANTIC_PROBES])
    return sessions.select("session_id", F.explode(listed).alias("query_text"))


def probe_hits(chunks: DataFrame, docs: DataFrame, probes: DataFrame, k: int = 3) -> DataFrame:
    """Chunk numbers per document that answer a probe: (doc_id, chunk_index).

    A document's own name is probed once per document, the shared questions
    once per session. A hit counts for each document holding the same text,
    through the first such chunk.
    """
    shared = probes.select(
        F.concat(F.lit("s:"), "session_id", F.lit(":"), F.md5("query_text")).alias("query_id"), "session_id", "query_text"
    ).distinct()
    named = docs.select(
        F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("query_id"), "session_id", F.col("doc_name").alias("query_text")
    )
    keyed = chunks.select("session_id", "doc_id", "chunk_id", "chunk_index", F.md5("content").alias("content_key"))
    first = keyed.groupBy("session_id", "doc_id", "content_key").agg(F.min("chunk_index").alias("chunk_index"))
    hits = term_search(chunks, shared.unionByName(named), k).select("query_id", "chunk_id")
    found = hits.join(keyed.select("session_id", "chunk_id", "content_key"), "chunk_id").select(
        "query_id", "session_id", "content_key"
    ).distinct()
    for_all = found.where("query_id like 's:%'").join(first, ["session_id", "content_key"])
    for_one = (
        found.where("query_id like 'd:%'")
        .withColumn("doc_id", F.expr("cast(substr(query_id, 3) as bigint)"))
        .join(first, ["session_id", "doc_id", "content_key"])
    )
    both = for_all.select("doc_id", "chunk_index").unionByName(for_one.select("doc_id", "chunk_index"))
    return both.groupBy("doc_id").agg(F.array_sort(F.collect_set("chunk_index")).alias("relevant"))


def _with_hits(chunks: DataFrame, probes: DataFrame, only: Column | None = None) -> DataFrame:
    gathered = document_chunks(chunks)
    asking = chunks.groupBy("session_id", "doc_id", "doc_name").agg(F.count("*").alias("n"))  # no text is moved to ask
    if only is not None:
        asking = asking.where(only)
    return gathered.join(probe_hits(chunks, asking, probes), "doc_id", "left")


def semantic_content(target: int = V.TARGET_CHUNKS) -> Column:
    chosen = F.slice(F.col("relevant"), 1, target)
    picked = F.filter(F.col("parts"), lambda p: F.array_contains(chosen, p["chunk_index"]))
    return F.when(F.col("relevant").isNull(), _joined(diverse_parts(F.col("parts")))).otherwise(_joined(picked))


def select_semantic(chunks: DataFrame, probes: DataFrame) -> DataFrame:
    """Chunks that answer the probes, in document order; diverse ones if none do."""
    return _with_hits(chunks, probes).select("session_id", "doc_id", semantic_content().alias("content"))


def _hybrid(structural: Column, semantic: Column, diverse: Column) -> Column:
    """Openings of the three, leaving out what is already there."""
    first = head(structural, 800)
    second = head(semantic, 1200)
    use_second = (semantic != "") & (semantic != structural) & ~structural.contains(second)
    body = F.when(use_second & (first != ""), F.concat(first, F.lit(" "), second)).when(use_second, second).otherwise(first)
    third = head(diverse, 1000)
    use_third = (diverse != "") & ~body.contains(third)
    joined = F.when(use_third & (body != ""), F.concat(body, F.lit(" "), third)).when(use_third, third).otherwise(body)
    return truncate_ellipsis(dedupe_sentences(joined), V.MAX_CONTENT_LENGTH)


def _strategy_columns(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("_structural", _joined(structural_parts(F.col("parts"))))
        .withColumn("_semantic", semantic_content())
        .withColumn("_diverse", _joined(diverse_parts(F.col("parts"))))
    )


def select_hybrid(chunks: DataFrame, probes: DataFrame) -> DataFrame:
    return _strategy_columns(_with_hits(chunks, probes)).select(
        "session_id", "doc_id", _hybrid(F.col("_structural"), F.col("_semantic"), F.col("_diverse")).alias("content")
    )


def strategic_content(chunks: DataFrame, probes: DataFrame, strategy: str = "auto") -> DataFrame:
    """Content by strategy with the strategy used, totals and a quality score."""
    chosen = _strategy(F.size("parts")) if strategy == "auto" else F.lit(strategy)
    only = (F.col("n") > V.MEDIUM_DOCUMENT_CHUNKS) if strategy == "auto" else None
    rows = _strategy_columns(_with_hits(chunks, probes, only)).withColumn("strategy_used", chosen)
    content = (
        F.when(F.col("strategy_used") == "diverse", F.col("_diverse"))
        .when(F.col("strategy_used") == "semantic", F.col("_semantic"))
        .when(F.col("strategy_used") == "structural", F.col("_structural"))
        .otherwise(_hybrid(F.col("_structural"), F.col("_semantic"), F.col("_diverse")))
    )
    return rows.withColumn("content", content).select(
        "session_id", "doc_id", "doc_name", "content", "strategy_used",
        F.size("parts").alias("total_chunks"),
        F.length("content").alias("content_length"),
        content_quality("content").alias("selection_quality"),
    )


def content_fallback(docs: DataFrame, strategic: DataFrame, chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """A text for every document, from the best source that has one.

    Strategic content, else the three chunks closest to its name, else the
    openings of its first three chunks, else its name and page count. Name
    search runs only for documents that need it.
    """
    base = docs.select("session_id", "doc_id", "doc_name").join(
        strategic.select("doc_id", F.col("content").alias("_content"), "strategy_used", "selection_quality"), "doc_id", "left"
    )
    empty = F.coalesce(F.col("_content"), F.lit("")) == ""
    lacking = base.where(empty).select(
        F.col("doc_id").alias("query_id"), "session_id", F.col("doc_name").alias("query_text")
    )
    hits = term_search(chunks, lacking, 3).join(chunks.select("chunk_id", "content"), "chunk_id")
    by_name = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_hits")).select(
        F.col("query_id").alias("doc_id"), F.array_join(F.transform("_hits", lambda h: h["content"]), " ").alias("_by_name")
    )
    openings = (
        chunks.where("chunk_index < 3").groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", head("content", 500).alias("text")))).alias("_first"))
        .select("doc_id", F.array_join(F.transform("_first", lambda p: p["text"]), " ").alias("_openings"))
    )
    rows = base.join(by_name, "doc_id", "left").join(openings, "doc_id", "left")
    if pages is not None:
        rows = rows.join(pages.select("doc_id", "page_count"), "doc_id", "left")
    else:
        rows = rows.withColumn("page_count", F.lit(0))
    name = F.concat("doc_name", F.lit(" "), "doc_name", F.lit(" pages:"), F.coalesce("page_count", F.lit(0)).cast("string"))
    return rows.select(
        "session_id", "doc_id", "doc_name",
        F.when(~empty, F.col("_content")).otherwise(F.coalesce("_by_name", "_openings", name)).alias("content"),
        F.when(~empty, F.col("strategy_used"))
        .when(F.col("_by_name").isNotNull(), "semantic_fallback")
        .when(F.col("_openings").isNotNull(), "storage_fallback")
        .otherwise("basic_fallback").alias("content_source"),
        F.coalesce("selection_quality", F.lit(0.0)).alias("selection_quality"),
    )
