"""Packing chosen text under size budgets.

Result lists are at most k long per request, so gathering one list stays small
whatever share of all rows a request, session or document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import content_hash, display_page, head, key_sentences, percent, truncate_sentences
from quire.operators.search import top_k
from quire.session import cut_lineage


def _numbered(hits: DataFrame, limit: int, *columns: str) -> DataFrame:
    """Hits per request as one ordered list of at most ``limit`` entries."""
    return (
        hits.where(F.col("rank") <= limit).groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", *columns))).alias("hits"))
    )


def ask_context(hits: DataFrame, limit: int = 5) -> DataFrame:
    """Numbered sources with their full text, and the list of names."""
    listed = _numbered(hits, limit, "doc_name", "content")
    return listed.select(
        "query_id",
        F.array_join(
            F.transform(
                "hits",
                lambda h, i: F.concat(
                    F.lit("Source "), (i + 1).cast("string"), F.lit(" (from "), h["doc_name"], F.lit("):\n"), h["content"], F.lit("\n\n")
                ),
            ),
            "",
        ).alias("context"),
        F.transform("hits", lambda h, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), h["doc_name"])).alias("sources"),
    )


def insight_context(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """The selection at 300 characters and three openings cut at 500 in all."""
    listed = _numbered(hits, 3, "content").select(
        "query_id",
        F.array_join(
            F.transform(
                "hits", lambda h, i: F.concat(F.lit("Doc"), (i + 1).cast("string"), F.lit(": "), head(h["content"], 400), F.lit("...\n"))
            ),
            "",
        ).alias("_context"),
    )
    return requests.select("query_id", head("query_text", 300).alias("selection")).join(listed, "query_id", "left").select(
        "query_id", "selection", F.coalesce(head("_context", 500), F.lit("")).alias("context")
    )


def persona_context(sections: DataFrame) -> DataFrame:
    """Up to ten ranked chunks with document and page above each.

    Takes rows with the 0-based page and ``rank`` in persona order.
    """
    listed = _numbered(sections.withColumn("page", display_page("page_number")), 10, "doc_name", "page", "content")
    return listed.select(
        "query_id",
        F.array_join(
            F.transform(
                "hits",
                lambda h: F.concat(
                    F.lit("Document: "), h["doc_name"], F.lit(", Page "), h["page"].cast("string"), F.lit("\n"), head(h["content"], 500), F.lit("\n\n")
                ),
            ),
            "",
        ).alias("context"),
    )


def budget_pack(hits: DataFrame, budget: int = 1500, sections: int = 5, prefer: str | None = None) -> DataFrame:
    """Sections in order until the next one would pass the budget.

    ``prefer`` names a column with the document that comes first. The running
    total only grows, so the sections kept are exactly those before the stop.
    """
    fetched = hits.where(F.col("rank") <= 2 * sections)
    order = [F.col("rank").asc()]
    if prefer:
        order.insert(0, (~F.col("doc_name").eqNullSafe(F.col(prefer))).asc())
    by_request = Window.partitionBy("query_id").orderBy(*order)
    placed = fetched.withColumn("place", F.row_number().over(by_request)).where(F.col("place") <= sections)
    text = F.concat(
        F.lit("\n--- Section "), F.col("place").cast("string"), F.lit(" (from "), F.col("doc_name"), F.lit(") ---\n"),
        head("content", 400), F.lit("...\n"),
    )
    running = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        placed.withColumn("section", text)
        .withColumn("used", F.sum(F.length("section")).over(running))
        .where(F.col("used") <= budget)
        .select("query_id", "chunk_id", "place", "section", "used")
    )


def packed_text(packed: DataFrame) -> DataFrame:
    return packed.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda s: s["section"]), "").alias("content"),
        F.max("used").alias("used"),
    )


def global_position(rows: DataFrame, order: str, bucket: Column) -> DataFrame:
    """0-based place of each row in the order of a key, without one global sort.

    ``bucket`` must not decrease as the key grows and hold a bounded number of
    rows. Rows are numbered inside their bucket, buckets inside the range of
    buckets that their partition holds; across the whole table only one total
    per partition is summed up.
    """
    marked = rows.withColumn("_bucket", bucket)
    counts = marked.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    # stored, since the bounds of the ranges are sampled anew at each run
    ranged = cut_lineage(counts.repartitionByRange("_bucket").withColumn("_part", F.spark_partition_id()))

    def before(key: str, over: WindowSpec) -> Column:
        return F.coalesce(F.sum(key).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = ranged.groupBy("_part").agg(F.sum("_rows").alias("_total")).withColumn("_start", before("_total", Window.orderBy("_part")))
    offsets = ranged.withColumn("_inner", before("_rows", Window.partitionBy("_part").orderBy("_bucket"))).join(parts, "_part").select(
        "_bucket", (F.col("_start") + F.col("_inner")).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy(order)
    return (
        marked.withColumn("_at", F.row_number().over(inside) - 1).join(offsets, "_bucket")
        .withColumn("position", F.col("_offset") + F.col("_at")).drop("_bucket", "_at", "_offset")
    )


def batch_requests(requests: DataFrame, bucket: Column, n: int = V.REQUEST_BATCH, order: str = "query_id") -> DataFrame:
    """Groups of ``n`` requests in order, one combined text per group."""
    placed = global_position(requests, order, bucket)
    grouped = placed.groupBy(F.floor(F.col("position") / n).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "content"))).alias("items")
    )
    entry = F.transform(
        "items",
        lambda r, i: F.concat(
            F.lit("Request "), (i + 1).cast("string"), F.lit(":\nType: "), r["kind"], F.lit("\nContent: "), head(r["content"], 200), F.lit("...\n\n")
        ),
    )
    return grouped.select(
        "batch", F.size("items").alias("requests"),
        F.concat(
            F.lit("Process the following requests and provide responses in JSON format:\n\n"),
            F.array_join(entry, ""),
            F.lit("Respond with JSON array: [response1, response2, ...]"),
        ).alias("text"),
    )


def document_context(docs: DataFrame, kind: str = "summary", text: str = "text") -> DataFrame:
    """A task line, the opening, and the two longest sentences of the rest."""
    c = F.col(text)
    opening = head(c, 500)
    rest = F.substring(c, F.lit(501), F.length(c))
    body = F.when(F.length(c) > 500, F.concat(opening, F.lit(" "), key_sentences(rest, 2))).otherwise(opening)
    task = V.ANALYSIS_TASKS.get(kind, V.DEFAULT_TASK)
    return docs.withColumn("context", F.concat(F.lit(f"{task}:\n\n"), body))


def pair_context(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """A request to explain each edge, with both texts cut to 300."""
    texts = docs.select("doc_id", truncate_sentences("content", 300).alias("cut"))
    a = texts.withColumnsRenamed({"doc_id": "src", "cut": "src_cut"})
    b = texts.withColumnsRenamed({"doc_id": "dst", "cut": "dst_cut"})
    return edges.join(a, "src").join(b, "dst").select(
        "src", "dst",
        F.concat(
            F.lit("Explain relationship between these documents in 2 sentences:\n\nDoc1: "), F.col("src_cut"),
            F.lit("\nDoc2: "), F.col("dst_cut"), F.lit("\nSimilarity: "), percent("similarity", 0),
            F.lit("\n\nFocus on shared topics, themes, or methodologies."),
        ).alias("context"),
    )


def importance_context(docs: DataFrame, text: str = "content", context: str | None = None) -> DataFrame:
    """A request to rate a document, its text cut to 400 and any context to 200."""
    extra = F.lit("")
    if context is not None:
        extra = F.when(
            F.coalesce(F.col(context), F.lit("")) != "",
            F.concat(F.lit("\n\nContext: "), truncate_sentences(context, 200)),
        ).otherwise("")
    return docs.withColumn(
        "context",
        F.concat(
            F.lit("Rate importance (1-10) and explain why:\n\nDocument: "), truncate_sentences(text, 400), extra,
            F.lit("\n\nProvide: 1) Importance score (1-10) 2) Brief reason"),
        ),
    )


def community_context(docs: DataFrame, partition: DataFrame, limit: int = 3) -> DataFrame:
    """Up to three documents of each community, cut to 200."""
    members = partition.select("community", F.col("node").alias("doc_id"))
    first = top_k(members, "community", [F.col("doc_id").asc()], limit)
    cut = first.join(docs.select("doc_id", truncate_sentences("content", 200).alias("cut")), "doc_id")
    listed = cut.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "cut"))).alias("members"))
    return listed.select(
        "community",
        F.array_join(
            F.transform("members", lambda m: F.concat(F.lit("Doc"), m["rank"].cast("string"), F.lit(": "), m["cut"], F.lit("\n"))), ""
        ).alias("context"),
    )


def reuse_answers(requests: DataFrame, cache: DataFrame, now: Column, ttl_days: int = V.ANSWER_TTL_DAYS) -> tuple[DataFrame, DataFrame]:
    """Requests with a fresh stored answer, and those still to be answered.

    ``requests`` hold a ``content``; ``cache`` holds answer_key, answer and
    written_at (seconds). The newest stored answer of a key counts.
    """
    fresh = (
        cache.where(now - F.col("written_at") < ttl_days * 86400).groupBy("answer_key")
        .agg(F.max_by("answer", F.struct("written_at", "answer")).alias("answer"))
    )
    keyed = requests.withColumn("answer_key", content_hash("content"))
    return keyed.join(fresh, "answer_key"), keyed.join(fresh, "answer_key", "left_anti")
