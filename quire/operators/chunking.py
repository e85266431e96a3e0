"""Cutting documents into chunks and giving chunks a page.

Each document's pieces stay in its own row until the final explode, so
chunking needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import let, strip


def fixed_windows(c: Column, size: int, overlap: int) -> Column:
    """Character windows of ``size`` that advance by ``size - overlap``."""
    stride = size - overlap
    count = F.greatest(F.ceil((F.length(c) - overlap) / float(stride)).cast("int"), F.lit(1))
    return F.when(
        F.length(c) > 0,
        F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(c, i * stride + 1, F.lit(size))),
    ).otherwise(F.array().cast("array<string>"))


def chunk_id(doc_id: str = "doc_id", index: str = "chunk_index") -> Column:
    return F.concat(F.col(doc_id).cast("string"), F.lit("_chunk_"), F.col(index).cast("string"))


def _explode(docs: DataFrame, pieces: Column) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    return docs.select(*kept, F.posexplode(pieces).alias("chunk_index", "content")).withColumn(
        "chunk_id", chunk_id()
    )


def chunk_fixed(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    return _explode(docs, fixed_windows(F.col("text"), size, overlap))


def split_fixed(c, n: int) -> Column:
    """Consecutive pieces of ``n`` characters."""
    return fixed_windows(F.col(c) if isinstance(c, str) else c, n, 0)


# --- recursive splitting ------------------------------------------------------
#
# A piece is (text, run). A piece at or above the size limit is split at the
# next separator that it holds; its children form new runs, and a long child
# ends the run of short ones before it. Only pieces of one run are packed
# together afterwards.

def _piece(text: Column, run: Column) -> Column:
    return F.struct(text.alias("text"), run.alias("run"))


def _split_keep(text: Column, separator: str) -> Column:
    """Parts with the separator at the start of each following part."""
    if len(separator) > 1:
        # separators are taken from the left and don't overlap, however long a run of them is
        parts = F.transform(F.split(text, separator), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(separator), p)))
    else:
        parts = F.split(text, f"(?=[{separator}])")
    return F.array_remove(parts, "")


def _split_level(pieces: Column, separator: str, level: int, size: int) -> Column:
    def children(piece: Column, parts: Column, lengths: Column) -> Column:
        return F.transform(
            parts,
            lambda p, j: _piece(
                p,
                F.concat(
                    piece["run"], F.lit(f"/{level}."),
                    # runs are numbered by how many long parts come before
                    F.size(F.filter(F.slice(lengths, F.lit(1), j), lambda n: n >= size)).cast("string"),
                    F.when(F.length(p) >= size, "L").otherwise(""),
                ),
            ),
        )

    def split_piece(piece: Column) -> Column:
        parts = _split_keep(piece["text"], separator)
        split = let(parts, lambda ps: let(F.transform(ps, lambda p: F.length(p)), lambda ns: children(piece, ps, ns)))
        return F.when(
            (F.length(piece["text"]) >= size) & piece["text"].contains(separator), split
        ).otherwise(F.array(piece))

    return F.flatten(F.transform(pieces, split_piece))


def _split_long(pieces: Column, size: int, overlap: int) -> Column:
    """What no separator can split becomes character windows, each its own run."""
    return F.flatten(
        F.transform(
            pieces,
            lambda piece: F.when(F.length(piece["text"]) <= size, F.array(piece)).otherwise(
                F.transform(
                    fixed_windows(piece["text"], size, overlap),
                    lambda w, j: _piece(w, F.concat(piece["run"], F.lit("#"), j.cast("string"))),
                )
            ),
        )
    )


def _tail(parts: Column, limit: Column) -> Column:
    """The longest run of final parts whose lengths sum to at most ``limit``."""
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(0).alias("total"), F.lit(False).alias("full")
    )

    def step(s: Column, p: Column) -> Column:
        over = s["full"] | (s["total"] + F.length(p) > limit)
        return F.when(
            over, F.struct(s["kept"].alias("kept"), s["total"].alias("total"), F.lit(True).alias("full"))
        ).otherwise(
            F.struct(
                F.concat(F.array(p), s["kept"]).alias("kept"),
                (s["total"] + F.length(p)).alias("total"),
                F.lit(False).alias("full"),
            )
        )

    return F.aggregate(F.reverse(parts), start, step)["kept"]


def _lengths(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p))


def _pack(pieces: Column, size: int, overlap: int) -> Column:
    """Greedy packing of each run into chunks, carrying an overlap forward."""
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("done"), texts.alias("open"), F.lit("").alias("run"))

    def state(done, open_, run):
        return F.struct(done.alias("done"), open_.alias("open"), run.alias("run"))

    def close(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.array_join(s["open"], "")))

    def step(s: Column, p: Column) -> Column:
        one = F.array(p["text"])
        grown = _lengths(s["open"]) + F.length(p["text"])
        room = F.least(F.lit(overlap), F.lit(size) - F.length(p["text"]))
        return (
            F.when(F.size(s["open"]) == 0, state(s["done"], one, p["run"]))
            .when(s["run"] != p["run"], state(close(s), one, p["run"]))
            .when(grown > size, state(close(s), F.concat(_tail(s["open"], room), one), p["run"]))
            .otherwise(state(s["done"], F.concat(s["open"], one), p["run"]))
        )

    packed = F.aggregate(pieces, start, step, lambda s: F.when(F.size(s["open"]) > 0, close(s)).otherwise(s["done"]))
    return F.array_remove(F.transform(packed, lambda t: strip(t)), "")


def recursive_chunks(c: Column, size: int, overlap: int) -> Column:
    pieces = F.array(_piece(c, F.lit("")))
    for level, separator in enumerate(V.SEPARATORS):
        pieces = _split_level(pieces, separator, level, size)
    return _pack(_split_long(pieces, size, overlap), size, overlap)


def chunk_recursive(docs: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Split at the coarsest separator that helps, pack up to ``size`` with overlap."""
    return _explode(docs.where(F.length("text") > 0), recursive_chunks(F.col("text"), size, overlap))


# --- pages and counts -----------------------------------------------------------

def assign_pages(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """0-based page: the last marker in the chunk, else spread, else a guess.

    ``pages`` (doc_id, page_count) gives the known page counts.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    if pages is not None:
        counts = counts.join(pages.select("doc_id", "page_count"), "doc_id", "left")
    else:
        counts = counts.withColumn("page_count", F.lit(0))
    marker = F.try_element_at(F.regexp_extract_all("content", F.lit(V.PAGE_MARKER), F.lit(1)), F.lit(-1))
    i = F.col("chunk_index")
    spread = F.when(
        F.col("page_count") > 0,
        F.least(F.floor(i * F.col("page_count") / F.col("n_chunks")), F.col("page_count") - 1),
    )
    guess = F.least(F.floor(i / V.CHUNKS_PER_GUESSED_PAGE), F.lit(V.PAGE_GUESS_LIMIT))
    marked = F.when(marker.isNotNull(), F.greatest(marker.cast("int") - 1, F.lit(0)))
    page = F.coalesce(marked, spread, guess)
    return chunks.join(counts, "doc_id").withColumn("page_number", page.cast("int")).drop("n_chunks", "page_count")


def chunk_stats(chunks: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per document: chunk count, sizes, indexed status and page count."""
    stats = chunks.groupBy("doc_id").agg(
        F.count("*").alias("chunk_count"),
        F.min(F.length("content")).alias("min_size"),
        F.max(F.length("content")).alias("max_size"),
        F.sum(F.length("content")).alias("total_size"),
    )
    guess = F.floor(F.col("chunk_count") / 2)
    if pages is not None:
        stats = stats.join(pages.select("doc_id", F.col("page_count").alias("_pages")), "doc_id", "left")
        stats = stats.withColumn("page_count", F.coalesce("_pages", guess)).drop("_pages")
    else:
        stats = stats.withColumn("page_count", guess)
    return stats.withColumn("status", F.lit("indexed"))
