"""Keyword top-k that scores only the blocks of chunks which can hold a hit.

The chunks of a session are dealt to blocks of similar length, and every (block, term)
keeps its largest score part. The sum of those parts over a question's terms bounds the
score of all chunks of the block. The blocks with the best bounds are scored first; what
their k-th best hit leaves unreachable is removed by a join before the rest is scored.
Nothing is estimated: the hits are those of ``search.keyword_search``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.operators.search import KeywordIndex, best_first, bm25, minmax_normalize, query_terms, top_k
from quire.session import cut_lineage, discard

#: Chunks of a block, on average.
BLOCK_ROWS = 64
#: Ratio of the longest to the shortest chunk of a block.
LENGTH_STEP = 1.25
#: Blocks of a question that are scored to find a floor for the others.
SEEDS = 8
#: Blocks of a term that share a salt.
BLOCKS_PER_SALT = 1024
#: Hits tie when their scores agree to nine digits; twice that is left for ties and for the rounding of sums.
SLACK = 2e-9


@dataclass
class BlockIndex:
    """Postings by block, the best score part of each block's terms, and the terms."""

    postings: DataFrame  # session_id, block, term, doc_id, chunk_id, part
    blocks: DataFrame  # session_id, term, salt, block, rows, best
    terms: DataFrame  # session_id, term, rows, salts
    stats: DataFrame  # one row: chunks, mean_length


def build_block_index(index: KeywordIndex, block_rows: int = BLOCK_ROWS, blocks_per_salt: int = BLOCKS_PER_SALT) -> BlockIndex:
    """Deal a keyword index to blocks of about ``block_rows`` chunks, stored in the shared folder.

    Chunks of a session whose lengths lie within a factor of ``LENGTH_STEP`` share as many
    blocks as they fill, dealt by a hash of the chunk. A term has one salt per
    ``blocks_per_salt`` blocks, so only terms of many blocks are spread (and asked for) more
    than once. The score parts hold the mean length of ``index.stats``. An index without
    postings gives empty tables.
    """
    band = F.floor(F.log(F.col("length").cast("double")) / math.log(LENGTH_STEP)).cast("int")
    rows = index.postings.withColumn("band", band)
    # a chunk's terms sum up to its length, so no chunk has to be told from another to count them
    sizes = rows.groupBy("session_id", "band").agg(F.ceil(F.sum(F.col("tf") / F.col("length")) / block_rows).alias("parts"))
    turn = F.pmod(F.xxhash64("chunk_id"), F.greatest("parts", F.lit(1)))
    part = bm25(F.lit(1.0), F.col("tf"), F.col("length"), index.stats.select("mean_length").scalar())
    placed = rows.join(sizes, ["session_id", "band"]).select(
        "session_id", (F.col("band") * F.lit(1 << 32) + turn).alias("block"), "term", "doc_id", "chunk_id", part.alias("part")
    )
    postings = cut_lineage(placed)
    best = cut_lineage(postings.groupBy("session_id", "term", "block").agg(F.count("*").alias("rows"), F.max("part").alias("best")))
    salts = F.ceil(F.count("*") / blocks_per_salt).cast("int")
    terms = cut_lineage(best.groupBy("session_id", "term").agg(F.sum("rows").alias("rows"), salts.alias("salts")))
    spread = best.join(terms.select("session_id", "term", "salts"), ["session_id", "term"])
    blocks = cut_lineage(spread.select("session_id", "term", F.pmod(F.xxhash64("block"), "salts").cast("int").alias("salt"), "block", "rows", "best"))
    discard(best)
    return BlockIndex(postings, blocks, terms, cut_lineage(index.stats))


def write_block_index(index: BlockIndex, folder: str) -> None:
    """Store an index, a partition per session; a block's postings lie in one file, sorted by term."""
    by_block = index.postings.repartition("session_id", "block").sortWithinPartitions("session_id", "term", "block")
    for name, rows in (("postings", by_block), ("blocks", index.blocks.repartition("session_id", "term", "salt")), ("terms", index.terms.repartition("session_id"))):
        rows.write.mode("overwrite").partitionBy("session_id").parquet(f"{folder}/{name}")
    index.stats.write.mode("overwrite").parquet(f"{folder}/stats")


def read_block_index(spark: SparkSession, folder: str) -> BlockIndex:
    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}").withColumn("session_id", F.col("session_id").cast("string"))

    return BlockIndex(stored("postings"), stored("blocks"), stored("terms"), spark.read.parquet(f"{folder}/stats"))


def _weights(index: BlockIndex, wanted: DataFrame) -> DataFrame:
    """(query_id, session_id, term, weight, salts) of the terms asked for that the question's session holds."""
    known = index.terms.join(wanted.select("term").distinct(), "term", "left_semi")
    df = known.groupBy("term").agg(F.sum("rows").alias("df"))
    n = index.stats.select("chunks").scalar()
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(V.BM25_MIN_IDF))
    return wanted.join(df, "term").join(known, ["session_id", "term"]).select(
        "query_id", "session_id", "term", (F.col("asked") * idf).alias("weight"), "salts"
    )


def _bounds(index: BlockIndex, weights: DataFrame, needed: DataFrame | None) -> DataFrame:
    """(query_id, session_id, block, bound, rows) of all blocks with a term of the question, or with every one if ``needed`` is given."""
    asked = weights.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    bounds = index.blocks.join(asked.drop("salts"), ["session_id", "term", "salt"]).groupBy("query_id", "session_id", "block").agg(
        F.sum(F.col("weight") * F.col("best")).alias("bound"), F.sum("rows").alias("rows"), F.count("*").alias("held")
    )
    if needed is not None:
        bounds = bounds.join(needed, "query_id").where("held = needed").drop("needed")
    return bounds.drop("held")


def _scores(index: BlockIndex, picked: DataFrame, weights: DataFrame, needed: DataFrame | None) -> DataFrame:
    """Scores of the matching chunks of the blocks ``picked`` (query_id, session_id, block)."""
    lists = picked.select("query_id", "session_id", "block").join(weights.drop("salts"), ["query_id", "session_id"])
    scored = index.postings.join(lists, ["session_id", "block", "term"]).groupBy("query_id", "session_id", "doc_id", "chunk_id").agg(
        F.sum(F.col("weight") * F.col("part")).alias("score"), F.count("*").alias("matched")
    )
    if needed is not None:
        scored = scored.join(needed, "query_id").where("matched = needed").drop("needed")
    return scored.drop("matched")


def _plan(index: BlockIndex, queries: DataFrame, k: int, mode: str, stems: DataFrame | None, seeds: int):
    """The questions' weights and needs, and their blocks with ``open``: whether one can hold a hit."""
    if mode not in ("all", "any"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = query_terms(queries, stems).groupBy("query_id", "session_id", "term").agg(F.count("*").alias("asked"))
    needed = cut_lineage(wanted.groupBy("query_id").agg(F.count("*").alias("needed"))) if mode == "all" else None
    weights = cut_lineage(_weights(index, wanted))
    bounds = cut_lineage(_bounds(index, weights, needed))
    first = top_k(bounds, "query_id", [F.col("bound").desc(), F.col("block").asc()], seeds, "turn")
    floors = top_k(_scores(index, first, weights, needed), "query_id", best_first(), k).groupBy("query_id").agg(
        F.count("*").alias("found"), F.min("score").alias("floor")
    ).where(F.col("found") >= k)
    reach = F.col("bound") >= F.col("floor") - SLACK * (1 + F.col("floor"))
    return weights, needed, bounds.join(floors.drop("found"), "query_id", "left").withColumn("open", F.coalesce(reach, F.lit(True)))


def block_search(
    index: BlockIndex,
    queries: DataFrame,
    k: int = V.DEFAULT_TOP_K,
    mode: str = "all",
    stems: DataFrame | None = None,
    parity: bool = False,
    seeds: int = SEEDS,
) -> DataFrame:
    """The hits of ``search.keyword_search`` with corpus statistics, columns alike.

    ``seeds`` blocks per question are scored first. A question with fewer than ``k`` hits
    there has all of its blocks scored.
    """
    weights, needed, blocks = _plan(index, queries, k, mode, stems, seeds)
    hits = top_k(_scores(index, blocks.where("open"), weights, needed), "query_id", best_first(), k)
    return minmax_normalize(hits, "score", "query_id", best="low" if parity else "high")


def postings_read(
    index: BlockIndex, queries: DataFrame, k: int = V.DEFAULT_TOP_K, mode: str = "all", stems: DataFrame | None = None, seeds: int = SEEDS
) -> DataFrame:
    """Per question with a match: its blocks and their postings, and how many of both ``block_search`` scores at the end."""
    _, _, blocks = _plan(index, queries, k, mode, stems, seeds)
    return blocks.groupBy("query_id").agg(
        F.count("*").alias("blocks"), F.count_if("open").alias("blocks_read"),
        F.sum("rows").alias("postings"), F.sum(F.when(F.col("open"), F.col("rows")).otherwise(0)).alias("postings_read"),
    )
