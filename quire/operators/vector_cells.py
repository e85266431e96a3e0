"""Exact top-k over vectors that reads only the cells which can hold a hit.

The vectors of a session are dealt to cells, each with a centre and a radius (the
largest angle between a member and the centre). A question meets no member of a cell
at a smaller angle than that to the centre less the radius, which bounds the cosine.
Cells are read in the order of their bounds, in rounds of 1, 1, 2, 4, ... cells, until
no unread cell's bound reaches the question's k-th best score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.operators.search import TILE_ROWS, best_first, best_of_tile, tiled, top_k, unit_rows
from quire.session import cut_lineage, discard

#: Room for the rounding of angles.
SLACK = 1e-6


@dataclass
class VectorCells:
    """Vectors by cell, and the cells."""

    rows: DataFrame  # session_id, doc_id, chunk_id, embedding, cell, part
    cells: DataFrame  # session_id, cell, centre, radius, members, parts


def build_cells(vectors: DataFrame, per_cell: float | None = None, tile_rows: int = TILE_ROWS) -> VectorCells:
    """Deal the vectors of every session to cells.

    Centres are the vectors whose hash falls under a session's share, so that a cell has
    about ``per_cell`` members (by default the square root of the session's vectors), and
    the vector with the smallest hash in any case. A vector goes to the centre it is
    nearest to. Cells of more than ``tile_rows`` members have several parts.
    """
    named = vectors.select("session_id", "doc_id", "chunk_id", "embedding")
    turn = F.pmod(F.xxhash64("chunk_id", "doc_id"), F.lit(1 << 40))
    sizes = named.groupBy("session_id").agg(F.count("*").alias("n"), F.min(turn).alias("first"))
    wanted = F.sqrt("n") if per_cell is None else F.lit(float(per_cell))
    chosen = named.withColumn("turn", turn).join(sizes, "session_id").where((F.col("turn") == F.col("first")) | (F.col("turn") * wanted < F.lit(float(1 << 40))))
    centres = cut_lineage(chosen.select("session_id", F.col("embedding").alias("centre")).distinct().withColumn("cell", F.monotonically_increasing_id()))
    rows = tiled(named, "session_id", "chunk_id", "tile", tile_rows)
    spans = rows.groupBy("session_id").agg(F.max("tiles").alias("tiles"))
    copies = centres.join(spans, "session_id").withColumn("tile", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")))).drop("tiles")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left.assign(cell=pd.Series(dtype="int64"), apart=pd.Series(dtype="float64")).drop(columns=["tile"])
        right = right.sort_values("cell", kind="stable")
        x = unit_rows(left["embedding"])
        cosine = np.clip(x @ unit_rows(right["centre"]).T, -1, 1)
        at = cosine.argmax(axis=1)
        apart = np.where(x.any(axis=1), np.arccos(cosine[np.arange(len(at)), at]), np.pi)  # vectors of length 0 are near everything
        return left.drop(columns=["tile"]).assign(cell=right["cell"].to_numpy()[at], apart=apart)

    kinds = dict(named.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in named.columns) + ", cell long, apart double"
    placed = rows.drop("tiles").groupBy("session_id", "tile").cogroup(copies.groupBy("session_id", "tile")).applyInPandas(nearest, schema)
    placed = cut_lineage(placed)
    ranges = placed.groupBy("session_id", "cell").agg(F.max("apart").alias("radius"), F.count("*").alias("members"))
    cells = cut_lineage(ranges.join(centres, ["session_id", "cell"]).withColumn("parts", F.ceil(F.col("members") / tile_rows).cast("int")))
    stored = cut_lineage(
        placed.join(cells.select("session_id", "cell", "parts"), ["session_id", "cell"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), "parts").cast("int")).drop("apart", "parts")
    )
    discard(centres, placed)
    return VectorCells(stored, cells)


def write_cells(index: VectorCells, folder: str) -> None:
    """Store the index: a partition per session, its rows by cell, so that a cell is few row groups."""
    index.rows.repartition("session_id", "cell").sortWithinPartitions("session_id", "cell").write.mode("overwrite").partitionBy("session_id").parquet(f"{folder}/rows")
    index.cells.write.mode("overwrite").parquet(f"{folder}/cells")


def read_cells(spark: SparkSession, folder: str) -> VectorCells:
    rows = spark.read.parquet(f"{folder}/rows").withColumn("session_id", F.col("session_id").cast("string"))
    return VectorCells(rows, spark.read.parquet(f"{folder}/cells"))


def _bounds(index: VectorCells, queries: DataFrame) -> DataFrame:
    """(query_id, session_id, cell, members, parts, bound, turn) of all cells of the questions' sessions; turn 1 has the best bound."""

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)

    both = queries.select("query_id", "session_id", "query_vec").join(index.cells, "session_id")
    scale = F.sqrt(dot("query_vec", "query_vec")) * F.sqrt(dot("centre", "centre"))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot("query_vec", "centre"), scale))))
    # There is no angle to a vector of length 0.
    bound = F.when(scale > 0, F.cos(F.greatest(angle - F.col("radius") - SLACK, F.lit(0.0))) + SLACK).otherwise(1.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    return both.select("query_id", "session_id", "cell", "members", "parts", bound.alias("bound")).withColumn("turn", F.row_number().over(order))


def nearest_in_cells(index: VectorCells, queries: DataFrame, k: int = V.DEFAULT_TOP_K) -> tuple[DataFrame, DataFrame]:
    """The hits that ``semantic_search`` has, and per question how many ``cells`` and ``rows`` were compared with it."""
    asked = cut_lineage(_bounds(index, queries))
    vectors = queries.select("query_id", "query_vec")
    kinds = {**dict(index.rows.dtypes), **dict(queries.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["query_id", "session_id", "doc_id", "chunk_id"]) + ", score double"
    hits, reads, last = None, None, 0
    while True:
        go = asked.where((F.col("turn") > last) & (F.col("turn") <= max(1, 2 * last)))
        later = asked.where(F.col("turn") > last)
        if hits is not None:
            kth = hits.where(F.col("rank") == k).select("query_id", F.round("score", 9).alias("kth"))
            open_ = later.join(kth, "query_id", "left").where("kth is null or bound >= kth").drop("kth")
            if open_.isEmpty():
                break
            go = open_.where(F.col("turn") <= 2 * last)
        elif later.isEmpty():
            hits = top_k(_no_hits(index, schema), "query_id", best_first(), k)
            return hits, asked.select("query_id", F.col("turn").cast("bigint").alias("cells"), "members").where("false").withColumnRenamed("members", "rows")
        go = cut_lineage(go)
        right = go.join(vectors, "query_id").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("query_id", "query_vec", "session_id", "cell", "part")
        # Questions that ask one cell are dealt as well, its rows go to each deal.
        right = tiled(right.withColumn("_cell", F.struct("session_id", "cell", "part")), "_cell", "query_id", "deal", TILE_ROWS)
        spans = right.groupBy("session_id", "cell", "part").agg(F.max("deals").alias("deals"))
        left = index.rows.join(spans, ["session_id", "cell", "part"]).withColumn("deal", F.explode(F.sequence(F.lit(0), (F.col("deals") - 1).cast("int")))).drop("deals")
        by = ["session_id", "cell", "part", "deal"]
        found = left.groupBy(*by).cogroup(right.drop("deals", "_cell").groupBy(*by)).applyInPandas(best_of_tile(k), schema)
        every = found if hits is None else found.unionByName(hits.drop("rank"))
        before, hits = hits, cut_lineage(top_k(every, "query_id", best_first(), k))
        read = go.groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("members").alias("rows"))
        reads = read if reads is None else reads.unionByName(read).groupBy("query_id").agg(F.sum("cells").alias("cells"), F.sum("rows").alias("rows"))
        if before is not None:
            discard(before)
        last = max(1, 2 * last)
    return hits, reads


def _no_hits(index: VectorCells, schema: str) -> DataFrame:
    return index.rows.sparkSession.createDataFrame([], schema)
