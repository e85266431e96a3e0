"""Embedding near-duplicates: an exact metric range join around pivots.

Vectors of length 1 with a cosine of at least c are at most e = sqrt(2 - 2c) apart.
Every vector belongs to the cell of its nearest pivot. It is replicated to
another cell if a member of that cell could be within e: its distance to the
plane between the two pivots is at most e (the triangle inequality's bound,
sharpened for Euclidean space), and its distance to the pivot is at most the
cell's radius plus e. Cells then join independently, their own members against
their own and the replicated ones, in tiles of bounded size. Every vector's
links are counted in its own cell, so each is counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import components, forest, map_batches
from quire.session import cut_lineage

#: Vectors per pivot, most pivots (they are broadcast: 4096 of 1024 dimensions are 32 MB), rows of a tile's side.
PER_PIVOT, MOST_PIVOTS, TILE = 8192, 4096, 8192
#: Names above this stand for vectors whose rows have no vec_id.
NAMELESS = 0x6000000000000000
#: Room for rounding in the bounds; the comparison itself is exact in double precision.
SLACK = 1e-6


def _units(raw: list[bytes], width: str) -> np.ndarray:
    """Packed vectors as doubles of length 1; the largest component comes out first, so no square over- or underflows."""
    x = np.stack([np.frombuffer(r, width) for r in raw]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(rows: DataFrame, vector: str, name: str, width: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, key) and the distinct usable vectors (key, vec_id: smallest, copies, dim, raw: packed as ``width``).

    The key is the SHA-256 of the packed vector (in its own precision); rows whose vector is null, empty,
    zero, or holds a null or non-finite component have none.
    """

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = []
        for v in batch.column("_vector").to_pylist():
            x = np.array([np.nan if c is None else c for c in v], width) if v else np.zeros(0)
            usable = len(x) and np.isfinite(x).all() and x.any()
            raw.append((x + 0).astype(width).tobytes() if usable else None)  # + 0: no negative zero
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    packed = map_batches(
        rows.select(F.col(name).cast("bigint").alias("vec_id"), F.col(vector).alias("_vector")), pack, "vec_id bigint, raw binary",
    ).withColumn("key", F.unhex(F.sha2("raw", 256)))
    packed = cut_lineage(packed)
    groups = packed.where("key is not null").groupBy("key").agg(
        F.coalesce(F.min("vec_id"), F.pmod(F.xxhash64("key"), F.lit(1 << 60)) + NAMELESS).alias("vec_id"), F.count("*").alias("copies"),
        F.first("raw").alias("raw"), F.first(F.length("raw") / np.dtype(width).itemsize).cast("int").alias("dim"),
    )
    return packed.select("vec_id", "key"), cut_lineage(groups)


def _pivots(vectors: DataFrame, wanted: int, width: str) -> dict[int, np.ndarray]:
    """The vectors with the smallest keys, by their number of components: at most ``wanted``."""
    taken = vectors.orderBy("key").limit(wanted).select("dim", "raw").collect()
    return {d: _units([bytes(r["raw"]) for r in taken if r["dim"] == d], width) for d in sorted({r["dim"] for r in taken})}


def _homes(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vector's cell and its squared distances to all pivots."""
    square = np.maximum(2 - 2 * (x @ pivots.T), 0)
    return square.argmin(axis=1), square


def _assign(vectors: DataFrame, pivots: dict[int, np.ndarray], reach: float, width: str) -> DataFrame:
    """(dim, cell, home, key, raw): every vector in its own cell and, as far as the bounds ask, in others."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def radius(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            if d in shared.value:
                rows = batch.filter(pa.array(dims == d))
                home, square = _homes(_units(rows.column("raw").to_pylist(), width), shared.value[d])
                far = np.sqrt(square[np.arange(len(home)), home])
                out += [{"dim": int(d), "cell": int(c), "radius": float(far[home == c].max())} for c in np.unique(home)]
        yield from pa.Table.from_pylist(out, schema=pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("radius", pa.float64())])).to_batches()

    # At most one row per pivot.
    radii = map_batches(vectors.select("dim", "raw"), radius, "dim int, cell int, radius double").groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect()
    widest = {d: np.full(len(p), -np.inf) for d, p in pivots.items()}
    for r in radii:
        widest[r["dim"]][r["cell"]] = r["radius"]

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            rows = batch.filter(pa.array(dims == d))
            n = rows.num_rows
            if d in shared.value:
                p = shared.value[d]
                home, square = _homes(_units(rows.column("raw").to_pylist(), width), p)
                apart = np.sqrt(np.maximum(2 - 2 * (p @ p.T), 1e-12))
                plane = (square - square[np.arange(n), home][:, None]) / (2 * apart[home])
                near = (plane <= reach + SLACK) & (np.sqrt(square) <= widest[d][None, :] + reach + SLACK)
                near[np.arange(n), home] = True
            else:
                home, near = np.zeros(n, np.int64), np.ones((n, 1), bool)
            row, cell = np.nonzero(near)
            picked = rows.take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [picked.column("dim"), pa.array(cell.astype(np.int32)), pa.array(home[row] == cell), picked.column("key"), picked.column("vec_id"), picked.column("copies"), picked.column("raw")],
                names=["dim", "cell", "home", "key", "vec_id", "copies", "raw"],
            )

    return map_batches(vectors.select("dim", "key", "vec_id", "copies", "raw"), place, "dim int, cell int, home boolean, key binary, vec_id bigint, copies bigint, raw binary")


def _compare(cosine: float, width: str):
    """One tile: its own members (side 0) against members (side 1).

    Gives the copies linked per own member (key, n_links), and a spanning forest of
    all links found (a, b).
    """

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own, other = group[group["side"] == 0], group[group["side"] == 1]
        n_links = np.zeros(len(own), np.int64)
        a = b = np.zeros(0, np.int64)
        if len(own) and len(other):
            x, y = _units(own["raw"].tolist(), width), _units(other["raw"].tolist(), width)
            copies = other["copies"].to_numpy()
            keys, at = np.unique(np.concatenate([own["key"].to_numpy(), other["key"].to_numpy()]), return_inverse=True)
            name = np.zeros(len(keys), np.int64)
            name[at] = np.concatenate([own["vec_id"].to_numpy(), other["vec_id"].to_numpy()])
            labels, n_own = np.arange(len(keys)), len(own)
            for k in range(0, n_own, 512):
                close = x[k : k + 512] @ y.T >= cosine
                row, col = np.nonzero(close)
                left, right = at[:n_own][k + row], at[n_own:][col]
                other_key = left != right
                n_links[k : k + 512] += np.bincount(row[other_key], weights=copies[col[other_key]], minlength=min(512, n_own - k)).astype(np.int64)
                labels = forest(labels, left[other_key], right[other_key])
            below = np.flatnonzero(labels != np.arange(len(keys)))
            a, b = name[below], name[labels[below]]
        return pd.concat([
            pd.DataFrame({"key": own["key"].to_numpy(), "n_links": n_links}).assign(a=pd.array([pd.NA] * len(own), "Int64"), b=pd.array([pd.NA] * len(own), "Int64")),
            pd.DataFrame({"key": None, "n_links": 0, "a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")}),
        ])

    return compare


def link_vectors(rows: DataFrame, cosine: float = 0.9, vector: str = "embedding", name: str = "vec_id", per_pivot: int = PER_PIVOT, tile: int = TILE) -> DataFrame:
    """vec_id, ``n_links``, ``component_id``, ``kept`` for every row.

    Two vectors of as many components are linked if their cosine in double
    precision is at least ``cosine``. Vectors that are null, empty, zero or hold
    a null or non-finite component link with nothing and are kept. Identical
    vectors are compared once and counted as often as they occur; repeated rows
    are vectors of their own. The component's name is the smallest vec_id reachable;
    a null vec_id is never the smallest, its row has component null if it
    stands alone and isn't kept. Other columns are ignored; an empty table gives
    an empty one. The smallest key picks pivots, one per ``per_pivot`` distinct
    vectors and at most MOST_PIVOTS; beyond that cells grow and have more tiles.
    Where vectors are far from each other in many dimensions the bounds prune
    little and the tiles compare nearly all pairs.
    """
    width = "<f4" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"
    packed, vectors = distinct_vectors(rows, vector, name, width)
    n = vectors.count()
    reach = float(np.sqrt(max(2 - 2 * cosine, 0)))
    pivots = _pivots(vectors, min(MOST_PIVOTS, max(1, -(-n // per_pivot))), width)
    placed = cut_lineage(_assign(vectors, pivots, reach, width))
    counts = placed.groupBy("dim", "cell").agg(
        F.ceil(F.count_if("home") / tile).cast("int").alias("own_tiles"), F.ceil(F.count("*") / tile).cast("int").alias("all_tiles"),
    )
    split = placed.join(counts, ["dim", "cell"]).where("own_tiles > 0").withColumn("_h", F.xxhash64("key"))
    columns = ["key", "vec_id", "copies", "raw"]
    own = split.where("home").select(
        "dim", "cell", F.pmod("_h", "own_tiles").cast("int").alias("t1"), F.explode(F.sequence(F.lit(0), F.col("all_tiles") - 1)).alias("t2"), F.lit(0).alias("side"), *columns,
    )
    others = split.select(
        "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("own_tiles") - 1)).alias("t1"), F.pmod("_h", "all_tiles").cast("int").alias("t2"), F.lit(1).alias("side"), *columns,
    )
    tiles = cut_lineage(
        own.union(others).groupBy("dim", "cell", "t1", "t2").applyInPandas(_compare(cosine, width), "key binary, n_links bigint, a bigint, b bigint")
    )
    links = tiles.where("key is not null").groupBy("key").agg(F.sum("n_links").alias("linked"))
    found = components(tiles.where("a <> b").select("a", "b"))
    classes = (
        vectors.join(links, "key", "left").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
        .select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component"))
        .withColumn("component", F.when(F.col("component") < NAMELESS, F.col("component")))
    )
    return packed.join(classes, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )
