"""Hard-negative mining with angular triangle filtering.

Every vector stores its angles to a few reference directions. By the triangle
inequality two vectors are at least |u - v| and at most u + v (or 2 pi - u - v) apart
if u and v are their angles to one reference; all references together give an
interval of the cosine, and times both lengths, rounded outwards, of the score.
Vectors are dealt to cells by label and nearest reference, cells are cut into
blocks, and a block into groups of similar vectors with the range of their angles.
An anchor asks for windows of scores. Only groups whose interval overlaps a window
are scored, with integer products; what these give is exact.

A search has two passes. The first asks the cells of the anchor's own reference;
the scores found there narrow the windows (a window's k-th best so far is a floor),
and the second asks the other cells whose interval still overlaps. Positives are a
search among the anchor's label for the best, negatives a search among the other
labels below each positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import beside, map_batches
from quire.session import cut_lineage, discard

#: What a component is multiplied by before it is rounded down.
SCALE = 256
#: Best rows of an anchor's label, best rows below each of them, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Reference directions, parts by label, rows of a block, rows of a group within it, anchors scored at a time.
REFERENCES, LABEL_PARTS, BLOCK, GROUP, ASKED = 8, 16, 16384, 64, 64
#: Room for the rounding of angles (kept in single precision) in the cosine; the scores' bounds get one more besides.
SLACK = 2e-6
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1
_ROWS = "rid bigint, vec_id bigint, label bigint, raw binary, norm double"


def scaled_rows(rows: DataFrame, vector: str, name: str, label: Column) -> DataFrame:
    """(rid: a number of its own, vec_id, label: hashed, raw: whole components packed, norm) of the rows that take part."""

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, norm = [], []
        for v in batch.column("_vector").to_pylist():
            x = np.array([np.nan if c is None else c for c in v or ()], np.float64)
            usable = np.isfinite(x).all()
            x = np.floor(SCALE * x)
            raw.append(packed(x) if usable else None)
            norm.append(float(np.sqrt(x @ x)) if usable else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "vec_id", "label")), pa.array(raw, pa.binary()), pa.array(norm, pa.float64())], names=["rid", "vec_id", "label", "raw", "norm"])

    taken = rows.where(label.isNotNull() & F.col(vector).isNotNull()).select(
        F.monotonically_increasing_id().alias("rid"), F.col(name).cast("bigint").alias("vec_id"), F.xxhash64(label).alias("label"), F.col(vector).alias("_vector"),
    )
    return map_batches(taken, pack, _ROWS).where("raw is not null")


def packed(x: np.ndarray) -> bytes:
    """Two bytes per component if they fit; else eight, and one more as a mark."""
    return x.astype("<i2").tobytes() if not len(x) or np.abs(x).max() < 1 << 15 else x.astype("<i8").tobytes() + b"\0"


def unpacked(raw: list[bytes]) -> np.ndarray:
    """Packed vectors as rows of whole numbers in double precision; the shorter ones end in zeros."""
    parts = [np.frombuffer(r, "<i2") if len(r) % 2 == 0 else np.frombuffer(r[:-1], "<i8") for r in raw]
    out = np.zeros((len(parts), max(map(len, parts), default=0)))
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products as integers. Doubles hold them exactly below 2**53; above, integers are multiplied."""
    width = max(x.shape[1], y.shape[1])
    x, y = _fit(x, width), _fit(y, width)
    if not x.size or not y.size or np.abs(x).max() * np.abs(y).max() * width < 1 << 53:
        return (x @ y.T).astype(np.int64)
    return x.astype(np.int64) @ y.T.astype(np.int64)


class References:
    """The reference directions: the distinct vectors with the smallest hashes, at most ``wanted``."""

    def __init__(self, rows: DataFrame, wanted: int) -> None:
        distinct = rows.where("norm > 0").groupBy(F.xxhash64("raw").alias("h")).agg(F.min("raw").alias("raw")).orderBy("h").limit(wanted)
        x = unpacked([bytes(r["raw"]) for r in distinct.collect()])
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else np.ones((1, 1))

    def __len__(self) -> int:
        return len(self.unit)

    def angles(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Angle to every reference; vectors of length 0 have right angles."""
        width = max(x.shape[1], self.unit.shape[1])
        cosine = _fit(x, width) @ _fit(self.unit, width).T / np.where(norm > 0, norm, 1)[:, None]
        return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def bounds(asked: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest cosine between every asked vector and any vector of every range of angles, rounded outwards."""
    near = np.zeros((len(asked), len(least)), np.float32)
    far = np.full((len(asked), len(least)), np.pi, np.float32)
    for r in range(asked.shape[1]):
        a = asked[:, r : r + 1]
        np.maximum(near, np.maximum(a - most[:, r], least[:, r] - a), out=near)
        np.minimum(far, np.minimum(a + most[:, r], 2 * np.float32(np.pi) - a - least[:, r]), out=far)
    return np.cos(np.maximum(far, near), dtype=np.float64) - SLACK, np.cos(near, dtype=np.float64) + SLACK


def score_bounds(asked: np.ndarray, norm: np.ndarray, least: np.ndarray, most: np.ndarray, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score for lengths between ``short`` and ``long``."""
    low, high = bounds(asked, least, most)
    low = norm[:, None] * np.where(low < 0, low * long, low * short)
    high = norm[:, None] * np.where(high < 0, high * short, high * long)
    return np.floor(low) - 1, np.ceil(high) + 1


def _span(windows: list[list[dict]]) -> tuple[np.ndarray, np.ndarray]:
    """From where to where each ask's windows reach."""
    return np.array([min(w["low"] for w in ws) for ws in windows], float), np.array([max(w["high"] for w in ws) for ws in windows], float)


class Block:
    """The rows of one block, with the ranges of its groups."""

    def __init__(self, stored: pa.Table) -> None:
        self.rid, self.label, self.norm = (stored.column(c).to_numpy() for c in ("rid", "label", "norm"))
        self.vec_id = stored.column("vec_id").fill_null(MOST_LONG).to_numpy() if stored.column("vec_id").null_count else stored.column("vec_id").to_numpy()
        self.x = unpacked(stored.column("raw").to_pylist())
        angles = np.stack([np.frombuffer(a, np.float32) for a in stored.column("angles").to_pylist()])
        self.start = np.arange(0, len(self.rid), GROUP)
        self.least, self.most = np.minimum.reduceat(angles, self.start), np.maximum.reduceat(angles, self.start)
        self.short, self.long = np.minimum.reduceat(self.norm, self.start), np.maximum.reduceat(self.norm, self.start)
        self.group = np.repeat(np.arange(len(self.start)), GROUP)[: len(self.rid)]

    def search(self, asks: pa.RecordBatch, same: bool, k: int) -> Iterator[pa.RecordBatch]:
        """Per ask and window the best ``k`` rows of the block within it."""
        for a in range(0, asks.num_rows, ASKED):
            part = asks.slice(a, ASKED)
            rid, label, norm = (part.column(c).to_numpy() for c in ("rid", "label", "norm"))
            windows = part.column("windows").to_pylist()
            angles = np.stack([np.frombuffer(x, np.float32) for x in part.column("angles").to_pylist()])
            low, high = score_bounds(angles, norm, self.least, self.most, self.short, self.long)
            least, most = _span(windows)
            overlap = (high >= least[:, None]) & (low <= most[:, None])
            rows = np.flatnonzero(overlap.any(axis=0)[self.group])
            if not len(rows):
                continue
            found = scores(unpacked(part.column("raw").to_pylist()), self.x[rows])
            right = (self.label[rows] == label[:, None]) == same
            right &= self.rid[rows] != rid[:, None]
            right &= overlap[:, self.group[rows]]
            out = []
            for i, ws in enumerate(windows):
                for w in ws:
                    hit = np.flatnonzero(right[i] & (found[i] >= w["low"]) & (found[i] <= w["high"]))
                    if len(hit) > 4 * k:  # all that tie with the k-th best stay until they are sorted
                        kth = np.partition(found[i][hit], len(hit) - k)[len(hit) - k]
                        hit = hit[found[i][hit] >= kth]
                    hit = hit[np.lexsort((self.vec_id[rows[hit]], -found[i][hit]))][:k]
                    out.append((np.full(len(hit), rid[i]), np.full(len(hit), w["w"]), found[i][hit], self.vec_id[rows[hit]], self.rid[rows[hit]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=["ask", "w", "score", "vec_id", "row"])


FOUND = "ask bigint, w bigint, score bigint, vec_id bigint, row bigint"


class Searched:
    """Rows placed in cells and blocks, ready to be searched by anchors."""

    def __init__(self, rows: DataFrame, references: int, block: int) -> None:
        self.rows = cut_lineage(rows)
        self.references = refs = References(self.rows, references)

        def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            norm = batch.column("norm").to_numpy()
            angles = refs.angles(unpacked(batch.column("raw").to_pylist()), norm)
            home = angles.argmin(axis=1) if len(angles) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home.astype(np.int64)), pa.array(np.take_along_axis(angles, home[:, None], 1)[:, 0].astype(np.float64)), pa.array([x.tobytes() for x in angles], pa.binary())],
                names=[*batch.schema.names, "home", "apart", "angles"],
            )

        placed = map_batches(self.rows, place, f"{_ROWS}, home bigint, apart double, angles binary")
        self.placed = cut_lineage(placed.withColumn("cell", F.pmod("label", F.lit(LABEL_PARTS)) * len(refs) + F.col("home")))

        def span(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            cell, norm = batch.column("cell").to_numpy(), batch.column("norm").to_numpy()
            angles = np.stack([np.frombuffer(a, np.float32) for a in batch.column("angles").to_pylist()])
            out = [(int(c), r, int(own.sum()), float(angles[own, r].min()), float(angles[own, r].max()), float(norm[own].min()), float(norm[own].max())) for c in np.unique(cell) for own in [cell == c] for r in range(len(refs))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["cell", "r", "n", "least", "most", "short", "long"])

        spans = map_batches(self.placed, span, "cell bigint, r bigint, n bigint, least double, most double, short double, long double")
        # At most LABEL_PARTS * REFERENCES cells, one row per reference.
        ranges = spans.groupBy("cell", "r").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("short").alias("short"), F.max("long").alias("long")).collect()
        self.cells = np.array(sorted({r["cell"] for r in ranges}), np.int64)
        at, shape = {c: i for i, c in enumerate(self.cells)}, (len(self.cells), len(refs))
        self.least, self.most = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
        self.short, self.long, self.blocks = np.zeros(shape[0]), np.zeros(shape[0]), np.zeros(shape[0], np.int64)
        for r in ranges:
            i = at[r["cell"]]
            self.least[i, r["r"]], self.most[i, r["r"]] = r["least"], r["most"]
            self.short[i], self.long[i], self.blocks[i] = r["short"], r["long"], -(-r["n"] // block)
        self.first = np.concatenate(([0], np.cumsum(self.blocks)))
        starts = F.create_map(*(F.lit(int(x)) for c, n, s in zip(self.cells, self.blocks, self.first) for x in (c, s))) if len(self.cells) else F.create_map(F.lit(0), F.lit(0))
        counts = F.create_map(*(F.lit(int(x)) for c, n in zip(self.cells, self.blocks) for x in (c, n))) if len(self.cells) else F.create_map(F.lit(0), F.lit(1))
        self.stored = self.placed.withColumn("block", (starts[F.col("cell")] + F.pmod(F.xxhash64("rid"), counts[F.col("cell")])).cast("bigint")).drop("cell", "home")

    def visits(self, asks: DataFrame, same: bool, own: bool) -> DataFrame:
        """A row of ``asks`` per block that may hold what it asks for, in the cells of its own reference or in the others."""
        first, ranges = self.first, (self.least, self.most, self.short, self.long)
        home, part = self.cells % len(self.references), self.cells // len(self.references)

        def choose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            norm, at = batch.column("norm").to_numpy(), batch.column("home").to_numpy()
            angles = np.stack([np.frombuffer(x, np.float32) for x in batch.column("angles").to_pylist()])
            windows = batch.column("windows").to_pylist()
            low, high = score_bounds(angles, norm, *ranges)
            least, most = _span(windows)
            go = (high >= least[:, None]) & (low <= most[:, None]) & ((home == at[:, None]) == own)
            if same:
                go &= part == batch.column("label").to_numpy()[:, None] % LABEL_PARTS
            row, cell = np.nonzero(go)
            many = first[cell + 1] - first[cell]
            block = np.repeat(first[cell] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
            picked = batch.take(pa.array(np.repeat(row, many)))
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), *(picked.column(c) for c in ("rid", "label", "raw", "norm", "angles", "windows"))], names=["block", "rid", "label", "raw", "norm", "angles", "windows"])

        return map_batches(asks, choose, f"block bigint, rid bigint, label bigint, raw binary, norm double, angles binary, windows {WINDOWS}")

    def best(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(ask, w, score, vec_id, row, rank) of the best ``k`` rows within every window (w, low, high) of ``asks``."""

        def run(some: DataFrame, own: bool) -> DataFrame:
            return beside(self.stored, self.visits(some, same, own), "block", Block, lambda block, batch: block.search(batch, same, k), FOUND, order=("apart",))

        near = cut_lineage(run(asks, True))
        floors = ranked(near, k).where(F.col("rank") == k).groupBy(F.col("ask").alias("rid")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("_floors"))
        narrower = asks.join(floors, "rid", "left").withColumn(
            "windows", F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["low"], F.coalesce(F.col("_floors")[w["w"]], w["low"])).alias("low"), w["high"].alias("high"))),
        ).drop("_floors")
        out = cut_lineage(ranked(near.union(run(narrower, False)), k))
        discard(near)
        return out


WINDOWS = "array<struct<w:bigint,low:bigint,high:bigint>>"


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("ask", "w").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_negatives(
    rows: DataFrame, anchors: Column, label: Column | None = None, vector: str = "embedding", name: str = "vec_id", positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, references: int = REFERENCES, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components are multiplied by SCALE and rounded down; a score is the inner
    product with the anchor. Every row with ``anchors`` (a condition on ``name``) is
    an anchor. Its positives are the first ``positives`` other rows of its label, and
    per positive the first ``negatives`` rows of other labels with low * positive
    <= 100 * score <= high * positive are returned; higher scores come first, then
    smaller ids, rows without an id last. A positive with a negative score has no
    such rows; one with 0 has those with 0. Rows with a null label, a null vector,
    a null or non-finite component take no part. Repeated rows are rows of
    their own, so an anchor's copy can be its positive and is an anchor itself. An
    empty vector has the score 0 with all; vectors of other lengths compare as if the
    shorter ended in zeros. Scores have to fit into 63 bits (components below about
    2**22 for 64 of them). Other columns are ignored; an empty table gives an empty one.
    """
    space = Searched(scaled_rows(rows, vector, name, F.col("label") if label is None else label), references, block)
    chosen = space.placed.where(F.expr("vec_id is not null") & anchors).drop("cell", "apart")
    every = F.array(F.struct(F.lit(0).cast("bigint").alias("w"), F.lit(LEAST_LONG).alias("low"), F.lit(MOST_LONG).alias("high")))
    good = space.best(chosen.withColumn("windows", every), True, positives).select("ask", F.col("rank").cast("bigint").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    wide = good.select(F.col("ask").alias("rid"), F.struct("w", F.ceil(score * low / F.lit(100).cast("decimal(20,0)")).cast("bigint").alias("low"), F.floor(score * high / F.lit(100).cast("decimal(20,0)")).cast("bigint").alias("high")).alias("window")).where("window.low <= window.high")
    asks = chosen.join(wide.groupBy("rid").agg(F.collect_list("window").alias("windows")), "rid")
    bad = space.best(asks, False, negatives).select("ask", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = chosen.select(F.col("rid").alias("ask"), F.col("vec_id").alias("anchor_id"))

    def known(column: str) -> Column:
        return F.when(F.col(column) < MOST_LONG, F.col(column)).alias(column)

    return bad.join(good, ["ask", "w"]).join(names, "ask").select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


def moved_label() -> Column:
    """The label of the query: one further, modulo 10, where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


SQL = f"""
WITH v AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
      FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS n FROM s WHERE same QUALIFY n <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.a, p.n ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""
