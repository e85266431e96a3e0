"""Similarity of documents inside a session.

Texts that are equal after normalisation are one node with a copy count, so a
group of copies of any size costs one row and its members are listed in
``copy_members``. Different texts are dealt into blocks by their number of terms,
and a pair of blocks is one sparse product in one task; pairs of blocks whose
lengths and largest counts can't reach the threshold are never shipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import jaccard_words, length_ratio, normalize_text, pair_summary, words
from quire.operators.search import tiled, unit_rows
from quire.session import cut_lineage

TILE_ROWS = 1024
#: Term counts of the blocks that travel together, and the least number of such units of a session that has the blocks for it.
UNIT_TERMS, UNITS = 1 << 22, 6
#: Vectors that travel together where only sums are passed on.
SHIPPED_ROWS = 4096
#: Powers of two up to which the most frequent terms are summed, and term counts per block.
CLASSES, BLOCK_TERMS = 24, 1 << 21
#: A term whose pairs are at least this part of all pairs of two blocks is a dense column; columns multiplied and pairs summed at a time.
DENSE_PART, DENSE_TERMS, SPARSE_PAIRS = 256, 2048, 1 << 22


def distinct_texts(docs: DataFrame, text: str = "content") -> DataFrame:
    """One row per session and normalised text: lowest id, its name, copies."""
    normed = docs.select("session_id", "doc_id", "doc_name", normalize_text(text).alias("text"))
    return (
        normed.groupBy("session_id", F.md5("text").alias("text_key"))
        .agg(
            F.min("doc_id").alias("id"),
            F.min_by("doc_name", "doc_id").alias("label"),
            F.any_value("text").alias("text"),
            F.count("*").alias("copies"),
        )
    )


def copy_members(docs: DataFrame, text: str = "content") -> DataFrame:
    """(session_id, doc_id, node_id): the node that stands for each document."""
    keyed = docs.select("session_id", "doc_id", F.md5(normalize_text(text)).alias("text_key"))
    nodes = keyed.groupBy("session_id", "text_key").agg(F.min("doc_id").alias("node_id"))
    return keyed.join(nodes, ["session_id", "text_key"]).drop("text_key")


# --- term counts: blocks of a sparse product ------------------------------------------

def term_counts(nodes: DataFrame) -> DataFrame:
    """Per node its length in terms and in characters, and the counts of the terms it shares with another node.

    Shared terms get a number (``term_ids``, with ``tfs``); terms of one node alone count
    for the length only. ``reach`` holds, for the 1, 2, 4, ... most frequent shared terms,
    their part of the vector's length: no more of it can meet a text of so few terms.
    """
    counted = cut_lineage(
        nodes.select("session_id", "id", F.explode(words("text")).alias("term"))
        .groupBy("session_id", "id", "term").agg(F.count("*").cast("double").alias("tf"))
    )
    shared = cut_lineage(
        counted.groupBy("session_id", "term").agg(F.count("*").alias("df")).where("df > 1")
        .select("session_id", "term", F.monotonically_increasing_id().alias("term_id"))
    )
    return count_rows(nodes, counted, shared)


def count_rows(nodes: DataFrame, counted: DataFrame, numbered: DataFrame) -> DataFrame:
    """The rows of ``term_counts`` from counts (session_id, id, term, tf) and the numbers of the terms that may be shared."""
    whole = counted.groupBy("session_id", "id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"), F.count("*").alias("terms"))
    posts = counted.join(numbered, ["session_id", "term"]).groupBy("session_id", "id").agg(F.collect_list(F.struct("tf", "term_id")).alias("posts"))
    rows = posts.join(whole, ["session_id", "id"]).join(nodes.select("session_id", "id", "label", "copies", F.length("text").alias("chars")), ["session_id", "id"])
    most = F.sort_array("posts", asc=False)
    energy = F.transform(
        F.sequence(F.lit(0), F.lit(CLASSES - 1)),
        lambda k: F.aggregate(F.slice("posts", F.lit(1), F.pow(F.lit(2.0), k).cast("int")), F.lit(0.0), lambda acc, p: acc + p["tf"] * p["tf"]),
    )
    return rows.withColumn("posts", most).select(
        "session_id", "id", "label", "copies", "chars", "norm", "terms", F.transform("posts", lambda p: p["term_id"]).alias("term_ids"), F.transform("posts", lambda p: p["tf"]).alias("tfs"),
        F.transform(energy, lambda e: F.least(F.sqrt(e) / F.col("norm"), F.lit(1.0))).alias("reach"),
    )


def _bound(cosine: Column, jaccard: Column, length: Column) -> Column:
    return cosine * V.COSINE_WEIGHT + jaccard * V.JACCARD_WEIGHT + length * V.LENGTH_WEIGHT


def blocks_of(rows: DataFrame, tile_rows: int) -> DataFrame:
    """``rows`` dealt into blocks of nodes with about as many terms: at most ``tile_rows`` nodes and BLOCK_TERMS counts each."""
    classed = rows.withColumn("class", F.floor(F.log2("terms")).cast("int"))
    most = F.least(F.lit(float(tile_rows)), F.lit(float(BLOCK_TERMS)) / F.pow(F.lit(2.0), F.col("class")))
    sizes = classed.groupBy("session_id", "class").agg(F.count("*").alias("n")).select("session_id", "class", F.ceil(F.greatest(F.col("n") / most, F.lit(1.0))).alias("parts"))
    return classed.join(sizes, ["session_id", "class"]).withColumn("block", F.col("class") * (1 << 32) + F.pmod(F.xxhash64("id"), "parts")).drop("class", "parts")


def block_pairs(blocked: DataFrame, floor: float) -> DataFrame:
    """(session_id, a, b: blocks, a <= b) whose nodes may reach ``floor``.

    A text of n terms meets at most the n most frequent terms of another one, the words in
    common are at most those of the shorter, and the length ratio that of the nearest lengths.
    """
    summary = blocked.groupBy("session_id", "block").agg(
        F.min("terms").alias("least"), F.max("terms").alias("most"), F.min("chars").alias("short"), F.max("chars").alias("long"),
        F.array(*[F.max(F.col("reach")[k]) for k in range(CLASSES)]).alias("reach"),
    )
    x = summary.select("session_id", F.struct("block", "least", "most", "short", "long", "reach").alias("x"))
    y = summary.select("session_id", F.struct("block", "least", "most", "short", "long", "reach").alias("y"))
    x_, y_ = F.col("x"), F.col("y")

    def reach(of: Column, terms: Column) -> Column:
        return F.get(of["reach"], F.least(F.ceil(F.log2(terms)), F.lit(CLASSES - 1)).cast("int"))

    def ratio(low: str, high: str) -> Column:
        return F.least(F.lit(1.0), x_[high] / y_[low], y_[high] / x_[low])

    best = _bound(F.least(reach(x_, y_["most"]), reach(y_, x_["most"])), ratio("least", "most"), ratio("short", "long"))
    return x.join(y, "session_id").where((x_["block"] <= y_["block"]) & (best >= floor - 1e-9)).select("session_id", x_["block"].alias("a"), y_["block"].alias("b"))


class _Counts:
    """The counts of one block's nodes, flat, by term."""

    def __init__(self, rows: pa.Table) -> None:
        self.rows = rows
        ids, tfs = (rows.column(c).combine_chunks() for c in ("term_ids", "tfs"))
        term = ids.flatten().to_numpy()
        by_term = np.argsort(term, kind="stable")
        self.tf = tfs.flatten().to_numpy()[by_term]
        self.node = np.repeat(np.arange(rows.num_rows), np.diff(ids.offsets.to_numpy()))[by_term]
        self.vocabulary, self.begin, self.many = np.unique(term[by_term], return_index=True, return_counts=True)
        self.norm, self.terms, self.chars, self.id = (rows.column(c).to_numpy() for c in ("norm", "terms", "chars", "id"))
        self.longest = np.sqrt(np.bincount(self.node, self.tf * self.tf, minlength=1).max())

    def among(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``terms``, node, count) of the counts whose term is listed, by place. All are terms of the block."""
        k = np.searchsorted(self.vocabulary, terms)
        many = self.many[k]
        at = np.arange(many.sum()) + np.repeat(self.begin[k] - (np.cumsum(many) - many), many)
        return np.repeat(np.arange(len(terms)), many), self.node[at], self.tf[at]


def sparse_product(x: _Counts, y: _Counts) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of counts, and numbers of common terms, of every node of x with every node of y. Both are whole numbers.

    Terms that many nodes hold are multiplied as dense columns, of the others the pairs are summed up.
    """
    shape = len(x.id), len(y.id)
    # single precision where it holds every sum
    kind = np.float32 if x.longest * y.longest < 1 << 24 else np.float64
    dot, common = np.zeros(shape, kind), np.zeros(shape, np.float32)
    terms = np.intersect1d(x.vocabulary, y.vocabulary, assume_unique=True)
    if not len(terms):
        return dot, common
    (tx, nx, fx), (ty, ny, fy) = x.among(terms), y.among(terms)
    many_x, many_y = np.bincount(tx, minlength=len(terms)), np.bincount(ty, minlength=len(terms))
    dense = many_x * many_y * DENSE_PART >= shape[0] * shape[1]
    columns = np.flatnonzero(dense)
    place = np.cumsum(dense) - 1
    for a in range(0, len(columns), DENSE_TERMS):
        part = np.zeros(len(terms), bool)
        part[columns[a : a + DENSE_TERMS]] = True
        left, right = (np.zeros((n, int(part.sum())), kind) for n in shape)
        ox, oy = part[tx], part[ty]
        left[nx[ox], place[tx[ox]] - a], right[ny[oy], place[ty[oy]] - a] = fx[ox], fy[oy]
        dot += left @ right.T
        common += (left > 0).astype(np.float32) @ (right > 0).astype(np.float32).T
    ox = ~dense[tx]
    tx, nx, fx = tx[ox], nx[ox], fx[ox]
    begin, many = np.concatenate(([0], np.cumsum(many_y)))[tx], many_y[tx]
    ends = np.cumsum(many)
    a = 0
    while a < len(tx):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SPARSE_PAIRS, "right")))
        n = many[a:b]
        of = np.repeat(np.arange(a, b), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + begin[of]
        cell = nx[of] * shape[1] + ny[at]
        dot += np.bincount(cell, fx[of] * fy[at], minlength=dot.size).reshape(shape).astype(kind)
        common += np.bincount(cell, minlength=dot.size).reshape(shape).astype(np.float32)
        a = b
    return dot, common


def pair_similarity(nodes: DataFrame, floor: float = V.MIN_EDGE_SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Pairs of distinct texts at or above ``floor``.

    0.6 cosine of term counts + 0.3 word overlap + 0.1 length ratio. The nodes of a session
    are dealt into blocks, and every pair of blocks that can reach the floor is
    one sparse product in one task; a pair of nodes comes up once. ``floor``
    must be above 0.1: texts with no shared word never reach more.
    """
    if floor <= V.LENGTH_WEIGHT:
        raise ValueError("floor must be above the weight of the length ratio")
    stored = cut_lineage(nodes.select("session_id", "id", "label", "copies", "text"))
    blocked = cut_lineage(blocks_of(term_counts(stored), tile_rows))
    return compare_blocks(blocked, cut_lineage(block_pairs(blocked, floor)), floor)


def units_of(blocked: DataFrame) -> DataFrame:
    """(session_id, block, unit): blocks next to each other that travel together, up to UNIT_TERMS counts a unit."""
    sizes = blocked.groupBy("session_id", "block").agg(F.sum("terms").alias("n"))
    before = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    size = F.least(F.lit(float(UNIT_TERMS)), F.sum("n").over(Window.partitionBy("session_id")) / UNITS)
    return sizes.select("session_id", "block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size).cast("long").alias("unit"))


def _similar(x: _Counts, y: _Counts, floor: float) -> tuple[np.ndarray, ...]:
    """(row of x, row of y, cosine, jaccard, length ratio, similarity) of the pairs at or above ``floor``; of a block with itself each once."""
    dot, common = sparse_product(x, y)
    near = dot * (V.COSINE_WEIGHT / y.norm).astype(dot.dtype)
    near /= x.norm.astype(dot.dtype)[:, None]
    near += V.JACCARD_WEIGHT * (common / (x.terms[:, None].astype(np.float32) + y.terms.astype(np.float32) - common))
    ratio = x.chars[:, None].astype(np.float32) / y.chars.astype(np.float32)
    near += V.LENGTH_WEIGHT * np.minimum(ratio, 1 / ratio)
    hit = (near >= floor - 1e-4) & (common > 0)
    if y is x:
        hit &= x.id[:, None] < x.id
    # the exact figures of the few that are left
    i, j = np.nonzero(hit)
    both = common[i, j].astype(np.float64)
    cosine = dot[i, j].astype(np.float64) / (x.norm[i] * y.norm[j])
    jaccard = both / (x.terms[i] + y.terms[j] - both)
    length = np.minimum(x.chars[i], y.chars[j]) / np.maximum(x.chars[i], y.chars[j])
    similarity = cosine * V.COSINE_WEIGHT + jaccard * V.JACCARD_WEIGHT + length * V.LENGTH_WEIGHT
    stay = similarity >= floor - 1e-12
    return tuple(c[stay] for c in (i, j, cosine, jaccard, length, similarity))


def compare_blocks(blocked: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    """The pairs of nodes at or above ``floor`` in the given pairs of blocks (session_id, a, b).

    Blocks travel in units: a node is shipped once per unit that one of its pairs lies in, and
    a task works through the block pairs of two units one at a time.
    """
    columns = ["id", "label", "copies", "chars", "norm", "terms", "term_ids", "tfs"]
    units = cut_lineage(units_of(blocked))
    placed = (
        pairs.join(units.select("session_id", F.col("block").alias("a"), F.col("unit").alias("ua")), ["session_id", "a"])
        .join(units.select("session_id", F.col("block").alias("b"), F.col("unit").alias("ub")), ["session_id", "b"])
    )
    unit = ["session_id", "ua", "ub"]
    left = placed.groupBy(*unit, F.col("a").alias("block")).agg(F.collect_set("b").alias("others"))
    right = placed.where("a <> b").select(*unit, F.col("b").alias("block")).distinct().withColumn("others", F.lit(None).cast("array<long>"))

    def side(asked: DataFrame, number: int) -> DataFrame:
        return blocked.join(asked, ["session_id", "block"]).select(*unit, "block", "others", F.lit(number).alias("side"), *columns)

    kinds = dict(blocked.dtypes)
    schema = (
        f"session_id {kinds['session_id']}, src {kinds['id']}, dst {kinds['id']}, src_label {kinds['label']}, dst_label {kinds['label']}, src_copies {kinds['copies']}, dst_copies {kinds['copies']}, "
        "cosine double, jaccard double, length_ratio double, similarity double"
    )
    names = [part.split()[0] for part in schema.split(", ")]

    def found(x: _Counts, y: _Counts) -> pa.Table:
        i, j, cosine, jaccard, length, similarity = _similar(x, y, floor)
        turned = x.id[i] > y.id[j]
        out = {"session_id": x.rows.column("session_id").take(pa.array(np.zeros(len(i), np.int64)))}
        for name in ("id", "label", "copies"):
            both = pa.chunked_array([*x.rows.column(name).chunks, *y.rows.column(name).chunks], x.rows.column(name).type)
            first, second = i, len(x.id) + j
            out["src" if name == "id" else f"src_{name}"] = both.take(pa.array(np.where(turned, second, first)))
            out["dst" if name == "id" else f"dst_{name}"] = both.take(pa.array(np.where(turned, first, second)))
        out |= {"cosine": cosine, "jaccard": jaccard, "length_ratio": length, "similarity": similarity}
        return pa.table({c: out[c] for c in names})

    def product(group: pa.Table) -> pa.Table:
        def blocks(number: int) -> dict[int, _Counts]:
            own = group.filter(pc.equal(group.column("side"), number))
            return {int(b): _Counts(own.filter(pc.equal(own.column("block"), b))) for b in np.unique(own.column("block").to_numpy())}

        first, second = blocks(0), blocks(1)
        return pa.concat_tables([found(x, x if b == a else second[b]) for a, x in first.items() for b in x.rows.column("others")[0].as_py()])

    return side(left, 0).unionByName(side(right, 1)).groupBy(*unit).applyInArrow(product, schema)


# --- dense vectors: blocks of a matrix -------------------------------------------

def _tile_pairs(vectors: DataFrame, tile_rows: int) -> DataFrame:
    """Each vector once per pair of tiles that it belongs to."""
    rows = tiled(vectors.select("session_id", "doc_id", "embedding"), "session_id", "doc_id", "tile", tile_rows)
    other = F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int")))
    return rows.withColumn("other", other).select(
        "session_id", "doc_id", "embedding", "tile",
        F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"),
    )


def _tile_cosines(block: pd.DataFrame):
    """Rows, columns and cosines of the pairs that one tile pair owns."""
    lo, hi = block["lo"].iloc[0], block["hi"].iloc[0]
    left = block[block["tile"] == lo].reset_index(drop=True)
    right = block[block["tile"] == hi].reset_index(drop=True)
    if left.empty or right.empty:
        return left, right, np.zeros((0, 0)), np.zeros((0, 0), dtype=bool)
    cosines = unit_rows(left["embedding"]) @ unit_rows(right["embedding"]).T
    owned = np.ones(cosines.shape, dtype=bool) if lo != hi else np.triu(np.ones(cosines.shape, dtype=bool), 1)
    return left, right, cosines, owned


def pair_cosine(vectors: DataFrame, floor: float = V.COSINE_FLOOR, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Cosines at or above ``floor``; every pair not listed counts as 0."""

    def survivors(block: pd.DataFrame) -> pd.DataFrame:
        left, right, cosines, owned = _tile_cosines(block)
        i, j = np.nonzero(owned & (cosines >= floor))
        a = left["doc_id"].to_numpy()[i] if len(i) else np.array([], dtype="int64")
        b = right["doc_id"].to_numpy()[j] if len(j) else np.array([], dtype="int64")
        return pd.DataFrame(
            {
                "session_id": block["session_id"].iloc[0],
                "src": np.minimum(a, b), "dst": np.maximum(a, b), "cosine": cosines[i, j],
            }
        )

    kinds = dict(vectors.dtypes)
    schema = f"session_id {kinds['session_id']}, src {kinds['doc_id']}, dst {kinds['doc_id']}, cosine double"
    return _tile_pairs(vectors, tile_rows).groupBy("session_id", "lo", "hi").applyInPandas(survivors, schema)


def pair_similarity_vectors(nodes: DataFrame, vectors: DataFrame, floor: float = V.MIN_EDGE_SIMILARITY, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The blended similarity with supplied vectors: 0.6 cosine + 0.3 word overlap + 0.1 length ratio.

    ``vectors`` (session_id, doc_id, embedding) has a row for each node; nodes
    without one get no pair. Overlap and length ratio are at most 1, so the texts
    are fetched only for pairs whose cosine can still reach ``floor``.
    """
    least = (floor - V.JACCARD_WEIGHT - V.LENGTH_WEIGHT) / V.COSINE_WEIGHT
    own = vectors.join(nodes.select("session_id", F.col("id").alias("doc_id")), ["session_id", "doc_id"], "left_semi")
    close = cut_lineage(pair_cosine(own, least - 1e-9, tile_rows))

    def end(id_: str, prefix: str) -> DataFrame:
        return nodes.select(
            "session_id", F.col("id").alias(id_), F.col("label").alias(f"{prefix}_label"), F.col("copies").alias(f"{prefix}_copies"), F.col("text").alias(f"_{prefix}"),
        )

    pairs = close.join(end("src", "src"), ["session_id", "src"]).join(end("dst", "dst"), ["session_id", "dst"])
    scored = pairs.select(
        "session_id", "src", "dst", "src_label", "dst_label", "src_copies", "dst_copies", "cosine",
        jaccard_words(words("_src"), words("_dst")).alias("jaccard"), length_ratio(F.length("_src"), F.length("_dst")).alias("length_ratio"),
    )
    blended = _bound(F.col("cosine"), F.col("jaccard"), F.col("length_ratio"))
    return scored.withColumn("similarity", blended).where(F.col("similarity") >= floor - 1e-12)


def similarity_stats(vectors: DataFrame, floor: float = V.COSINE_FLOOR, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean, max and min cosine over all pairs of a session, low ones as 0.

    Tiles pass on sums, not pairs. They travel in blocks of at least SHIPPED_ROWS vectors, of
    which ``tile_rows`` at a time are multiplied. The edge thresholds are fixed and returned
    along with the figures.
    """

    def summary(block: pd.DataFrame) -> pd.DataFrame:
        lo, hi = block["lo"].iloc[0], block["hi"].iloc[0]
        left, right = (unit_rows(block.loc[block["tile"] == t, "embedding"]) for t in (lo, hi))
        n, total, most, least = 0, 0.0, None, None
        for a in range(0, len(left) if len(right) else 0, tile_rows):
            values = left[a : a + tile_rows] @ right.T
            values = values.ravel() if lo != hi else values[np.arange(len(right)) > np.arange(a, a + len(values))[:, None]]
            if not len(values):
                continue
            values = np.where(values < floor, 0.0, values)
            n, total = n + len(values), total + float(values.sum())
            most = float(values.max()) if most is None else max(most, float(values.max()))
            least = float(values.min()) if least is None else min(least, float(values.min()))
        return pd.DataFrame({"session_id": [block["session_id"].iloc[0]], "n": [n], "total": [total], "hi": [most], "lo": [least]})

    schema = f"session_id {dict(vectors.dtypes)['session_id']}, n long, total double, hi double, lo double"
    tiles = _tile_pairs(vectors, max(tile_rows, SHIPPED_ROWS)).withColumnRenamed("lo", "tlo").withColumnRenamed("hi", "thi")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        return summary(block.rename(columns={"tlo": "lo", "thi": "hi"}))

    return (
        tiles.groupBy("session_id", "tlo", "thi").applyInPandas(run, schema)
        .groupBy("session_id")
        .agg(
            F.sum("n").alias("pairs"), (F.sum("total") / F.sum("n")).alias("mean"),
            F.max("hi").alias("max"), F.min("lo").alias("min"),
        )
        .withColumns(
            {
                "highly_similar": F.lit(V.HIGHLY_SIMILAR),
                "similar_to": F.lit(V.SIMILAR_TO),
                "related_to": F.lit(V.RELATED_TO),
            }
        )
    )


# --- edges --------------------------------------------------------------------------

def related_threshold(user: float | None) -> float:
    """A user threshold can raise the lowest band, never lower it."""
    return max(V.RELATED_TO, user or 0.0)


def classify_edges(pairs: DataFrame, user_threshold: float | None = None) -> DataFrame:
    """Name the band of each pair, top down, with a small tolerance."""
    s = F.col("similarity")
    band = (
        F.when(s >= V.HIGHLY_SIMILAR - V.TOLERANCE, "highly_similar")
        .when(s >= V.SIMILAR_TO - V.TOLERANCE, "similar_to")
        .when(s >= related_threshold(user_threshold) - V.TOLERANCE, "related_to")
    )
    return pairs.withColumn("relationship", band).where(F.col("relationship").isNotNull())


def edge_quality_filter(edges: DataFrame) -> DataFrame:
    """Drop very short names, near-equal names with little in common, weak pairs."""
    a, b = F.col("src_label"), F.col("dst_label")
    same_name = jaccard_words(words(F.lower(a)), words(F.lower(b))) > 0.9
    return edges.where(
        (F.length(a) >= 5) & (F.length(b) >= 5)
        & ~(same_name & (F.col("similarity") < 0.7))
        & (F.col("similarity") >= V.MIN_EDGE_SIMILARITY)
    )


def classify_edges_simple(pairs: DataFrame, threshold: float = V.RELATED_TO, score: str = "cosine") -> DataFrame:
    """Bands on plain cosine, all strict."""
    s = F.col(score)
    band = F.when(s > 0.9, "highly_similar").when(s > 0.8, "similar_to").otherwise("related_to")
    return pairs.where(s > threshold).withColumn("relationship", band)


def build_edges(nodes: DataFrame, user_threshold: float | None = None, tile_rows: int = TILE_ROWS, vectors: DataFrame | None = None) -> DataFrame:
    """Classified and filtered edges with a sentence on each.

    With ``vectors`` their cosine takes the place of that of term counts.

    The pair search starts at the lowest similarity that can become an edge:
    the band floor, or the user's threshold where the two upper bands are
    above it anyway.
    """
    lowest = min(related_threshold(user_threshold), V.SIMILAR_TO) - V.TOLERANCE
    lowest = max(lowest, V.MIN_EDGE_SIMILARITY)
    pairs = pair_similarity(nodes, lowest, tile_rows) if vectors is None else pair_similarity_vectors(nodes, vectors, lowest, tile_rows)
    return _edges(pairs, user_threshold)


def _edges(pairs: DataFrame, user_threshold: float | None) -> DataFrame:
    edges = edge_quality_filter(classify_edges(pairs, user_threshold))
    return edges.withColumn("weight", F.col("similarity")).withColumn(
        "summary", pair_summary("src_label", "dst_label", "similarity", "relationship")
    )


def similarity_of_pairs(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``pair_similarity`` of the ``asked`` pairs of nodes (session_id, a, b, in either order) that share a word, whatever it is.

    Only their texts are counted, so the work grows with the asked pairs.
    """
    pairs = asked.select("session_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).where("src <> dst").distinct()
    ends = nodes.select("session_id", "id")
    for end in ("src", "dst"):
        pairs = pairs.join(ends.withColumnRenamed("id", end), ["session_id", end], "left_semi")
    pairs = cut_lineage(pairs)
    named = pairs.select("session_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    counted = cut_lineage(
        nodes.join(named, ["session_id", "id"], "left_semi").select("session_id", "id", F.explode(words("text")).alias("term"))
        .groupBy("session_id", "id", "term").agg(F.count("*").cast("double").alias("tf"))
    )
    whole = counted.groupBy("session_id", "id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"), F.count("*").alias("terms"))
    whole = whole.join(nodes.select("session_id", "id", "label", "copies", F.length("text").alias("chars")), ["session_id", "id"])

    def end(name: str) -> DataFrame:
        return whole.select("session_id", F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("label", "copies", "norm", "terms", "chars")])

    first = pairs.join(counted.withColumnRenamed("id", "src"), ["session_id", "src"])
    met = first.join(counted.select("session_id", F.col("id").alias("dst"), "term", F.col("tf").alias("tf2")), ["session_id", "dst", "term"])
    sums = met.groupBy("session_id", "src", "dst").agg(F.sum(F.col("tf") * F.col("tf2")).alias("dot"), F.count("*").alias("common"))
    scored = sums.join(end("src"), ["session_id", "src"]).join(end("dst"), ["session_id", "dst"]).select(
        "session_id", "src", "dst", "src_label", "dst_label", "src_copies", "dst_copies",
        (F.col("dot") / (F.col("src_norm") * F.col("dst_norm"))).alias("cosine"),
        (F.col("common") / (F.col("src_terms") + F.col("dst_terms") - F.col("common"))).alias("jaccard"),
        length_ratio(F.col("src_chars"), F.col("dst_chars")).alias("length_ratio"),
    )
    return scored.withColumn("similarity", _bound(F.col("cosine"), F.col("jaccard"), F.col("length_ratio")))


def edges_of_pairs(nodes: DataFrame, asked: DataFrame, user_threshold: float | None = None) -> DataFrame:
    """Those edges of ``build_edges`` that lie between ``asked`` pairs of nodes (session_id, a, b, in either order)."""
    return _edges(similarity_of_pairs(nodes, asked).where(F.col("similarity") >= V.MIN_EDGE_SIMILARITY - 1e-12), user_threshold)
