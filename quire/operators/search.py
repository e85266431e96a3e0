"""Keyword, vector and hybrid top-k search for batches of questions.

Skew. A session, a term or a question may hold a large share of all rows, so:

* hits are joined on (session, term, salt), with the postings spread over
  ``salts`` by chunk and the question side repeated once per salt;
* nothing but the surviving rows of a partial aggregate or a partial top-k is
  shuffled by question (a rank filter plans as a group limit before and after
  the exchange);
* vectors are compared in tiles of bounded size, so one session never lands
  in one task.

No side is marked for broadcast: Spark decides by measured size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions.text import embedding_key, normal_words, strip, truncate_ellipsis
from quire.session import cut_lineage

SALTS = 8
#: Tasks that a session's chunks are dealt to when they are indexed.
BUCKETS = 32
TILE_ROWS = 2048
#: Chunks and questions of a tile of a term search, and its cells worked on at a time. A chunk's text is
#: shipped once per tile of questions, which are short, so their tiles are the larger ones.
CHUNK_TILE, QUESTION_TILE, TILE_CELLS = 8192, 1 << 16, 1 << 22
#: A term whose pairs are at least this part of a tile's cells is a dense column; columns multiplied at a time.
DENSE_PART, DENSE_TERMS = 128, 1024


# --- terms ----------------------------------------------------------------------

def tokens(c: Column) -> Column:
    """Letter and digit runs, lower case, Latin marks removed."""
    plain = F.translate(F.lower(c), V.MARKED_LETTERS, V.PLAIN_LETTERS)
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


@dataclass
class KeywordIndex:
    """Postings, plus the chunk count and mean length they are scored against."""

    postings: DataFrame  # session_id, doc_id, chunk_id, length, term, tf
    stats: DataFrame  # one row: chunks, mean_length
    sessions: DataFrame | None = None  # session_id, chunks, tokens
    terms: DataFrame | None = None  # stored indexes only: session_id, term, df


def _with_stems(rows: DataFrame, stems: DataFrame | None) -> DataFrame:
    """Replace ``term`` by its stem; terms without one stay."""
    if stems is None:
        return rows
    return (
        rows.join(stems.select("term", "stem"), "term", "left")
        .withColumn("term", F.coalesce("stem", "term")).drop("stem")
    )


def build_keyword_index(
    chunks: DataFrame, stems: DataFrame | None = None, only_terms: DataFrame | None = None, buckets: int = BUCKETS
) -> KeywordIndex:
    """Index chunks by term.

    ``only_terms`` keeps the postings of those terms alone, which removes most
    tokens before the only shuffle when a known batch of questions is answered
    without a stored index. A session is counted in at most ``buckets`` tasks.
    """
    lexed = chunks.select("session_id", "doc_id", "chunk_id", tokens(F.col("content")).alias("tokens"))
    lexed = lexed.withColumn("length", F.size("tokens"))
    sessions = lexed.groupBy("session_id").agg(F.count("*").alias("chunks"), F.sum(F.col("length").cast("long")).alias("tokens"))
    # texts are dealt, not terms: what is counted by chunk then stays in its task
    dealt = chunks.select("session_id", "doc_id", "chunk_id", "content").withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))).repartition("session_id", "bucket")
    dealt = dealt.withColumn("tokens", tokens(F.col("content")))
    exploded = dealt.select("session_id", "bucket", "doc_id", "chunk_id", F.size("tokens").alias("length"), F.explode("tokens").alias("term"))
    exploded = _with_stems(exploded, stems)
    if only_terms is not None:
        exploded = exploded.join(only_terms.select("term").distinct(), "term", "left_semi")
    postings = exploded.groupBy("session_id", "bucket", "doc_id", "chunk_id", "length", "term").agg(
        F.count("*").alias("tf")
    )
    return KeywordIndex(postings.drop("bucket"), corpus_stats(sessions), sessions)


def corpus_stats(sessions: DataFrame) -> DataFrame:
    """Chunks and their mean length over all sessions."""
    return sessions.agg(
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), (F.sum("tokens") / F.nullif(F.sum("chunks"), F.lit(0))).alias("mean_length")
    )


def write_keyword_index(index: KeywordIndex, folder: str) -> None:
    """Store an index: postings, term frequencies and counts, one partition per session.

    A write replaces the sessions it holds and leaves the others. Postings are written
    from the tasks that count them; the frequencies are counted from the stored postings.
    """
    def write(rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(f"{folder}/{name}")

    sessions = cut_lineage(index.sessions)
    write(index.postings, "postings")
    stored = index.postings.sparkSession.read.schema(index.postings.schema).parquet(f"{folder}/postings")
    wanted = sessions.select(F.col("session_id").alias("_own")).distinct()
    own = stored.join(wanted, F.col("session_id").eqNullSafe(F.col("_own")), "left_semi")
    write(own.groupBy("session_id", "term").agg(F.count("*").alias("df")).repartition("session_id"), "terms")
    write(sessions.repartition("session_id"), "sessions")


def read_keyword_index(spark: SparkSession, folder: str) -> KeywordIndex:
    """A stored index. Emptied sessions hold one row without a term, which is left out."""
    def stored(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}").withColumn("session_id", F.col("session_id").cast("string"))

    sessions = stored("sessions")
    return KeywordIndex(stored("postings").where("term is not null"), corpus_stats(sessions), sessions, stored("terms").where("term is not null"))


def document_frequency(index: KeywordIndex) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def query_terms(queries: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Terms of each question with how often each is asked for and where."""
    asked = queries.select(
        "query_id", "session_id", F.posexplode(tokens(F.col("query_text"))).alias("at", "term")
    )
    return _with_stems(asked, stems)


def salted(rows: DataFrame, by: str, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))


def per_salt(rows: DataFrame, salts: int) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def top_k(rows: DataFrame, by: str, order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; planned as partial limits around one exchange."""
    limit = F.lit(k) if isinstance(k, int) else k
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(
        F.col(rank) <= limit
    )


def minmax_normalize(rows: DataFrame, score: str, by: str, out: str = "normalized", best: str = "high") -> DataFrame:
    """Scores to 0..1 per group; 1.0 when they are all equal.

    The extremes are a partial aggregate joined back, so a group of any size
    is fine. ``best="low"`` gives 1 to the lowest score.
    """
    span = rows.groupBy(by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    joined = rows.join(span, by)
    width = F.col("_hi") - F.col("_lo")
    raised = F.col(score) - F.col("_lo") if best == "high" else F.col("_hi") - F.col(score)
    return joined.withColumn(out, F.when(width > 0, raised / width).otherwise(F.lit(1.0))).drop("_lo", "_hi")


# --- keyword search ----------------------------------------------------------------

def bm25(idf: Column, tf: Column, length: Column, mean_length: Column) -> Column:
    damped = V.BM25_K1 * (1 - V.BM25_B + V.BM25_B * length / mean_length)
    return idf * (tf * (V.BM25_K1 + 1)) / (tf + damped)


def keyword_scores(
    index: KeywordIndex,
    queries: DataFrame,
    mode: str = "all",
    stems: DataFrame | None = None,
    stats: str = "corpus",
    salts: int = SALTS,
) -> DataFrame:
    """BM25 of every matching (query_id, chunk_id) inside the question's session.

    ``mode="all"`` keeps chunks that hold every distinct term, ``"any"`` those
    with at least one. Counts and lengths span the whole corpus by default,
    each session on its own with ``stats="session"``.
    """
    asked = query_terms(queries, stems)
    wanted = asked.groupBy("query_id", "session_id", "term").agg(F.count("*").alias("asked"))
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("needed"))
    scope = ["session_id", "term"] if stats == "session" else ["term"]
    if index.terms is None:
        df = index.postings.groupBy(*scope).agg(F.count("*").alias("df"))
    else:  # of the stored frequencies, only those of the terms asked for
        df = index.terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy(*scope).agg(F.sum("df").alias("df"))
    hits = salted(index.postings, "chunk_id", salts).join(
        per_salt(wanted.join(df, scope), salts), ["session_id", "term", "salt"]
    )
    if stats == "session":
        sizes = (
            index.postings.select("session_id", "chunk_id", "length").distinct()
            .groupBy("session_id")
            .agg(F.count("*").alias("chunks"), F.avg(F.col("length").cast("double")).alias("mean_length"))
        )
        hits = hits.join(sizes, "session_id")
        n, mean = F.col("chunks"), F.col("mean_length")
    else:
        n = index.stats.select("chunks").scalar()
        mean = index.stats.select("mean_length").scalar()
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(V.BM25_MIN_IDF))
    scored = hits.groupBy("query_id", "session_id", "doc_id", "chunk_id").agg(
        F.sum(bm25(idf, F.col("tf"), F.col("length"), mean) * F.col("asked")).alias("score"),
        F.count("*").alias("matched"),
    )
    if mode == "all":
        scored = scored.join(needed, "query_id").where("matched = needed").drop("needed")
    elif mode != "any":
        raise ValueError(f"unknown mode {mode!r}")
    return scored.drop("matched")


def best_first(score: str = "score", tie: str = "chunk_id") -> list[Column]:
    """Score order with differences below rounding treated as ties."""
    return [F.round(score, 9).desc(), F.col(tie).asc()]


def keyword_search(
    index: KeywordIndex,
    queries: DataFrame,
    k: int = V.DEFAULT_TOP_K,
    mode: str = "all",
    stems: DataFrame | None = None,
    stats: str = "corpus",
    parity: bool = False,
    salts: int = SALTS,
) -> DataFrame:
    """Top-k by BM25 with the score scaled to 0..1 among the k.

    The best hit gets 1. ``parity=True`` keeps the inverted scale in which the
    best hit gets 0.
    """
    hits = top_k(keyword_scores(index, queries, mode, stems, stats, salts), "query_id", best_first(), k)
    return minmax_normalize(hits, "score", "query_id", best="low" if parity else "high")


# --- matching without scores ----------------------------------------------------------

def match_terms(index: KeywordIndex, queries: DataFrame, mode: str = "all", salts: int = SALTS) -> DataFrame:
    """Chunks that hold all or any of a question's terms."""
    wanted = query_terms(queries).select("query_id", "session_id", "term").distinct()
    needed = wanted.groupBy("query_id").agg(F.count("*").alias("needed"))
    hits = salted(index.postings, "chunk_id", salts).join(
        per_salt(wanted, salts), ["session_id", "term", "salt"]
    )
    found = hits.groupBy("query_id", "chunk_id").agg(F.count("*").alias("matched"))
    if mode == "all":
        found = found.join(needed, "query_id").where("matched = needed").drop("needed")
    return found.drop("matched")


def match_without(
    index: KeywordIndex, queries: DataFrame, excluded: DataFrame, mode: str = "any", salts: int = SALTS
) -> DataFrame:
    """Matches of ``queries`` minus chunks with any term of ``excluded``."""
    return match_terms(index, queries, mode, salts).join(
        match_terms(index, excluded, "any", salts), ["query_id", "chunk_id"], "left_anti"
    )


def match_prefix(index: KeywordIndex, prefixes: DataFrame, salts: int = SALTS) -> DataFrame:
    """Chunks with a term that starts with one of (query_id, session_id, prefix).

    The vocabulary is cut to every asked-for length and joined by equality,
    then the terms found are looked up like any others.
    """
    wanted = prefixes.select("query_id", "session_id", "prefix").where("prefix <> ''").distinct()
    vocabulary = index.postings.select("term").distinct()
    cut = vocabulary.select("term", F.explode(F.sequence(F.lit(1), F.length("term"))).alias("n")).select(
        "term", F.expr("left(term, n)").alias("prefix")
    )
    terms = wanted.join(cut, "prefix").select("query_id", "session_id", "term").distinct()
    hits = salted(index.postings, "chunk_id", salts).join(
        per_salt(terms, salts), ["session_id", "term", "salt"]
    )
    return hits.select("query_id", "chunk_id").distinct()


def match_phrase(chunks: DataFrame, queries: DataFrame, salts: int = SALTS) -> DataFrame:
    """Chunks that hold a question's terms next to each other in order.

    A phrase starts where all of its terms agree on the start position.
    """
    asked = query_terms(queries)
    needed = asked.groupBy("query_id").agg(F.count("*").alias("needed"))
    placed = chunks.select("session_id", "chunk_id", F.posexplode(tokens(F.col("content"))).alias("pos", "term"))
    placed = placed.join(asked.select("term").distinct(), "term", "left_semi")
    hits = salted(placed, "chunk_id", salts).join(per_salt(asked, salts), ["session_id", "term", "salt"])
    starts = hits.groupBy("query_id", "chunk_id", (F.col("pos") - F.col("at")).alias("start")).agg(
        F.count("*").alias("matched")
    )
    return starts.join(needed, "query_id").where("matched = needed").select("query_id", "chunk_id").distinct()


# --- vector search ------------------------------------------------------------------

def unit_rows(column: pd.Series) -> np.ndarray:
    """Stack vectors and scale each to length one; zero vectors stay zero."""
    rows = np.asarray(column.tolist(), dtype=np.float64)
    if rows.size == 0:
        return rows.reshape(0, 0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def tiled(rows: DataFrame, key: str, by: str, out: str, tile_rows: int) -> DataFrame:
    """Number the tiles of each group so that one tile holds about ``tile_rows``."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    tiles = F.greatest(F.ceil(F.col("_n") / float(tile_rows)), F.lit(1)).cast("long")
    return (
        rows.join(sizes, key)
        .withColumn(f"{out}s", tiles)
        .withColumn(out, F.pmod(F.xxhash64(by), F.col(f"{out}s")).cast("int"))
        .drop("_n")
    )


def best_of_tile(k: int):
    """Cosines of the questions of one tile (right) with its vectors (left): the best ``k`` of each question."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "session_id", "doc_id", "chunk_id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame(columns=columns)
        left = left.sort_values("chunk_id", kind="stable").reset_index(drop=True)
        scores = np.round(unit_rows(right["query_vec"]) @ unit_rows(left["embedding"]).T, 12)
        order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
        picked = order.ravel()
        owner = np.repeat(np.arange(len(right)), order.shape[1])
        return pd.DataFrame(
            {
                "query_id": right["query_id"].to_numpy()[owner],
                "session_id": left["session_id"].to_numpy()[picked],
                "doc_id": left["doc_id"].to_numpy()[picked],
                "chunk_id": left["chunk_id"].to_numpy()[picked],
                "score": scores[owner, picked],
            }
        )

    return best


def semantic_scores(
    vectors: DataFrame, queries: DataFrame, k: int = V.DEFAULT_TOP_K, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Cosine of each question with the best ``k`` vectors of every tile.

    Exact: each tile multiplies a block of questions with a block of vectors
    of one session, and passes on only its own best ``k`` per question.
    """
    v = tiled(vectors.select("session_id", "doc_id", "chunk_id", "embedding"), "session_id", "chunk_id", "vtile", tile_rows)
    q = tiled(queries.select("session_id", "query_id", "query_vec"), "session_id", "query_id", "qtile", tile_rows)
    spans = v.groupBy("session_id").agg(F.max("vtiles").alias("vtiles"))
    qspans = q.groupBy("session_id").agg(F.max("qtiles").alias("qtiles"))
    q = q.drop("qtiles").join(spans, "session_id").withColumn(
        "vtile", F.explode(F.sequence(F.lit(0), (F.col("vtiles") - 1).cast("int")))
    ).drop("vtiles")
    v = v.drop("vtiles").join(qspans, "session_id").withColumn(
        "qtile", F.explode(F.sequence(F.lit(0), (F.col("qtiles") - 1).cast("int")))
    ).drop("qtiles")
    tile = ["session_id", "vtile", "qtile"]

    kinds = {**dict(vectors.dtypes), **dict(queries.dtypes)}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["query_id", "session_id", "doc_id", "chunk_id"]) + ", score double"
    return v.groupBy(*tile).cogroup(q.groupBy(*tile)).applyInPandas(best_of_tile(k), schema)


def semantic_search(
    vectors: DataFrame, queries: DataFrame, k: int = V.DEFAULT_TOP_K, tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Exact cosine top-k inside each question's session."""
    return top_k(semantic_scores(vectors, queries, k, tile_rows), "query_id", best_first(), k)


def index_stats(sessions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vector count and dimension per session; zero where there is no index."""
    built = vectors.groupBy("session_id").agg(
        F.count("*").alias("vector_count"), F.max(F.size("embedding")).alias("dimension")
    )
    return sessions.select("session_id").join(built, "session_id", "left").select(
        "session_id",
        F.coalesce("vector_count", F.lit(0)).alias("vector_count"),
        F.coalesce("dimension", F.lit(0)).alias("dimension"),
        F.col("vector_count").isNotNull().alias("index_exists"),
    )


def embed_text(rows: DataFrame, embed, text: str = "content", model: str = "model") -> DataFrame:
    """Add a vector per row, calling the supplied model once per distinct text.

    ``embed`` is a pandas UDF from text to an array of floats.
    """
    keyed = rows.withColumn("_key", embedding_key(model, text))
    distinct = keyed.groupBy("_key").agg(F.any_value(text).alias("_text"))
    vectors = distinct.select("_key", embed(F.col("_text")).alias("embedding"))
    return keyed.join(vectors, "_key").drop("_key")


# --- term vectors: the model-free stand-in --------------------------------------------

def term_vectors(rows: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    """Term counts of the normalised text with the length of the whole vector."""
    counted = (
        rows.select(*keep, key, F.explode(normal_words(text)).alias("term"))
        .groupBy(*keep, key, "term").agg(F.count("*").alias("tf"))
    )
    norms = counted.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return counted.join(norms, key)


def term_questions(queries: DataFrame) -> DataFrame:
    """(query_id, session_id, question, words): questions of the same words in a session share a number.

    Rows of one query_id are one question; those without a word are left out.
    """
    asked = (
        queries.select("query_id", "session_id", F.explode(normal_words("query_text")).alias("term")).where("query_id is not null and session_id is not null")
        .groupBy("query_id", "session_id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("words"))
    )
    asked = cut_lineage(asked)
    numbered = cut_lineage(asked.select("session_id", "words").distinct().withColumn("question", F.monotonically_increasing_id()))
    return asked.join(numbered, ["session_id", "words"])


class _Terms:
    """Counts of the words of a tile's texts, rows of the same key as one."""

    def __init__(self, owner: np.ndarray, owners: int, texts: pa.ChunkedArray) -> None:
        lists = pc.split_pattern(texts.combine_chunks(), " ")
        words = lists.flatten().dictionary_encode()
        self.vocabulary = words.dictionary
        term = words.indices.to_numpy().astype(np.int64)
        row = np.repeat(owner, np.diff(lists.offsets.to_numpy()))
        cell, tf = np.unique(term * owners + row, return_counts=True)
        self.term, self.row, self.tf = cell // owners, cell % owners, tf.astype(np.float64)
        self.norm = np.sqrt(np.bincount(self.row, self.tf * self.tf, minlength=owners))
        self.rows = owners

    def among(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, row, count) of the counts whose term has a place, by place and row."""
        at = place[self.term]
        own = np.flatnonzero(at >= 0)
        own = own[np.lexsort((self.row[own], at[own]))]
        return at[own], self.row[own], self.tf[own]


def _best_cells(dot: np.ndarray, norm: np.ndarray, qnorm: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, chunk, score) that may be among a question's best ``k``; equal scores by place.

    A first choice by rounded quotients leaves a margin; then every score within 2e-9 of the k-th
    stays, and of equal ones the first k, so rounding to 9 places can't bring up another one.
    """
    near = dot * (1.0 / norm).astype(dot.dtype)
    floor = np.zeros(len(dot))
    if dot.shape[1] > k:
        floor = np.partition(near, dot.shape[1] - k, axis=1)[:, dot.shape[1] - k] * (1 - 1e-6) - 4e-9 * qnorm
    i, j = np.nonzero((near >= floor[:, None].astype(dot.dtype)) & (dot > 0))
    score = dot[i, j].astype(np.float64) / (norm[j] * qnorm[i])
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]

    def place(new: np.ndarray) -> np.ndarray:
        at = np.arange(len(new))
        return at - np.maximum.accumulate(np.where(new, at, 0))

    if not len(i):
        return i, j, score
    stay = place(np.r_[True, (np.diff(i) > 0) | (np.diff(score) != 0)]) < k
    i, j, score = i[stay], j[stay], score[stay]
    at = place(np.r_[True, np.diff(i) > 0])
    least = np.full(len(dot), -1.0)
    least[i[at == k - 1]] = score[at == k - 1]
    stay = score >= least[i] - 2e-9
    return i[stay], j[stay], score[stay]


def best_by_terms(k: int):
    """Cosines of the questions of one tile (right) with its chunks (left): those that may be among the best ``k`` of a question."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"question": [], "at": [], "score": []}
        kinds = {"question": pa.int64(), "session_id": right.schema.field("session_id").type, "doc_id": left.schema.field("doc_id").type, "chunk_id": left.schema.field("chunk_id").type}
        empty = pa.table({c: pa.array([], t) for c, t in kinds.items()} | {"score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        left = left.sort_by([("chunk_id", "ascending"), ("doc_id", "ascending")])
        # repeated rows of a chunk are one
        ids = left.column("chunk_id").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        docs = left.column("doc_id").combine_chunks().dictionary_encode().indices
        new = np.r_[True, (np.diff(ids) != 0) | (np.diff(pc.fill_null(docs, -1).to_numpy()) != 0)]
        x = _Terms(np.cumsum(new) - 1, int(new.sum()), left.column("words"))
        y = _Terms(np.arange(right.num_rows), right.num_rows, right.column("words"))
        common = pc.index_in(y.vocabulary, value_set=x.vocabulary)
        of_y = np.flatnonzero(pc.is_valid(common).to_numpy(zero_copy_only=False))
        if not len(of_y):
            return empty
        place_y, place_x = np.full(len(y.vocabulary), -1), np.full(len(x.vocabulary), -1)
        place_y[of_y] = np.arange(len(of_y))
        place_x[pc.fill_null(common, 0).to_numpy()[of_y]] = np.arange(len(of_y))
        (tx, nx, fx), (ty, ny, fy) = x.among(place_x), y.among(place_y)
        many_x, many_y = np.bincount(tx, minlength=len(of_y)), np.bincount(ty, minlength=len(of_y))
        dense = many_x * many_y * DENSE_PART >= x.rows * y.rows
        column = np.cumsum(dense) - 1
        columns = int(dense.sum())
        # counts and their products are whole numbers; single precision where it holds every sum
        kind = np.float32 if x.norm.max() * y.norm.max() < 1 << 24 else np.float64
        of_x = np.flatnonzero(dense[tx])
        begin = np.concatenate(([0], np.cumsum(many_x)))
        slot = [of_x[(column[tx[of_x]] >= a) & (column[tx[of_x]] < a + DENSE_TERMS)] for a in range(0, columns, DENSE_TERMS)]
        by_row = np.argsort(ny, kind="stable")
        ty, ny, fy = ty[by_row], ny[by_row], fy[by_row]
        step = max(1, TILE_CELLS // x.rows)
        for a in range(0, y.rows, step):
            b = min(a + step, y.rows)
            own = slice(*np.searchsorted(ny, [a, b]))
            t, n, f = ty[own], ny[own] - a, fy[own]
            dot = np.zeros((b - a, x.rows), kind)
            for c, of in zip(range(0, columns, DENSE_TERMS), slot):
                width = min(DENSE_TERMS, columns - c)
                rows, cols = np.zeros((b - a, width), kind), np.zeros((width, x.rows), kind)
                cols[column[tx[of]] - c, nx[of]] = fx[of]
                mine = dense[t] & (column[t] >= c) & (column[t] < c + width)
                rows[n[mine], column[t[mine]] - c] = f[mine]
                dot += rows @ cols
            rare = np.flatnonzero(~dense[t])
            ends = np.cumsum(many_x[t[rare]])
            s = 0
            while s < len(rare):
                e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + TILE_CELLS, "right")))
                some = rare[s:e]
                many = many_x[t[some]]
                of = np.repeat(some, many)
                at = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + begin[t[of]]
                dot += np.bincount(n[of] * x.rows + nx[at], f[of] * fx[at], minlength=dot.size).reshape(dot.shape).astype(kind)
                s = e
            i, j, score = _best_cells(dot, x.norm, y.norm[a:b], k)
            out["question"].append(i + a), out["at"].append(j), out["score"].append(score)
        i, j, score = (np.concatenate(out[c]) for c in ("question", "at", "score"))
        first = np.flatnonzero(new)[j]
        return pa.table({
            "question": right.column("question").take(pa.array(i)), "session_id": right.column("session_id").take(pa.array(i)),
            "doc_id": left.column("doc_id").take(pa.array(first)), "chunk_id": left.column("chunk_id").take(pa.array(first)), "score": score,
        })

    return best


def term_scores(chunks: DataFrame, questions: DataFrame, k: int = V.DEFAULT_TOP_K, chunk_rows: int = CHUNK_TILE, question_rows: int = QUESTION_TILE) -> DataFrame:
    """Cosine of term counts of each question (``term_questions``) with the best chunks of every tile.

    Exact: a tile multiplies a block of questions with a block of chunks of one session and passes
    on only what may be among a question's best ``k``. A text is shipped once per block of the other side.
    """
    q = questions.select("session_id", "question", "words").distinct()
    # stored, since the numbers of tiles and the tiles read it
    c = cut_lineage(chunks.select("session_id", "doc_id", "chunk_id", F.array_join(normal_words("content"), " ").alias("words")).where("chunk_id is not null and words <> ''"))

    def tiles(rows: DataFrame, out: str, tile_rows: int) -> DataFrame:
        return rows.groupBy("session_id").agg(F.ceil(F.count("*") / float(tile_rows)).cast("int").alias(out))

    # one row per session, stored so that its real size is known: texts are then shuffled once, by tile, and not by session
    spans = cut_lineage(tiles(c, "ctiles", chunk_rows).join(tiles(q, "qtiles", question_rows), "session_id"))

    def dealt(rows: DataFrame, by: str, own: str, other: str) -> DataFrame:
        rows = rows.join(spans, "session_id").withColumn(own, F.pmod(F.xxhash64(by), F.col(f"{own}s")).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop("ctiles", "qtiles")

    c, q = dealt(c, "chunk_id", "ctile", "qtile"), dealt(q, "question", "qtile", "ctile")
    tile = ["session_id", "ctile", "qtile"]
    kinds = dict(chunks.dtypes)
    schema = f"question long, session_id {kinds['session_id']}, doc_id {kinds['doc_id']}, chunk_id {kinds['chunk_id']}, score double"
    return c.groupBy(*tile).cogroup(q.groupBy(*tile)).applyInArrow(best_by_terms(k), schema)


def term_search(chunks: DataFrame, queries: DataFrame, k: int = V.DEFAULT_TOP_K, chunk_rows: int = CHUNK_TILE, question_rows: int = QUESTION_TILE) -> DataFrame:
    """Top-k by term-count cosine: semantic search where no model is plugged in. Questions of the same words are compared once."""
    questions = term_questions(queries)
    hits = top_k(term_scores(chunks, questions, k, chunk_rows, question_rows), "question", best_first(), k)
    return questions.select("query_id", "question").join(hits, "question").select("query_id", "session_id", "doc_id", "chunk_id", "score", "rank")


# --- merging and presenting ---------------------------------------------------------------

def hybrid_search(
    semantic: DataFrame, keyword: DataFrame, k: int = V.DEFAULT_TOP_K, weight: float = V.SEMANTIC_WEIGHT
) -> DataFrame:
    """Merge two result lists by chunk; a side that misses a chunk scores 0."""
    keys = ["query_id", "session_id", "doc_id", "chunk_id"]
    s = minmax_normalize(semantic.select(*keys, "score"), "score", "query_id", "semantic_score").drop("score")
    w = minmax_normalize(keyword.select(*keys, "score"), "score", "query_id", "keyword_score").drop("score")
    merged = s.join(w, keys, "full_outer").withColumn(
        "source_type",
        F.when(F.col("keyword_score").isNull(), "semantic")
        .when(F.col("semantic_score").isNull(), "keyword")
        .otherwise("both"),
    )
    merged = merged.fillna(0.0, ["semantic_score", "keyword_score"]).withColumn(
        "score", F.col("semantic_score") * weight + F.col("keyword_score") * (1 - weight)
    )
    return top_k(merged, "query_id", best_first(), k)


def search_with_fallback(primary: DataFrame, secondary: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Results of the second method for questions the first left empty."""
    columns = ["query_id", "chunk_id", "score", "rank"]
    spare = secondary.join(primary.select("query_id").distinct(), "query_id", "left_anti")
    return primary.select(*columns, F.lit(names[0]).alias("method")).unionByName(
        spare.select(*columns, F.lit(names[1]).alias("method"))
    )


def clean_results(results: DataFrame) -> DataFrame:
    """Drop empty results and results with a page marker."""
    return results.where((strip("content") != "") & ~F.col("content").contains("--- Page"))


def snippets(results: DataFrame, n: int = 200) -> DataFrame:
    return results.withColumn("snippet", truncate_ellipsis("content", n))


def source_lists(results: DataFrame) -> DataFrame:
    """Distinct document names per question; result lists are at most k long."""
    return results.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_name")).alias("sources"))


def search_capability_report(sessions: DataFrame, stats: DataFrame, **results: DataFrame) -> DataFrame:
    """Per session: hit counts and one sample hit from every method."""
    report = sessions.select("session_id").join(stats, "session_id", "left")
    for name, hits in results.items():
        found = hits.groupBy("session_id").agg(
            F.count("*").alias(f"{name}_count"),
            F.min_by("chunk_id", F.struct("rank", "query_id", "chunk_id")).alias(f"{name}_sample"),
        )
        report = report.join(found, "session_id", "left").fillna(0, [f"{name}_count"])
    return report
