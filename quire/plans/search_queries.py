"""Index building and top-k search over the whole corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from quire.operators import block_postings as B
from quire.operators import matching as M
from quire.operators import search as Q
from quire.operators import vector_cells as C
from quire.operators.stemming import stem_vocabulary
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.registry import Registry
from quire.session import cut_lineage, scratch_path

registry = Registry()


def big(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def index_for(spark, folder, queries, stems=None):
    chunks = X.chunks(spark, folder)
    asked = Q.query_terms(queries, stems)
    index = Q.build_keyword_index(chunks, stems, only_terms=asked)
    # an index is stored once and then read by every step of the search
    return Q.KeywordIndex(cut_lineage(index.postings), cut_lineage(index.stats), index.sessions)


# Each question two words at a time, for the modes in which every word must be present.
SHORT = f"""{X.SEARCH_REQUESTS}, short_requests AS (SELECT * EXCLUDE (toks, i) REPLACE (query_id * 1000 + i // 2 AS query_id, array_to_string(toks[i + 1:i + 2], ' ') AS query_text)
  FROM (SELECT *, unnest(range(0, len(toks), 2)) AS i FROM (SELECT *, {S.tokens('query_text')} AS toks FROM search_requests)))"""


def short_requests(spark, folder):
    toks = X.search_requests(spark, folder).withColumn("_toks", Q.tokens(F.col("query_text"))).where("size(_toks) > 0")
    parts = toks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_toks") - 1, F.lit(2))))
    return parts.withColumns({
        "query_id": F.col("query_id") * 1000 + F.expr("_i div 2"), "query_text": F.array_join(F.slice("_toks", F.col("_i") + 1, F.lit(2)), " "),
    }).drop("_toks", "_i")


POSTINGS = f"""{X.CHUNKS}, lexed AS (SELECT session_id, doc_id, chunk_id, {S.tokens('content')} AS toks FROM chunks),
postings AS (SELECT session_id, doc_id, chunk_id, length, term, count(*) AS tf FROM (
  SELECT session_id, doc_id, chunk_id, len(toks) AS length, unnest(toks) AS term FROM lexed) GROUP BY ALL)"""


@registry.add("build_keyword_index", f"WITH {POSTINGS} SELECT session_id, chunk_id, term, tf, length::BIGINT AS length FROM postings")
def _(spark, folder):
    index = Q.build_keyword_index(X.chunks(spark, folder))
    return index.postings.select("session_id", "chunk_id", "term", "tf", big("length").alias("length"))


@registry.add(
    "keyword_index_stats",
    f"WITH {POSTINGS} SELECT term, count(*) AS df, (SELECT count(*) FROM lexed) AS chunks, round((SELECT avg(len(toks)) FROM lexed), 6) AS mean_length FROM postings GROUP BY term",
)
def _(spark, folder):
    index = Q.build_keyword_index(X.chunks(spark, folder))
    return Q.document_frequency(index).select(
        "term", "df", index.stats.select("chunks").scalar().alias("chunks"),
        F.round(index.stats.select("mean_length").scalar(), 6).alias("mean_length"),
    )


def bm25_sql(requests: str, mode: str, stats: str = "corpus") -> str:
    if stats == "session":
        df = "SELECT session_id, term, count(*) AS df FROM postings GROUP BY 1, 2"
        sizes = "SELECT session_id, count(*) AS n, avg(len(toks)) AS mean FROM lexed WHERE len(toks) > 0 GROUP BY 1"
        joins = "JOIN df USING (session_id, term) JOIN sizes USING (session_id)"
    else:
        df = "SELECT term, count(*) AS df FROM postings GROUP BY 1"
        sizes = "SELECT count(*) AS n, avg(len(toks)) AS mean FROM lexed"
        joins = "JOIN df USING (term) CROSS JOIN sizes"
    having = "HAVING count(*) = max(needed)" if mode == "all" else ""
    return f"""{POSTINGS},
asked AS (SELECT query_id, session_id, unnest({S.tokens('query_text')}) AS term FROM {requests}),
wanted AS (SELECT query_id, session_id, term, count(*) AS asked FROM asked GROUP BY ALL),
needed AS (SELECT query_id, count(*) AS needed FROM wanted GROUP BY 1),
df AS ({df}), sizes AS ({sizes}),
scored AS (
  SELECT query_id, session_id, doc_id, chunk_id,
    sum(asked * greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * (tf * 2.2::DOUBLE)
        / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score
  FROM postings JOIN wanted USING (session_id, term) JOIN needed USING (query_id) {joins}
  GROUP BY query_id, session_id, doc_id, chunk_id {having}),
keyword_hits AS (
  SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS normalized FROM (
    SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored)
    WHERE rank <= 5))"""


_HIT_COLUMNS = "query_id, session_id, doc_id, chunk_id, rank, round(score, 5) AS score, round(normalized, 5) AS normalized"


def _hit_columns(df):
    return df.select(
        "query_id", "session_id", "doc_id", "chunk_id", big("rank").alias("rank"),
        F.round("score", 5).alias("score"), F.round("normalized", 5).alias("normalized"),
    )


def keyword_hits(spark, folder, mode="any", whole=False, **options):
    asked = short_requests(spark, folder) if mode == "all" and not whole else X.search_requests(spark, folder)
    return Q.keyword_search(index_for(spark, folder, asked), asked, mode=mode, **options)


@registry.add("keyword_search", f"WITH {SHORT}, {bm25_sql('short_requests', 'all')} SELECT {_HIT_COLUMNS} FROM keyword_hits")
def _(spark, folder):
    return _hit_columns(keyword_hits(spark, folder, mode="all"))


@registry.add("keyword_search_any", f"WITH {X.SEARCH_REQUESTS}, {bm25_sql('search_requests', 'any')} SELECT {_HIT_COLUMNS} FROM keyword_hits")
def _(spark, folder):
    return _hit_columns(keyword_hits(spark, folder, mode="any"))


@registry.add("keyword_search_stored", f"WITH {X.SEARCH_REQUESTS}, {bm25_sql('search_requests', 'any')} SELECT {_HIT_COLUMNS} FROM keyword_hits")
def _(spark, folder):
    path = scratch_path(spark, "index")
    Q.write_keyword_index(Q.build_keyword_index(X.chunks(spark, folder)), path)
    return _hit_columns(Q.keyword_search(Q.read_keyword_index(spark, path), X.search_requests(spark, folder), mode="any"))


@registry.add("keyword_search_by_session", f"WITH {X.SEARCH_REQUESTS}, {bm25_sql('search_requests', 'any', 'session')} SELECT {_HIT_COLUMNS} FROM keyword_hits")
def _(spark, folder):
    # document frequencies per session need the full postings of that session
    index = Q.build_keyword_index(X.chunks(spark, folder))
    return _hit_columns(Q.keyword_search(index, X.search_requests(spark, folder), mode="any", stats="session"))


@registry.add("keyword_search_stemmed")
def _(spark, folder):
    asked = X.search_requests(spark, folder)
    words = X.chunks(spark, folder).select(F.explode(Q.tokens(F.col("content"))).alias("term"))
    stems = stem_vocabulary(words.unionByName(Q.query_terms(asked).select("term")))
    return _hit_columns(Q.keyword_search(index_for(spark, folder, asked, stems), asked, stems=stems, mode="any"))


@registry.add("stem_vocabulary")
def _(spark, folder):
    words = X.table(spark, folder, "documents").select(F.explode(Q.tokens(F.col("text"))).alias("term"))
    return stem_vocabulary(words)


def _match_sql(mode, requests):
    having = "HAVING count(DISTINCT p.term) = max(n.c)" if mode == "all" else ""
    return f"""WITH {SHORT}, {POSTINGS}, asked AS (SELECT query_id, session_id, unnest({S.tokens('query_text')}) AS term FROM {requests}),
    n AS (SELECT query_id, count(DISTINCT term) AS c FROM asked GROUP BY 1)
    SELECT a.query_id, p.chunk_id FROM postings p JOIN (SELECT DISTINCT * FROM asked) a ON a.session_id = p.session_id AND a.term = p.term
    JOIN n ON n.query_id = a.query_id GROUP BY a.query_id, p.chunk_id {having}"""


@registry.add("match_all_terms", _match_sql("all", "short_requests"))
def _(spark, folder):
    asked = short_requests(spark, folder)
    return Q.match_terms(index_for(spark, folder, asked), asked, "all")


@registry.add("match_any_term", _match_sql("any", "search_requests"))
def _(spark, folder):
    asked = X.search_requests(spark, folder)
    return Q.match_terms(index_for(spark, folder, asked), asked, "any")


# Each question keeps its first word and excludes its second.
@registry.add(
    "match_without",
    f"""WITH {X.SEARCH_REQUESTS}, {POSTINGS}, w AS (SELECT query_id, session_id, {S.tokens('query_text')} AS t FROM search_requests)
    SELECT DISTINCT w.query_id, p.chunk_id FROM w JOIN postings p ON p.session_id = w.session_id AND p.term = w.t[1]
    WHERE NOT EXISTS (SELECT 1 FROM postings x WHERE x.chunk_id = p.chunk_id AND x.term = w.t[2])""",
)
def _(spark, folder):
    asked = X.search_requests(spark, folder)
    first = asked.withColumn("query_text", Q.tokens(F.col("query_text"))[0])
    second = asked.withColumn("query_text", Q.tokens(F.col("query_text"))[1])
    return Q.match_without(index_for(spark, folder, asked), first, second)


@registry.add(
    "match_prefix",
    f"""WITH {X.SEARCH_REQUESTS}, {POSTINGS}, w AS (SELECT query_id, session_id, substr({S.tokens('query_text')}[2], 1, 4) AS prefix FROM search_requests)
    SELECT DISTINCT w.query_id, p.chunk_id FROM w JOIN postings p ON p.session_id = w.session_id AND starts_with(p.term, w.prefix)""",
)
def _(spark, folder):
    asked = X.search_requests(spark, folder)
    prefixes = asked.withColumn("prefix", F.substring(Q.tokens(F.col("query_text"))[1], 1, 4))
    return Q.match_prefix(Q.build_keyword_index(X.chunks(spark, folder)), prefixes)


# The first two words of each question, next to each other.
@registry.add(
    "match_phrase",
    f"""WITH {SHORT}, {X.CHUNKS}, t AS (SELECT session_id, chunk_id, ' ' || array_to_string({S.tokens('content')}, ' ') || ' ' AS body FROM chunks)
    SELECT w.query_id, t.chunk_id FROM (SELECT query_id, session_id, ' ' || query_text || ' ' AS phrase FROM short_requests) w
    JOIN t ON t.session_id = w.session_id AND contains(t.body, w.phrase)""",
)
def _(spark, folder):
    asked = short_requests(spark, folder)
    return Q.match_phrase(X.chunks(spark, folder), asked)


# Of each question's words: ((w1 or w2's beginning) and w1 near w3) or "w2 w3", without w5.
@registry.add(
    "match_expression",
    f"""WITH {X.SEARCH_REQUESTS}, {X.CHUNKS}, w AS (SELECT query_id, session_id, {S.tokens('query_text')} AS w FROM search_requests),
    t AS (SELECT session_id, chunk_id, {S.tokens('content')} AS toks FROM chunks)
    SELECT query_id, chunk_id FROM w JOIN t USING (session_id) WHERE
      (((list_contains(toks, w[1]) OR len(list_filter(toks, lambda x: starts_with(x, left(w[2], 3)))) > 0)
        AND len(list_filter(range(1, len(toks) + 1), lambda i: list_contains(toks[i:i + 31], w[1]) AND list_contains(toks[i:i + 31], w[3]) AND (toks[i] = w[1] OR toks[i] = w[3]))) > 0)
       OR contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || w[2] || ' ' || w[3] || ' ')) AND NOT list_contains(toks, w[5])""",
)
def _(spark, folder):
    word = Q.tokens(F.col("query_text"))
    w = [F.get(word, F.lit(i)) for i in range(5)]
    steps = [
        ("phrase", w[0], 0), ("prefix", F.substring(w[1], 1, 3), 0), ("or", F.lit(""), 0), ("near", F.concat_ws(" ", w[0], w[2]), 30), ("and", F.lit(""), 0),
        ("phrase", F.concat_ws(" ", w[1], w[2]), 0), ("or", F.lit(""), 0), ("phrase", w[4], 0), ("without", F.lit(""), 0),
    ]
    column = F.array(*[F.struct(F.lit(op).alias("op"), words.alias("words"), F.lit(d).cast("int").alias("distance")) for op, words, d in steps])
    asked = cut_lineage(X.search_requests(spark, folder).select("query_id", "session_id", column.alias("steps")))
    path = scratch_path(spark, "positions")
    M.write_positions(M.build_positions(X.chunks(spark, folder), only_asked=asked), path)
    return M.match(M.read_positions(spark, path), asked)


@registry.add(
    "minmax_normalize",
    f"WITH {X.CORPUS} SELECT session_id, doc_id, round((length(text) - min(length(text)) OVER (PARTITION BY session_id))::DOUBLE / nullif(max(length(text)) OVER (PARTITION BY session_id) - min(length(text)) OVER (PARTITION BY session_id), 0), 6) AS normalized FROM corpus",
)
def _(spark, folder):
    rows = X.corpus(spark, folder).select("session_id", "doc_id", F.length("text").alias("score"))
    return Q.minmax_normalize(rows, "score", "session_id").select("session_id", "doc_id", F.round("normalized", 6).alias("normalized"))


SEMANTIC = f"""{X.VECTORS}, {X.SEARCH_REQUESTS}, semantic_hits AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
    SELECT q.query_id, q.session_id, v.doc_id, v.chunk_id, v.doc_name, list_cosine_similarity(v.embedding::DOUBLE[], q.query_vec) AS score
    FROM vectors v JOIN search_requests q USING (session_id)) QUALIFY rank <= 5)"""


def semantic_hits(spark, folder, k=5):
    return Q.semantic_search(X.vectors(spark, folder), X.search_requests(spark, folder), k)


_SEMANTIC_COLUMNS = "query_id, session_id, doc_id, chunk_id, rank, round(score, 6) AS score"


@registry.add("semantic_search_cells", f"WITH {SEMANTIC} SELECT {_SEMANTIC_COLUMNS} FROM semantic_hits")
def _(spark, folder):
    hits, _ = C.nearest_in_cells(C.build_cells(X.vectors(spark, folder)), X.search_requests(spark, folder), 5)
    return hits.select("query_id", "session_id", "doc_id", "chunk_id", big("rank").alias("rank"), F.round("score", 6).alias("score"))


@registry.add("semantic_search", f"WITH {SEMANTIC} SELECT {_SEMANTIC_COLUMNS} FROM semantic_hits")
def _(spark, folder):
    return semantic_hits(spark, folder).select(
        "query_id", "session_id", "doc_id", "chunk_id", big("rank").alias("rank"), F.round("score", 6).alias("score")
    )


def _norm(alias, out):
    return f"""CASE WHEN max(score) OVER (PARTITION BY query_id) > min(score) OVER (PARTITION BY query_id)
      THEN (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) ELSE 1.0 END AS {out} FROM {alias}"""


_KEYWORD_CTES = bm25_sql("search_requests", "any").replace(f"{X.CORPUS}, ", "", 1)
HYBRID = f"""{SEMANTIC}, {_KEYWORD_CTES}, merged AS (
  SELECT query_id, session_id, doc_id, chunk_id, coalesce(s.semantic_score, 0) AS semantic_score, coalesce(w.keyword_score, 0) AS keyword_score,
    CASE WHEN w.keyword_score IS NULL THEN 'semantic' WHEN s.semantic_score IS NULL THEN 'keyword' ELSE 'both' END AS source_type
  FROM (SELECT query_id, session_id, doc_id, chunk_id, {_norm('semantic_hits', 'semantic_score')}) s
  FULL JOIN (SELECT query_id, session_id, doc_id, chunk_id, {_norm('keyword_hits', 'keyword_score')}) w USING (query_id, session_id, doc_id, chunk_id)),
hybrid_hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
  SELECT *, semantic_score * 0.6::DOUBLE + keyword_score * 0.4::DOUBLE AS score FROM merged) QUALIFY rank <= 5)"""


@registry.add(
    "hybrid_search",
    f"WITH {HYBRID} SELECT query_id, chunk_id, source_type, rank, round(semantic_score, 5) AS semantic_score, round(keyword_score, 5) AS keyword_score, round(score, 5) AS score FROM hybrid_hits",
)
def _(spark, folder):
    hits = Q.hybrid_search(semantic_hits(spark, folder), keyword_hits(spark, folder, mode="any"))
    return hits.select(
        "query_id", "chunk_id", "source_type", big("rank").alias("rank"),
        *[F.round(c, 5).alias(c) for c in ["semantic_score", "keyword_score", "score"]],
    )


@registry.add(
    "search_with_fallback",
    f"""WITH {SEMANTIC}, {bm25_sql('search_requests', 'all').replace(f'{X.CORPUS}, ', '', 1)}
    SELECT query_id, chunk_id, rank, round(score, 5) AS score, 'keyword' AS method FROM keyword_hits
    UNION ALL SELECT query_id, chunk_id, rank, round(score, 5), 'semantic' FROM semantic_hits WHERE query_id NOT IN (SELECT query_id FROM keyword_hits)""",
)
def _(spark, folder):
    merged = Q.search_with_fallback(
        keyword_hits(spark, folder, mode="all", whole=True), semantic_hits(spark, folder), ("keyword", "semantic")
    )
    return merged.select("query_id", "chunk_id", big("rank").alias("rank"), F.round("score", 5).alias("score"), "method")


def with_content(spark, folder, hits):
    return hits.join(X.chunks(spark, folder).select("chunk_id", "content", "page_number", "doc_name"), "chunk_id")


@registry.add(
    "snippets",
    f"""WITH {X.SEARCH_REQUESTS}, {bm25_sql('search_requests', 'any')} SELECT query_id, chunk_id,
      CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet
    FROM keyword_hits JOIN chunks USING (chunk_id)""",
)
def _(spark, folder):
    return Q.snippets(with_content(spark, folder, keyword_hits(spark, folder, mode="any"))).select("query_id", "chunk_id", "snippet")


@registry.add(
    "source_lists",
    f"""WITH {X.SEARCH_REQUESTS}, {bm25_sql('search_requests', 'any')} SELECT query_id, array_to_string(list_sort(list(DISTINCT doc_name)), '|') AS sources
    FROM keyword_hits JOIN chunks USING (chunk_id) GROUP BY query_id""",
)
def _(spark, folder):
    lists = Q.source_lists(with_content(spark, folder, keyword_hits(spark, folder, mode="any")))
    return lists.select("query_id", F.array_join("sources", "|").alias("sources"))


def letter_model():
    """A stand-in for a supplied model: counts of the 26 letters."""

    @pandas_udf(ArrayType(DoubleType()))
    def letter_counts(texts: pd.Series) -> pd.Series:
        letters = "abcdefghijklmnopqrstuvwxyz"
        return texts.map(lambda t: np.array([t.lower().count(c) for c in letters], dtype=float))

    return letter_counts


@registry.add(
    "embed_text",
    "SELECT doc_id, " + " || ',' || ".join(f"(length(text) - length(replace(lower(text), '{c}', '')))" for c in "abcdefghijklmnopqrstuvwxyz") + " AS counts FROM documents",
)
def _(spark, folder):
    rows = Q.embed_text(X.table(spark, folder, "documents"), letter_model(), "text", "letters")
    return rows.select("doc_id", F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",").alias("counts"))


@registry.add(
    "index_stats",
    f"""WITH {X.VECTORS}, {X.SESSIONS} SELECT s.session_id, count(v.doc_id) AS vector_count, coalesce(max(len(v.embedding)), 0)::BIGINT AS dimension, count(v.doc_id) > 0 AS index_exists
    FROM sessions s LEFT JOIN vectors v USING (session_id) GROUP BY 1""",
)
def _(spark, folder):
    return Q.index_stats(X.sessions(spark, folder), X.vectors(spark, folder)).withColumn("dimension", big("dimension"))


@registry.add(
    "search_capability_report",
    f"""WITH {SEMANTIC}, {_KEYWORD_CTES}, {X.SESSIONS},
    k AS (SELECT session_id, count(*) AS c, arg_min(chunk_id, (rank, query_id)) AS s FROM keyword_hits WHERE rank <= 3 GROUP BY 1),
    m AS (SELECT session_id, count(*) AS c, arg_min(chunk_id, (rank, query_id)) AS s FROM semantic_hits WHERE rank <= 3 GROUP BY 1),
    v AS (SELECT session_id, count(*) AS c FROM vectors GROUP BY 1)
    SELECT session_id, coalesce(v.c, 0) AS vector_count, coalesce(k.c, 0) AS keyword_count, k.s AS keyword_sample, coalesce(m.c, 0) AS semantic_count, m.s AS semantic_sample
    FROM sessions LEFT JOIN v USING (session_id) LEFT JOIN k USING (session_id) LEFT JOIN m USING (session_id)""",
)
def _(spark, folder):
    sessions = X.sessions(spark, folder)
    stats = Q.index_stats(sessions, X.vectors(spark, folder)).select("session_id", "vector_count")
    return Q.search_capability_report(
        sessions, stats,
        keyword=keyword_hits(spark, folder, mode="any", k=3), semantic=semantic_hits(spark, folder, 3),
    )


TERM_VECTORS = f"""term_counts AS (SELECT doc_id, term, count(*) AS tf FROM (
  SELECT doc_id, unnest({S.words(S.normalize('text'))}) AS term FROM corpus) GROUP BY ALL)"""


@registry.add("term_vectors", f"WITH {X.CORPUS}, {TERM_VECTORS} SELECT doc_id, term, tf, round(sqrt(sum(tf * tf) OVER (PARTITION BY doc_id)), 6) AS norm FROM term_counts")
def _(spark, folder):
    return Q.term_vectors(X.corpus(spark, folder), "doc_id", "text", ["session_id"]).select(
        "doc_id", "term", "tf", F.round("norm", 6).alias("norm")
    )


def term_search_sql(requests: str, k: int, name: str = "term_hits") -> str:
    return f"""ct AS (SELECT session_id, doc_id, chunk_id, term, count(*) AS tf FROM (
      SELECT session_id, doc_id, chunk_id, unnest({S.words(S.normalize('content'))}) AS term FROM chunks) GROUP BY ALL),
    cn AS (SELECT chunk_id, sqrt(sum(tf * tf)) AS norm FROM ct GROUP BY 1),
    qt AS (SELECT query_id, session_id, term, count(*) AS qtf FROM (SELECT query_id, session_id, unnest({S.words(S.normalize('query_text'))}) AS term FROM {requests}) GROUP BY ALL),
    qn AS (SELECT query_id, sqrt(sum(qtf * qtf)) AS qnorm FROM qt GROUP BY 1),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
      SELECT query_id, ct.session_id, doc_id, chunk_id, sum(tf * qtf) / (max(norm) * max(qnorm)) AS score
      FROM ct JOIN qt USING (session_id, term) JOIN cn USING (chunk_id) JOIN qn USING (query_id) GROUP BY ALL) QUALIFY rank <= {k})"""


@registry.add(
    "term_search",
    f"WITH {X.CHUNKS}, {X.USER_REQUESTS}, {term_search_sql('user_requests', 5)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM term_hits",
)
def _(spark, folder):
    hits = Q.term_search(X.chunks(spark, folder), X.user_requests(spark, folder))
    return hits.select("query_id", "chunk_id", big("rank").alias("rank"), F.round("score", 6).alias("score"))


def block_hits(spark, folder, asked, mode):
    return _hit_columns(B.block_search(B.build_block_index(index_for(spark, folder, asked)), asked, mode=mode))


@registry.add("keyword_search_blocks", f"WITH {X.SEARCH_REQUESTS}, {bm25_sql('search_requests', 'any')} SELECT {_HIT_COLUMNS} FROM keyword_hits")
def _(spark, folder):
    return block_hits(spark, folder, X.search_requests(spark, folder), "any")


@registry.add("keyword_search_blocks_all", f"WITH {SHORT}, {bm25_sql('short_requests', 'all')} SELECT {_HIT_COLUMNS} FROM keyword_hits")
def _(spark, folder):
    return block_hits(spark, folder, short_requests(spark, folder), "all")
