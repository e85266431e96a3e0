"""Scalar text functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import fixed_values as V
from quire.functions import headings as H
from quire.functions import text as T
from quire.operators.chunking import split_fixed
from quire.plans import fixtures as X
from quire.plans import sqltext as S
from quire.plans.registry import Registry

registry = Registry()


def docs(spark, folder):
    return X.table(spark, folder, "documents")


def big(c):
    return T.col(c).cast("bigint")


@registry.add("normalize_text", f"SELECT doc_id, {S.normalize('text')} AS normalized FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.normalize_text("text").alias("normalized"))


# Each document against the benchmark passage its id points to.
_PASSAGES = "JOIN (SELECT item_id, text AS passage, (SELECT count(*) FROM benchmark) AS n FROM benchmark) b ON d.doc_id % b.n = b.item_id"


def passages(spark, folder):
    items = X.table(spark, folder, "benchmark").select("item_id", F.col("text").alias("passage"))
    n = items.agg(F.count("*").alias("n")).scalar()
    d = docs(spark, folder).withColumn("item_id", F.col("doc_id") % n)
    return d.join(items, "item_id")


@registry.add(
    "jaccard",
    f"SELECT doc_id, round({S.jaccard_lists(S.words('d.text'), S.words('b.passage'))}, 6) AS jaccard FROM documents d {_PASSAGES}",
)
def _(spark, folder):
    return passages(spark, folder).select("doc_id", F.round(T.jaccard("text", "passage"), 6).alias("jaccard"))


@registry.add(
    "cosine",
    f"""WITH {X.VECTORS}, {X.SEARCH_REQUESTS}
    SELECT v.doc_id, m.label::BIGINT AS label,
           round(list_cosine_similarity(v.embedding::DOUBLE[], m.query_vec), 6) AS cosine
    FROM vectors v JOIN label_means m ON m.label = v.label""",
)
def _(spark, folder):
    v = X.vectors(spark, folder)
    spread = X.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = (
        spread.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .select("label", F.transform("v", lambda e: e["x"]).alias("mean_vec"))
    )
    return v.join(means, "label").select(
        "doc_id", big("label").alias("label"), F.round(T.cosine("embedding", "mean_vec"), 6).alias("cosine")
    )


@registry.add(
    "length_ratio",
    f"""SELECT doc_id, round(CASE WHEN least(length(d.text), length(b.passage)) > 0
        THEN least(length(d.text), length(b.passage))::DOUBLE / greatest(length(d.text), length(b.passage)) ELSE 0 END, 6) AS length_ratio
    FROM documents d {_PASSAGES}""",
)
def _(spark, folder):
    return passages(spark, folder).select(
        "doc_id", F.round(T.length_ratio(F.length("text"), F.length("passage")), 6).alias("length_ratio")
    )


@registry.add(
    "truncate_ellipsis",
    "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS cut FROM documents",
)
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.truncate_ellipsis("text", 400).alias("cut"))


@registry.add("truncate_sentences", f"SELECT doc_id, {S.truncate_sentences('text', 300)} AS cut FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.truncate_sentences("text", 300).alias("cut"))


@registry.add("key_sentences", f"SELECT doc_id, {S.key_sentences('text', 3)} AS sentences FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.key_sentences("text", 3).alias("sentences"))


@registry.add("dedupe_sentences", f"SELECT doc_id, {S.dedupe_sentences('text')} AS deduped FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.dedupe_sentences("text").alias("deduped"))


@registry.add(
    "fit_tokens",
    f"""SELECT doc_id, est AS tokens, CASE WHEN est <= 200 THEN text ELSE {S.truncate_sentences('text', 'target')} END AS fitted
    FROM (SELECT doc_id, text, (length(text) // 4)::BIGINT AS est,
                 floor(length(text) * (200.0::DOUBLE / greatest(length(text) // 4, 1)))::BIGINT AS target FROM documents)""",
)
def _(spark, folder):
    return docs(spark, folder).select(
        "doc_id", big(T.estimate_tokens("text")).alias("tokens"), T.fit_tokens("text", 200).alias("fitted")
    )


def _shorten_sql(x):
    fillers = S.in_list([w for w in V.FILLER_WORDS if " " not in w])
    out = f"array_to_string(list_filter({S.words(x)}, lambda f_: lower(f_) NOT IN {fillers}), ' ')"
    for long, short in V.SHORT_PHRASES:
        out = f"replace({out}, {S.quote(long)}, {S.quote(short)})"
    return out


_ASKED = "'Could you Please please explain and based on the following ' || text"


@registry.add(
    "strip_fillers",
    f"SELECT conv_id, turn, {_shorten_sql('asked')} AS task FROM (SELECT conv_id, turn, {_ASKED} AS asked FROM conversations)",
)
def _(spark, folder):
    asked = F.concat(F.lit("Could you Please please explain and based on the following "), F.col("text"))
    return X.table(spark, folder, "conversations").select("conv_id", "turn", T.strip_fillers(asked).alias("task"))


_HASH = "md5(substr({0}, 1, 1000) || '__LEN_' || length({0}))"


@registry.add(
    "content_hash",
    f"SELECT doc_id, {_HASH.format('d.text')} AS content_hash, md5({_HASH.format('d.text')} || '_' || {_HASH.format('b.passage')}) AS pair_hash FROM documents d {_PASSAGES}",
)
def _(spark, folder):
    a, b = T.content_hash("text"), T.content_hash("passage")
    return passages(spark, folder).select("doc_id", a.alias("content_hash"), T.pair_hash(a, b).alias("pair_hash"))


@registry.add("embedding_key", "SELECT md5('mini:' || text) AS embedding_key, count(*) AS n FROM documents GROUP BY 1")
def _(spark, folder):
    return docs(spark, folder).groupBy(T.embedding_key("mini", "text").alias("embedding_key")).agg(F.count("*").alias("n"))


@registry.add("content_quality", f"SELECT doc_id, round({S.content_quality('text')}, 9) AS quality FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", F.round(T.content_quality("text"), 9).alias("quality"))


@registry.add("text_properties", f"SELECT doc_id, length(text) AS length, len({S.words('text')})::BIGINT AS word_count FROM documents")
def _(spark, folder):
    p = T.text_properties("text")
    return docs(spark, folder).select("doc_id", big(p["length"]).alias("length"), big(p["word_count"]).alias("word_count"))


@registry.add(
    "display_page",
    f"WITH {X.CHUNKS} SELECT chunk_id, (chunk_index + 1)::BIGINT AS page, (greatest(0, least(chunk_index - 1, 100)) + 1)::BIGINT AS clamped FROM chunks",
)
def _(spark, folder):
    i = F.col("chunk_index")
    return X.chunks(spark, folder).select(
        "chunk_id", big(T.display_page(i)).alias("page"), big(T.display_page(i - 1, clamp=True)).alias("clamped")
    )


@registry.add(
    "clean_results",
    rf"""WITH {X.CHUNKS}, marked AS (SELECT chunk_id, CASE WHEN chunk_index % 3 = 1 THEN content || '--- Page 1 ---' ELSE content END AS content FROM chunks)
    SELECT chunk_id FROM marked WHERE {S.strip('content')} <> '' AND NOT contains(content, '--- Page')""",
)
def _(spark, folder):
    from quire.operators.search import clean_results

    marked = X.chunks(spark, folder).withColumn(
        "content", F.when(F.col("chunk_index") % 3 == 1, F.concat("content", F.lit("--- Page 1 ---"))).otherwise(F.col("content"))
    )
    return clean_results(marked).select("chunk_id")


@registry.add(
    "spoken_duration",
    rf"""SELECT conv_id, turn, (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration
    FROM (SELECT conv_id, turn, floor(len({S.words('text')}) * 0.6::DOUBLE)::BIGINT AS s FROM conversations)""",
)
def _(spark, folder):
    return X.table(spark, folder, "conversations").select("conv_id", "turn", T.spoken_duration("text").alias("duration"))


@registry.add(
    "split_fixed",
    """SELECT doc_id, i AS piece_index, substr(text, i * 500 + 1, 500) AS piece FROM
    (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 500)) AS i FROM documents WHERE length(text) > 0)""",
)
def _(spark, folder):
    return docs(spark, folder).select("doc_id", F.posexplode(split_fixed("text", 500)).alias("i", "piece")).select(
        "doc_id", big("i").alias("piece_index"), "piece"
    )


@registry.add("collapse_repeats")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.collapse_repeats("text").alias("collapsed"))


_HEAD_SQL = rf"regexp_replace(regexp_replace({S.strip('text')}, '\s+', ' ', 'g'), ':\s*$', '')"
_TITLE_SQL = rf"regexp_replace(regexp_replace({S.strip('text')}, '\s+', ' ', 'g'), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s.!?:-]+$', '', 'g')"


@registry.add("clean_heading", f"WITH {X.LINES} SELECT doc_id, line_no, {_HEAD_SQL} AS heading, {_TITLE_SQL} AS title FROM lines")
def _(spark, folder):
    return X.lines(spark, folder).select(
        "doc_id", big("line_no").alias("line_no"), T.clean_heading("text").alias("heading"), T.clean_title("text").alias("title")
    )


@registry.add(
    "numbering",
    f"""WITH {X.LINES} SELECT doc_id, line_no, {S.numbering('text', 'type')} AS type, {S.numbering('text', 'pattern')} AS pattern,
    ({S.numbering('text', 'depth')})::BIGINT AS depth FROM lines""",
)
def _(spark, folder):
    n = H.numbering("text")
    return X.lines(spark, folder).select(
        "doc_id", big("line_no").alias("line_no"), n["type"].alias("type"), n["pattern"].alias("pattern"), big(n["depth"]).alias("depth")
    )


# Model answers built from assistant turns: clean, fenced, wrapped in prose, cut short.
_SAFE = "regexp_replace(text, '[\"\\\\\n`{}]', ' ', 'g')"
_JSON_SQL = f"""'{{"summary":"' || {_SAFE} || '","sentiment_tone":"neutral"}}'"""
_ANSWERS = f"""answers AS (SELECT conv_id, turn, text, CASE turn % 4
   WHEN 1 THEN {_JSON_SQL} WHEN 3 THEN '```json' || chr(10) || {_JSON_SQL} || chr(10) || '```'
   WHEN 2 THEN 'Here is the result: ' || {_JSON_SQL} || ' Thanks.' ELSE substr({_JSON_SQL}, 1, 40) END AS answer
   FROM conversations)"""


def answers(spark, folder):
    safe = F.regexp_replace("text", '["\\\\\n`{}]', " ")
    body = F.concat(F.lit('{"summary":"'), safe, F.lit('","sentiment_tone":"neutral"}'))
    kind = F.col("turn") % 4
    return X.table(spark, folder, "conversations").withColumn(
        "answer",
        F.when(kind == 1, body)
        .when(kind == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Here is the result: "), body, F.lit(" Thanks.")))
        .otherwise(F.substring(body, 1, 40)),
    )


@registry.add(
    "parse_model_json",
    f"""WITH {_ANSWERS} SELECT conv_id, turn,
      CASE WHEN turn % 4 = 0 THEN 'Analysis of selected text: ' || substr(text, 1, 200) || '...' ELSE {_SAFE} END AS summary,
      CASE WHEN turn % 4 = 0 THEN 'analytical' ELSE 'neutral' END AS tone,
      CASE WHEN turn % 4 = 0 THEN {S.quote(V.INSIGHT_DEFAULTS['counterpoints'])} END AS counterpoints FROM answers""",
)
def _(spark, folder):
    p = T.parse_model_json("answer", "text")
    return answers(spark, folder).select(
        "conv_id", "turn", p["summary"].alias("summary"), p["sentiment_tone"].alias("tone"), p["counterpoints"].alias("counterpoints")
    )



@registry.add(
    "explode_batch_response",
    f"""SELECT conv_id, turn, i::BIGINT AS pos, CASE WHEN turn % 2 = 0 THEN CASE i WHEN 0 THEN {_SAFE} ELSE 'second' END ELSE text END AS answer
    FROM (SELECT *, unnest([0, 1]) AS i FROM conversations)""",
)
def _(spark, folder):
    safe = F.regexp_replace("text", '["\\\\\n`{}]', " ")
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('["'), safe, F.lit('","second","third"]'))).otherwise(F.col("text"))
    return (
        X.table(spark, folder, "conversations")
        .select("conv_id", "turn", F.posexplode(T.batch_answers(answer, 2)).alias("pos", "answer"))
        .withColumn("pos", big("pos"))
    )


@registry.add(
    "clean_answer",
    f"""SELECT doc_id, replace(replace(text, '**', ''), '*', '•') || chr(10) || chr(10) || 'Sources:' || chr(10) || '[1] ' || source || chr(10) || '[2] ' || lang AS answer FROM documents""",
)
def _(spark, folder):
    sources = F.array(F.concat(F.lit("[1] "), "source"), F.concat(F.lit("[2] "), "lang"))
    return docs(spark, folder).select("doc_id", T.clean_answer("text", sources).alias("answer"))


@registry.add(
    "name_terms", f"WITH {X.CORPUS} SELECT doc_id, array_to_string(list_sort({S.name_terms('doc_name')}), ' ') AS terms FROM corpus"
)
def _(spark, folder):
    return X.corpus(spark, folder).select("doc_id", F.array_join(F.array_sort(T.name_terms("doc_name")), " ").alias("terms"))


# Neighbouring documents by id, with a made-up but derived similarity.
_NEIGHBOURS = f"""WITH {X.CORPUS}, near AS (SELECT a.doc_id, a.doc_name AS a, b.doc_name AS b, (a.doc_id % 101) / 101.0::DOUBLE AS sim,
  CASE WHEN a.doc_id % 3 = 0 THEN 'highly_similar' WHEN a.doc_id % 3 = 1 THEN 'similar_to' ELSE 'related_to' END AS rel
  FROM corpus a JOIN corpus b ON b.doc_id = a.doc_id + 20)"""


def neighbours(spark, folder):
    a = X.corpus(spark, folder).select("doc_id", F.col("doc_name").alias("a"))
    b = X.corpus(spark, folder).select((F.col("doc_id") - 20).alias("doc_id"), F.col("doc_name").alias("b"))
    m = F.col("doc_id") % 3
    return (
        a.join(b, "doc_id")
        .withColumn("sim", (F.col("doc_id") % 101) / F.lit(101.0))
        .withColumn("rel", F.when(m == 0, "highly_similar").when(m == 1, "similar_to").otherwise("related_to"))
    )


@registry.add("pair_summary", f"{_NEIGHBOURS} SELECT doc_id, {S.pair_summary('a', 'b', 'sim', 'rel')} AS summary FROM near")
def _(spark, folder):
    return neighbours(spark, folder).select("doc_id", T.pair_summary("a", "b", "sim", "rel").alias("summary"))


@registry.add("relationship_text", f"{_NEIGHBOURS} SELECT doc_id, {S.relationship_text('a', 'b', 'sim')} AS sentence FROM near")
def _(spark, folder):
    return neighbours(spark, folder).select("doc_id", T.relationship_text("a", "b", "sim").alias("sentence"))


@registry.add("grade", f"SELECT doc_id, {S.grade(S.content_quality('text'))} AS grade FROM documents")
def _(spark, folder):
    return docs(spark, folder).select("doc_id", T.grade(T.content_quality("text")).alias("grade"))


@registry.add(
    "is_header_footer",
    f"""WITH {X.LINES} SELECT doc_id, line_no, {S.any_contained('lower(text)', V.RUNNING_WORDS)} AS running_words,
    {S.any_match('lower(text)', V.RUNNING_PATTERNS)} AS running_patterns, {S.any_match('text', V.FORM_FIELD_PATTERNS)} AS form_field FROM lines""",
)
def _(spark, folder):
    return X.lines(spark, folder).select(
        "doc_id", big("line_no").alias("line_no"), H.is_running_text("text").alias("running_words"),
        H.is_running_line("text").alias("running_patterns"), H.is_form_field("text").alias("form_field"),
    )


LIKELY_HEADING = rf"""(NOT (length(text) > 200 OR {S.any_match('lower(text)', V.NOT_A_HEADING_PATTERNS)}) AND
  ({S.any_contained('lower(text)', V.SECTION_WORDS)} OR {S.is_title('text')} OR {S.is_upper('text')}
   OR regexp_matches(text, '^\d+\.?\s+[\p{{L}}\p{{N}}_]+') OR len({S.words('text')}) <= 10))"""


@registry.add("is_likely_heading", f"WITH {X.LINES} SELECT doc_id, line_no, {LIKELY_HEADING} AS likely FROM lines")
def _(spark, folder):
    return X.lines(spark, folder).select("doc_id", big("line_no").alias("line_no"), H.is_likely_heading("text").alias("likely"))
