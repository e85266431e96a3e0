import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import search as Q
from quire.operators.stemming import porter_stem


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "nothing here", "cat cat cat", "Élan vital"]
    # one session holds most rows
    rows = [("s1" if i < 5 else "s2", i, f"{i}_chunk_0", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "session_id string, doc_id long, chunk_id string, content string")


def ask(spark, *texts, session="s1"):
    return spark.createDataFrame([(i, session, t) for i, t in enumerate(texts)], "query_id long, session_id string, query_text string")


def test_bm25_by_hand(spark, chunks):
    hits = Q.keyword_search(Q.build_keyword_index(chunks), ask(spark, "cat"), 5).orderBy("rank").collect()
    idf = max(math.log((6 - 3 + 0.5) / (3 + 0.5)), 1e-6)
    mean = (6 + 3 + 5 + 2 + 3 + 2) / 6
    want = {"0_chunk_0": (1, 6), "2_chunk_0": (1, 5), "4_chunk_0": (3, 3)}
    for h in hits:
        tf, n = want[h["chunk_id"]]
        assert h["score"] == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)))
    assert [h["chunk_id"] for h in hits] == ["4_chunk_0", "2_chunk_0", "0_chunk_0"]
    assert hits[0]["normalized"] == 1.0 and hits[-1]["normalized"] == 0.0


def test_salts_do_not_change_scores(spark, chunks):
    index, asked = Q.build_keyword_index(chunks), ask(spark, "cat dog", "the sat")
    one = {tuple(r) for r in Q.keyword_scores(index, asked, "any", salts=1).withColumn("score", F.round("score", 9)).collect()}
    many = {tuple(r) for r in Q.keyword_scores(index, asked, "any", salts=7).withColumn("score", F.round("score", 9)).collect()}
    assert one == many and one


def test_modes(spark, chunks):
    index = Q.build_keyword_index(chunks)

    def ids(rows):
        return sorted(r["chunk_id"][0] for r in rows.collect())

    assert ids(Q.match_terms(index, ask(spark, "cat dog"), "all")) == ["2"]
    assert ids(Q.match_terms(index, ask(spark, "cat dog"), "any")) == ["0", "1", "2", "4"]
    assert ids(Q.match_without(index, ask(spark, "cat"), ask(spark, "dog"))) == ["0", "4"]
    assert ids(Q.match_phrase(chunks, ask(spark, "sat on"))) == ["0"]
    assert ids(Q.match_phrase(chunks, ask(spark, "on sat"))) == []
    prefixes = spark.createDataFrame([(0, "s1", "do")], "query_id long, session_id string, prefix string")
    assert ids(Q.match_prefix(index, prefixes)) == ["1", "2"]
    assert ids(Q.match_terms(index, ask(spark, "elan", session="s2"))) == ["5"]


def test_tiles_are_exact(spark):
    rng = np.random.default_rng(3)
    # two of three vectors sit in one session, with copies among them
    v = rng.normal(size=(60, 5))
    v[30:40] = v[0]
    rows = [("hot" if i % 3 else f"s{i % 4}", i, f"{i:03d}", v[i].tolist()) for i in range(60)]
    vectors = spark.createDataFrame(rows, "session_id string, doc_id long, chunk_id string, embedding array<double>")
    q = rng.normal(size=(7, 5))
    asked = spark.createDataFrame([(i, "hot", q[i].tolist()) for i in range(7)], "query_id long, session_id string, query_vec array<double>")
    hot = [r for r in rows if r[0] == "hot"]
    for tile in (3, 1000):
        got = {}
        for r in Q.semantic_search(vectors, asked, 6, tile_rows=tile).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        for i in range(7):
            cos = {r[2]: round(float(np.dot(q[i], r[3]) / np.linalg.norm(q[i]) / np.linalg.norm(r[3])), 9) for r in hot}
            assert got[i] == sorted(cos, key=lambda c: (-cos[c], c))[:6]


def test_hybrid(spark):
    cols = "query_id long, session_id string, doc_id long, chunk_id string, score double"
    semantic = spark.createDataFrame([(1, "s", 1, "a", 0.9), (1, "s", 2, "b", 0.5), (1, "s", 3, "c", 0.1)], cols)
    keyword = spark.createDataFrame([(1, "s", 3, "c", 7.0), (1, "s", 4, "d", 3.0)], cols)
    hits = Q.hybrid_search(semantic, keyword, 10).orderBy("rank").collect()
    assert [(h["chunk_id"], h["source_type"]) for h in hits] == [("a", "semantic"), ("c", "both"), ("b", "semantic"), ("d", "keyword")]
    only = Q.hybrid_search(semantic, keyword, 3, weight=1.0).orderBy("rank").collect()
    assert [h["chunk_id"] for h in only] == ["a", "b", "c"]
    few = Q.hybrid_search(semantic, keyword, 2).orderBy("rank").collect()
    assert [h["chunk_id"] for h in few] == ["a", "c"]


@pytest.mark.parametrize(
    "word, stem",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"),
        ("hopefulness", "hope"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"),
    ],
)
def test_porter(word, stem):
    assert porter_stem(word) == stem


def test_term_search_tiles_pass_on_only_the_best(spark):
    """Tiles of a few rows, copies and repeated questions: the hits of brute force, and no row per pair of chunk and question."""
    rng = np.random.default_rng(11)
    words = [a + b + c for a in "bcd" for b in "aeiou" for c in "klmn"]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 12))) for _ in range(60)]
    texts[20:40] = [texts[20]] * 20
    chunks = spark.createDataFrame([("hot" if i % 4 else "cold", i, f"{i}_chunk_0", t) for i, t in enumerate(texts)], "session_id string, doc_id long, chunk_id string, content string")
    asked = [" ".join(rng.choice(words, size=6)) for _ in range(9)] + [texts[20], "zzz", ""]
    asked += [asked[0]]
    queries = spark.createDataFrame([(i, "hot", t) for i, t in enumerate(asked)], "query_id long, session_id string, query_text string")

    def counts(text):
        return {w: text.split().count(w) for w in set(text.split())}

    want = []
    for q, text in enumerate(asked):
        a, scored = counts(text), []
        for i, t in enumerate(texts):
            b = counts(t)
            dot = sum(n * b.get(w, 0) for w, n in a.items())
            if i % 4 and dot:
                scored.append((-round(dot / math.sqrt(sum(n * n for n in b.values())) / math.sqrt(sum(n * n for n in a.values())), 9), f"{i}_chunk_0"))
        want += [(q, r + 1, c) for r, (_, c) in enumerate(sorted(scored)[:3])]
    for sizes in ((7, 4), (8192, 4096)):
        got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in Q.term_search(chunks, queries, 3, *sizes).collect())
        assert got == want
    questions = Q.term_questions(queries)
    assert questions.select("question").distinct().count() == 11
    passed = Q.term_scores(chunks, questions, 1).groupBy("question").count().collect()
    assert max(r["count"] for r in passed) == 1


def test_texts_are_dealt_before_terms(spark, chunks):
    """No row per term is shuffled to count the postings of a chunk, and rows of a repeated chunk are still counted together."""
    twice = chunks.unionByName(chunks.where("doc_id = 0"))
    postings = Q.build_keyword_index(twice).postings
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "term" in line]
    assert postings.where("doc_id = 0 and term = 'the'").select("tf").collect()[0]["tf"] == 4


def test_stored_frequencies_keep_the_session_names(spark, chunks, tmp_path):
    renamed = chunks.withColumn("session_id", F.when(F.col("session_id") == "s1", "007").otherwise("12"))
    Q.write_keyword_index(Q.build_keyword_index(renamed), str(tmp_path))
    stored = spark.read.schema("term string, df long, session_id string").parquet(f"{tmp_path}/terms")
    assert {(r["session_id"], r["df"]) for r in stored.where("term in ('cat', 'vital')").collect()} == {("007", 3), ("12", 1)}


def _exchanges(rows):
    plan = rows._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line], plan


def test_term_search_moves_a_text_once_by_tile_and_not_by_session(spark):
    chunks = spark.createDataFrame([("s", i % 9, f"c{i}", f"stone river {'light ' * (i % 4)}") for i in range(60)], "session_id string, doc_id long, chunk_id string, content string")
    asked = spark.createDataFrame([(q, "s", "river light" if q % 2 else "stone harbour") for q in range(30)], "query_id long, session_id string, query_text string")
    scores = Q.term_scores(chunks, Q.term_questions(asked), 3, chunk_rows=16, question_rows=1)
    moved, _ = _exchanges(scores)
    assert moved and all("ctile" in line and "qtile" in line for line in moved if "question" not in line)
    small = {tuple(r) for r in Q.term_search(chunks, asked, 3, chunk_rows=16, question_rows=1).select("query_id", "chunk_id", "rank").collect()}
    assert small == {tuple(r) for r in Q.term_search(chunks, asked, 3).select("query_id", "chunk_id", "rank").collect()} and len(small) == 90


def test_a_persona_report_searches_once(spark):
    from quire.plans import persona_queries as R

    _, plan = _exchanges(R.metrics(spark, "/root/testdata/sf0.001"))
    assert "FlatMapCoGroupsInArrow" not in plan


def test_documents_are_gathered_once_for_semantic_selection(spark):
    from quire.operators import selection as G

    chunks = spark.createDataFrame([("s", i // 4, f"d{i // 4}", f"c{i}", i % 4, 0, f"stone river {i % 3}") for i in range(40)], "session_id string, doc_id long, doc_name string, chunk_id string, chunk_index int, page_number int, content string")
    probes = spark.createDataFrame([("s", "river stones")], "session_id string, query_text string")
    chosen = G.select_semantic(chunks, probes)
    moved, _ = _exchanges(chosen)
    assert moved and not any("doc_name" in line for line in moved)
    assert chosen.count() == 10
