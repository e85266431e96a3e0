import random

import pytest

from quire.operators import matching as M

WORDS = "alpha alps beta betas gamma delta eps zeta eta theta".split()


def leaf(rng):
    kind = rng.randrange(4)
    words = rng.choices(WORDS, k=1 + rng.randrange(3))
    if kind == 0:
        return M.phrase(words[0].upper()), lambda t: words[0] in t
    if kind == 1:
        return M.phrase("-".join(words)), lambda t: any(t[i : i + len(words)] == words for i in range(len(t)))
    if kind == 2:
        start = words[0][: 1 + rng.randrange(4)]
        return M.prefix(start), lambda t: any(x.startswith(start) for x in t)
    d = rng.randrange(4)
    return M.near(" ".join(words), d), lambda t: any(t[i] in words and {*words} <= {*t[i : i + d + 2]} for i in range(len(t)))


def expression(rng, depth):
    if depth == 0:
        return leaf(rng)
    (a, x), (b, y) = expression(rng, rng.randrange(depth)), expression(rng, rng.randrange(depth))
    op = rng.randrange(3)
    if op == 0:
        return a & b, lambda t: x(t) and y(t)
    if op == 1:
        return a | b, lambda t: x(t) or y(t)
    return a - b, lambda t: x(t) and not y(t)


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(1)
    texts = {i: rng.choices(WORDS, k=rng.randrange(14)) for i in range(120)}
    rows = [("s" if i % 3 else "r", i, rng.choice([" ", ", ", " - "]).join(t).title()) for i, t in texts.items()]
    return texts, spark.createDataFrame(rows, "session_id string, chunk_id long, content string")


def test_nested_expressions_equal_brute_force(spark, chunks, tmp_path):
    texts, table = chunks
    M.write_positions(M.build_positions(table), str(tmp_path / "p"))
    rng = random.Random(2)
    asked = [(q, "sr"[q % 2], *expression(rng, q % 5)) for q in range(60)]
    got = {tuple(r) for r in M.match(M.read_positions(spark, str(tmp_path / "p")), M.requests(spark, [a[:3] for a in asked])).collect()}
    wanted = {(q, i) for q, s, _, plain in asked for i, t in texts.items() if ("s" if i % 3 else "r") == s and plain(t)}
    assert got == wanted and 200 < len(wanted) < 60 * 80
    assert max(len(a[2].steps) for a in asked) > 9


def test_requests_without_words_match_nothing(spark, chunks):
    positions = M.build_positions(chunks[1])
    asked = [(1, "s", M.phrase(" ,")), (2, "s", M.prefix("")), (3, "s", M.near("")), (4, "none", M.phrase("alpha")), (5, "s", M.phrase("alpha") - M.phrase(""))]
    got = M.match(positions, M.requests(spark, asked)).collect()
    assert {r["query_id"] for r in got} == {5}
    assert M.match(positions.where("false"), M.requests(spark, asked)).count() == 0
    assert M.match(positions, M.requests(spark, [])).count() == 0


def test_positions_of_asked_words_alone_give_the_same_matches(spark, chunks):
    texts, table = chunks
    rng = random.Random(4)
    asked = [(q, "sr"[q % 2], expression(rng, q % 3)[0]) for q in range(30)] + [(99, "s", M.prefix("be")), (98, "r", M.prefix("g") & M.phrase("beta"))]
    requests = M.requests(spark, asked)
    whole = M.match(M.build_positions(table), requests)
    assert {tuple(r) for r in M.match(M.build_positions(table, only_asked=requests), requests).collect()} == {tuple(r) for r in whole.collect()}
    few = M.requests(spark, [(1, "s", M.prefix("be") - M.phrase("gamma"))])
    kept = M.build_positions(table, only_asked=few).select("session_id", "term").distinct().collect()
    assert {tuple(r) for r in kept} == {("s", "beta"), ("s", "betas"), ("s", "gamma")}


def test_an_asked_batch_does_not_shuffle_the_positions(spark, chunks, tmp_path):
    M.write_positions(M.build_positions(chunks[1]), str(tmp_path / "p"))
    found = M.match(M.read_positions(spark, str(tmp_path / "p")), M.requests(spark, [(1, "s", M.prefix("be") & M.phrase("eta theta") | M.near("eps zeta"))]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [session_id" not in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "salt#" in x]
