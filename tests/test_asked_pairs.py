import random

from pyspark.sql import functions as F

from quire.operators import similarity as H


def test_edges_of_asked_pairs_are_those_of_the_graph(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    docs = [("s" if i < 30 else "t", i, f"name {i} of it", " ".join(rng.choices(words, k=rng.randrange(3, 60)))) for i in range(45)] + [("s", 90, "empty one", "")]
    nodes = H.distinct_texts(spark.createDataFrame(docs, "session_id string, doc_id long, doc_name string, content string")).localCheckpoint()
    # either order, twice, itself, another session's, one that isn't there
    pairs = [("s", a, b) for a in range(30) for b in range(30) if (a + b) % 3 == 0] + [("t", 30, 41), ("t", 41, 30), ("s", 1, 31), ("s", 2, 77), ("s", 90, 1)]
    asked = spark.createDataFrame(pairs, "session_id string, a long, b long")
    keys = {(s, min(a, b), max(a, b)) for s, a, b in pairs}
    columns = ["session_id", "src", "dst", "src_label", "dst_label", "src_copies", "dst_copies", "relationship", "summary", F.round("weight", 9).alias("weight")]
    got = {tuple(r) for r in H.edges_of_pairs(nodes, asked).select(columns).collect()}
    assert got == {tuple(r) for r in H.build_edges(nodes).select(columns).collect() if tuple(r)[:3] in keys} and got


def test_lookup_builds_no_graph(spark, monkeypatch):
    from quire.plans.registry import all_queries

    def no(*_, **__):
        raise AssertionError("all pairs are compared")

    monkeypatch.setattr(H, "pair_similarity", no)
    for name in ("edge_lookup", "document_edge_lookup"):
        all_queries()[name][0](spark, "/root/testdata/sf0.001").collect()
