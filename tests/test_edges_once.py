import pytest

from quire.operators import similarity as H
from quire.plans import graph_queries as Q
from quire.plans.registry import all_queries

ONCE = ["classify_edges", "degree_centrality", "connected_components", "graph_type_counts", "most_connected", "neighbors", "document_neighbors", "pair_context", "community_context"]


@pytest.mark.parametrize("name", ONCE)
def test_edges_that_are_read_once_are_compared_once_and_not_stored(spark, monkeypatch, name):
    monkeypatch.setattr(Q, "_stored", {})
    edges = spark.createDataFrame([("s", 1, 2, "a_long", "b_long", 1, 1, 0.9, "highly_similar", 0.9, "said")], "session_id string, src long, dst long, src_label string, dst_label string, src_copies long, dst_copies long, similarity double, relationship string, weight double, summary string")
    compared = spark.sparkContext.accumulator(0)

    def watched(batches):
        compared.add(1)
        yield from batches

    monkeypatch.setattr(H, "build_edges", lambda *_: edges.coalesce(1).mapInArrow(watched, edges.schema))
    all_queries()[name][0](spark, "/root/testdata/sf0.001").collect()
    assert compared.value == 1 and not any(len(k) == 2 and k[1] == "edges" for k in Q._stored)
