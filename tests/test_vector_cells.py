import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import search as Q
from quire.operators import vector_cells as C

VECTOR = "session_id string, doc_id long, chunk_id long, embedding array<double>"
ASKED = "query_id long, session_id string, query_vec array<double>"


def tables(spark, kind, n=1500, dim=12):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = rng.normal(size=(20, dim))[rng.integers(0, 20, n)] + 0.05 * x
    rows = [("a" if i % 5 else "b", i, i, v.tolist()) for i, v in enumerate(x)]
    rows += [("a", 9000 + i, 9000 + i, x[1].tolist()) for i in range(60)] + [("a", 9500, 9500, [0.0] * dim), ("c", 1, 1, x[0].tolist())]
    asked = [(i, s, (x[i * 7] + 0.02 * rng.normal(size=dim)).tolist()) for i, s in enumerate("ab" * 10 + "c")] + [(50, "a", [0.0] * dim), (51, "none", [1.0] * dim)]
    return spark.createDataFrame(rows, VECTOR), spark.createDataFrame(asked, ASKED)


@pytest.mark.parametrize("kind, part", [("clustered", 0.5), ("uniform", 1.0)])
def test_cells_give_the_exact_hits(spark, tmp_path, kind, part):
    vectors, asked = tables(spark, kind)
    index = C.build_cells(vectors, tile_rows=50)
    C.write_cells(index, str(tmp_path / "cells"))
    hits, reads = C.nearest_in_cells(C.read_cells(spark, str(tmp_path / "cells")), asked, 6)
    columns = ["query_id", "rank", "chunk_id", "doc_id", "session_id", F.round("score", 9).alias("score")]
    assert sorted(map(tuple, hits.select(*columns).collect())) == sorted(map(tuple, Q.semantic_search(vectors, asked, 6).select(*columns).collect()))
    all_rows = asked.join(vectors.groupBy("session_id").count(), "session_id").where("query_id < 50").agg(F.sum("count")).first()[0]
    read = reads.where("query_id < 50").agg(F.sum("rows")).first()[0]
    print(kind, read, all_rows)
    assert 0 < read <= part * all_rows


def test_cells_hold_their_members(spark):
    vectors, _ = tables(spark, "clustered", 400)
    index = C.build_cells(vectors, per_cell=30, tile_rows=40)
    joined = index.rows.join(index.cells, ["session_id", "cell"]).collect()
    assert len(joined) == vectors.count()
    for r in joined:
        x, c = np.array(r["embedding"]), np.array(r["centre"])
        if x.any():
            assert np.arccos(min(1, x @ c / np.linalg.norm(x) / np.linalg.norm(c))) <= r["radius"] + 1e-7
        assert r["part"] < r["parts"]


def test_empty_tables(spark):
    vectors, asked = tables(spark, "uniform", 160)
    hits, reads = C.nearest_in_cells(C.build_cells(vectors.where("false")), asked, 3)
    assert hits.count() == 0 and reads.count() == 0
    hits, reads = C.nearest_in_cells(C.build_cells(vectors), asked.where("false"), 3)
    assert hits.count() == 0 and reads.count() == 0
