import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import block_postings as B
from quire.operators import search as Q
from quire.session import scratch_path

CHUNKS = "session_id string, doc_id long, chunk_id string, content string"
ASKED = "query_id long, session_id string, query_text string"


@pytest.fixture(scope="module")
def index(spark):
    """2,000 chunks that all hold one word, most of them in one session, with skewed other words, copies and empty texts."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(300)])
    share = 1 / np.arange(1, 301)
    rows = []
    for i in range(2000):
        text = "hot " + " ".join(rng.choice(words, rng.integers(3, 90), p=share / share.sum()))
        rows.append(("s1" if i % 5 else "s2", i, f"{i}_chunk_0", text))
    rows += [("s1", 3000 + i, f"{3000 + i}_chunk_0", rows[1][3]) for i in range(40)]
    rows += [("s1", 4000, "4000_chunk_0", ""), ("s2", 4001, "4001_chunk_0", None)]
    return Q.build_keyword_index(spark.createDataFrame(rows, CHUNKS))


@pytest.fixture(scope="module")
def blocks(index):
    return B.build_block_index(index, block_rows=8, blocks_per_salt=16)


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["hot", "hot w250", "w1 w2 w3", "w299 w280 w270", "hot hot w40 w41", "absent", "w5 absent", "", None, rare_and_common()]
    return spark.createDataFrame([(i, "s1" if i % 3 else "s2", t) for i, t in enumerate(texts)], ASKED)


def rare_and_common():
    return "w1 w2 hot w200 w210"


def rows_of(hits):
    return {
        (r["query_id"], r["session_id"], r["doc_id"], r["chunk_id"], r["rank"], round(r["score"], 9), round(r["normalized"], 6)) for r in hits.collect()
    }


@pytest.mark.parametrize("mode, k", [("any", 5), ("all", 5), ("any", 400)])
def test_hits_are_those_of_keyword_search(index, blocks, asked, mode, k):
    want = rows_of(Q.keyword_search(index, asked, k, mode))
    assert want and rows_of(B.block_search(blocks, asked, k, mode)) == want


def test_one_seed_or_many_give_the_same(index, blocks, asked):
    assert rows_of(B.block_search(blocks, asked, 3, "any", seeds=1)) == rows_of(B.block_search(blocks, asked, 3, "any", seeds=50))


def test_blocks_without_a_hit_are_not_scored(blocks, spark):
    asked = spark.createDataFrame([(0, "s1", rare_and_common()), (1, "s1", "hot w250"), (2, "s1", "hot")], ASKED)
    read = {r["query_id"]: r for r in B.postings_read(blocks, asked, 5, "any").collect()}
    assert all(r["postings_read"] <= r["postings"] for r in read.values())
    total = sum(r["postings"] for r in read.values())
    share = sum(r["postings_read"] for r in read.values()) / total
    print("share of postings scored", round(share, 3), {q: (r["postings_read"], r["postings"]) for q, r in read.items()})
    assert share < 0.5
    # the frequent word alone: short chunks score best, so blocks of long ones are never scored
    assert read[2]["postings"] > 1500 and read[2]["postings_read"] < read[2]["postings"] / 2


def test_salts_follow_the_frequency_of_a_term(blocks):
    of = {r["term"]: r["salts"] for r in blocks.terms.where("session_id = 's1'").collect()}
    filled = {r["term"]: r["count"] for r in blocks.blocks.where("session_id = 's1'").groupBy("term").count().collect()}
    assert of == {t: -(-n // 16) for t, n in filled.items()} and of["hot"] > 3 * of["w299"]
    most = blocks.blocks.groupBy("session_id", "term", "salt").count().agg(F.max("count")).first()[0]
    assert most <= 16 * 3
    # every posting is in one block, and the blocks know how many they hold
    assert blocks.blocks.agg(F.sum("rows")).first()[0] == blocks.postings.count() == blocks.terms.agg(F.sum("rows")).first()[0]


def test_stored_index(spark, index, blocks, asked):
    path = scratch_path(spark, "blocks")
    B.write_block_index(blocks, path)
    assert rows_of(B.block_search(B.read_block_index(spark, path), asked, 5, "any")) == rows_of(Q.keyword_search(index, asked, 5, "any"))


def test_empty_tables(spark, blocks, asked):
    empty = B.build_block_index(Q.build_keyword_index(spark.createDataFrame([], CHUNKS)))
    assert B.block_search(empty, asked, 5, "any").count() == 0
    assert B.block_search(blocks, spark.createDataFrame([], ASKED), 5, "all").count() == 0
    with pytest.raises(ValueError):
        B.block_search(blocks, asked, 5, "some")
