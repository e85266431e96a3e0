import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graph as GR
from quire.operators import similarity as H

STOP = set(H.V.STOPWORDS)


@pytest.fixture(scope="module")
def small(spark):
    # a path of four, a triangle, a star of five and one node alone, as one session
    links = [(1, 2), (2, 3), (3, 4), (11, 12), (12, 13), (11, 13), (21, 22), (21, 23), (21, 24), (21, 25)]
    edges = spark.createDataFrame([("s", a, b, "related_to", 1.0, 1, 1) for a, b in links], "session_id string, src long, dst long, relationship string, weight double, src_copies long, dst_copies long")
    ids = sorted({x for e in links for x in e} | {99})
    nodes = spark.createDataFrame([("s", i, f"doc{i}", "document", 1) for i in ids], "session_id string, id long, label string, type string, copies long")
    return nodes, edges, ids, links


def values(df, name):
    return {r["node"]: r[name] for r in df.collect()}


def test_centralities(spark, small):
    nodes, edges, ids, links = small
    n = len(ids)
    paths = GR.shortest_paths(edges)
    dist = {(r["source"], r["node"]): r["dist"] for r in paths.collect()}
    assert dist[(1, 4)] == 3.0 and (1, 11) not in dist
    degree = values(GR.degree_centrality(nodes, edges), "degree")
    assert degree[21] == pytest.approx(4 / (n - 1)) and degree[99] == 0.0
    close = values(GR.closeness_centrality(nodes, paths), "closeness")
    assert close[1] == pytest.approx((3 / 6) * (3 / (n - 1))) and close[99] == 0.0
    between = values(GR.betweenness_centrality(nodes, edges, paths), "betweenness")
    scale = 2 / ((n - 1) * (n - 2))
    assert between[2] == pytest.approx(2 * scale) and between[21] == pytest.approx(6 * scale)
    assert between[11] == 0.0 and between[1] == 0.0


def test_betweenness_splits_equal_paths(spark):
    # a square: two shortest paths between opposite corners
    edges = spark.createDataFrame([("s", a, b, 1.0) for a, b in [(1, 2), (2, 3), (3, 4), (1, 4)]], "session_id string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("s", i) for i in range(1, 5)], "session_id string, id long")
    between = values(GR.betweenness_centrality(nodes, edges, GR.shortest_paths(edges)), "betweenness")
    assert all(b == pytest.approx(0.5 * 2 / 6) for b in between.values())


def test_eigenvector(spark, small):
    nodes, edges, ids, links = small
    got = values(GR.eigenvector_centrality(nodes, edges), "eigenvector")
    a = np.eye(len(ids))
    for x, y in links:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1.0
    v = np.ones(len(ids))
    for _ in range(500):
        v = a @ v
        v /= np.linalg.norm(v)
    assert sum(x * x for x in got.values()) == pytest.approx(1.0)
    assert [got[i] for i in ids] == pytest.approx(list(v), abs=1e-3)


def test_components_and_communities(spark, small):
    nodes, edges, ids, _ = small
    parts = values(GR.connected_components(nodes, edges), "component")
    assert parts == {i: 1 if i < 10 else 11 if i < 20 else 21 if i < 30 else 99 for i in ids}
    chain = spark.createDataFrame([("s", i, i + 1, 1.0) for i in range(40)], "session_id string, src long, dst long, weight double")
    chain_nodes = spark.createDataFrame([("s", i) for i in range(41)], "session_id string, id long")
    assert set(values(GR.connected_components(chain_nodes, chain), "component").values()) == {0}
    found = GR.communities(nodes, edges)
    rows = found.collect()
    assert sorted(r["node"] for r in rows) == ids
    assert -0.5 <= rows[0]["modularity"] <= 1
    alone = GR.modularity(edges, nodes.select("session_id", F.col("id").alias("node"), F.col("id").alias("community"))).first()["modularity"]
    assert rows[0]["modularity"] > alone
    of = {r["node"]: r["community"] for r in rows}
    assert of[11] == of[12] == of[13]


def brute_pairs(docs, floor):
    kept, seen = [], {}
    for i, t in docs:
        ws = tuple(w for w in t.lower().split() if w not in STOP and len(w) > 2)
        if ws not in seen:
            seen[ws] = i
            kept.append((i, ws))
    out = {}
    for (i, a), (j, b) in itertools.combinations(kept, 2):
        ca, cb = Counter(a), Counter(b)
        if not a or not b:
            continue
        cos = sum(ca[w] * cb[w] for w in ca) / (sum(x * x for x in ca.values()) * sum(x * x for x in cb.values())) ** 0.5
        jac = len(set(a) & set(b)) / len(set(a) | set(b))
        la, lb = len(" ".join(a)), len(" ".join(b))
        s = 0.6 * cos + 0.3 * jac + 0.1 * min(la, lb) / max(la, lb)
        if s >= floor:
            out[(i, j)] = round(s, 6)
    return out


@pytest.mark.parametrize("floor, tile", [(0.35, 1024), (0.6, 4), (0.8, 4), (0.15, 8)])
def test_pairs_match_brute_force(spark, floor, tile):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}word" for a in "abcdefg" for b in "hijk"]
    docs = [(i, " ".join(rng.choice(vocabulary[: rng.choice([4, 28])]) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    docs += [(100 + i, docs[0][1]) for i in range(25)] + [(200, "")]  # many copies of one text
    rows = spark.createDataFrame([("s", i, f"name {i}.pdf", t) for i, t in docs], "session_id string, doc_id long, doc_name string, content string")
    nodes = H.distinct_texts(rows)
    got = {(r["src"], r["dst"]): round(r["similarity"], 6) for r in H.pair_similarity(nodes, floor, tile).collect()}
    assert got == brute_pairs(docs, floor) and got
    members = {r["doc_id"]: r["node_id"] for r in H.copy_members(rows).collect()}
    assert all(members[100 + i] == 0 for i in range(25))


def test_user_threshold_only_raises():
    assert H.related_threshold(0.1) == 0.4 and H.related_threshold(0.55) == 0.55 and H.related_threshold(None) == 0.4


def test_tiles_of_dense_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(30, 4))
    vectors = spark.createDataFrame([("s", i, v[i].tolist()) for i in range(30)], "session_id string, doc_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j): round(float(u[i] @ u[j]), 6) for i in range(30) for j in range(i + 1, 30) if u[i] @ u[j] >= 0.1}
    for tile in (4, 1000):
        got = {(r["src"], r["dst"]): round(r["cosine"], 6) for r in H.pair_cosine(vectors, tile_rows=tile).collect()}
        assert got == want
        s = H.similarity_stats(vectors, tile_rows=tile).first()
        assert s["pairs"] == 435 and s["mean"] == pytest.approx(sum(want.values()) / 435, abs=1e-5) and s["min"] == 0.0


def test_no_node_gains_by_moving_once_a_level_has_settled(spark):
    rng = random.Random(11)
    links = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)})
    weights = {e: 1.0 + rng.randrange(3) for e in links}
    rows = [(1.0, a, b, w) for (x, y), w in weights.items() for a, b in ((x, y), (y, x))]
    ways = spark.createDataFrame([("s", *r) for r in rows], "session_id string, resolution double, node long, peer long, weight double")
    of = {r["node"]: r["community"] for r in GR._local_moves(ways).collect()}
    strength = Counter()
    for _, a, _, w in rows:
        strength[a] += w
    total = sum(strength.values())

    def gain(node, target):
        mass = sum(k for n, k in strength.items() if of[n] == target and n != node)
        return sum(w for _, a, b, w in rows if a == node and b != node and of[b] == target) - strength[node] * mass / total

    assert all(gain(n, t) <= gain(n, of[n]) + 1e-6 for n in of for t in set(of.values()))


def test_measures_of_chosen_sources(spark, small):
    nodes, edges, ids, _ = small
    few = spark.createDataFrame([("s", 2), ("s", 3)], "session_id string, node long")
    whole = values(GR.closeness_centrality(nodes, GR.shortest_paths(edges)), "closeness")
    paths = GR.shortest_paths(edges, sources=few)
    part = values(GR.closeness_centrality(nodes, paths, few), "closeness")
    assert {i: v for i, v in part.items() if v is not None} == {i: whole[i] for i in (2, 3)}
    once = values(GR.betweenness_centrality(nodes, edges, paths), "betweenness")
    scaled = values(GR.betweenness_centrality(nodes, edges, paths, sources=few), "betweenness")
    assert scaled == pytest.approx({i: v * len(ids) / 2 for i, v in once.items()})


def test_sparse_products_of_rare_and_common_terms(monkeypatch):
    rng = np.random.default_rng(2)
    tables = []
    for n in (40, 25):
        rows = []
        for i in range(n):
            terms = np.unique(np.r_[rng.integers(0, 5, 4), rng.integers(5, 4000, 60)])
            rows.append({"id": i, "term_ids": terms.tolist(), "tfs": rng.integers(1, 9, len(terms)).astype(float).tolist(), "norm": 1.0, "terms": len(terms), "chars": 9})
        tables.append(H.pa.Table.from_pylist(rows))
    dense = []
    for t in tables:
        m = np.zeros((t.num_rows, 4000))
        for i, r in enumerate(t.to_pylist()):
            m[i, r["term_ids"]] = r["tfs"]
        dense.append(m)
    for part, columns, pairs in ((256, 2048, 1 << 22), (1, 3, 50), (10**9, 7, 1)):
        monkeypatch.setattr(H, "DENSE_PART", part)
        monkeypatch.setattr(H, "DENSE_TERMS", columns)
        monkeypatch.setattr(H, "SPARSE_PAIRS", pairs)
        dot, common = H.sparse_product(*(H._Counts(t) for t in tables))
        assert np.array_equal(dot, dense[0] @ dense[1].T)
        assert np.array_equal(common, (dense[0] > 0).astype(int) @ (dense[1] > 0).astype(int).T)


def test_blocks_of_other_lengths_are_not_compared(spark):
    words = ["".join(chr(97 + int(d)) for d in f"{i:04d}") + "word" for i in range(4000)]
    rng = random.Random(3)
    docs = [(i, " ".join(rng.sample(words, 3000))) for i in range(4)] + [(10 + i, " ".join(words[i * 3 : i * 3 + 5])) for i in range(40)]
    rows = spark.createDataFrame([("s", i, f"name {i}.pdf", t) for i, t in docs], "session_id string, doc_id long, doc_name string, content string")
    blocked = H.blocks_of(H.term_counts(H.distinct_texts(rows)), 8)
    pairs = H.block_pairs(blocked, 0.35).collect()
    n = blocked.select("block").distinct().count()
    assert 0 < len(pairs) < n * (n + 1) // 2
    long = {r["block"] for r in blocked.where("id < 10").select("block").distinct().collect()}
    assert not any((r["a"] in long) != (r["b"] in long) for r in pairs)


def test_communities_are_split_into_connected_parts(spark):
    # 0-1-2 and 3-4 are called one community, though no link runs between them; 5 and 6 are another
    ways = [(0, 1), (1, 2), (3, 4), (2, 5), (3, 6), (5, 6)]
    rows = [("s", r, a, b, 1.0) for r in (0.5, 1.0) for x, y in ways for a, b in ((x, y), (y, x))]
    links = spark.createDataFrame(rows, "session_id string, resolution double, node long, peer long, weight double")
    level = spark.createDataFrame([("s", r, n, 3 if n < 5 else 6) for r in (0.5, 1.0) for n in range(7)], "session_id string, resolution double, node long, community long")
    parts = GR._connected_parts(links, level)
    want = {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}
    assert {(r["resolution"], r["node"]): r["community"] for r in parts.collect()} == {(r, n): c for r in (0.5, 1.0) for n, c in want.items()}
    edges = spark.createDataFrame([("s", x, y, 1.0) for x, y in ways], "session_id string, src long, dst long, weight double")
    before, after = (GR.modularity(edges, p.where("resolution = 1.0")).first()["modularity"] for p in (level, parts))
    assert after > before


def test_blocks_travel_in_units(spark, monkeypatch):
    """A node is shipped once per unit that it is compared with, not once per block, and the pairs stay the same."""
    monkeypatch.setattr(H, "UNITS", 2)
    rng = np.random.default_rng(5)
    words = [a + b + c for a in "bcd" for b in "aeiou" for c in "klmn"]
    rows = [("s", i, f"name {i}", " ".join(rng.choice(words, size=16))) for i in range(64)]
    nodes = H.distinct_texts(spark.createDataFrame(rows, "session_id string, doc_id long, doc_name string, content string"))
    whole = {(r["src"], r["dst"], round(r["similarity"], 9)) for r in H.pair_similarity(nodes, 0.35).collect()}
    parts = {(r["src"], r["dst"], round(r["similarity"], 9)) for r in H.pair_similarity(nodes, 0.35, 4).collect()}
    assert whole == parts and whole
    blocked = H.blocks_of(H.term_counts(nodes), 4)
    units = H.units_of(blocked)
    assert blocked.select("block").distinct().count() > 8 and units.select("unit").distinct().count() <= 3


def test_small_tiles_of_sums_travel_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([("s", i, rng.normal(size=4).tolist()) for i in range(90)], "session_id string, doc_id long, embedding array<double>")
    shipped = []
    pairs = H._tile_pairs
    monkeypatch.setattr(H, "_tile_pairs", lambda *a: shipped.append(pairs(*a)) or shipped[-1])
    one = H.similarity_stats(vectors, tile_rows=90).first()
    many = H.similarity_stats(vectors, tile_rows=4).first()
    assert one["pairs"] == many["pairs"] == 90 * 89 // 2 and one["mean"] == pytest.approx(many["mean"]) and (one["max"], one["min"]) == pytest.approx((many["max"], many["min"]))
    assert shipped[1].count() == 90
    monkeypatch.setattr(H, "SHIPPED_ROWS", 16)
    blocks = H.similarity_stats(vectors, tile_rows=4).first()
    assert blocks["pairs"] == one["pairs"] and blocks["mean"] == pytest.approx(one["mean"])
