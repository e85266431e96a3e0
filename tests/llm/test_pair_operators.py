"""Operators on pairs, against all pairs of small tables."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from quire.llm import decontaminate, neardup, vectors
from quire.llm.common import components, shingle_hashes, word_hashes


def classes_of(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 40)] + [(3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(20, 40)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Near-duplicates of texts


def shingles(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_links(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    return [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def edited(rng, words, share):
    return [rng.choice(["new", "odd", f"w{rng.random():.6f}".replace(".", "")]) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("tile", [256, 8])
def test_near_duplicates_equal_all_pairs(spark, tile):
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(4000)]
    texts, n = {}, 0
    for size in (300, 60, 60, 30):
        base = rng.choices(pool, k=size)
        for k in range(30):
            texts[n] = " ".join(edited(rng, base, 0.012 if k % 3 else 0.03))
            n += 1
    for _ in range(40):
        texts[n] = " ".join(rng.choices(pool, k=80))
        n += 1
    same = " ".join(rng.choices(pool, k=50))
    for variant in (same, same.upper(), same + "!!", "a b", "A, b.", "", None, " . ", "word " * 3000):
        texts[n] = variant
        n += 1
    rows = [(k, t, 1, "x") for k, t in texts.items()]
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, class_id int, band string"), tile=tile).collect()}
    wanted = classes_of(texts, near_links(texts))
    assert {k: r["class_id"] for k, r in got.items()} == wanted
    assert all(r["kept"] == (k == wanted[k]) for k, r in got.items())
    assert len(set(wanted.values())) < len(wanted) - 60


def test_near_duplicates_of_repeated_and_missing_rows(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (2, "ONE two three, four five six"), (3, None), (3, None)]
    got = sorted((str(r["doc_id"]), r["class_id"], r["n_copies"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [g[:2] for g in got] == [("1", 1), ("1", 1), ("2", 1), ("3", 3), ("3", 3), ("None", None)]
    assert [g[3] for g in got] == [True, True, False, True, True, False]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_texts_of_one_id_are_linked_each_by_itself(spark):
    rng = random.Random(6)
    one, two = (rng.choices([f"w{i}" for i in range(4000)], k=60) for _ in range(2))
    near = two[:58] + ["other", "end"]
    for order in (1, -1):
        rows = [(1, " ".join(one)), (1, " ".join(two)), (3, " ".join(near)), (4, " ".join(one[:59] + ["end"])), (5, "nothing like the others at all")][::order]
        got = sorted((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
        assert got == [(1, 1), (1, 1), (3, 1), (4, 1), (5, 5)]


def repeated_lines(rng):
    """Texts of 20 lines, and near copies of them that have one or two lines 2 to 100 times."""
    pool, texts = [f"w{i}" for i in range(4000)], []
    for times in (2, 3, 5, 10, 20, 41, 70, 100):
        for _ in range(12):
            lines = [" ".join(rng.choices(pool, k=10)) for _ in range(20)]
            texts += [" ".join(lines), " ".join(lines[:3] + [lines[3]] * times + lines[4:]), " ".join([lines[0]] * 7 + lines[1:9] + [lines[9]] * times + lines[10:])]
    return dict(enumerate(texts))


def test_near_duplicates_of_repeated_lines_equal_all_pairs(spark):
    texts = repeated_lines(random.Random(21))
    links = near_links(texts)
    assert len(links) > 250
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == classes_of(texts, links)


def test_bands_cover_the_jaccard_of_sets():
    texts = repeated_lines(random.Random(22)) | {1000: "a b c d e f", 1001: "", 1002: "word " * 30}
    hashes, ends = shingle_hashes(*word_hashes(list(texts.values())), 5)
    keys, at = neardup.all_bands(hashes, ends, neardup.BANDS, neardup.ROWS)
    sets = {k: set(keys[a:b].tolist()) for k, a, b in zip(texts, at, at[1:])}
    assert all(len(sets[k]) == b - a for k, a, b in zip(texts, at, at[1:]))
    assert len(sets[0]) == len(sets[1000]) == len(sets[1002]) == neardup.BANDS
    weighted = neardup.band_keys(neardup.signatures(*neardup.weighted(hashes, ends), len(texts), neardup.BANDS * neardup.ROWS), neardup.BANDS, neardup.ROWS)
    by_count = {k: set(row.tolist()) for k, row in zip(texts, weighted)}
    assert all(by_count[k] <= sets[k] for k in texts)
    links = near_links(texts)
    assert sum(not by_count[a] & by_count[b] for a, b in links) > 20
    assert all(sets[a] & sets[b] for a, b in links)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(10)
    a = rng.integers(0, 1 << 60, 400).astype(np.uint64)
    sets = [np.sort(a[:300]), np.sort(a[60:360])]
    text = np.repeat([0, 1], 300)
    s = neardup.signatures(text, np.concatenate(sets), np.full(600, 1 / 300), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.05
    weights = np.concatenate([np.full(300, 1 / 300), rng.exponential(size=300)])
    weights[300:] /= weights[300:].sum()
    order = {x: i for i, x in enumerate(np.concatenate(sets[1:]))}
    x = {v: 1 / 300 for v in sets[0]}
    y = {v: weights[300 + order[v]] for v in sets[1]}
    wanted = sum(1 / sum(max(x.get(w, 0) / x[v], y.get(w, 0) / y[v]) for w in {*x, *y}) for v in x if v in y)
    s = neardup.signatures(text, np.concatenate(sets), weights, 2, 4000)
    assert abs((s[0] == s[1]).mean() - wanted) < 0.04


# Decontamination


def plain_tiles(doc, item, least):
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    least = min(least, len(item))
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and free_d[i + k] and free_i[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return sum(t[0] for t in tiles) / len(item)
        tiles.append(best)
        for k in range(best[0]):
            free_d[best[1] + k] = free_i[best[2] + k] = False


def test_contamination_equals_plain_tiling(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(60)]
    items = {i: rng.choices(pool, k=rng.choice([2, 3, 12, 20])) for i in range(12)} | {12: [], 13: ["w1"] * 9}
    docs = {}
    for d in range(60):
        words = rng.choices(pool, k=rng.randint(0, 30))
        part = list(items[d % 14])
        if d % 3 == 0 and len(part) > 6:  # halves changed over
            part = part[len(part) // 2 :] + ["zz"] + part[: len(part) // 2]
        elif d % 3 == 1:
            part = edited(rng, part, 0.15)
        docs[d] = words[:10] + part + words[10:]
    frame = spark.createDataFrame([(d, " ".join(w), "x") for d, w in docs.items()] + [(None, "w1 w2", None), (99, None, None)], "doc_id bigint, text string, seed string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(None, "w1 w2"), (77, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(frame, bench).collect()}
    wanted = {(d, i): plain_tiles(w, it, decontaminate.LEAST) for d, w in docs.items() for i, it in items.items() if it}
    assert got == pytest.approx({k: v for k, v in wanted.items() if v >= decontaminate.COVERAGE})
    assert any(0.6 <= v < 1 for v in got.values())


def test_contamination_of_nothing(spark):
    none, some = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a b c d e")], "doc_id bigint, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(some, items.where("false")).count() == 0
    assert decontaminate.contaminated(some.union(some), items).count() == 1


def test_texts_of_one_id_are_not_joined(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta")], "item_id bigint, text string")
    halves = [(5, "alpha beta gamma delta x"), (5, "y epsilon zeta eta theta")]
    got = decontaminate.contaminated(spark.createDataFrame(halves, "doc_id bigint, text string"), item).collect()
    assert [(r["doc_id"], r["coverage"], r["longest"]) for r in got] == [(5, 0.5, 4)]
    assert decontaminate.contaminated(spark.createDataFrame(halves, "doc_id bigint, text string"), item, coverage=0.6).count() == 0
    whole = halves + [(5, "alpha beta gamma delta epsilon zeta eta theta"), (6, halves[0][1])]
    got = decontaminate.contaminated(spark.createDataFrame(whole, "doc_id bigint, text string"), item).collect()
    assert sorted((r["doc_id"], r["coverage"], r["n_tiles"]) for r in got) == [(5, 1.0, 1), (6, 0.5, 1)]


# Vectors


@pytest.mark.parametrize("per_pivot, tile", [(4096, 4096), (40, 16)])
def test_vectors_equal_all_pairs(spark, per_pivot, tile):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), (centres[i % 12] + 0.25 * rng.normal(size=8)).tolist()) for i in range(240)]
    rows += [(500 + i, rows[0][1]) for i in range(5)] + [(600, None), (601, [0.0] * 8), (602, [1.0, None] + [0.0] * 6), (603, [float("nan")] + [1.0] * 7), (604, [float("inf")] + [1.0] * 7), (605, []), (606, [1.0, 2.0]), (607, [2.0, 4.0]), (608, [1e200, 1e-200]), (609, [-1.0] * 8)]
    got = {r["vec_id"]: r for r in vectors.link_vectors(spark.createDataFrame([(*r, 3) for r in rows], "vec_id bigint, embedding array<double>, component_id int"), per_pivot=per_pivot, tile=tile).collect()}
    good = {k: np.array(v, float) for k, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    good = {k: v / np.abs(v).max() for k, v in good.items()}
    links = [(a, b) for a, b in combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a] * (good[b] @ good[b])) >= 0.9]
    wanted = classes_of([k for k, _ in rows], links)
    assert {k: r["component_id"] for k, r in got.items()} == wanted
    assert {k: r["n_links"] for k, r in got.items()} == {k: sum(k in p for p in links) for k in wanted}
    assert all(r["kept"] == (k == wanted[k]) for k, r in got.items())


def test_vectors_without_id_or_rows(spark):
    rows = [(None, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [0.0, 1.0]), (2, [1.0, 0.1])]
    got = sorted(map(str, vectors.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()))
    assert got == sorted(map(str, [
        _row(None, 2, 2, False), _row(2, 2, 2, True), _row(2, 2, 2, True), _row(None, 0, None, False),
    ]))
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def _row(vec_id, n_links, component_id, kept):
    from pyspark.sql import Row

    return Row(vec_id=vec_id, n_links=n_links, component_id=component_id, kept=kept)
