"""Hard negatives against all pairs, and the score bounds by themselves."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, rid int, score string, block int"


def plain(rows, positives=5, n_negatives=10):
    taken = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a, (i, x, label) in enumerate(taken):
        if i is None or i % 100:
            continue
        order = sorted(((-sum(p * q for p, q in zip(x, y)), math.inf if j is None else j, j, m == label) for b, (j, y, m) in enumerate(taken) if b != a), key=lambda r: r[:2])
        for score, _, j, _ in [r for r in order if r[3]][:positives]:
            window = [r for r in order if not r[3] and -30 * score <= -100 * r[0] <= -90 * score][:n_negatives]
            out += [(i, j, k + 1, r[2], -score, -r[0]) for k, r in enumerate(window)]
    return Counter(out)


def run(spark, rows, **options):
    table = spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA)
    got = negatives.mine_negatives(table, F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(tuple(r) for r in got.collect())


def clustered(seed, n, dim, centres, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dim))
    at = rng.integers(0, centres, n)
    x = middle[at] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i * 20, v.tolist(), int(c if rng.random() < 0.7 else rng.integers(0, 6))) for i, (v, c) in enumerate(zip(x, at))]


@pytest.mark.parametrize("spread, options", [(0.15, {"block": 40, "references": 5}), (3.0, {})])
def test_negatives_equal_all_pairs(spark, spread, options):
    rows = clustered(1, 700, 24, 6, spread)
    got = run(spark, rows, **options)
    assert got == plain(rows)
    assert sum(got.values()) > 500


def test_negatives_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 25, [float(x) for x in rng.integers(-1, 2, 6)], int(rng.integers(0, 3))) for i in range(120)]  # many ties
    rows += [(100, [1.0] * 6, 1)] * 3 + [(None, [1.0] * 6, 1), (None, [0.5] * 6, 2), (200, [0.0] * 6, 0), (300, [], 1), (7, [], 2), (400, [1.0, 1.0], 1), (8, [1.0] * 9, 0)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [math.nan] * 6, 1), (800, [math.inf] * 6, 1), (900, [1.0] * 6, None), (1000, [200.0, -3.5], 2), (9, [300.0, 200.0], 1)]
    got = run(spark, rows, block=16, references=3)
    assert got == plain(rows)
    assert run(spark, []) == Counter()
    assert run(spark, [(500, None, 1), (100, [0.0], 1)]) == Counter()


def test_one_label_may_hold_most_rows(spark):
    rows = [(i, v, 0 if i % 100 or i % 300 else 1) for i, v, _ in clustered(3, 400, 8, 3, 0.5)]
    assert run(spark, rows, block=32) == plain(rows)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    x = np.floor(256 * np.concatenate([rng.normal(size=(300, 12)), np.eye(12), -np.eye(12), np.zeros((2, 12))]))
    norm = np.sqrt((x * x).sum(axis=1))
    refs = negatives.References.__new__(negatives.References)
    refs.unit = x[:7] / norm[:7, None]
    angles = refs.angles(x, norm)
    low, high = negatives.score_bounds(angles, norm, angles, angles, norm, norm)
    exact = negatives.scores(x, x)
    assert (low <= exact).all() and (exact <= high).all()
    assert (np.diag(exact)[:7] >= high[:7, :7].diagonal() - 1e-3 * norm[:7] ** 2).all()


def test_groups_out_of_reach_are_not_scored(spark):
    rows = clustered(5, 3000, 16, 6, 0.02)
    table = spark.createDataFrame([(i, v, label, 1, "x", 2) for i, v, label in rows], SCHEMA)
    space = negatives.Searched(negatives.scaled_rows(table, "embedding", "vec_id", F.col("label")), 8, 64)
    asks = space.placed.where("vec_id % 100 = 0").withColumn("windows", F.expr("array(named_struct('w', 0L, 'low', 58000L, 'high', 70000L))"))
    asked, visited = asks.count(), space.visits(asks, False, True).count() + space.visits(asks, False, False).count()
    assert visited < 0.5 * asked * space.first[-1]
