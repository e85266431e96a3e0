"""Line deduplication against a plain version, and the perfect hash by itself."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quire.llm import lines

SCHEMA = "doc_id bigint, text string, kept string, dropped string, line_no int, slot int"


def plain(rows, least=3, length=20):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    held = defaultdict(set)
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                held[key(line)].add(d)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if not (len(key(x)) >= length and len(held[key(x)]) >= least and d != max(held[key(x)]))]
        out.append((d, len(all_lines), len(all_lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def run(spark, rows, **options):
    table = spark.createDataFrame([(d, t, "x", "y", 1, 2) for d, t in rows], SCHEMA)
    got = lines.dedup_lines(table, **options)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    return Counter(tuple(r) for r in got.collect())


def test_every_key_has_a_number_of_its_own():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 500, 20_000):
        h1, h2 = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        h1[: n // 2] = h1[0]  # equal first halves still differ in the second
        sizes, bits = lines.perfect_hash(h1, h2)
        assert sorted(lines.numbers_of(sizes, bits, np.cumsum(bits), h1, h2)) == list(range(n))
        assert bits.sum() == n and sizes.sum() < 6 * n + 64


@pytest.mark.parametrize("options", [{}, {"shard_lines": 8, "least_shards": 3}, {"least": 2, "length": 5}])
def test_lines_equal_the_plain_version(spark, options):
    rng = random.Random(5)
    stock = [f"stock line number {i} of the whole table" for i in range(60)] + ["short", "", "Été à la plage, le matin", "ÉTÉ à la plage, le matin", "exactly twenty chars"]
    rows = []
    for d in range(400):
        picked = [rng.choice(stock) for _ in range(rng.randrange(12))] + [f"only document {d} says this one"]
        if d % 3 == 0:
            picked.append("A hot line that a third of all documents hold")
        rng.shuffle(picked)
        rows.append((d * 7 % 401, "\n".join(rng.choice(["", "  ", "\t\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", " \x0b"]) for x in picked)))
    limits = {k: options[k] for k in ("least", "length") if k in options}
    got = run(spark, rows, **options)
    assert got == plain(rows, **limits)
    assert sum(n * r[2] for r, n in got.items()) > 500


def test_lines_of_awkward_rows(spark):
    shared = "a line that several documents share"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, shared), (5, shared + "\n" + shared), (6, shared + "\r\nend"), (6, shared + "\r\nend"), (None, shared + "\nown"), (None, shared + "\nown")]
    rows += [(7, "z" * 200_000 + "\n" + shared), (8, "\n".join(["the same line over and over again"] * 5000)), (9, "the same line over and over again"), (9, shared), (-4, "the same line over and over again"), (10, "no blank at the end of this ")]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows * 3) == plain(rows * 3)
    assert run(spark, []) == Counter()
