"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: all runs of three bytes of the text, and runs
of three word shapes (letters' case, digits, signs, and whether a word repeats
the one before), hashed to a fixed number of places. Each indicator is scaled
by the logarithm of the ratio of its counts in the two classes; a linear
hinge-loss model on the scaled indicators is fitted by dual coordinate descent
on a bounded sample of the labelled rows, and its margin is turned into a
probability by a logistic curve fitted on other rows of that sample, weighted so
that the classes have their shares in all labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, mix, texts_of

#: Places of the byte runs, and after them of the shape runs.
BYTE_PLACES, SHAPE_PLACES = 1 << 16, 1 << 12
PLACES = BYTE_PLACES + SHAPE_PLACES
STEP = 1 << 20

_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 capital, 4 other letter, 8 digit, 16 sign
_KIND[:] = 16
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[97:123] = 4
_KIND[128:] = 4
_KIND[48:58] = 8


def _shapes(data: np.ndarray) -> np.ndarray:
    """One small number per word of ``data``: which kinds of characters it has, and whether it repeats the word before."""
    kind = _KIND[data]
    edge = np.diff(np.concatenate(([0], (kind != 1).view(np.int8), [0])))
    start = np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.int64)
    held = np.bitwise_or.reduceat(kind, start) >> 1
    several = np.minimum(np.add.reduceat((kind == 16).astype(np.int64), start), 3)
    position = np.zeros(len(data), np.uint64)
    position[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))
    letters = np.where(kind == 1, np.uint64(0), mix(data.astype(np.uint64) + (position << np.uint64(8)) + np.uint64(1)))
    word = np.add.reduceat(letters, start)
    same = np.concatenate(([False], word[1:] == word[:-1]))
    return (held.astype(np.int64) << 3) | (several << 1) | same


def indicators(text: str) -> np.ndarray:
    """Sorted places of the n-grams that occur anywhere in ``text``."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    seen = np.zeros(PLACES, bool)
    for a in range(0, len(data), STEP):
        part = data[a : a + STEP + 2].astype(np.uint32)
        if len(part) >= 3:
            code = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
            seen[code >> 16] = True
        shape = _shapes(data[a : a + STEP])
        if len(shape) >= 3:
            code = ((shape[:-2] * 131 + shape[1:-1]) * 131 + shape[2:]).astype(np.uint64)
            seen[BYTE_PLACES + (mix(code) >> np.uint64(52)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Weights on indicators and bias of the hinge-loss model over scaled, normed indicators.

    One dual variable per row, each set to its best value in turn, in a fixed
    shuffled order per round.
    """
    weights, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] / max(np.sqrt((scale[r] ** 2).sum()), 1e-9) for r in rows]
    dual = np.zeros(len(rows))
    for k in range(rounds):
        moved = 0.0
        for i in np.random.default_rng(k).permutation(len(rows)):
            slope = y[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / 2, 0.0), cost[i])  # 2: the norm of a row and its bias entry
            if (step := (new - dual[i]) * y[i]) != 0:
                dual[i] = new
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights * scale, bias


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label, weight), by Newton steps with a weak prior."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        gradient = np.array([(weight * (y - p) * margin).sum() - 0.01 * (a - 1), (weight * (y - p)).sum() - 0.01 * b])
        w = weight * p * (1 - p)
        h = np.array([[(w * margin**2).sum() + 0.01, (w * margin).sum()], [(w * margin).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, gradient)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 8000, rounds: int = 30, penalty: float = 1.0, label: str = "quality") -> dict:
    """The model: a weight per place, bias, and the logistic curve.

    ``labels`` has doc_id and ``label`` (1 good, 0 bad; others are left out),
    ``docs`` doc_id and text. Fitted on at most ``sample`` labelled documents, half
    of them per class: those whose doc_id has the smallest hash. This list of ids,
    bounded by ``sample``, is broadcast, so no text is shuffled; what reaches the
    driver is the indicators of these documents, and the number of all labels per
    class: a chosen row weighs in the logistic curve as many labels as it stands
    for, so a score means the same whatever ``sample`` leaves out. Repeated ids
    count once per label. Without rows of both classes every score is the share of class 1
    (0.5 without rows).
    """
    half = sample // 2
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null").distinct()
    chosen = [known.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for v in (0, 1)]
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    stands_for = [total.get(v, 0) / max(min(total.get(v, 0), half), 1) for v in (0, 1)]

    def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [indicators(t).astype("<u4").tobytes() for t in texts_of(batch.column("_text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], names=["doc_id", "y", "places"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text")).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = (
        map_batches(rows, places, f"doc_id {kind}, y int, places binary")
        .groupBy("doc_id", "y").agg(F.min("places").alias("places")).select(F.xxhash64("doc_id").alias("h"), "doc_id", "y", "places").collect()
    )
    taken.sort(key=lambda r: (r["h"], r["doc_id"], r["y"]))
    x = [np.frombuffer(r["places"], "<u4").astype(np.int64) for r in taken]
    good = np.array([r["y"] for r in taken], bool)
    if not good.any() or good.all():
        share = min(max(float(good.mean()) if len(good) else 0.5, 1e-6), 1 - 1e-6)
        return {"weights": np.zeros(PLACES, np.float32), "squares": np.zeros(PLACES, np.float32), "bias": 0.0, "slope": 0.0, "offset": float(np.log(share / (1 - share)))}
    fit = np.arange(len(x)) % 4 != 0
    fit = fit if 0 < good[fit].sum() < fit.sum() and not fit.all() else np.ones(len(x), bool)
    counts = np.ones((2, PLACES))
    for at, g, f in zip(x, good, fit):
        if f:
            counts[int(g), at] += 1
    ratio = np.log(counts[1] / (good[fit].sum() + 2)) - np.log(counts[0] / ((~good[fit]).sum() + 2))
    y = np.where(good, 1, -1)
    share = np.where(good, good.mean(), 1 - good.mean())
    weights, bias = dual_descent([r for r, f in zip(x, fit) if f], y[fit], ratio, penalty / (2 * share[fit]), rounds)
    norm = [max(float(np.sqrt((ratio[r] ** 2).sum())), 1e-9) for r in x]
    margin = np.array([weights[r].sum() / n + bias for r, n in zip(x, norm)])
    back = ~fit if not fit.all() else fit
    weight = np.where(good, stands_for[1], stands_for[0])
    slope, offset = _curve(margin[back], good[back].astype(float), (weight / weight.mean())[back])
    return {"weights": weights.astype(np.float32), "squares": (ratio**2).astype(np.float32), "bias": bias, "slope": slope, "offset": offset}


def score_quality(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` in 0..1 for every row (null counts as an empty text, which has the score of no indicators).

    Each row stands for itself: repeated rows repeat the result; other columns
    are ignored; an empty table gives an empty one. The model has a fixed size
    (two numbers per place, 0.6 MB) and travels with the tasks.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m, out = shared.value, []
        squares = m["squares"]
        for t in texts_of(batch.column("_text")):
            at = indicators(t)
            norm = max(float(np.sqrt(squares[at].sum())), 1e-9)
            z = m["slope"] * (float(m["weights"][at].sum()) / norm + m["bias"]) + m["offset"]
            out.append(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return map_batches(docs.select(*keep, docs[text].cast("string").alias("_text")), score, f"{kinds}, score double")


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that aren't held out: crc32 of doc_id's decimal text mod 5 is not 0."""
    return labels.where("quality is not null and crc32(cast(doc_id as string)) % 5 <> 0")
