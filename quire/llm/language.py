"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A run of three letters is bound
into one vector: the first letter's vector permuted twice (rotated by two
places), the second's permuted once, multiplied with the third's. Bundling, the
sum over all runs, gives the profile of a language or a document, and a document
gets the language whose profile has the largest cosine with its own.

Sums and products commute, so a document's dot product with a profile is the sum
of the profile's dot products with the document's runs; those are tabulated once
per process and the document's own vector need not be written out. Its length is
the same factor in all cosines, which leaves their order and ratios alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches, texts_of

#: Dimensions of the vectors, places for letters (0: what isn't a letter), and letters counted at a time.
DIMENSIONS, LETTERS, STEP = 1024, 128, 1 << 20
RUNS = LETTERS**3


def _places() -> np.ndarray:
    """Place of every character of the basic plane: a to z have their own, other letters share 101 by code point."""
    out = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        s = chr(c).lower()
        if s[:1].isalpha():
            o = ord(s[0])
            out[c] = o - 96 if 97 <= o <= 122 else 27 + o % 101
    return out


_cached: dict = {}


def _place_table() -> np.ndarray:
    if "places" not in _cached:
        _cached["places"] = _places()
    return _cached["places"]


def letter_vectors(seed: int = 5) -> np.ndarray:
    """LETTERS x DIMENSIONS of +1 and -1, the same in every process."""
    return np.random.default_rng(seed).integers(0, 2, (LETTERS, DIMENSIONS)).astype(np.float32) * 2 - 1


def bound(runs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The vectors of runs given as first * LETTERS**2 + second * LETTERS + third."""
    first, second, third = runs // LETTERS**2, runs // LETTERS % LETTERS, runs % LETTERS
    return np.roll(vectors, 2, axis=1)[first] * np.roll(vectors, 1, axis=1)[second] * vectors[third]


def letter_runs(text: str) -> Iterator[np.ndarray]:
    """All runs of three places of a text, part by part; those with two or more non-letters are left out.

    A character beyond the basic plane counts by its surrogates' places: not a letter.
    """
    table = _place_table()
    data = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")
    for a in range(0, max(len(data), 1), STEP):
        p = table[np.concatenate(([32] if a == 0 else data[a - 2 : a], data[a : a + STEP], [32] if a + STEP >= len(data) else []))  .astype(np.int64)]
        if len(p) >= 3:
            codes = p[:-2] * LETTERS**2 + p[1:-1] * LETTERS + p[2:]
            yield codes[((p[:-2] > 0).view(np.int8) + (p[1:-1] > 0).view(np.int8) + (p[2:] > 0).view(np.int8)) >= 2]


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Language -> its bundled profile, from all rows of ``docs`` with a language.

    Each task bundles its own rows into one vector per language; the vectors of
    the tasks are summed dimension by dimension in Spark. What reaches the driver
    is one vector per language.
    """

    def bundle(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(texts_of(batch.column("_text")), batch.column("_lang").to_pylist()):
                for codes in letter_runs(t):
                    own = counts.setdefault(name, np.zeros(RUNS, np.int64))
                    np.add(own, np.bincount(codes, minlength=RUNS), out=own) if len(codes) > RUNS // 8 else np.add.at(own, codes, 1)
        vectors = letter_vectors()
        for name, own in counts.items():
            total, seen = np.zeros(DIMENSIONS), np.flatnonzero(own)
            for a in range(0, len(seen), 4096):
                total += own[seen[a : a + 4096]].astype(np.float64) @ bound(seen[a : a + 4096], vectors)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * DIMENSIONS), pa.array(range(DIMENSIONS), pa.int32()), pa.array(total)], names=["lang", "place", "value"],
            )

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    summed = (
        rows.mapInArrow(bundle, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
        .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("profile"))
    )
    return {r["lang"]: np.array([v["value"] for v in r["profile"]]) for r in summed.collect()}


def _table_of(names: tuple[str, ...], profiles: np.ndarray) -> np.ndarray:
    """RUNS x languages: dot products of every run's vector with the unit profiles."""
    key = (names, profiles.tobytes())
    if _cached.get("key") != key:
        vectors = letter_vectors()
        first, second = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1)
        out = np.empty((LETTERS, LETTERS, LETTERS, len(names)), np.float32)
        for a in range(LETTERS):
            pair = first[a] * second
            for k, p in enumerate(profiles):
                out[a, :, :, k] = (pair * p.astype(np.float32)) @ vectors.T
        _cached["key"], _cached["table"] = key, out.reshape(RUNS, len(names))
    return _cached["table"]


def predict_languages(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``: the best cosine's share of all positive cosines.

    A null text or one without a letter is ``und`` with score 0, and so is any
    text if nothing was learned. Equal cosines: the first name in order. Rows
    stand for themselves; an empty table gives an empty one. The model holds one
    vector per language and travels with the tasks.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = tuple(sorted(model))
    profiles = np.stack([model[n] / max(np.linalg.norm(model[n]), 1e-12) for n in names]) if names else np.zeros((0, DIMENSIONS))

    def predict(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lang, score = [], []
        scores = _table_of(names, profiles) if names else None
        for t in texts_of(batch.column("_text")):
            total, letters = np.zeros(len(names)), False
            for codes in letter_runs(t) if names else ():
                letters = letters or bool(len(codes))
                for a in range(0, len(codes), 1 << 14):
                    total += scores[codes[a : a + (1 << 14)]].sum(axis=0)
            if not letters and names:
                letters = any(c.isalpha() for c in t)
            positive = np.maximum(total, 0)
            best = int(total.argmax()) if letters else -1
            lang.append(names[best] if best >= 0 else "und")
            share = positive[best] / positive.sum() if best >= 0 and positive.sum() > 0 else 1 / len(names) if best >= 0 else 0.0
            score.append(float(share))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    return map_batches(docs.select(*keep, docs[text].cast("string").alias("_text")), predict, f"{kinds}, lang_pred string, score double")
