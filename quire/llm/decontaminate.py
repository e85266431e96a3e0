"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` words are hashed with a rolling polynomial (Karp-Rabin). Runs
that a document shares with a benchmark item are its seeds; seeds in a row on
one diagonal make up a match, and every match of at least ``least`` words is
such a row. Per document and item the longest match is marked, what is left of
the others is kept if it is still long enough, and so on until nothing is left.
The marked tiles don't overlap in either text and may stand in any order, so a
reordered passage is covered as well as a verbatim one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import IdBits, map_batches, shingle_hashes, texts_of, word_hashes
from quire.session import cut_lineage

LEAST, COVERAGE = 4, 0.5


def _runs(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, each one's text and place, and every text's number of words."""
    words, offsets = word_hashes(texts)
    runs, ends = shingle_hashes(words, offsets, size)
    text, n = np.repeat(np.arange(len(texts)), np.diff(ends)), np.diff(offsets)
    whole = n[text] >= size
    return runs[whole], text[whole], (np.arange(len(runs)) - ends[text])[whole], n


def benchmark_seeds(items: DataFrame, least: int, text: str = "text", item: str = "item_id") -> DataFrame:
    """item_id, n_words, size, item_at and seed (the hash) of every run of the items.

    The runs of an item of fewer than ``least`` words have all its words.
    """

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch.column("_text"))
        for size in range(1, least + 1):
            runs, of, at, n = _runs(texts, size)
            own = (n[of] == size) | (n[of] > size) & (size == least)
            runs, of, at = runs[own], of[own], at[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(of)), pa.array(n[of]), pa.array(np.full(len(of), size)), pa.array(at), pa.array(runs.view(np.int64))],
                names=["item_id", "n_words", "size", "item_at", "seed"],
            )

    rows = items.where(F.col(item).isNotNull()).select(F.col(item).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("_text"))
    return map_batches(rows, make, "item_id bigint, n_words bigint, size bigint, item_at bigint, seed bigint")


def tile(doc_at: np.ndarray, item_at: np.ndarray, least: int, n_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the document, place in the item, words), longest first, from the seeds' places.

    Equal lengths: the earlier place in the item, then in the document.
    """
    least = min(least, n_words)
    order = np.lexsort((item_at, doc_at - item_at))
    p, q = doc_at[order], item_at[order]
    cut = np.flatnonzero(np.r_[True, (np.diff(p - q) != 0) | (np.diff(q) != 1)])
    stop = np.r_[cut[1:], len(q)]
    matches = [(int(p[a]), int(q[a]), int(b - a + least - 1)) for a, b in zip(cut, stop)]
    taken_doc: set[int] = set()
    taken_item = np.zeros(n_words, bool)
    by_length: dict[int, list[tuple[int, int]]] = {}
    for a, b, n in matches:
        by_length.setdefault(n, []).append((b, a))
    tiles: list[tuple[int, int, int]] = []
    while by_length:
        n = max(by_length)
        for b, a in sorted(by_length.pop(n)):
            free = [not taken_item[b + k] and a + k not in taken_doc for k in range(n)]
            if all(free):
                tiles.append((a, b, n))
                taken_item[b : b + n] = True
                taken_doc.update(range(a, a + n))
                continue
            # What is still free goes back among the shorter matches.
            k = 0
            while k < n:
                if not free[k]:
                    k += 1
                    continue
                begin = k
                while k < n and free[k]:
                    k += 1
                if k - begin >= least:
                    by_length.setdefault(k - begin, []).append((b + begin, a + begin))
        if taken_item.all():
            break
    return tiles


def contaminated(
    docs: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = COVERAGE, text: str = "text", doc: str = "doc_id", item_text: str = "text", item: str = "item_id",
) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest, tiles) of all pairs whose tiles cover at least ``coverage`` of the item's words.

    ``tiles`` has doc_at, item_at (words from 0) and length. Items of fewer than
    ``least`` words match as a whole; items without words, null ids and null or
    empty texts match nothing. Repeated rows count once; rows of one id with different
    texts are judged each by itself, and the best covered one is returned (of equal ones
    that with fewer tiles). Empty tables give an empty one. Other columns are ignored.
    Only runs whose hash has a bit in a table of fixed size leave the documents'
    tasks; the join with the benchmark's runs is exact whatever its size. A pair
    needs coverage * words / ``least`` different places of the item at least, or
    it can't be covered; the others are never tiled.
    """
    seeds = cut_lineage(benchmark_seeds(items, least, item_text, item))
    among = IdBits(seeds, "seed", hashed=True)
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most ``least`` numbers

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = texts_of(batch.column("_text"))
        for size in sizes:
            runs, of, at, _ = _runs(texts, size)
            hit = among.contains(runs)
            runs, of, at = runs[hit], of[hit], at[hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(of)) for c in ("t1", "t2")] + [pa.array(at), pa.array(runs.view(np.int64))], names=["t1", "t2", "doc_at", "seed"],
            )

    # A text is known by 128 bits; rows with the same text are tiled once, whatever their ids.
    rows = docs.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.withColumn("t1", F.xxhash64("_text")).withColumn("t2", F.xxhash64(F.lit(1), "_text"))
    found = map_batches(rows.select("t1", "t2", "_text"), find, "t1 bigint, t2 bigint, doc_at bigint, seed bigint")
    pairs = (
        found.join(seeds, "seed").groupBy("t1", "t2", "item_id")
        .agg(F.collect_set(F.struct("doc_at", "item_at")).alias("seeds"), F.size(F.collect_set("item_at")).alias("places"), F.max("n_words").alias("n_words"))
        .where(F.col("places") * F.least(F.lit(least), "n_words") >= F.lit(coverage) * F.col("n_words"))
    )

    def mark(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for t1, t2, i, s, n in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "item_id", "seeds", "n_words"))):
            tiles = tile(np.array([x["doc_at"] for x in s]), np.array([x["item_at"] for x in s]), least, n)
            covered = sum(t[2] for t in tiles) / n
            if covered >= coverage:
                out.append({
                    "t1": t1, "t2": t2, "item_id": i, "coverage": covered, "n_tiles": len(tiles), "longest": max(t[2] for t in tiles),
                    "tiles": [{"doc_at": a, "item_at": b, "length": k} for a, b, k in sorted(tiles)],
                })
        yield from pa.Table.from_pylist(out, schema=MARKED).to_batches()

    marked = map_batches(
        pairs, mark, "t1 bigint, t2 bigint, item_id bigint, coverage double, n_tiles bigint, longest bigint, tiles array<struct<doc_at:bigint,item_at:bigint,length:bigint>>",
    )
    # Of the texts of one id the best covered one counts.
    best = F.max(F.struct("coverage", -F.col("n_tiles"), "longest", "tiles")).alias("_best")
    found = rows.select("doc_id", "t1", "t2").join(cut_lineage(marked), ["t1", "t2"]).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", "_best.coverage", (-F.col("_best.col2")).alias("n_tiles"), "_best.longest", "_best.tiles")


MARKED = pa.schema([
    ("t1", pa.int64()), ("t2", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("longest", pa.int64()),
    ("tiles", pa.list_(pa.struct([("doc_at", pa.int64()), ("item_at", pa.int64()), ("length", pa.int64())]))),
])
