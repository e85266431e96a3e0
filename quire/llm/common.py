"""What the operators share: reading tables, Arrow batches, word hashes, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut_lineage, discard

#: Bytes of text hashed at a time: bounds the work arrays whatever the length of a text.
CHUNK = 1 << 18
#: Rows that an operator's function gets at a time: its work arrays follow these and not the batch.
SLICE = 500
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, after: Callable[[], None] | None = None
) -> DataFrame:
    """``fn`` over every Arrow batch, SLICE rows at a time; it yields any number of batches of ``schema``.

    ``after`` runs at the end of each task, also of one that fails.
    """

    def each(batches):
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, SLICE):
                    yield from fn(batch.slice(a, SLICE))
        finally:
            if after is not None:
                after()

    return df.mapInArrow(each, schema)


def beside(store: DataFrame, asks: DataFrame, key: str, load: Callable[[pa.Table], object], answer: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``answer`` over the rows of ``asks``, in slices, each beside what ``load`` makes of the rows of ``store`` with the same key.

    Both sides are dealt by ``key`` (not null) and sorted, a key's stored rows first
    (by ``order``), so a task holds one key's stored rows at a time and streams what
    asks for them, however much that is. Asks whose key isn't stored get no answer.
    """
    rows = store.withColumn("_ask", F.lit(False)).unionByName(asks.withColumn("_ask", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition(key).sortWithinPartitions(key, "_ask", *order)

    def stream(batches):
        current, waiting, loaded = None, [], None
        for batch in batches:
            keys, ask = batch.column(key).to_numpy(), batch.column("_ask").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (ask[1:] != ask[:-1])) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if keys[a] != current:
                    current, waiting, loaded = keys[a], [], None
                if not ask[a]:
                    waiting.append(batch.slice(a, b - a))
                    continue
                if waiting:
                    loaded, waiting = load(pa.Table.from_batches(waiting)), []
                if loaded is not None:
                    for k in range(a, b, SLICE * 8):
                        yield from answer(loaded, batch.slice(k, min(SLICE * 8, b - k)))

    return rows.mapInArrow(stream, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def list_column(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, p)))) for p in (_P, _INV)]
    return _powers[0], _powers[1]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` in order, and where each text begins among them.

    A word is a run of ASCII digits, letters or any character beyond ASCII,
    lower-cased. Equal words have equal hashes in every process.
    """
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    buffer = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    is_word = WORD[buffer]
    gaps, cuts = ~is_word, [0]
    while cuts[-1] < len(buffer):
        at = min(cuts[-1] + CHUNK, len(buffer))
        while at < len(buffer) and not gaps[at]:
            at += 1
        cuts.append(at)
    hashes, begins = [], []
    for a, b in zip(cuts, cuts[1:]):
        w = np.concatenate(([False], is_word[a:b], [False])).astype(np.int8)
        edge = np.diff(w)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = _power(max(b - a + 1, CHUNK + 1))
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((buffer[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=total[1:])
        hashes.append(mix((total[stop] - total[start]) * inverse[start]))
        begins.append(start + a)
    begin = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.searchsorted(begin, ends)))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), offsets.astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``size`` words in a row per text, in order, and their offsets.

    A text of fewer words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(offsets)
    texts = np.repeat(np.arange(len(counts)), counts)
    room = np.repeat(offsets[1:], counts) - np.arange(len(words))
    out = np.zeros(len(words), np.uint64)
    for k in range(size):
        part = np.zeros(len(words), np.uint64)
        inside = np.flatnonzero(room > k)
        part[inside] = words[inside + k]
        out = out * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(k + 1)
    first = np.arange(len(words)) == np.repeat(offsets[:-1], counts)
    keep = (room >= size) | (first & (np.repeat(counts, counts) < size))
    n = np.bincount(texts[keep], minlength=len(counts))
    return mix(out[keep]), np.concatenate(([0], np.cumsum(n)))


class IdBits:
    """One bit per hash of the ids of a table: a filter of fixed size (2**25 bits, 4 MB) that travels with the tasks.

    It passes every id of the table, and others with the chance that their bit is
    set, so it only spares work; an exact join has to follow where that matters.
    """

    BITS, CELL = 1 << 25, 1 << 15

    def __init__(self, ids: DataFrame, column: str, hashed: bool = False) -> None:
        place = F.pmod(F.col(column), F.lit(self.BITS)) + 1 if hashed else self.bit(column)
        cells = ids.select(F.bitmap_bucket_number(place).alias("cell"), F.bitmap_bit_position(place).alias("at")).groupBy("cell").agg(F.bitmap_construct_agg("at").alias("bits"))
        table = np.zeros(self.BITS // 8, np.uint8)
        for r in cells.collect():  # at most BITS / CELL rows of 4 KB
            a = (r["cell"] - 1) * self.CELL // 8
            table[a : a + self.CELL // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
        self.shared = ids.sparkSession.sparkContext.broadcast(table)

    @classmethod
    def bit(cls, column: str):
        """An id's place, from 1, as Spark's bitmap functions count."""
        return F.pmod(F.xxhash64(column), F.lit(cls.BITS)) + 1

    def test(self, places: np.ndarray) -> np.ndarray:
        at = places - 1
        return (self.shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """For a table of 64-bit hashes (``hashed``): which of ``hashes`` may be among them."""
        return self.test((hashes & np.uint64(self.BITS - 1)).astype(np.int64) + 1)

    def __getstate__(self):
        return {"shared": self.shared}


def forest(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``labels`` (each a node's root) after joining the pairs (left, right): the smallest root wins."""
    while len(left):
        a, b = labels[left], labels[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            break
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels = jumped
    return labels


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node reachable.

    Rounds of taking the smallest neighbour and then the label's own label; each
    round is a written table, so lost executors cost one round. The number of
    rounds grows with the logarithm of the longest shortest path.
    """
    both = cut_lineage(links.select("a", "b").where("a <> b").union(links.select("b", "a").where("a <> b")).distinct())
    state = stored = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")))
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        jump = state.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut_lineage(
            state.join(near, "node").join(jump, "component", "left").select(
                "node", F.least("component", "near", "further").alias("component"), F.col("component").alias("before"),
            )
        )
        discard(stored)
        state, stored = step.select("node", "component"), step
        if step.where("component <> before").isEmpty():
            discard(both)
            return state


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)
