"""MinHash near-duplicates: ProbMinHash of weighted and of equal shingles, banding, exact verification.

Texts of the same words in the same order form one group first, by a key of 128
bits; only one text of each such group goes on. A text's shingles are runs of
five words, weighted by how often they occur. Each shingle is a Poisson process
whose rate is its share of the weight; arrivals go to random components, and
every component keeps its first arrival, so two signatures agree in a component
with the probability Jaccard similarity. Arrivals later than every component's
first can't matter, so a shingle's process stops there; a first guess of that
time spares most shingles any arrival at all.

Links are verified on the sets of shingles, and with equal shares the probability
Jaccard similarity is that of the sets. So a text that repeats a shingle has the
bands of both signatures, by its counts and with equal shares; without repeats the
two are one.

Bands of components make candidates. A band shared by many texts isn't expanded
into pairs: its members are first verified against one of them (a star), and only
where a bucket then still holds several components its members are compared in
tiles of bounded size, pairs of one component left out. Links need a Jaccard
similarity of the shingle sets of at least the threshold, computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import IdBits, components, forest, list_column, map_batches, mix, shingle_hashes, texts_of, word_hashes
from quire.session import cut_lineage, discard

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 25, 5
#: Members of a bucket per tile of the second comparison.
TILE = 256
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def weighted(shingles: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles per text with their shares: (text number, shingle, share), by text and shingle."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((shingles, text))
    s, t = shingles[order], text[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(first)
    count = np.diff(np.r_[at, len(s)])
    return t[at], s[at], count / np.diff(offsets)[t[at]]


def all_bands(shingles: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys of every text, flat, and their offsets: by its shingles' counts, and where they differ also with equal shares."""
    n_texts = len(offsets) - 1
    text, shingle, share = weighted(shingles, offsets)
    keys = band_keys(signatures(text, shingle, share, n_texts, bands * rows), bands, rows)
    distinct = np.bincount(text, minlength=n_texts)
    repeats = distinct < np.diff(offsets)
    own = repeats[text]
    equal = band_keys(signatures((np.cumsum(repeats) - 1)[text[own]], shingle[own], 1 / distinct[text[own]], int(repeats.sum()), bands * rows), bands, rows)
    both = np.concatenate((keys, keys), axis=1)
    both[repeats, bands:] = equal
    new = np.ones(both.shape, bool)
    new[:, bands:] = both[:, bands:] != keys
    return both[new], np.concatenate(([0], np.cumsum(new.sum(axis=1))))


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(text: np.ndarray, shingle: np.ndarray, share: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """n_texts x size: the shingle of each component's first arrival (0 for a text without shingles)."""
    first = np.full(n_texts * size, np.inf)
    owner = np.zeros(n_texts * size, np.uint64)
    todo = np.zeros(n_texts, bool)
    todo[text] = True
    # All components are likely filled by this time: rate 1 per text, size components.
    limit = np.full(n_texts, size * (np.log(size) + 3.0))
    while todo.any():
        live = np.flatnonzero(todo[text])
        t, s, w = text[live], shingle[live], share[live]
        time, k = np.zeros(len(live)), 0
        while len(live):
            r = mix(s + np.uint64((2 * k + 1) * int(_GOLD) & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(_uniform(r)) / w
            near = time <= limit[t]
            t, s, w, time, live, r = t[near], s[near], w[near], time[near], live[near], r[near]
            if not len(live):
                break
            place = t * size + (mix(r ^ _GOLD) % np.uint64(size)).astype(np.int64)
            sooner = time < first[place]
            # Later arrivals are written first, so the first one of a component stays.
            order = np.flatnonzero(sooner)[np.argsort(-time[sooner], kind="stable")]
            first[place[order]], owner[place[order]] = time[order], s[order]
            worst = first.reshape(n_texts, size).max(axis=1)
            limit = np.minimum(limit, worst)
            k += 1
        open_ = np.isinf(first.reshape(n_texts, size)).any(axis=1) & todo
        todo = open_
        limit = np.where(open_, np.maximum(limit, size * (np.log(size) + 3.0)) * 4, limit)
        clear = np.repeat(open_, size)
        first[clear], owner[clear] = np.inf, 0
    return owner.reshape(n_texts, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n_texts x bands hashes of ``rows`` components each."""
    out = np.zeros((len(signature), bands), np.uint64)
    for r in range(rows):
        out = mix(out + signature[:, r::rows][:, :bands] * _GOLD + np.uint64(r + 1))
    return out ^ (np.arange(bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def text_keys(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every text's words in order."""
    counts = np.diff(offsets)
    at = (np.arange(len(words)) - np.repeat(offsets[:-1], counts)).astype(np.uint64)
    out = []
    for salt in (1, 2):
        h = mix(words ^ mix(at * _GOLD + np.uint64(salt)))
        total = np.concatenate(([np.uint64(0)], np.cumsum(h, dtype=np.uint64)))
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + counts.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the text's key (k1, k2; null without words) and its band hashes."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        words, offsets = word_hashes(texts_of(batch.column("_text")))
        k1, k2 = text_keys(words, offsets)
        hashes, ends = shingle_hashes(words, offsets, shingle)
        keys, of_text = all_bands(hashes, ends, bands, rows)
        none = np.diff(offsets) == 0
        flat = list_column(keys.view(np.int64), of_text, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), pa.array(k1, mask=none), pa.array(k2, mask=none), flat], names=[*keep, "k1", "k2", "bands"],
        )

    return map_batches(docs.select(*keep, docs[text].cast("string").alias("_text")), make, f"{kinds}, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, sought: DataFrame, size: int, text: str) -> DataFrame:
    """node and the sorted distinct shingle hashes, packed, of the texts in ``sought`` (node, k1, k2, rep: a doc_id that has it).

    Which doc_ids are sought is told by a bit per hash (a table of fixed size), so no
    text is shuffled; the join by the text's key is exact.
    """
    among = IdBits(sought, "rep")

    def make(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(among.test(batch.column("_bit").to_numpy())))
        words, offsets = word_hashes(texts_of(batch.column("_text")))
        k1, k2 = text_keys(words, offsets)
        hashes, ends = shingle_hashes(words, offsets, size)
        sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(k1), pa.array(k2), pa.array(sets, pa.binary())], names=["rep", "k1", "k2", "shingles"])

    ids = docs.where("doc_id is not null").select("doc_id", among.bit("doc_id").alias("_bit"), F.col(text).alias("_text"))
    found = map_batches(ids, make, "rep bigint, k1 bigint, k2 bigint, shingles binary").where("length(shingles) > 0")
    return found.join(sought, ["k1", "k2", "rep"]).select("node", "shingles").dropDuplicates(["node"])


def _verified(pairs: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b, sa, sb: packed shingle sets) those that are similar enough."""

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            n, m = len(x) // 8, len(y) // 8
            if min(n, m) < similarity * max(n, m):
                keep.append(False)
                continue
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), m - 1)
            common = int((y[at] == x).sum())
            keep.append(common >= similarity * (n + m - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return map_batches(pairs, check, "a bigint, b bigint")


def _tile_links(similarity: float):
    """Comparing the members (doc, component, shingles, side) of one tile pair: a spanning forest of its links."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("doc").reset_index(drop=True)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        _, root, which = np.unique(group["component"].to_numpy(), return_index=True, return_inverse=True)
        labels = root[which]
        left, right = group["low"].to_numpy(), group["high"].to_numpy()
        doc, a, b = group["doc"].to_numpy(), [], []
        marked = np.zeros(ids.max() + 1, bool)
        for i in range(len(sets)):
            others = np.flatnonzero((labels != labels[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i])) & (left & right[i] | right & left[i]))
            if not len(others):
                continue
            marked[ids[begin[i] : begin[i] + sizes[i]]] = True
            common = np.add.reduceat(marked[ids].astype(np.int64), begin)[others]
            marked[ids[begin[i] : begin[i] + sizes[i]]] = False
            hit = others[common >= similarity * (sizes[i] + sizes[others] - common)]
            if len(hit):
                _, one = np.unique(labels[hit], return_index=True)
                a += [doc[i]] * len(one)
                b += doc[hit[one]].tolist()
                labels = forest(labels, np.full(len(hit), i), hit)
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return compare


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, tile: int = TILE,
    text: str = "text", doc: str = "doc_id",
) -> DataFrame:
    """doc_id, ``class_id`` (smallest doc_id reachable by links), ``n_copies`` (rows of the very same words, itself included), ``kept``.

    ``kept`` is doc_id = class_id. Texts of the same words are always linked; others
    when the sets of their runs of five words have a Jaccard similarity of at least
    ``similarity`` and a band in common (missed with a chance under 1 in 10,000 at a
    Jaccard similarity of 0.8 of the sets, however often their runs repeat). A text of fewer than five words has one run of all
    its words; null texts and those without a word link with nothing. Repeated rows
    share a class and are all kept if their id is its smallest; rows of one id with
    different texts are texts of their own, each in the class of its text. Rows without
    doc_id get class_id null and kept false. Other columns are ignored, an empty
    table gives an empty one.
    """
    base = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    keyed = cut_lineage(sketch(base, bands, rows, shingle, "_text"))
    # A text is a node; its rows, whatever their ids, are the node's members.
    groups = cut_lineage(
        keyed.where("doc_id is not null and k1 is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    in_bands = groups.select("node", F.explode("bands").alias("band"))
    # One row per bucket: its size, its smallest member, and a mark of its members, equal for equal buckets.
    size = F.count("*")
    buckets = in_bands.groupBy("band").agg(
        size.alias("n"), F.min("node").alias("star"),
        F.struct(F.sum(F.xxhash64("node").cast("decimal(20,0)")), F.sum(F.hash("node").cast("bigint")), size, F.min("node"), F.max("node")).alias("mark"),
    ).where("n > 1")
    chosen = buckets.groupBy("mark").agg(F.min("band").alias("band"), F.first("n").alias("n"), F.first("star").alias("star"))
    members = cut_lineage(in_bands.join(chosen.select("band", "n", "star"), "band").select("band", "n", "star", "node"))
    sought = cut_lineage(groups.select("node", "k1", "k2", "rep").join(members.select("node").distinct(), "node", "left_semi"))
    sets = cut_lineage(shingle_sets(base, sought, shingle, "_text"))
    pairs = members.where("node <> star").select(F.col("star").alias("a"), F.col("node").alias("b")).distinct()
    stars = _verified(
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb"),
        similarity,
    )
    stars = cut_lineage(stars)
    found = components(stars)
    placed = members.where("n > 2").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("band").agg(F.min("component").alias("low_c"), F.max("component").alias("high_c")).where("low_c <> high_c").select("band")
    open_ = placed.join(split, "band").withColumn("_tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("_own", F.pmod(F.xxhash64("node"), "_tiles").cast("int"))
    spread = open_.select(
        "band", "node", "component", "_own", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"),
    ).select(
        "band", F.least("_own", "_other").alias("t1"), F.greatest("_own", "_other").alias("t2"), F.col("node").alias("doc"), "component",
        (F.col("_own") <= F.col("_other")).alias("low"), (F.col("_own") >= F.col("_other")).alias("high"),
    )
    more = (
        spread.join(sets.withColumnRenamed("node", "doc"), "doc")
        .groupBy("band", "t1", "t2").applyInPandas(_tile_links(similarity), "a bigint, b bigint")
    )
    links = cut_lineage(stars.union(more))
    linked = cut_lineage(components(links).join(groups.select("node", "rep"), "node").select("node", "component", "rep"))
    names = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = linked.join(names, "component").select("node", "class_id")
    final = cut_lineage(groups.join(classes, "node", "left").select("k1", "k2", "n_copies", F.coalesce("class_id", "rep").alias("class_id")))
    discard(members, sought, sets, stars, links, linked, groups)
    return keyed.select("doc_id", "k1", "k2").join(final, ["k1", "k2"], "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce(F.col("doc_id") == F.coalesce("class_id", "doc_id"), F.lit(False)).alias("kept"),
    )
