"""Line deduplication by a sharded minimal perfect hash.

A line is known by 128 bits of its key. Lines found in at least two documents are
dealt to shards by their hash. In a shard a minimal perfect hash gives every line
a number of its own: keys that are alone at their place of a level's bits stay
there, the others go on to the next, smaller level, and the number is the rank of
the bit. The numbers index three compact arrays: fingerprints (which tell lines
that are no keys), numbers of documents, and largest documents. No line is joined
with a line: a document's hashes go to the shards, whose arrays come first and
stay in memory while the hashes stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import beside, map_batches, mix, texts_of
from quire.session import cut_lineage, discard

#: Code points of the shortest key that is looked at, documents from which a line is dropped.
LENGTH, LEAST = 20, 3
#: Lines per shard (some 20 bytes each), fewest shards, bits per line of a level.
SHARD_LINES, LEAST_SHARDS, ROOM = 1 << 16, 1024, 2.0
#: A shard that gets more than this part of all lines is stored so often that each copy gets about that part.
HOT_PART = 512
#: What is stripped from both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GOLD = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased; other letters stay as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    plain = F.char_length(bare) == F.octet_length(bare)  # all ASCII: lower() changes A-Z only
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _row_key(doc: Column, text: Column) -> list[Column]:
    """128 bits of a row's id and text: rows with the same bits lose the same lines."""
    return [F.xxhash64(doc, text).alias("_r1"), F.xxhash64(F.lit(7), text, doc).alias("_r2")]


def line_hashes(docs: DataFrame, length: int = LENGTH, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """(_r1, _r2: the row; doc_id, line_no from 0, h1, h2: the line's key) of every line whose key has at least ``length`` code points."""
    of, whole = F.col(doc).cast("bigint"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = docs.select(of.alias("doc_id"), whole.alias("_text")).select(
        *_row_key(F.col("doc_id"), F.col("_text")), "doc_id", F.posexplode(F.split("_text", "\n", -1)).alias("line_no", "_line"),
    )
    return (
        lines.select("_r1", "_r2", "doc_id", "line_no", line_key(F.col("_line")).alias("_key")).where(F.char_length("_key") >= length)
        .select("_r1", "_r2", "doc_id", "line_no", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))
    )


# The minimal perfect hash of one shard


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * _GOLD & _ALL)
    return (mix(mix(h1 + salt) ^ (h2 * np.uint64(2 * level + 1) + salt)) % np.uint64(size)).astype(np.int64)


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, all their bits) of a minimal perfect hash of the pairs, which have to be distinct."""
    sizes, levels = [], []
    while len(h1):
        size = max(8, int(ROOM * len(h1)))
        slot = _slot(h1, h2, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        h1, h2 = h1[~alone[slot]], h2[~alone[slot]]
    return np.array(sizes, np.int32), np.concatenate(levels) if levels else np.zeros(0, bool)


def numbers_of(sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The number of every pair: of a key its own from 0, of another one anything or -1."""
    out, open_, start = np.full(len(h1), -1), np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = start + _slot(h1[open_], h2[open_], level, int(size))
        hit = bits[at]
        out[open_[hit]] = ranks[at[hit]] - 1
        open_, start = open_[~hit], start + int(size)
        if not len(open_):
            break
    return out


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix(h2 ^ mix(h1 ^ np.uint64(_GOLD)))


def line_index(counted: DataFrame, shards: int) -> DataFrame:
    """One row per shard (shard, sizes, bits, marks, counts, docs: packed) from (h1, h2, n, last)."""

    def build(group: pa.Table) -> pa.Table:
        h1, h2 = (group.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        sizes, bits = perfect_hash(h1, h2)
        place = numbers_of(sizes, bits, np.cumsum(bits), h1, h2)
        order = np.argsort(place)  # place is a permutation
        arrays = (
            sizes, np.packbits(bits), _fingerprint(h1, h2)[order], np.minimum(group.column("n").to_numpy()[order], (1 << 32) - 1).astype(np.uint32), group.column("last").to_numpy()[order],
        )
        return pa.table([group.column("shard").slice(0, 1), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=["shard", "sizes", "bits", "marks", "counts", "docs"])

    dealt = counted.select(F.pmod("h1", F.lit(shards)).cast("bigint").alias("shard"), "h1", "h2", "n", "last")
    return dealt.groupBy("shard").applyInArrow(build, "shard bigint, sizes binary, bits binary, marks binary, counts binary, docs binary")


def _load(stored: pa.Table) -> tuple[np.ndarray, ...]:
    sizes, bits, marks, counts, docs = (stored.column(c)[0].as_py() for c in ("sizes", "bits", "marks", "counts", "docs"))
    sizes = np.frombuffer(sizes, np.int32)
    flags = np.unpackbits(np.frombuffer(bits, np.uint8))[: int(sizes.sum())].astype(bool)
    return sizes, flags, np.cumsum(flags), np.frombuffer(marks, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(docs, np.int64)


def dropped_lines(docs: DataFrame, least: int = LEAST, length: int = LENGTH, text: str = "text", doc: str = "doc_id", shard_lines: int = SHARD_LINES, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """(_r1, _r2, dropped: numbers of the lines) of the rows that lose a line."""
    lines = cut_lineage(line_hashes(docs, length, text, doc).withColumn("_at", F.monotonically_increasing_id()))
    counted = cut_lineage(
        lines.where("doc_id is not null").select("h1", "h2", "doc_id").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where("n > 1")
    )
    shards = max(least_shards, -(-counted.count() // shard_lines))
    index = line_index(counted, shards)
    asks = lines.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("bigint"))
    part = max(1, lines.count() // HOT_PART)
    # At most HOT_PART rows.
    hot = asks.groupBy("shard").agg(F.ceil(F.count("*") / part).cast("bigint").alias("_copies")).where("_copies > 1")
    hot = F.broadcast(cut_lineage(hot))
    slot = F.col("shard") * (2 * HOT_PART) + F.col("_copy")
    stored = index.join(hot, "shard", "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).select(slot.alias("slot"), *index.columns[1:])
    asked = asks.join(hot, "shard", "left").withColumn("_copy", F.pmod("_at", F.coalesce("_copies", F.lit(1)))).select(slot.alias("slot"), "_r1", "_r2", "doc_id", "line_no", "h1", "h2")

    def answer(loaded: tuple, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, bits, ranks, marks, counts, last = loaded
        h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        number = numbers_of(sizes, bits, ranks, h1, h2)
        found = number >= 0
        found &= marks[np.where(found, number, 0)] == _fingerprint(h1, h2)
        at = np.where(found, number, 0)
        own = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False) & (batch.column("doc_id").fill_null(0).to_numpy() == last[at])
        yield batch.filter(pa.array(found & (counts[at] >= least) & ~own)).select(["_r1", "_r2", "line_no"])

    gone = beside(stored, asked, "slot", _load, answer, "_r1 bigint, _r2 bigint, line_no int")
    out = cut_lineage(gone.groupBy("_r1", "_r2").agg(F.sort_array(F.collect_set("line_no")).alias("dropped")))
    discard(lines, counted)
    return out


def dedup_lines(
    docs: DataFrame, least: int = LEAST, length: int = LENGTH, text: str = "text", doc: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
    shard_lines: int = SHARD_LINES, least_shards: int = LEAST_SHARDS,
) -> DataFrame:
    r"""``keep`` columns, ``n_lines`` (before), ``n_dropped`` and ``kept`` (the text without the dropped lines) of every row.

    Texts are split at \n; a null or empty text is one empty line. A line's key is the
    line without blanks at its ends and with A-Z lower-cased. Keys of at least ``length``
    code points that stand in at least ``least`` (2 or more) documents lose all their
    lines but those of the largest doc id that holds them; there every one stays.
    Documents are told apart by their id: rows that repeat an id are one document,
    though each has its own result. Rows without an id are no documents: they don't
    count, are never the largest, and lose a line that documents share. A text whose
    lines all go is empty. Other columns are ignored, an empty table gives an empty
    one. A line held by any part of all documents costs a row per line, dealt over
    copies of its shard. The list of dropped lines is bounded by one text's lines.
    """
    gone = dropped_lines(docs, least, length, text, doc, shard_lines, least_shards)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*keep, *_row_key(F.col(doc).cast("bigint"), whole), whole.alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, n_lines, n_dropped = [], [], []
        for t, gone in zip(texts_of(batch.column("_text")), batch.column("dropped").to_pylist()):
            n_lines.append(t.count("\n") + 1)
            n_dropped.append(len(gone or ()))
            if gone:
                lines = t.split("\n")
                for k in reversed(gone):
                    lines[k] = None
                t = "\n".join(x for x in lines if x is not None)
            texts.append(t)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string())], names=[*keep, "n_lines", "n_dropped", "kept"])

    # The lists are the smaller side: they are hashed, and no text is sorted.
    joined = rows.join(gone.hint("shuffle_hash"), ["_r1", "_r2"], "left").select(*keep, "_text", "dropped")
    return map_batches(joined, cut, f"{kinds}, n_lines bigint, n_dropped bigint, kept string")


def line_digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
      FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
c AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= {LENGTH} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST}),
m AS (SELECT l.*, c.k IS NOT NULL AND l.doc_id IS DISTINCT FROM c.last AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r"""
