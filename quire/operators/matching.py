"""Nested match expressions over stored positions.

An expression is put together from leaves (a term, a phrase, a prefix, words near each
other) with ``&``, ``|`` and ``-`` (without), to any depth, and travels with its request as
a list of steps. Leaves are looked up in a table of positions, all requests at once;
what a chunk matched is then combined by the steps in one expression. No text is
split when a request is answered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.search import SALTS, per_salt, salted, tokens
from quire.session import cut_lineage

STEPS = "array<struct<op:string,words:string,distance:int>>"


@dataclass(frozen=True)
class Match:
    """An expression as its steps: leaves, and what is done with the two results before."""

    steps: tuple[tuple[str, str, int], ...]

    def _with(self, other: Match, op: str) -> Match:
        return Match((*self.steps, *other.steps, (op, "", 0)))

    def __and__(self, other: Match) -> Match:
        return self._with(other, "and")

    def __or__(self, other: Match) -> Match:
        return self._with(other, "or")

    def __sub__(self, other: Match) -> Match:
        return self._with(other, "without")


def phrase(words: str) -> Match:
    """The words next to each other in order; a single word is a term."""
    return Match((("phrase", words, 0),))


def prefix(start: str) -> Match:
    """Any word that begins with ``start``."""
    return Match((("prefix", start, 0),))


def near(words: str, distance: int = 10) -> Match:
    """All the words, in any order, with at most ``distance`` others between the first and the last."""
    return Match((("near", words, distance),))


def requests(spark: SparkSession, asked: list[tuple[int, str, Match]]) -> DataFrame:
    """(query_id, session_id, steps) of some requests."""
    return spark.createDataFrame([(q, s, list(m.steps)) for q, s, m in asked], f"query_id long, session_id string, steps {STEPS}")


def _leaves(asked: DataFrame) -> DataFrame:
    """(query_id, session_id, leaf, op, distance, terms) of the leaves that hold a word."""
    steps = asked.select("query_id", "session_id", F.posexplode("steps").alias("leaf", "step"))
    return steps.select("query_id", "session_id", "leaf", F.col("step.op").alias("op"), F.col("step.distance").alias("distance"), tokens(F.col("step.words")).alias("terms")).where(
        "op in ('phrase', 'prefix', 'near') and size(terms) > 0"
    )


def _beginnings(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with each term's beginnings (``start``) of the lengths that their session's prefixes (``asked``) have."""
    lengths = asked.groupBy("session_id").agg(F.collect_set(F.length("start")).alias("lengths"))
    return rows.join(lengths, "session_id").withColumn("n", F.explode("lengths")).where("n <= length(term)").withColumn("start", F.expr("left(term, n)")).drop("lengths", "n")


def build_positions(chunks: DataFrame, only_asked: DataFrame | None = None) -> DataFrame:
    """(session_id, chunk_id, term, positions): where each term stands in each chunk, from 0.

    ``only_asked`` (as ``requests`` makes it) keeps the terms that those requests can touch in every chunk,
    which removes most before the only shuffle when a known batch is answered without a stored table.
    """
    placed = chunks.select("session_id", "chunk_id", F.posexplode(tokens(F.col("content"))).alias("pos", "term"))
    if only_asked is not None:
        leaves = _leaves(only_asked)
        words = leaves.where("op <> 'prefix'").select("session_id", F.explode("terms").alias("term"))
        starts = cut_lineage(leaves.where("op = 'prefix'").select("session_id", F.element_at("terms", -1).alias("start")).distinct())
        begun = _beginnings(starts, placed.select("session_id", "term").distinct()).join(starts, ["session_id", "start"], "left_semi")
        # stored, so that its real, small size is known
        wanted = cut_lineage(words.unionByName(begun.select("session_id", "term")).distinct())
        placed = placed.join(wanted, ["session_id", "term"], "left_semi")
    return placed.groupBy("session_id", "chunk_id", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def write_positions(positions: DataFrame, folder: str, buckets: int = 8) -> None:
    """Store the table, one partition per session, sorted by term so that a term is few row groups."""
    spread = positions.repartition("session_id", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))).sortWithinPartitions("session_id", "term")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(folder)


def read_positions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).withColumn("session_id", F.col("session_id").cast("string"))


def _phrases(positions: DataFrame, leaves: DataFrame, salts: int) -> DataFrame:
    """A phrase starts where all its words agree on the start."""
    asked = leaves.where("op = 'phrase'").select("query_id", "session_id", "leaf", F.size("terms").alias("needed"), F.posexplode("terms").alias("at", "term"))
    hits = salted(positions, "chunk_id", salts).join(per_salt(asked, salts), ["session_id", "term", "salt"])
    alone = hits.where("needed = 1").select("query_id", "leaf", "chunk_id")
    starts = hits.where("needed > 1").select("query_id", "leaf", "chunk_id", "needed", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("start"))
    whole = starts.groupBy("query_id", "leaf", "chunk_id", "start").agg(F.count("*").alias("n"), F.max("needed").alias("needed")).where("n = needed")
    return alone.unionByName(whole.select("query_id", "leaf", "chunk_id"))


def _prefixes(positions: DataFrame, leaves: DataFrame, salts: int) -> DataFrame:
    """Terms are cut to the lengths that their session asks for and joined by equality."""
    asked = leaves.where("op = 'prefix'").select("query_id", "session_id", "leaf", F.element_at("terms", -1).alias("start"))
    begun = _beginnings(asked, positions.select("session_id", "chunk_id", "term"))
    return salted(begun, "chunk_id", salts).join(per_salt(asked, salts), ["session_id", "start", "salt"]).select("query_id", "leaf", "chunk_id").distinct()


def _nears(positions: DataFrame, leaves: DataFrame, salts: int) -> DataFrame:
    """From some occurrence on all words stand within the distance; a chunk's occurrences are one list."""
    asked = leaves.where("op = 'near'").withColumn("terms", F.array_distinct("terms")).select(
        "query_id", "session_id", "leaf", "distance", F.size("terms").alias("needed"), F.explode("terms").alias("term"),
    )
    hits = salted(positions, "chunk_id", salts).join(per_salt(asked, salts), ["session_id", "term", "salt"])
    lists = hits.groupBy("query_id", "leaf", "chunk_id").agg(
        F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("term").alias("term"))))).alias("at"), F.max("needed").alias("needed"), F.max("distance").alias("distance"),
    )

    def complete(first: Column) -> Column:
        inside = F.filter("at", lambda o: (o["pos"] >= first["pos"]) & (o["pos"] <= first["pos"] + F.col("distance") + 1))
        return F.size(F.array_distinct(F.transform(inside, lambda o: o["term"]))) == F.col("needed")

    return lists.where(F.exists("at", complete)).select("query_id", "leaf", "chunk_id")


def _combined(steps: str, leaves: str) -> Column:
    """Whether the steps come out true if ``leaves`` holds the numbers of the matched ones: a stack of results."""
    numbered = F.transform(steps, lambda s, i: F.struct(s["op"].alias("op"), F.array_contains(leaves, i).alias("hit")))

    def step(stack: Column, s: Column) -> Column:
        last, before = F.get(stack, F.size(stack) - 1), F.get(stack, F.size(stack) - 2)
        two = F.when(s["op"] == "and", before & last).when(s["op"] == "or", before | last).otherwise(before & ~last)
        return F.when(s["op"].isin("and", "or", "without"), F.concat(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 2, F.lit(0))), F.array(two))).otherwise(F.concat(stack, F.array(s["hit"])))

    return F.aggregate(numbered, F.array().cast("array<boolean>"), step, lambda stack: F.get(stack, F.size(stack) - 1))


def match(positions: DataFrame, asked: DataFrame, salts: int = SALTS) -> DataFrame:
    """(query_id, chunk_id) of the chunks of a request's session that match its expression.

    ``positions`` as ``build_positions`` makes or ``read_positions`` reads them, ``asked`` as ``requests``
    makes it, query_id distinct. Words are read as the index reads texts (case, marks, punctuation); a
    leaf without a word matches nothing. What is taken away may match anywhere, but a result always
    matches a leaf, so there is no expression of what is missing alone.
    """
    asked = cut_lineage(asked)  # read by every kind of leaf
    leaves = cut_lineage(_leaves(asked))
    found = _phrases(positions, leaves, salts).unionByName(_prefixes(positions, leaves, salts)).unionByName(_nears(positions, leaves, salts))
    held = found.groupBy("query_id", "chunk_id").agg(F.collect_set("leaf").alias("_leaves"))
    return held.join(asked.select("query_id", "steps"), "query_id").where(_combined("steps", "_leaves")).select("query_id", "chunk_id")
