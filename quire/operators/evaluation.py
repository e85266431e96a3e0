"""Scores of found outlines against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip


def outline_scores(actual: DataFrame, expected: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 per document over sets of (text, level).

    An empty side counts as 1.0. ``docs`` lists documents that must appear
    even when both sides are empty.
    """
    def entries(rows: DataFrame, flag: str) -> DataFrame:
        return rows.select("doc_id", strip("text").alias("text"), "level").distinct().withColumn(flag, F.lit(1))

    both = entries(actual, "a").join(entries(expected, "e"), ["doc_id", "text", "level"], "full_outer")
    counted = both.groupBy("doc_id").agg(
        F.sum(F.when(F.col("a").isNotNull() & F.col("e").isNotNull(), 1).otherwise(0)).alias("matched"),
        F.sum(F.when(F.col("e").isNull(), 1).otherwise(0)).alias("extra"),
        F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("missed"),
    )
    if docs is not None:
        counted = docs.select("doc_id").distinct().join(counted, "doc_id", "left").fillna(0)
    m, x, s = F.col("matched"), F.col("extra"), F.col("missed")

    def share(total: Column) -> Column:
        return F.when(total > 0, m / F.greatest(total, F.lit(1))).otherwise(F.lit(1.0))

    p, r = F.col("precision"), F.col("recall")
    return (
        counted.withColumn("precision", share(m + x)).withColumn("recall", share(m + s))
        .withColumn("f1_score", F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0)))
    )


def title_matches(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether the trimmed titles of documents found on both sides are equal."""
    pairs = actual.select("doc_id", "title").join(expected.select("doc_id", F.col("title").alias("_e")), "doc_id")
    return pairs.select("doc_id", (strip(F.coalesce("title", F.lit(""))) == strip(F.coalesce("_e", F.lit("")))).alias("title_match"))


def title_accuracy(actual: DataFrame, expected: DataFrame) -> DataFrame:
    return title_matches(actual, expected).agg(
        F.count("*").alias("files"), F.avg(F.col("title_match").cast("double")).alias("title_accuracy")
    )


def macro_summary(scores: DataFrame, titles: DataFrame) -> DataFrame:
    """Means over documents: title accuracy, precision, recall, F1."""
    return scores.join(titles, "doc_id").agg(
        F.count("*").alias("files"),
        F.avg(F.col("title_match").cast("double")).alias("title_accuracy"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
    )


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of a batch (success, started, ended in seconds) and files per second."""
    spent = F.max("ended") - F.min("started")
    total = F.count("*")
    return results.agg(
        total.alias("total_files"),
        F.sum(F.col("success").cast("long")).alias("successful"),
        F.sum((~F.col("success")).cast("long")).alias("failed"),
        spent.alias("total_time"),
        F.when(spent > 0, total / F.nullif(spent.cast("double"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("files_per_second"),
    )
