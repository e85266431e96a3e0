"""From raw documents to token ids: quality, near-duplicates, contamination, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is
written and read again as the next stage's docs. All but the last return the
columns of ``documents``. The stages decide by row: near-duplicates and contamination
give every row a stored number, so rows without a doc_id or with the same one are
told apart. Empty tables give empty ones; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.bpe import bpe_encode
from quire.llm.common import table
from quire.llm.decontaminate import contaminated
from quire.llm.neardup import near_duplicates
from quire.llm.pii import find_pii, fit_pii
from quire.llm.quality import fit_quality, learnable, score_quality
from quire.session import cut_lineage, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Score from which a document is kept, as in the query of the classifier.
GOOD = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels that aren't held out. Null texts count as empty."""
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    return score_quality(docs, model, keep=COLUMNS).where(F.col("score") >= GOOD).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, stored, so that it stays the same however often they are read."""
    return cut_lineage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, rows without one last.

    Of repeated rows and of those that repeat an id one stays as well. Rows without a word are like no other and stay.
    """
    rows = numbered(docs)
    classes = cut_lineage(near_duplicates(rows, doc="_row").select(F.col("doc_id").alias("_row"), "class_id").join(rows.select("_row", "doc_id"), "_row"))
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    dropped = cut_lineage(classes.select("_row").join(first, "_row", "left_anti"))
    return rows.join(dropped, "_row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null and empty texts have none."""
    rows = numbered(docs)
    leaks = cut_lineage(contaminated(rows, table(spark, sf_dir, "benchmark"), doc="_row").select(F.col("doc_id").alias("_row")).distinct())
    return rows.join(leaks, "_row", "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text replaced by its kind; a null text stays null."""
    found = find_pii(docs, fit_pii(docs), keep=COLUMNS)
    text = F.when(F.col("text").isNotNull(), F.col("redacted"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("bigint").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of every document; a null text has none."""
    # Workers still hold memory of the stages before and serve those of the next run, so the encoder's tables are small and live for one task.
    return bpe_encode(docs, keep=("doc_id", "lang", "source"), states=20_000, cached=60_000, release=True)


STAGES = [
    ("quality", keep_good), ("near_duplicates", keep_one_of_a_kind), ("contamination", drop_contaminated), ("personal_data", redact), ("encoding", encode),
]
#: The models and hashes can't be written in SQL; tests/llm/test_pipeline.py checks each stage's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
