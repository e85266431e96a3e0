"""The registered queries of the operators: name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, licenses, lines, negatives, repair
from quire.llm.bpe import bpe_digest
from quire.llm.common import table
from quire.llm.decontaminate import contaminated
from quire.llm.html import extract_text
from quire.llm.language import fit_languages, predict_languages
from quire.llm.neardup import near_duplicates
from quire.llm.pii import find_pii, fit_pii
from quire.llm.quality import fit_quality, learnable, score_quality
from quire.llm.vectors import link_vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def keep(fn: Query) -> Query:
        QUERIES[name] = (fn, sql)
        return fn

    return keep


@query("op1_licenses", licenses.SQL)
def _(spark, folder):
    return licenses.license_digest(licenses.scan_licenses(table(spark, folder, "documents")))


@query("op2_chat", chat.SQL)
def _(spark, folder):
    return chat.chat_digest(table(spark, folder, "conversations"))


@query("op3_decontaminate")
def _(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_html")
def _(spark, folder):
    return extract_text(table(spark, folder, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


@query("op5_language")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.expr("crc32(cast(doc_id as string)) % 4 = 2")
    model = fit_languages(docs.where(F.col("lang").isNotNull() & ~F.coalesce(held_out, F.lit(False))))
    return predict_languages(docs.withColumn("_held_out", held_out), model, keep=("doc_id", "_held_out")).withColumnRenamed("_held_out", "held_out")


@query("op9_bpe")
def _(spark, folder):
    return bpe_digest(table(spark, folder, "documents"))


@query("op6_vectors")
def _(spark, folder):
    return link_vectors(table(spark, folder, "embeddings"))


@query("op7_neardup")
def _(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


@query("op8_pii")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    return find_pii(docs, fit_pii(docs)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans",
    )


@query("op10_quality")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    model = fit_quality(docs, learnable(table(spark, folder, "labels")))
    return score_quality(docs, model).select(
        "doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted"),
    )


@query("op11_lines", lines.SQL)
def _(spark, folder):
    return lines.line_digest(lines.dedup_lines(table(spark, folder, "documents")))


@query("op12_negatives", negatives.SQL)
def _(spark, folder):
    return negatives.mine_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, negatives.moved_label())


@query("op13_repair", repair.SQL)
def _(spark, folder):
    rows = table(spark, folder, "conversations")
    return repair.repair_digest(repair.repair_conversations(repair.damaged(rows)), rows)
