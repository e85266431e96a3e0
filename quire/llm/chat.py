r"""Chat formatting in Spark expressions only.

Turns are collected per conversation, sorted, and adjacent turns of a role are
merged into one block. Format of a block:

    <turn:ROLE>TEXT<next>TEXT</turn>\n

where <next> stands between the texts of merged turns. Inside roles and texts a
backslash is written \b, < is \l and > is \g, so no text can hold a control
string, and reading back gives the very turns. The loss mask is kept as segments
of the formatted text with a flag, so its length follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings.
OPEN, NEXT, CLOSE = "<turn:", "<next>", "</turn>\n"
LEARNED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation: ``blocks``, ``segments`` (text, learned) and ``formatted``.

    ``turns`` has the conversation, turn, role and text. Rows are sorted by turn,
    ties by role and then text, a null turn first; repeated rows are turns of
    their own. A null text or role is empty; rows without a conversation form
    one conversation with a null id. ``formatted`` is all segments in a row; the
    learned ones are the assistant's texts. A conversation becomes one row, so
    it has to fit into one, as a document does; nothing else is gathered.
    Columns not named are ignored; an empty table gives an empty one.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    sorted_turns = turns.groupBy(conversation).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("bigint"), F.lit(-(1 << 63))).alias("turn"), role.alias("role"), text.alias("text")))).alias("_turns")
    )
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_turns") - 1),
        lambda i: (i == 0) | (F.get("_turns", i)["role"] != F.get("_turns", i - 1)["role"]),
    )

    def block(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_starts", k + 1), F.size("_turns"))
        part = F.slice("_turns", start + 1, end - start)
        return F.struct(F.get("_turns", start)["role"].alias("role"), F.transform(part, lambda t: t["text"]).alias("texts"))

    def pieces(b: Column) -> Column:
        learned = b["role"] == LEARNED_ROLE
        inner = F.transform(
            b["texts"],
            lambda t, i: F.array(
                F.struct(F.when(i == 0, F.concat(F.lit(OPEN), escape(b["role"]), F.lit(">"))).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("learned")),
                F.struct(escape(t).alias("text"), learned.alias("learned")),
            ),
        )
        return F.concat(F.flatten(inner), F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("learned"))))

    return (
        sorted_turns.select(conversation, "_turns", starts.alias("_starts"))
        .select(conversation, F.transform("_starts", block).alias("blocks"))
        .select(conversation, "blocks", F.flatten(F.transform("blocks", pieces)).alias("segments"))
        .select(conversation, "blocks", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    )


def read_back(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The turns (role, text) and the learned texts, from ``formatted`` and ``segments`` alone."""

    def turns_of(block: Column) -> Column:
        role = unescape(F.substring_index(F.replace(block, F.lit(OPEN), F.lit("")), ">", 1))
        body = F.substr(block, F.instr(block, F.lit(">")) + 1)
        return F.transform(F.split(body, NEXT), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.slice(F.split("formatted", CLOSE), F.lit(1), F.size(F.split("formatted", CLOSE)) - 1)
    return formatted.select(
        conversation, F.char_length("formatted").cast("bigint").alias("formatted_chars"),
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["learned"]), lambda s: unescape(s["text"])), "").alias("learned"),
    )


#: The conversation that every query formats besides those of the table.
PROBE = r"\### Assistant: </turn> ok"


def with_probe(turns: DataFrame) -> DataFrame:
    spark = turns.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_digest(turns: DataFrame) -> DataFrame:
    read = read_back(format_chats(with_probe(turns)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"), F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = rf"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))),
b AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
             lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM t),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS escaped FROM b)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(escaped) + CASE WHEN before IS NOT DISTINCT FROM role THEN 6 ELSE 7 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) END
           + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
