"""Chat formatting: conversations become training strings with a loss mask, in Spark expressions.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns with one
role are merged into a block by array functions, and blocks are concatenated:

    <s>ROLE[INST]TEXT[TURN]TEXT[/INST]</s>

`<s>`, `</s>`, `[INST]`, `[/INST]` and `[TURN]` are the control strings; `[TURN]` parts the texts
that were merged, so the turns can be read back. Inside roles and texts each control string, also
one that holds backslashes after its first character, gets one backslash more there; taking one
away restores it, so any text survives. The loss mask lists the code points (start, end) of each
assistant text as it stands in the string.

Nulls and odd input: a null text or role is empty. Turns are ordered by turn (null first), then
role and text, so ties and repeated rows have a defined order. A conversation without rows does
not exist; an empty table gives an empty result. A conversation is one row of the result, so its
turns meet in one task; nothing else is gathered. Rows with a null conv_id form a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.llm.common import table

_CONTROL = r"(?:/?s>|/?INST\]|TURN\])"
END = "[/INST]</s>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{_CONTROL})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{_CONTROL})", r"$1$2")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) from rows of conv_id, turn, role and text; other columns
    don't matter."""
    blank = F.lit("")
    rows = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role"), blank).alias("role"), F.coalesce(F.col("text"), blank).alias("text")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # where a block starts: a turn whose role differs from the one before
    out = out.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"])))
    size = F.size("turns")
    after = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(size + 1))
    out = out.withColumn("blocks", F.transform(F.arrays_zip(F.col("starts").alias("a"), after.alias("b")), lambda x: F.slice("turns", x["a"], x["b"] - x["a"])))
    out = out.select("conv_id", F.transform("blocks", lambda b: F.struct(b[0]["role"].alias("role"), F.transform(b, lambda t: escaped(t["text"])).alias("texts"))).alias("blocks"))
    # each piece of the string, and whether the loss covers it
    head = lambda b: F.struct(F.concat(F.lit("<s>"), escaped(b["role"]), F.lit("[INST]")).alias("s"), F.lit(False).alias("loss"))
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    pieces = F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(head(b)),
        F.flatten(F.transform(b["texts"], lambda t, i: F.filter(F.array(piece(F.lit("[TURN]"), F.lit(False)), piece(t, b["role"] == LOSS_ROLE)), lambda _, j: (j == 1) | (i > 0)))),
        F.array(piece(F.lit(END), F.lit(False))),
    )))
    out = out.select("conv_id", pieces.alias("pieces"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    mask = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["s"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p["s"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted string."""
    blocks = F.split(formatted, r"\[/INST\]</s>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    opened = F.transform(blocks, lambda b: F.struct(F.substring_index(b, "[INST]", 1).alias("head"), b.alias("all")))
    return F.flatten(F.transform(opened, lambda b: F.transform(
        F.split(F.substring(b["all"], F.length(b["head"]) + 7, F.length(b["all"])), r"\[TURN\]"),
        lambda t: F.struct(unescaped(F.substring(b["head"], F.lit(4), F.length(b["head"]))).alias("role"), unescaped(t).alias("text")),
    )))


def masked_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_chats(turns.unionByName(extra))
    out = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    spoken = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*(?:/?s>|/?INST\]|TURN\]))', '\1\\\2', 'g') AS erole,
    regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|TURN\]))', '\1\\\2', 'g') AS etext,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joined
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN joined THEN 6 ELSE 3 + length(erole) + 6 + 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
