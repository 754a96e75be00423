"""Chat formatting with Spark expressions only.

Turns are escaped, collected as structs, sorted, and joined into one string;
a turn of the same role as the one before it goes on in its block. Control
marks begin with ``<|``; inside texts and roles each of ``< [ \\`` is followed
by a backslash, so neither these marks nor others like ``</s>`` or ``[INST]``
can stand in them, and taking the backslashes away gives the texts back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import read_table

# Control marks: a block's begin, the end of its role, a further turn of the same role, the block's end.
BLOCK, TEXT, MORE, END = "<|turn|>", "<|text|>", "<|more|>", "<|end|>\n"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``turns(conv_id, turn, role, text)``:
    ``conv_id``, ``formatted`` and ``loss`` (start from 0 and length, in
    characters, of every assistant text within it).

    Turns are ordered by turn (null first), then role, then text; rows that
    repeat are turns each. A null text or role is empty; a null conv_id is a
    conversation of its own. Other columns are ignored; an empty table gives
    no rows.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.col("text")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def head(t: Column, i: Column) -> Column:
        first = F.concat(F.lit(BLOCK), escape(t["role"]), F.lit(TEXT))
        last = F.get(F.col("turns"), i - 1)
        return F.when(i == 0, first).when(last["role"] == t["role"], F.lit(MORE)).otherwise(F.concat(F.lit(END), first))

    parts = F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), t["text"].alias("text"), (t["role"] == LEARNT).alias("learnt")))
    chats = chats.select("conv_id", parts.alias("parts"))
    places = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")), lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["text"])).alias("at"),
        F.when(p["learnt"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("length")))))
        .otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    whole = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))
    return chats.select("conv_id", whole.alias("formatted"), places.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = unescape(F.substring_index(block, TEXT, 1))
        body = F.substring(block, F.length(F.substring_index(block, TEXT, 1)) + len(TEXT) + 1, F.length(block))
        texts = F.split(F.substring(body, F.lit(1), F.length(body) - len(END)), r"<\|more\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What a formatted table says when it is read back."""
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", turns.alias("turns"), learnt_text(F.col("formatted"), F.col("loss")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars")) \
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings."""
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(LEARNT).alias("role"), F.lit(tricky).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_chats(turns))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, coalesce(lag(role) OVER w = role, false) AS more, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(regexp_replace(text, '([<\\[\\\\])', '\\1\\\\', 'g')) AS size, length(regexp_replace(role, '([<\\[\\\\])', '\\1\\\\', 'g')) AS role_size FROM p),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '') AS learnt,
  sum(size + CASE WHEN more THEN 8 ELSE 16 + role_size + 8 END) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a
"""
