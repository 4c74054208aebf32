"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted; adjacent turns of one role
share a header.  The template is::

    <turn role=ROLE>\\n text [<next/> text]... </turn>\\n

Texts and roles are escaped reversibly (backslash to \\s, < to \\l, > to \\g), so every
angle bracket in the output is the template's.  The loss mask is run-length coded:
(characters, loss) pieces that cover the output from begin to end; an assistant turn's
text is one piece under loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE_END, CLOSE, NEXT = "<turn role=", ">\n", "</turn>\n", "<next/>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def format_chats(turns: DataFrame, loss_role: str = "assistant", id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask array<struct<chars, loss>>.

    Rows are ordered by (turn, role, text), nulls first; null texts and roles are empty.
    A row without a conversation is a conversation of its own, with its repeats.
    Repeated rows are turns of their own.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    role = F.coalesce(F.col("role"), F.lit(""))
    alone = F.when(F.col(id_col).isNull(), F.xxhash64(F.col("turn"), role, text))
    grouped = turns.groupBy(F.col(id_col).alias("conv_id"), alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct(F.col("turn"), role.alias("role"), text.alias("text")))).alias("turns"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"]))

    def piece(turn: Column, earlier: Column) -> Column:
        head = F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit(ROLE_END))
        mark = F.when(earlier.isNull(), head).when(earlier == turn["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(CLOSE), head))
        return F.struct(mark.alias("mark"), escaped(turn["text"]).alias("body"), (turn["role"] == loss_role).alias("loss"))

    pieces = grouped.select("conv_id", F.zip_with("turns", F.slice(before, 1, F.size("turns")), piece).alias("pieces"))
    run = F.flatten(F.transform("pieces", lambda p: F.array(
        F.struct(F.length(p["mark"]).cast("long").alias("chars"), F.lit(False).alias("loss")),
        F.struct(F.length(p["body"]).cast("long").alias("chars"), p["loss"].alias("loss")))))
    end = F.array(F.struct(F.lit(len(CLOSE)).cast("long").alias("chars"), F.lit(False).alias("loss")))
    return pieces.select(
        "conv_id",
        F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""), F.lit(CLOSE)).alias("formatted"),
        F.concat(run, end).alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """Turns from the formatted text, and the text under the loss mask: conv_id, turns
    array<struct<role, text>>, loss_text, formatted_chars.

    Pieces of the mask at even places are the template's marks, at odd ones the turns'
    texts, so the mask and the turns are read side by side; lengths or numbers that
    disagree raise an error.
    """
    runs = F.filter(F.split(F.col("formatted"), CLOSE, -1), lambda r: r != "")

    def turns_of(run: Column) -> Column:
        head = F.split(run, ROLE_END, 2)
        role = unescaped(F.substr(head[0], F.lit(len(OPEN) + 1)))
        # The struct is bound once, so a long run is split once.
        run_of = F.array(F.struct(role.alias("role"), F.split(head[1], NEXT, -1).alias("texts")))
        return F.flatten(F.transform(run_of, lambda r: F.transform(r["texts"], lambda t: F.struct(r["role"].alias("role"), t.alias("body")))))

    parsed = chats.withColumn("raw", F.flatten(F.transform(runs, turns_of)))
    texts_mask = F.filter(F.col("mask"), lambda m, i: i % 2 == 1)
    wrong = F.raise_error(F.lit("the mask does not fit the text")).cast("string")
    under = F.zip_with(F.col("raw"), texts_mask, lambda t, m: F.when(~F.coalesce(F.length(t["body"]) == m["chars"], F.lit(False)), wrong).when(m["loss"], unescaped(t["body"])))
    return parsed.select(
        "conv_id",
        F.transform("raw", lambda t: F.struct(t["role"].alias("role"), unescaped(t["body"]).alias("text"))).alias("turns"),
        F.array_join(under, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digests(chats: DataFrame) -> DataFrame:
    back = read_back(chats)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


SQL = r"""
WITH talk AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS earlier,
    length(text) + 0 + (length(text) - length(replace(text, '\', ''))) + (length(text) - length(replace(text, '<', ''))) + (length(text) - length(replace(text, '>', ''))) AS body,
    length(role) + (length(role) - length(replace(role, '\', ''))) + (length(role) - length(replace(role, '<', ''))) + (length(role) - length(replace(role, '>', ''))) AS name
  FROM talk
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(8 + sum(body + CASE WHEN earlier IS NULL THEN 13 + name WHEN earlier = role THEN 7 ELSE 21 + name END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
