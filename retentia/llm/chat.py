"""Prefix-target chat formatting, with DataFrame operations only.

Every assistant turn becomes one example: all turns before it are context, the
reply ends the text, and the loss mask covers the reply only.  Turns after the
last reply (or a conversation without a reply) make one more example with an
empty mask, so nothing of the input is lost in the output.

A turn is written as ``<s>[ROLE]\\nROLE\\n[/ROLE]\\nTEXT\\n</s>\\n``.  Control strings
inside roles and texts get one more backslash in front, taken off again on
reading; the line breaks keep a text's own backslashes apart from the marks.

Defined results: a null role or text is written as empty; rows are ordered by
(turn, role, text), nulls first; repeated rows are repeated turns; rows with a
null conv_id form one conversation.  A conversation must fit into one row, as
its digest covers all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"</?s>|\[/?(?:ROLE|INST|SYS)\]"
#: Characters that the template adds to a turn.
MARKS = len("<s>[ROLE]\n" + "\n[/ROLE]\n" + "\n</s>\n")


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, rf"\\(\\*)({CONTROL})", "$1$2")


def examples(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_length): one row per example, offsets in code points."""
    turn = F.struct("turn", "role", "text")
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    marked = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(
        (t["role"] == "assistant").alias("reply"),
        F.concat(F.lit("<s>[ROLE]\n"), escape(t["role"]), F.lit("\n[/ROLE]\n")).alias("head"),
        escape(t["text"]).alias("body"))).alias("turns"))
    ends = F.filter(F.sequence(F.lit(1), F.size("turns")),
                    lambda i: F.coalesce(F.element_at("turns", i)["reply"], F.lit(False)) | (i == F.size("turns")))
    split = marked.select("conv_id", "turns", F.posexplode(ends).alias("example", "last"))
    prefix = F.concat(F.array_join(F.transform(F.slice("turns", 1, F.col("last") - 1), lambda t: F.concat(
        t["head"], t["body"], F.lit("\n</s>\n"))), ""), F.element_at("turns", F.col("last"))["head"])
    target = F.element_at("turns", F.col("last"))
    return split.select(
        "conv_id", F.col("example").cast("long").alias("example"), prefix.alias("prefix"), target["body"].alias("body"),
        F.coalesce(target["reply"], F.lit(False)).alias("reply"),
    ).select(
        "conv_id", "example", F.concat("prefix", "body", F.lit("\n</s>\n")).alias("formatted"),
        F.char_length("prefix").cast("long").alias("loss_start"),
        F.when(F.col("reply"), F.char_length("body")).otherwise(0).cast("long").alias("loss_length"), "reply")


def parse(formatted: Column) -> Column:
    """The turns that a formatted text holds: array of (role, text)."""
    turns = F.split(formatted, r"(?<!\\)</s>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)  # after the last mark comes nothing
    return F.transform(turns, lambda t: F.transform(
        F.array(F.split(t, r"\n\[/ROLE\]\n", 2)), lambda p: F.struct(
            unescape(F.substr(p[0], F.lit(len("<s>[ROLE]\n") + 1))).alias("role"),
            unescape(F.regexp_replace(p[1], r"\n\z", "")).alias("text")))[0])


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, what its examples hold: turn count and digest, trainable text, characters."""
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_length")))
    seen = made.select("conv_id", "example", F.char_length("formatted").cast("long").alias("chars"), loss.alias("loss"),
                       "formatted")
    grouped = seen.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.max(F.struct("example", "formatted")).alias("last"))  # the last example holds every turn
    turns = grouped.withColumn("turns", parse(F.col("last.formatted")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
