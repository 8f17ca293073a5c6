"""Chat formatting by prefix-target expansion, in DataFrame expressions only.

Template: a turn is ``<|role|>``, a new line, its text, ``<|end|>`` and a new line. Within roles and texts the characters
``&``, ``<``, ``[`` and ``|`` are written as character references, so nothing inside them can look like a mark of this
template or of another (``</s>``, ``[INST]``); the references are undone in the opposite order. Every assistant turn becomes
an example of its own: all preceding turns as context, then that reply, whose text alone is under the loss mask. Turns
after the last reply (or all, where there is none) give one last example without a target, so nothing is lost.

Turns of a conversation go by turn, then role, then text. Null texts and roles count as empty; a null conv_id is a
conversation of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

END = "<|end|>\n"
#: Fixed escapes, in the order in which they are applied; undone backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start and loss_length (code points).

    The conversation is formatted once; an example is its prefix up to the end of its target turn, cut from that one
    string by position. loss_start is null where nothing is trainable.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    head, body = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>\n")), escape(F.col("text"))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumn("head", head).withColumn("body", body).withColumn("n", F.row_number().over(order))
    turns = turns.select("conv_id", "n", "role", F.concat("head", "body", F.lit(END)).alias("said"), F.length("head").alias("head"), F.length("body").alias("body"))
    turns = turns.withColumn("stop", F.sum(F.length("said")).over(W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    one = F.struct("n", (F.col("stop") - F.length("said")).alias("first"), "stop", "head", "body", (F.col("role") == "assistant").alias("trained"), "said")
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    # A last turn that isn't a reply ends an example without a target.
    convs = convs.select("conv_id", F.concat_ws("", F.transform("t", lambda t: t.said)).alias("whole"), F.transform(F.filter("t", lambda t: t.trained | (t.n == F.size("t"))), lambda t: t.dropFields("said")).alias("ends"))
    rows = convs.select("conv_id", "whole", F.posexplode("ends").alias("example", "e"))
    return rows.select("conv_id", "example", F.col("e.n").alias("n_turns"), F.substr("whole", F.lit(1), F.col("e.stop").cast("int")).alias("formatted"), F.when(F.col("e.trained"), F.col("e.first") + F.col("e.head")).alias("loss_start"), F.when(F.col("e.trained"), F.col("e.body")).otherwise(0).alias("loss_length"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n", -1), lambda p: p != "")

    def turn(p):
        role = F.substring_index(F.substr(p, F.lit(3)), "|>\n", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + 6)).alias("text"))

    return F.transform(pieces, turn)


def digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: the last one holds all turns, the masks all replies."""
    loss = F.when(F.col("loss_length") > 0, unescape(F.substr("formatted", (F.col("loss_start") + 1).cast("int"), F.col("loss_length")))).otherwise("")
    ex = format_examples(conversations).select("conv_id", "example", "formatted", F.length("formatted").alias("chars"), loss.alias("loss"))
    by = ex.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("last"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss)).alias("loss"), F.sum("chars").alias("formatted_chars"))
    turns = by.withColumn("turns", read_turns(F.col("last")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long"))


def with_fixed(conversations: DataFrame) -> DataFrame:
    """conversations and conversation -7, whose texts hold another template's control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
