"""Chat formatting with Spark expressions only.

A conversation is the collected, sorted array of its turn structs. Adjacent
turns of one role share one message; inside a message a mark separates them, so
the output still tells every turn:

    <|im_start|>user<|im_sep|>first<|im_turn|>second<|im_end|>

``<|`` cannot occur inside a role or a text: a backslash is doubled and ``<|``
becomes ``<\\|``; dropping each backslash and keeping what follows undoes both.

Defined results: a NULL text or role is the empty string; turns are ordered by
(turn, role, text) with NULL turns first, so ties have one order; repeated rows
are repeated turns; rows whose conversation id is NULL form one conversation with
a NULL id; an empty table gives no rows; further columns are ignored. One output
row holds one conversation, so a conversation has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def _pattern(mark: str) -> str:
    return mark.replace("|", "\\|")


def format_chats(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, ``segments`` (text, loss) and ``formatted``.

    The segments concatenated are ``formatted``; those with ``loss`` are exactly the
    escaped texts of the role ``learn``.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv).alias(conv)).agg(F.sort_array(F.collect_list(one)).alias("_turns"))
    all_turns = F.col("_turns")

    def pieces(x: Column, i: Column) -> Column:
        opens = F.when(i == 0, F.lit(True)).otherwise(F.get(all_turns, i - 1)["role"] != x["role"])
        closes = F.when(i == F.size(all_turns) - 1, F.lit(True)).otherwise(
            F.get(all_turns, i + 1)["role"] != x["role"]
        )
        head = F.when(opens, F.concat(F.lit(START), escape(x["role"]), F.lit(SEP))).otherwise(F.lit(TURN))
        tail = F.when(closes, F.lit(END + "\n")).otherwise(F.lit(""))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x["text"]).alias("text"), (x["role"] == learn).alias("loss")),
            F.struct(tail.alias("text"), F.lit(False).alias("loss")),
        )

    cut = chats.select(conv, F.flatten(F.transform(all_turns, pieces)).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.col("segments")["text"], ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    messages = F.slice(F.split(formatted, _pattern(START)), 2, F.length(formatted) + 1)

    def turns(message: Column) -> Column:
        role = unescape(F.substring_index(message, SEP, 1))
        body = F.substring_index(F.substring_index(message, SEP, -1), END, 1)
        return F.transform(
            F.split(body, _pattern(TURN)),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(messages, turns))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )


def chat_digest(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the formatted output tells when it is read back."""
    turns = F.col("_read")
    read = chats.withColumns(
        {"_read": read_turns(F.col("formatted")), "_loss": read_loss(F.col("segments"))}
    )
    told = F.array_join(
        F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        conv,
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
