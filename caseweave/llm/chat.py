"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, it
alone is trainable. Turns that follow the last assistant turn (or all turns of a conversation
without one) go into one more example with nothing to train on, so that the output holds
every turn and can be read back.

The template marks a turn as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a
line feed. A text may spell these marks itself: ``<``, any number of backslashes and ``|`` gets
one backslash more, and reading takes it away again, so no text can end its turn and every text
comes back as it was. Line feeds and backslashes of a role are escaped too.

All steps are DataFrame functions: one shuffle by conversation, then the expansion. A row holds
one conversation, as its last example does in any case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.session import scratch_path

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # a doubled backslash is taken apart first, so that a backslash before an n stays what it was
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def turn_text(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape_role(role), F.lit("\n"), escape(text), F.lit(END + "\n"))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, turns, text, loss_start, loss_end, whole), one row for each assistant turn.

    ``text`` is the context and the reply under the template; code points from ``loss_start`` to
    ``loss_end`` (exclusive) are trainable, both null where nothing is. ``whole`` marks the
    example that holds all turns. Turns are ordered by turn, role and text, nulls first; repeated
    rows are turns of their own. A null role or text counts as empty, rows with a null conv_id
    form one conversation, an empty table gives no examples, other columns are ignored.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    held = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    marked = held.select(
        "conv_id",
        F.transform("turns", lambda t: F.struct(
            turn_text(F.coalesce(t["role"], F.lit("")), F.coalesce(t["text"], F.lit(""))).alias("text"),
            F.char_length(escape(F.coalesce(t["text"], F.lit("")))).alias("body"),
            F.coalesce(t["role"] == TRAINED, F.lit(False)).alias("trained"),
        )).alias("turns"),
    )
    places = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["trained"] | (i == F.size("turns")))
    each = marked.select("conv_id", "turns", F.posexplode(places).alias("example", "upto"))
    reply = F.element_at("turns", F.col("upto"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("upto")), lambda t: t["text"]), "")
    joined = each.select("conv_id", "example", F.col("upto").alias("turns"), text.alias("text"), reply.alias("reply"), (F.col("upto") == F.size("turns")).alias("whole"))
    end = F.char_length("text") - F.lit(len(END) + 1)
    return joined.select(
        "conv_id", "example", "turns", "text", F.when(F.col("reply.trained"), end - F.col("reply.body")).alias("loss_start"),
        F.when(F.col("reply.trained"), end).alias("loss_end"), "whole",
    )


def read_turns(text: Column) -> Column:
    """The (role, text) pairs that an example's text was made of."""
    def one(part: Column) -> Column:
        border = F.instr(part, "\n")
        role, body = F.substring(part, F.lit(len(START) + 1), border - F.lit(len(START) + 1)), F.substring(part, border + F.lit(1), F.char_length(part))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    parts = F.split(text, r"<\|im_end\|>\n")
    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - F.lit(1)), one)


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The text under an example's loss mask, as it was before escaping; null without a mask."""
    return unescape(F.substring(text, start + F.lit(1), end - start))


def written(examples: DataFrame) -> DataFrame:
    """The examples, written to the shared folder and read back."""
    path = scratch_path(examples.sparkSession, "examples")
    examples.write.option("compression", "zstd").parquet(path)
    return examples.sparkSession.read.schema(examples.schema).parquet(path)


def digests(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples), from the examples alone.

    Only replies and the digest of the whole conversation are shuffled, never the contexts.
    """
    turns = F.when(F.col("whole"), read_turns(F.col("text")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id", "example", F.when(F.col("whole"), F.size(turns)).cast("bigint").alias("n"), F.sha2(lines, 256).alias("digest"),
        read_loss(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"), F.char_length("text").cast("bigint").alias("chars"),
    )
    one = read.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("digest").alias("turns_sha256"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
    )
    loss = F.array_join(F.transform("losses", lambda e: e["loss"]), "")
    return one.select("conv_id", "n_turns", "turns_sha256", F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_examples")
