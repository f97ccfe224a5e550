"""Chat formatting: turns become one marked string a conversation, with Spark expressions only.

A conversation's turns are collected as structs and sorted by (turn, role, text); adjacent turns of one role are merged
into a message; messages are concatenated. The template is

    <|im_start|>ROLE\\nTEXT<|im_sep|>TEXT...<|im_end|>\\n

with ``<|im_sep|>`` between the merged turns of a message, so that turns can be read back. Inside texts and roles every
``<|`` gets a backslash between its characters (one more if some are there), so that no control string occurs there; in
roles backslash and line feed are written ``\\s`` and ``\\n``.

Nulls: a null text or role is empty; a null turn sorts first; rows with a null conversation id form one conversation.
Repeated rows are turns of their own. An empty table gives an empty result. A conversation is one output string, so it
has to fit in a row, long texts whole; conversations are spread by their id. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _segment(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_roles: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """Rows (conv_id, formatted string, segments array<struct<text, loss>>): the segments' texts joined are ``formatted``;
    ``loss`` marks those under the loss mask, the escaped texts of the trained roles. Other columns are not read."""
    sorted_turns = F.array_sort(
        F.collect_list(F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    )
    grouped = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(sorted_turns.alias("turns"))

    def messages(ts: Column) -> Column:
        """Merged messages: the positions where the role changes cut the sorted turns into slices."""
        first = F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, i - 1)["role"]))
        return let(first, lambda at: F.transform(at, lambda s, k: F.struct(F.get(ts, s)["role"].alias("role"), F.slice(ts, s + 1, F.coalesce(F.get(at, k + 1), F.size(ts)) - s)["text"].alias("texts"))))

    def segments(m: Column) -> Column:
        head = _segment(F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n")), F.lit(False))
        body = F.transform(
            m["texts"],
            lambda t, i: F.array(_segment(F.when(i == 0, F.lit("")).otherwise(F.lit(SEP)), F.lit(False)), _segment(escape(t), m["role"].isin(*trained_roles))),
        )
        return F.concat(F.array(head), F.flatten(body), F.array(_segment(F.lit(END + "\n"), F.lit(False))))

    made = grouped.select("conv_id", let(F.col("turns"), messages).alias("messages"))
    made = made.select("conv_id", F.filter(F.flatten(F.transform("messages", segments)), lambda s: s["loss"] | (s["text"] != "")).alias("segments"))
    return made.select("conv_id", F.array_join(F.col("segments")["text"], "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation again, as array<struct<role, text>>."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turns(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        body = F.regexp_replace(F.substr(x, F.length(role) + 2), r"<\|im_end\|>\n$", "")
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda t: F.struct(unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(parts, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
