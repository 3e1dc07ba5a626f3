r"""Chat formatting with DataFrame expressions only.

A conversation's rows become one string. Turns are collected as structs and sorted by (turn, role, text); adjacent
turns of one role share a block, inside which the separator control string stands between their texts::

    <|im_start|>role\ntext[<|im_sep|>text ...]<|im_end|>\n

Texts and roles are escaped so that no control string can arise in them: each ``<``, any number of backslashes,
``|`` gets one more backslash, which ``unescape`` takes off again. A newline in a role is written ``<|nl|>``.

``format_chats`` also returns the loss mask as run-length segments (text, loss), which joined give the formatted
string: exactly the assistants' texts are under the loss, separators and headers are not.

Every step is linear in the length of a conversation. Defined cases: null texts and roles are empty strings; rows
with equal turn numbers are ordered by role, then text, nulls first; repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END, SEP, NL = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NL))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NL), F.lit("\n")))


def _blocks(turns: Column) -> Column:
    """Sorted turns -> array of (role, texts): runs of one role, cut at the positions where the role changes."""

    def runs(rows: Column) -> Column:
        n = F.size(rows)
        first = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(rows, i - 1)["role"] != F.get(rows, i - 2)["role"]))
        return let(
            first,
            lambda at: F.transform(
                at,
                lambda p, k: F.struct(
                    F.get(rows, p - 1)["role"].alias("role"),
                    F.transform(F.slice(rows, p, F.coalesce(F.get(at, k + 1), n + 1) - p), lambda t: t["text"]).alias("texts"),
                ),
            ),
        )

    return let(turns, runs)


def _segments(blocks: Column) -> Column:
    """Blocks -> array of (text, loss); joined, the texts are the formatted conversation."""

    def plain(text: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(False).alias("loss"))

    def block(b: Column) -> Column:
        loss = b["role"] == F.lit("assistant")
        body = F.flatten(
            F.transform(
                b["texts"],
                lambda t, k: F.array(
                    plain(F.when(k > 0, F.lit(SEP)).otherwise(F.lit(""))),
                    F.struct(escape(t).alias("text"), loss.alias("loss")),
                ),
            )
        )
        return F.concat(F.array(plain(F.concat(F.lit(START), _escape_role(b["role"]), F.lit("\n")))), body, F.array(plain(F.lit(END))))

    return F.flatten(F.transform(blocks, block))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted string, segments array<struct<text, loss>>."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    cut = chats.select("conv_id", F.filter(_segments(_blocks(F.col("turns"))), lambda s: s["loss"] | (F.length(s["text"]) > 0)).alias("segments"))
    return cut.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chats(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: F.length(b) > 0)

    def turns(b: Column) -> Column:
        cut = F.locate("\n", b)
        role = _unescape_role(F.substring(b, F.lit(len(START) + 1), cut - len(START) - 1))
        return F.transform(F.split(F.substring(b, cut + 1, F.length(b)), r"<\|im_sep\|>"), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped text by text, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(chats: DataFrame) -> DataFrame:
    """What the check reads back out of formatted conversations."""
    read = chats.select("conv_id", "formatted", parse_chats(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("under"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(joined.cast("binary"), 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
