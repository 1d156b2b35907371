"""Operator 8: chat formatting with a grammar round trip, in DataFrame operations only.

Grammar: a line ``#0`` or ``#1`` (the escape level), then for each turn
``<s>`` role ``[INST]`` text ``[/INST]</s>``; no role or text contains one of the four control strings.
A conversation is rendered plainly, parsed again by the same deterministic parser that readers use,
and compared with its source. Where the two differ, because a text holds control strings, it is
rendered at the next level, where ``\\``, ``<`` and ``[`` become ``\\b``, ``\\l`` and ``\\k``: no
control string can be left, so that level always parses back to the source.

A conversation is the unit of the format and of its digest, so one task holds its turns, as it must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagwise.plans.scratch import materialize

_SWAPS = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"))


def _escape(c: Column) -> Column:
    for plain, mark in _SWAPS:
        c = F.replace(c, F.lit(plain), F.lit(mark))
    return c


def _unescape(c: Column) -> Column:
    for plain, mark in reversed(_SWAPS):
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def render(turns: Column, level: int) -> Column:
    """An array of (role, text) as one string."""
    own = _escape if level else lambda c: c
    each = F.transform(turns, lambda t: F.concat(F.lit("<s>"), own(t["role"]), F.lit("[INST]"), own(t["text"]), F.lit("[/INST]</s>")))
    return F.concat(F.lit(f"#{level}\n"), F.array_join(each, ""))


def parse(formatted: Column) -> Column:
    """The array of (role, text) of a rendered string. Text outside the grammar is not kept, so it shows in a comparison."""
    level = F.substring(formatted, 2, 1)
    pieces = F.split(F.substring(formatted, F.lit(4), F.length(formatted)), "</s>", -1)
    pieces = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        inner = F.substring_index(piece, "<s>", -1)
        role, text = F.substring_index(inner, "[INST]", 1), F.substring_index(F.substring_index(inner, "[INST]", -1), "[/INST]", 1)
        escaped = level == "1"
        return F.struct(F.when(escaped, _unescape(role)).otherwise(role).alias("role"), F.when(escaped, _unescape(text)).otherwise(text).alias("text"))

    return F.transform(pieces, turn)


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, formatted), one row per conversation.

    Turns go by ``turn_col`` (nulls first), equal ones by role, then text; repeated rows are turns of
    their own. Null roles and texts count as empty. Rows with a null conversation form one of their
    own. An empty table gives no conversation. Other columns are ignored.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    grouped = df.select(F.col(conv_col).cast("long").alias("conv"), row.alias("row")).groupBy("conv").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    grouped = grouped.select("conv", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns"))
    plain = grouped.withColumn("plain", render(F.col("turns"), 0))
    same = plain.withColumn("same", parse(F.col("plain")) == F.col("turns"))
    return same.select("conv", F.when(F.col("same"), F.col("plain")).otherwise(render(F.col("turns"), 1)).alias("formatted"))


def read_chats(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Parse (conv, formatted): turns, their digest, and the length and digest of the text under the loss mask."""
    parsed = formatted.select("conv", parse(F.col("formatted")).alias("turns"), F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: t["text"]), "")
    parsed = parsed.select("conv", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), "formatted_chars")
    return parsed.select("conv", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def chat_round_trip(df: DataFrame, conv_col: str = "conv_id", **columns: str) -> DataFrame:
    """Format, write, and read back: ``conv_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    written = materialize(format_chats(df, conv_col, **columns), "chats")
    return read_chats(written).withColumnRenamed("conv", conv_col)
