"""Chat formatting by a grammar round trip, in DataFrame functions only.

A conversation is rendered as one string, turn after turn: a header that names the role, the text, and
``</s>``. A deterministic parser reads it back. Where the recovered turns differ from the source, the
content that conflicts with the grammar is escaped, and the result is parsed and compared again; a
conversation that still differed would be an error.

Control strings are ``</s>``, ``[INST]``, ``[/INST]``, ``[SYS]``, ``[/SYS]``, ``[ROLE]`` and ``[/ROLE]``. Escaping puts a
backslash behind the first character of each, also of those that already have backslashes there;
the parser takes one backslash out again. So escaping is reversible for every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed strings of the template.
HEADERS = {"user": "[INST]", "assistant": "[/INST]", "system": "[SYS]"}
OTHER, OTHER_END, END = "[ROLE]", "[/ROLE]", "</s>"

REST = r"(?:/?(?:INST|SYS|ROLE)\]|/s>)"
CONTROL = rf"[\[<]{REST}"
ESCAPABLE = rf"([\[<])(\\*+{REST})"
ESCAPED = rf"([\[<])\\(\\*+{REST})"

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def render(turns: Column, escaped: bool) -> Column:
    """One string for an array of (role, text)."""
    safe = escape if escaped else lambda c: c

    def turn(t: Column) -> Column:
        header = F.concat(F.lit(OTHER), safe(t["role"]), F.lit(OTHER_END))
        for role, mark in HEADERS.items():
            header = F.when(t["role"] == role, F.lit(mark)).otherwise(header)
        return F.concat(header, safe(t["text"]), F.lit(END))

    return F.array_join(F.transform(turns, turn), "")


def parse(formatted: Column) -> Column:
    """The turns of a rendered string as (role, text, loss); a turn that breaks the grammar has a null text.

    ``loss`` marks the turns whose text is under the loss mask: those of the assistant.
    """
    pieces = F.split(formatted, F.lit(END), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        other = F.regexp_extract(piece, r"^\[ROLE\]((?s:.*?))\[/ROLE\]", 1)
        role, size = F.when(piece.startswith(OTHER), unescape(other)), F.length(other) + len(OTHER + OTHER_END)
        for name, mark in HEADERS.items():
            role = F.when(piece.startswith(mark), F.lit(name)).otherwise(role)
            size = F.when(piece.startswith(mark), F.lit(len(mark))).otherwise(size)
        body = F.substr(piece, size + 1)
        broken = F.rlike(body, F.lit(CONTROL)) | F.rlike(other, F.lit(CONTROL)) | role.isNull()
        return F.struct(role.alias("role"), F.when(~broken, unescape(body)).alias("text"), (role == "assistant").alias("loss"))

    return F.transform(pieces, turn)


def _plain(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted, turns)`` per conversation; ``turns`` is read back from ``formatted`` with its loss mask.

    Turns are ordered by ``turn``, equal ones by role and text; repeated rows are turns of their own; a
    null turn comes first. Null role or text count as empty, any role is possible. Rows without conv_id
    make up one conversation without id. No rows give no rows; other columns are not read. A
    conversation is one output value, so its turns meet in one task.
    """
    rows = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"], F.lit("")).alias("role"), F.coalesce(conversations["text"], F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("source"))
    source = grouped.select("conv_id", _plain(F.col("source")).alias("source"))
    first = source.withColumn("formatted", render(F.col("source"), escaped=False))
    same = F.coalesce(_plain(parse(F.col("formatted"))) == F.col("source"), F.lit(False))
    second = first.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(render(F.col("source"), escaped=True)))
    read = second.withColumn("turns", parse(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    same = F.coalesce(_plain(F.col("turns")) == F.col("source"), F.lit(False))
    return read.select("conv_id", "formatted", F.when(same, F.col("turns")).otherwise(wrong).alias("turns"))


def digest(conversations: DataFrame) -> DataFrame:
    """Per conversation: number of turns and digests of what is read back from its formatted string."""
    done = format_conversations(conversations)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return (done.withColumns({"lines": lines, "loss": loss})
                .select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("lines", 256).alias("turns_sha256"),
                        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars")))


def with_example(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose two turns both consist of control strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    example = conversations.sparkSession.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), said.alias("text")),
        F.struct(F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), said.alias("text")))))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(example)


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[\[<]\\*(/?(INST|SYS|ROLE)\]|/s>)')) + 4
    + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5
      ELSE 13 + length(role) + len(regexp_extract_all(role, '[\[<]\\*(/?(INST|SYS|ROLE)\]|/s>)')) END AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""
