"""Chat formatting with a grammar round trip.

A conversation is rendered as one text by a fixed grammar:

    conversation = { turn }
    turn         = "<s>[INST]" role "[/INST]" text "</s>"

The text is read back by a parser of this grammar and compared with the source; what does not
come back identical is escaped and rendered again. An escape puts a backslash behind the opening
bracket of a control string, or one more where some are there already; the parser takes one away.
So escaping is reversible, texts without control strings stay as they are, and no escaped
text holds a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\])"
_ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, r"$1$2$3")


def rendered(turns: Column) -> Column:
    """The conversation's text from its turns (structs of role and text)."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), ""
    )


def _cut(text: Column, mark: str) -> tuple[Column, Column]:
    """What comes before and after the first mark."""
    before = F.substring_index(text, mark, 1)
    return before, F.substring(text, F.length(before) + len(mark) + 1, F.length(text))


def raw_turns(text: Column) -> Column:
    """The turns as they stand in the text, still escaped."""
    pieces = F.split(text, OPEN.replace("[", r"\[").replace("]", r"\]"), -1)

    def turn(piece: Column) -> Column:
        role, rest = _cut(piece, MIDDLE)
        return F.struct(role.alias("role"), _cut(rest, CLOSE)[0].alias("text"))

    return F.transform(F.filter(pieces, lambda piece, i: i > 0), turn)


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation."""
    plain = lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
    return F.transform(raw_turns(text), plain)


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """Start (from 0) and length, in code points, of the texts that the role has to learn."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begins = state["at"] + len(OPEN) + F.length(turn["role"]) + len(MIDDLE)
        span = F.array(F.struct(begins.alias("start"), F.length(turn["text"]).alias("length")))
        ends = begins + F.length(turn["text"]) + len(CLOSE)
        spans = F.when(unescape(turn["role"]) == role, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(ends.alias("at"), spans.alias("spans"))

    return F.aggregate(raw_turns(text), start, step, lambda state: state["spans"])


def masked(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` for rows of (conv_id, turn, role, text).

    Turns stand in the order of ``turn``, null first; of equal numbers in that of role and text, and
    repeated rows are repeated turns. Null roles and texts count as empty, a null ``conv_id`` is a
    conversation of its own. Further columns are ignored. A conversation is one training record
    and so has to fit one row, however many conversations there are.
    """
    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    row = F.struct("turn", empty("role"), empty("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    chats = chats.withColumn("_turns", F.transform("_rows", lambda t: F.struct(t["role"], t["text"])))
    chats = chats.withColumn("formatted", rendered(F.col("_turns")))
    # A pass escapes what does not come back; one is always enough, and the last test proves it.
    chats = chats.withColumn("_back", parsed(F.col("formatted")))
    safe = F.transform(
        "_turns",
        lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")),
    )
    chats = chats.withColumn(
        "formatted", F.when(F.col("_back") == F.col("_turns"), F.col("formatted")).otherwise(rendered(safe))
    )
    same = F.coalesce(parsed(F.col("formatted")) == F.col("_turns"), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("a conversation does not come back: "), F.col("conv_id").cast("string")))
    chats = chats.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(wrong))
    return chats.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"))
