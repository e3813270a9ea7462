r"""Chat formatting by Spark expressions alone.

The turns of a conversation are collected as structs and sorted; neighbouring turns of one role
become one block, by arrays of places; the blocks are joined to a text:

    <turn user>first text<more/>second text of the same role</turn>
    <turn assistant>its answer</turn>

Inside texts and roles `\` is written `\s`, the `<` of a control string (`<turn`, `</turn`,
`<more/`) `\l`, and the `>` of a role `\g`; as no escape holds the lead of another, three
replacements in any text give it back. `segments` is the same text in pieces, each with its loss
mask: true for the texts of the assistant, false for all else.

Every step is linear in the turns of a conversation, and escapes are made before rows are
shuffled. A conversation is one text, so its turns meet in one task, as its text does.

Defined cases: a null text or role is empty; turns of the same number are ordered by role, then
text, null numbers first; repeated rows are turns of their own; a row without conv_id belongs to
no conversation and is formatted alone (so such rows are never collected); an empty table gives
no rows. Columns beyond conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARNED = "assistant"
CONTROL = r"<(/?turn|more/)"
START, ROLE_END, MORE, END = "<turn ", ">", "<more/>", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\s")), CONTROL, r"\\l$1")


def plain(text: Column) -> Column:
    """What escaped() was given."""
    text = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(text, F.lit("\\s"), F.lit("\\"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, and segments: array<struct<text, loss>>, whose texts make up `formatted`."""
    turn = rows.select("conv_id", F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    turn = turn.select("conv_id", F.struct("t.turn", "t.role", F.col("t.text").alias("by"), escaped(F.col("t.text")).alias("text"),
                                           F.replace(escaped(F.col("t.role")), F.lit(">"), F.lit("\\g")).alias("mark")).alias("t"))
    known = (turn.where(F.col("conv_id").isNotNull()).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list("t")).alias("turns")))
    alone = turn.where(F.col("conv_id").isNull()).select("conv_id", F.array("t").alias("turns"))
    found = known.unionByName(alone)
    # places where the role changes; each begins a block
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    first = F.filter(places, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    found = found.select("conv_id", "turns", first.alias("first"))
    blocks = F.transform("first", lambda i, k: F.struct(
        F.get("turns", i)["role"].alias("role"), F.get("turns", i)["mark"].alias("mark"),
        F.transform(F.slice("turns", i + 1, F.coalesce(F.get("first", k + 1), F.size("turns")) - i), lambda t: t["text"]).alias("texts")))
    found = found.select("conv_id", blocks.alias("blocks"))
    return found.select("conv_id", _joined(F.flatten(F.transform("blocks", _segments))).alias("segments")).select(
        "conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def _segments(block: Column) -> Column:
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    texts = F.transform(block["texts"], lambda t, i: F.array(
        piece(F.when(i == 0, F.concat(F.lit(START), block["mark"], F.lit(ROLE_END))).otherwise(F.lit(MORE)), no),
        piece(t, block["role"] == LEARNED)))
    return F.concat(F.flatten(texts), F.array(piece(F.lit(END), no)))


def _joined(segments: Column) -> Column:
    return F.filter(segments, lambda s: s["text"] != "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted text holds, as they were given."""
    blocks = F.filter(F.split(formatted, END, -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.substr(b, F.instr(b, ROLE_END) + 1), MORE, -1),
        lambda t: F.struct(plain(F.substring_index(F.substr(b, F.lit(len(START) + 1)), ROLE_END, 1)).alias("role"),
                           plain(t).alias("text")))))


def read_loss(segments: Column) -> Column:
    """The texts under the loss mask, one after the other."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: plain(s["text"])), "")
