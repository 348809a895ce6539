"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. A deterministic parser
reads the rendered text back: it splits at the start mark, demands exactly one end mark at the end of
each part, takes the role up to the first line end and undoes the escape. A turn whose reading differs
from its source is rendered again with its control strings escaped: one more backslash between ``<``
and ``|`` wherever only backslashes (or none) stand between them. The parser takes one off again. No text then
holds a control string, and reading gives back every text exactly. Backslashes and line ends in roles
are written ``\\\\`` and ``\\n``, as roles end at a line end.

Defined results: null role or text counts as empty; turns are ordered by turn, role, text, nulls first;
repeated rows are turns each; rows without conv_id are one conversation with a null id. A conversation
becomes one text, so it must fit in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.llm.common import before, chunks, cut, let

START, STOP = "<|im_start|>", "<|im_end|>"
_STUFFED, _UNSTUFFED = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _STUFFED, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNSTUFFED, "<$1|")


def _role_out(role: Column) -> Column:
    # by way of a sign for the backslash, so that the two steps cannot meet
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), _role_out(role), F.lit("\n"), text, F.lit(STOP + "\n"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, body, text, start, ok).

    ``body`` is the text as written, at code point ``start`` of the formatted text; ``ok`` is false where
    the grammar does not hold.
    """
    mark = F.lit(STOP + "\n")

    def turn(part: Column) -> Column:
        head = F.instr(part, "\n")
        body = F.substring(part, head + 1, F.greatest(F.length(part) - head - len(STOP) - 1, F.lit(0)))
        ok = (head > 0) & F.endswith(part, mark) & ~F.contains(body, F.lit(STOP)) & (F.length(part) >= head + len(STOP) + 1)
        return F.struct(_role_in(F.substring(part, F.lit(1), F.greatest(head - 1, F.lit(0)))).alias("role"), body.alias("body"), unescape(body).alias("text"), (F.length(part) + len(START)).alias("size"), head.alias("head"), ok.alias("ok"))

    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    # the first piece stands before the first mark and must be empty
    read = F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), turn)
    return F.when(F.get(pieces, F.lit(0)) == "", read).otherwise(F.slice(read, 1, 0))


def _same(parsed: Column, role: Column, text: Column) -> Column:
    first = F.get(parsed, F.lit(0))
    return (F.size(parsed) == 1) & F.coalesce(first["ok"] & (first["role"] == role) & (first["text"] == text), F.lit(False))


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, identical): each conversation as one text, and its turns read back.

    ``turns`` has role, text and the span of the text in the formatted text (``start``, ``length``; code
    points); ``identical`` says that reading gave the source back.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = rows.withColumn("_plain", render_turn(F.col("role"), F.col("text")))
    checked = plain.withColumn("_same", let(parse(F.col("_plain")), lambda p: _same(p, F.col("role"), F.col("text"))))
    written = checked.select("conv_id", F.struct("turn", "role", "text", F.when(F.col("_same"), F.col("_plain")).otherwise(render_turn(F.col("role"), escape(F.col("text")))).alias("out")).alias("t"))
    whole = written.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("source"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("source", lambda t: t["out"]), ""))
    read = whole.withColumn("_read", parse(F.col("formatted")))
    # the parts' sizes give each text's place; arrays are zipped, so that each is made once per conversation
    places = before(F.transform("_read", lambda t: t["size"]))
    turns = F.zip_with("_read", places, lambda t, at: F.struct(t["role"].alias("role"), t["text"].alias("text"), (at + len(START) + t["head"]).alias("start"), F.length(t["body"]).alias("length")))
    gave_back = F.forall("_read", lambda t: t["ok"]) & (F.transform("_read", lambda t: F.struct(t["role"], t["text"])).cast("array<struct<role:string,text:string>>") == F.transform("source", lambda t: F.struct(t["role"], t["text"])).cast("array<struct<role:string,text:string>>"))
    return read.select("conv_id", "formatted", turns.alias("turns"), gave_back.alias("identical"))


def loss_spans(turns: Column) -> Column:
    """Spans of the formatted text that count for the loss: the texts of assistant turns."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"], t["length"]))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The text of the spans, unescaped, in order, with nothing between."""
    return let(chunks(formatted), lambda parts: F.array_join(F.transform(spans, lambda s: unescape(cut(parts, s["start"], s["start"] + s["length"]))), ""))
