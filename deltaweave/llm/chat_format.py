"""Operator 1: chat formatting by a grammar round trip.

A turn is rendered as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. A deterministic
parser reads a rendering back: a turn begins at each start mark and must end at the
first end mark after it, with its line break and nothing more; the role ends at the
first line break, and in role and text one backslash is taken from every run of
backslashes between ``<`` and ``|``. What doesn't follow this grammar is read as a null
turn. Each turn is first rendered as it is and parsed; while the parser doesn't give
back the same turn, more of it is escaped and the result is parsed again: first the
runs between ``<`` and ``|`` (one more backslash in each), then also the line breaks of
the role (``<|nl|>``). A turn that still differed, or a conversation whose parse
did, would stop the job instead of passing silently.

All of it is built-in Spark expressions: a row for each turn until the last
step, a running window for the places of turns, one aggregation to conversations.

Defined results: null role or text is the empty string; rows come by turn, null
turns first, ties by role and then text; a null conv_id is a conversation; an
empty table gives an empty table. Extra columns of the input are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
_TAIL = END + "\n"


def escape(text: Column) -> Column:
    """One more backslash in each run between ``<`` and ``|``, which no control string then matches."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(_TAIL))


def _turn(piece: Column) -> Column:
    """A turn from what follows a start mark; null where that isn't a role, a text and one end mark."""
    cut, end = F.instr(piece, "\n"), F.instr(piece, END)
    role = F.substring(piece, F.lit(1), cut - 1)
    body = F.substring(piece, cut + 1, end - cut - 1)
    turn = F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(body).alias("text"))
    return F.when((cut > 0) & (end > cut) & (F.char_length(piece) - end + 1 == len(_TAIL)) & F.endswith(piece, F.lit(_TAIL)), turn)


def parse(formatted: Column) -> Column:
    """The turns of a rendering as an array of (role, text), null where one doesn't follow the grammar."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    return F.transform(F.slice(pieces, 2, F.size(pieces) - 1), _turn)


def reads_back(role: Column, text: Column, safe_role: Column, safe_text: Column) -> Column:
    """Whether the rendering of a turn is parsed to that turn alone."""
    back = parse(render(safe_role, safe_text))
    turn = F.get(back, 0)
    return (F.size(back) == 1) & F.coalesce((turn["role"] == role) & (turn["text"] == text), F.lit(False))


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn_role: str = "assistant") -> DataFrame:
    """A row for each turn: its number, its rendering, its place and its learned span in the conversation."""
    source = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    forms = [(role, text), (escape(role), escape(text)), (F.regexp_replace(escape(role), "\n", BREAK), escape(text))]
    form = F
    for k, shown_as in enumerate(forms):
        form = form.when(reads_back(role, text, *shown_as), k)
    form = form.otherwise(F.raise_error(F.concat(F.lit("a turn does not parse back: "), role)).cast("int"))
    of_form = lambda i: F.when(F.col("form") == 0, forms[0][i]).when(F.col("form") == 1, forms[1][i]).otherwise(forms[2][i])
    shown = source.withColumn("form", form).withColumns({"safe_role": of_form(0), "safe_text": of_form(1)})
    shown = shown.withColumns({"piece": render(F.col("safe_role"), F.col("safe_text")), "escaped": F.col("form") > 0})
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("piece").cast("long")
    at = F.coalesce(F.sum(size).over(before), F.lit(0).cast("long"))
    within = F.char_length("safe_role").cast("long") + 1
    placed = shown.withColumns({"n": F.row_number().over(order), "at": at})
    span = F.struct(
        (F.col("at") + len(START) + within).alias("start"), F.char_length("safe_text").cast("long").alias("length"),
        F.col("n").alias("turn"), within.alias("within"),
    )
    return placed.withColumn("span", F.when(F.col("role") == learn_role, span))


def format_conversations(rows: DataFrame, **columns) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans, n_escaped): one row for each conversation.

    ``turns`` are read back from ``formatted``; ``loss_spans`` are the places
    there, in code points, of the texts to learn from.
    """
    turns = format_turns(rows, **columns)
    item = F.struct("n", "piece", F.struct("role", "text").alias("source"), "span", "escaped")
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    made = grouped.select(
        "conv_id",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.transform("items", lambda x: x["source"]).alias("source"),
        F.filter(F.transform("items", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.size(F.filter("items", lambda x: x["escaped"])).cast("long").alias("n_escaped"),
    )
    made = made.withColumn("turns", parse(F.col("formatted")))
    wrong = F.raise_error(F.concat(F.lit("a conversation does not parse back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    checked = F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(wrong)
    return made.select("conv_id", "formatted", checked.alias("turns"), "loss_spans", "n_escaped")


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, read from the rendering and unescaped.

    A span also says in which piece of the rendering it lies and where there:
    cutting at each span's place from the start of a long conversation would
    take time in the square of its length.
    """
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    cut = lambda s: F.substring(F.get(pieces, s["turn"]), (s["within"] + 1).cast("int"), s["length"].cast("int"))
    return F.array_join(F.transform(spans, lambda s: unescape(cut(s))), "")
