"""Chat formatting with relational operations and array expressions only.

A conversation becomes one text. Adjacent turns of one role form one block::

    <|im_start|>role\\ntext<|im_sep|>text<|im_end|>\\n

``<|im_sep|>`` stands between the turns of a block. Inside roles and texts every
``<`` + backslashes + ``|`` gets one backslash more, so no text can hold a control
string, and taking one backslash away restores it. In roles, backslashes are doubled
and line feeds become ``\\n``, so a role ends at its first line feed.

Edge cases: a NULL text or role counts as empty; rows of a NULL ``conv_id`` are one
conversation; turns sort by (turn, role, text), NULL first, so repeated rows and ties
have one order; a conversation without an assistant has no loss spans; an empty table
gives no rows; other columns are ignored.

Long conversations are formatted in pieces of ``CHUNK`` turn numbers spread over the
cluster; only finished pieces of text meet in the row that is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, SEPARATOR = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
CHUNK = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    doubled = F.replace(role, F.lit("\\"), F.lit("\\\\"))
    return escape(F.replace(doubled, F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    lines = F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(lines, "\\")


def format_chat(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds (start, end) of each text of ``trained_role`` in ``formatted``,
    in code points, end exclusive, without markers and separators.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    chunks = (
        conversations.select("conv_id", F.floor(F.col("turn") / CHUNK).alias("chunk"), turn.alias("t"))
        .groupBy("conv_id", "chunk")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("chunk"))
    last = F.element_at("turns", -1)["role"]
    linked = chunks.withColumns(
        {
            "before": F.lag(last).over(order),
            "after": F.lead(F.element_at("turns", 1)["role"]).over(order),
        }
    )
    pieces = linked.select("conv_id", "chunk", _piece(trained_role).alias("p"))
    ahead = F.sum(F.char_length("p.text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    shifted = pieces.withColumn("ahead", F.coalesce(ahead, F.lit(0)))
    spans = F.transform(
        "p.spans",
        lambda s: F.struct(
            (s["start"] + F.col("ahead")).alias("start"), (s["end"] + F.col("ahead")).alias("end")
        ),
    )
    whole = shifted.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(F.struct("chunk", F.col("p.text").alias("text"), spans.alias("spans")))
        ).alias("pieces")
    )
    return whole.select(
        "conv_id",
        F.array_join("pieces.text", "").alias("formatted"),
        F.flatten("pieces.spans").alias("loss_spans"),
    )


def _piece(trained_role: str) -> Column:
    """Text and loss spans of one chunk, merging adjacent turns of one role."""
    count = F.size("turns")

    def neighbours(t: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("before")).otherwise(F.get("turns", i - 1)["role"])
        after = F.when(i == count - 1, F.col("after")).otherwise(F.get("turns", i + 1)["role"])
        opens = F.coalesce(before != t["role"], F.lit(True))
        closes = F.coalesce(after != t["role"], F.lit(True))
        head = F.when(opens, F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
        return F.struct(
            head.otherwise(F.lit(SEPARATOR)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END + "\n")).otherwise(F.lit("")).alias("tail"),
            (t["role"] == trained_role).alias("trained"),
        )

    def merge(done: Column, part: Column) -> Column:
        start = F.char_length(done["text"]) + F.char_length(part["head"])
        end = start + F.char_length(part["body"])
        span = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))
        spans = F.when(part["trained"], F.concat(done["spans"], F.array(span)))
        return F.struct(
            F.concat(done["text"], part["head"], part["body"], part["tail"]).alias("text"),
            spans.otherwise(done["spans"]).alias("spans"),
        )

    empty = F.struct(
        F.lit("").alias("text"),
        F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
    )
    empty = F.struct(
        empty["text"].alias("text"),
        F.coalesce(empty["spans"], F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    )
    return F.aggregate(F.transform("turns", neighbours), empty, merge)


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), every block taken apart again."""

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        skipped = F.char_length(role) + 1
        body = block.substr(skipped + 1, F.char_length(block) - skipped - len(END) - 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>"),
            lambda text: F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text")),
        )

    blocks = F.split(formatted, r"<\|im_start\|>")
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.size(blocks)), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))),
        "",
    )
