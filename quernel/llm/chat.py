"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts (type, text, ref, tokens). A visitor flattens them in order: a text part gives its
escaped text, any other known type a placeholder `<image:1>` with a running number in the turn; the attachment's
reference, type and expanded token count are recorded beside the text. The template of a turn is

    ### role:\\n content \\n</turn>\\n

In roles and texts a backslash goes before every backslash, `#`, `<` and `:`-in-a-role, so neither a mark nor a placeholder
can stand in them, and dropping each escaping backslash restores them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, HEAD_END, TURN_END = "### ", ":\n", "\n</turn>\n"
ATTACHMENTS = ("image", "audio", "document")

PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column, chars: str = r"\\#<") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"([{chars}])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(parts: Column) -> Column:
    """struct(content, attachments, expanded): parts in order; null parts and parts of unknown type give nothing."""
    start = F.struct(F.lit("").alias("content"), F.array().cast("array<struct<n:int,type:string,ref:string,tokens:int>>").alias("attachments"), F.lit(0).cast("long").alias("expanded"))

    def step(acc: Column, part: Column) -> Column:
        n = F.size(acc["attachments"]) + 1
        attached = F.coalesce(part["type"].isin(*ATTACHMENTS), F.lit(False))
        mark = F.concat(F.lit("<"), part["type"], F.lit(":"), n.cast("string"), F.lit(">"))
        text = F.when(attached, mark).when(part["type"] == "text", escape(part["text"])).otherwise("")
        one = F.struct(n.alias("n"), part["type"].alias("type"), part["ref"].alias("ref"), part["tokens"].alias("tokens"))
        return F.struct(
            F.concat(acc["content"], text).alias("content"),
            F.when(attached, F.concat(acc["attachments"], F.array(one))).otherwise(acc["attachments"]).alias("attachments"),
            (acc["expanded"] + F.when(attached, F.coalesce(part["tokens"], F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))).alias("expanded"),
        )

    return F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), start, step)


def as_parts(text: Column) -> Column:
    """A plain text as one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None) -> DataFrame:
    """(conv_id, formatted, loss_spans, attachments, expanded_tokens) for each conversation.

    turns has a row per turn; parts is its content (by default its column `text`). Rows go by turn (null first), then
    role, then content, so ties have an order; repeated rows stay. A null role or text is empty. loss_spans holds
    (start, length) of each assistant content in code points, from 0. A conversation becomes one string, so its rows
    meet in one task; conversations are spread evenly by a hash of their id. Other columns are not read; an empty
    table gives an empty result.
    """
    content = visit(as_parts(F.col("text")) if parts is None else parts)
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), content.alias("c"))
    rows = rows.select("conv_id", F.struct("turn", "role", F.col("c.content").alias("content"), F.col("c.attachments").alias("attachments"), F.col("c.expanded").alias("expanded")).alias("row"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    head = lambda r: F.concat(F.lit(HEAD), escape(r["role"], r"\\#<:"), F.lit(HEAD_END))
    whole = F.transform("rows", lambda r: F.concat(head(r), r["content"], F.lit(TURN_END)))
    no_span = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, r: Column) -> Column:
        at = acc["at"] + F.length(head(r))
        span = F.struct(at.alias("start"), F.length(r["content"]).alias("length"))
        return F.struct((at + F.length(r["content"]) + len(TURN_END)).alias("at"), F.when(r["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    walked = F.aggregate("rows", F.struct(F.lit(0).alias("at"), no_span.alias("spans")), step)
    zero = F.lit(0).cast("long")
    return chats.select(
        "conv_id",
        F.array_join(whole, "").alias("formatted"),
        walked["spans"].alias("loss_spans"),
        F.transform("rows", lambda r: r["attachments"]).alias("attachments"),
        F.aggregate("rows", zero, lambda a, r: a + r["expanded"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation; placeholders stay as text."""
    pieces = F.split(formatted, TURN_END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    pattern = r"(?s)^### ((?:[^\\:]|\\.)*+):\n(.*)$"
    part = lambda p, k: unescape(F.regexp_extract(p, pattern, k))
    return F.transform(pieces, lambda p: F.struct(part(p, 1).alias("role"), part(p, 2).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What reads back from format_chats' output, as counts and digests."""
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    read = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
