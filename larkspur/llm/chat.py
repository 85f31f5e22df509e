"""Chat formatting by a grammar round trip, in DataFrame expressions only.

A conversation is rendered as one string: for each turn ``<|im_start|>role\\ntext<|im_end|>\\n``. A deterministic
parser (split at every end mark, demand one start mark at the head of each part and no control string, ``<|``, further
in, cut at the first line break, undo escapes) reads the string back. Where what it reads differs from the source, the
conversation is rendered again with its texts and roles escaped. Escapes are reversible for every string, so the second
rendering is identical; it is an error if it isn't. So no ``<|`` is left in a rendered string but those of the marks.

Undoing escapes is part of the grammar at both levels, so the reader needs no flag.

The loss mask is part of the output: ``loss_spans`` are the places, in code points of the string, of the texts of
``LOSS_ROLES``, without marks, role or line break. ``chat_digests`` reads the text under it out of the string.

Turns are ordered by turn (null last), then role, then text, so ties give one result; repeated rows stay. Null text
or role is empty. A null conversation id is one conversation. An empty table gives an empty result. One conversation
becomes one string, so its turns have to meet in one row, and finding its spans takes steps in the square of its turns;
other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Every control string begins so.
CONTROL = "<|"
#: Roles whose texts are under the loss mask.
LOSS_ROLES = ("assistant",)
#: What is put for what, in order of use; undone in the opposite order.
ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))


def _replace(value: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, value)


def escaped(value: Column, role: bool = False) -> Column:
    return _replace(value, (*ESCAPES, *([("\n", "&nl;")] if role else [])))


def unescaped(value: Column, role: bool = False) -> Column:
    return _replace(value, ([("&nl;", "\n")] if role else []) + [(b, a) for a, b in reversed(ESCAPES)])


def render(turns: Column, level: int) -> Column:
    """The conversation's string. Level 0 writes as it is; level 1 escapes."""
    write = (lambda x, role: escaped(x, role)) if level else (lambda x, role: x)
    one = lambda t: F.concat(F.lit(START), write(t["role"], True), F.lit("\n"), write(t["text"], False), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


HEAD = "\n" + START


def _parts(formatted: Column) -> Column:
    """The string's parts up to each end mark, each begun by a line break."""
    parts = F.split(F.concat(F.lit("\n"), formatted), r"<\|im_end\|>")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def _body(part: Column) -> tuple[Column, Column]:
    """What follows a part's start mark, and where its first line break is."""
    body = F.substring(part, F.lit(len(HEAD) + 1), F.length(part))
    return body, F.instr(body, "\n")


def parse(formatted: Column) -> Column:
    """Array of (role, text) of a rendered string; a part that breaks the grammar gives null, as no source has."""

    def one(part: Column) -> Column:
        body, at = _body(part)
        turn = F.struct(
            unescaped(F.substring(body, F.lit(1), at - 1), True).alias("role"),
            unescaped(F.substring(body, at + 1, F.length(body))).alias("text"),
        )
        return F.when(part.startswith(HEAD) & (at > 0) & ~F.contains(body, F.lit(CONTROL)), turn)

    return F.transform(_parts(formatted), one)


SPANS = "array<struct<start:int,length:int>>"


def loss_spans(formatted: Column) -> Column:
    """(start, length) of the texts under the loss mask, in order; start counts from 0."""
    state = f"struct<at:int,spans:{SPANS}>"
    begun = F.struct(F.lit(-1).alias("at"), F.array().cast(SPANS).alias("spans")).cast(state)

    def step(held: Column, part: Column) -> Column:
        body, line = _body(part)
        span = F.struct((held["at"] + len(HEAD) + line).alias("start"), (F.length(body) - line).alias("length"))
        counts = unescaped(F.substring(body, F.lit(1), line - 1), True).isin(*LOSS_ROLES)
        spans = F.when(counts, F.concat(held["spans"], F.array(span))).otherwise(held["spans"])
        return F.struct((held["at"] + F.length(part) + len(END)).alias("at"), spans.alias("spans")).cast(state)

    return F.aggregate(_parts(formatted), begun, step)["spans"]


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: ``conv_col``, formatted (the string), loss_spans, parsed (turns read back) and escape_level."""
    one = F.struct(
        F.col(turn_col).isNull().alias("last"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    source = turns.groupBy(F.col(conv_col)).agg(F.array_sort(F.collect_list(one)).alias("t"))
    source = source.select(conv_col, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    tried = source.withColumn("plain", render(F.col("source"), 0))
    tried = tried.withColumn("level", F.when(parse(F.col("plain")) == F.col("source"), 0).otherwise(1))
    out = tried.withColumn("formatted", F.when(F.col("level") == 0, F.col("plain")).otherwise(render(F.col("source"), 1)))
    # assert_true: a rendering that doesn't read back as its source must never leave the operator
    parsed = out.withColumn("parsed", parse(F.col("formatted")))
    held = F.when(F.col("parsed") == F.col("source"), F.col("parsed")).otherwise(F.raise_error(F.lit("a rendered conversation does not read back")).cast(parsed.schema["parsed"].dataType))
    return parsed.select(conv_col, "formatted", loss_spans(F.col("formatted")).alias("loss_spans"), held.alias("parsed"), F.col("level").alias("escape_level"))


def chat_digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Turn count, digest of the turns, and length and digest of the text that the string holds under the loss mask."""
    whole = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("*", F.array_join(under, "").alias("_loss")).select(
        conv_col,
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.array_join(F.transform("loss_spans", lambda s: F.concat_ws("+", s["start"], s["length"])), ",").alias("loss_mask"),
        F.col("escape_level"),
    )
