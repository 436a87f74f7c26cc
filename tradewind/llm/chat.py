"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered as ``<|im_start|>role NL text<|im_end|> NL`` per turn.  ``parse`` is the
deterministic parser of that grammar: the control strings cut the text into pieces, every piece must be
one closed turn, and the escapes are undone.  A turn is first rendered as it is and parsed; where the
parser does not give back the very same role and text (or fails), the conflicting content is escaped.
The whole conversation is parsed again at the end and compared with its source; a difference would be
an error.

Escapes: in a text every ``<``, backslashes, ``|`` gets one more backslash, so no control string is
left; in a role ``%``, ``<`` and line breaks are percent-encoded.  Both are undone exactly.

A conversation is one value, so its turns meet in one task, as its digests need them to; nothing
else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a rendered conversation; null elements where a piece is no closed turn."""
    pieces = F.split(formatted, r"<\|im_start\|>", -1)
    turns = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), _parse_piece)
    return F.when(pieces[0] == "", turns).otherwise(F.array(F.lit(None).cast("struct<role:string,text:string>")))


def _parse_piece(piece: Column) -> Column:
    halves = F.split(piece, r"<\|im_end\|>", -1)
    body = halves[0]
    line = F.instr(body, F.lit("\n"))
    closed = (F.size(halves) == 2) & (halves[F.size(halves) - 1] == "\n") & (line > 0)
    return F.when(closed, F.struct(unescape_role(F.substring(body, F.lit(1), line - 1)).alias("role"),
                                   unescape_text(F.substring(body, line + 1, F.length(body))).alias("text")))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learned_role: str = LEARNED_ROLE) -> DataFrame:
    """(conv_col, n_turns, formatted, loss_spans): one row per conversation.

    ``loss_spans``: array<struct<start, size>>, the UTF-8 byte ranges of ``formatted`` that hold texts of
    ``learned_role``, in order.  Null texts and roles count as empty; a null turn comes first; equal
    turns go by role, then text; repeated rows are turns of their own; rows with a null conversation id
    form one conversation.  Other columns are not read.
    """
    turns = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    same = F.coalesce(parse(render(F.col("role"), F.col("text"))) == F.array(F.struct("role", "text")), F.lit(False))
    turns = turns.withColumn("as_is", same)
    turns = turns.withColumns({"role_out": F.when(F.col("as_is"), F.col("role")).otherwise(escape_role(F.col("role"))),
                               "text_out": F.when(F.col("as_is"), F.col("text")).otherwise(escape_text(F.col("text")))})
    turns = turns.withColumn("rendered", render(F.col("role_out"), F.col("text_out")))
    before = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.octet_length("rendered").cast("bigint")).over(before), F.lit(0).cast("bigint")))
    learned = F.when(F.col("role") == learned_role, F.struct(
        (F.col("at") + len(START) + F.octet_length("role_out") + 1).alias("start"), F.octet_length("text_out").cast("bigint").alias("size")))
    whole = turns.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "role", "text", "rendered", learned.alias("loss")))).alias("turns"))
    out = whole.select(
        "conv", F.size("turns").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"].isNotNull()), lambda t: t["loss"]).alias("loss_spans"),
        F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    agreed = F.coalesce(parse(F.col("formatted")) == F.col("source"), F.lit(False))
    return out.select(F.col("conv").alias(conv_col), "n_turns",
                      F.when(agreed, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns"))).alias("formatted"),
                      "loss_spans")


def loss_text(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    data = formatted.cast("binary")
    return F.array_join(F.transform(loss_spans, lambda s: unescape_text(
        F.decode(F.substring(data, (s["start"] + 1).cast("int"), s["size"].cast("int")), "UTF-8"))), "")
