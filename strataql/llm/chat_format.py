"""Chat formatting with typed content parts, in DataFrame functions alone.

A message is a list of parts: struct<type, text, ref, size>. A visitor flattens them in order: text
is escaped; image, audio and document parts become a placeholder ``<|type:i|>``, i counting
the attachments of the message, and are recorded with their reference and expanded token count
(size over the type's unit, rounded up). A turn reads ``<|turn|>role\\nbody<|end|>\\n``.

Escaping writes & as &amp;, < as &lt;, [ as &#91; (a line feed in a role as &#10;), so no control
string can occur inside a text, and is undone exactly.

Defined cases: null roles, texts and parts are empty; parts of unknown or null type are recorded as
``unknown`` with 0 tokens; turns go by turn number (null first), then role, then body; repeated
rows are turns each; a null conversation id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: units of size that make one token: pixels, audio samples, bytes
UNITS = {"image": 784, "audio": 640, "document": 4}
PART = "struct<type:string,text:string,ref:string,size:bigint>"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def escape(text: Column) -> Column:
    for plain, code in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    text = F.replace(text, F.lit("&#10;"), F.lit("\n"))
    for plain, code in reversed(_ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size")))


def attachments(parts: Column) -> Column:
    """array<struct<place, type, ref, tokens>> of the parts that aren't text, in order."""
    known = lambda p: F.when(p["type"].isin(*UNITS), p["type"]).otherwise("unknown")

    def tokens(p: Column) -> Column:
        out = F.lit(0).cast("long")
        for kind, unit in UNITS.items():
            out = F.when(p["type"] == kind, F.ceil(F.coalesce(p["size"], F.lit(0)) / unit)).otherwise(out)
        return out

    others = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: ~F.coalesce(p["type"] == "text", F.lit(False)))
    return F.transform(others, lambda p, i: F.struct(i.alias("place"), known(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))


def flatten_parts(parts: Column) -> Column:
    """The body of a message: escaped texts and placeholders, in order."""
    start = F.struct(F.lit("").alias("body"), F.lit(0).alias("n"))

    def visit(at: Column, p: Column) -> Column:
        is_text = F.coalesce(p["type"] == "text", F.lit(False))
        kind = F.when(p["type"].isin(*UNITS), p["type"]).otherwise("unknown")
        mark = F.concat(F.lit("<|"), kind, F.lit(":"), at["n"].cast("string"), F.lit("|>"))
        return F.struct(F.concat(at["body"], F.when(is_text, escape(F.coalesce(p["text"], F.lit("")))).otherwise(mark)).alias("body"), (at["n"] + F.when(is_text, 0).otherwise(1)).alias("n"))

    return F.aggregate(F.coalesce(parts, F.array().cast(f"array<{PART}>")), start, visit)["body"]


def format_conversations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, loss_mask (array<struct<start, length>> in code points) and attachments."""
    role = F.coalesce(F.col(role_col), F.lit(""))
    rows = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), flatten_parts(F.col(parts_col)).alias("body"),
        F.replace(escape(role), F.lit("\n"), F.lit("&#10;")).alias("name"), attachments(F.col(parts_col)).alias("attached"),
    )
    rows = rows.withColumn("segment", F.concat(F.lit(TURN), "name", F.lit("\n"), "body", F.lit(END)))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "body")
    length = F.char_length("segment").cast("long")
    rows = rows.withColumns({"at": F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0)) - length, "place": F.row_number().over(order)})
    start = F.col("at") + len(TURN) + F.char_length("name") + 1
    turns = F.array_sort(F.collect_list(F.struct("place", "segment", (F.col("role") == loss_role).alias("loss"), start.alias("start"), F.char_length("body").cast("long").alias("length"), "attached")))
    got = rows.groupBy("conv").agg(turns.alias("turns"))
    return got.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["attached"], lambda a: F.struct((t["place"] - 1).alias("turn"), a["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation; placeholders stay."""
    cut = F.split(formatted, r"<\|turn\|>")
    segments = F.slice(cut, F.lit(2), F.size(cut) - 1)
    newline = lambda s: F.instr(s, "\n")

    def parse(s: Column) -> Column:
        body = F.substr(s, newline(s) + 1, F.char_length(s) - newline(s) - len(END))
        return F.struct(unescape(F.substr(s, F.lit(1), newline(s) - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(segments, parse)


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """The text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss_mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
