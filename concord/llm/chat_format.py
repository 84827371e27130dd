"""Chat formatting of typed content parts, in DataFrame functions only.

A turn's content is an array of typed parts (``PART``).  A visitor flattens the
parts in order: text is escaped, an image, audio or document part becomes a
numbered placeholder, its reference and the number of model tokens that the
placeholder stands for are recorded.  A turn is written as

    <|im_start|>ROLE
    BODY<|im_end|>

Control strings begin with ``<|``.  In texts, ``<`` followed by any number of
backslashes and ``|`` gets one more backslash, so no text can open a control
string, and taking one backslash away gives the text back.  In roles, a
backslash and a line feed are written ``\\\\`` and ``\\n`` as well.

Defined cases: null text, role or part is empty; a part of unknown type is a
placeholder of 0 tokens; turns are ordered by (turn, role, text), null first,
repeated rows stay; a null conv_id is a conversation; no rows give no rows.
A conversation is one output row, so it is gathered in one task; its turns are
formatted before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
START, END, FEED = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
PATCH = 28                     # image pixels a side for one token
AUDIO_RATE = 25                # tokens a second
PAGE_TOKENS = 256              # tokens a document page


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(FEED))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(FEED), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A plain text as one text part."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *none))


def tokens_of(p: Column) -> Column:
    """Model tokens that a part's placeholder stands for; text has none."""
    sides = F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH)
    return (F.when(p["type"] == "image", sides)
            .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
            .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(0)).cast("long")


def is_text(p: Column) -> Column:
    return p.isNull() | F.coalesce(p["type"] == "text", F.lit(True))


def format_turns(rows: DataFrame, tie: str = "text") -> DataFrame:
    """One row per conversation from (conv_id, turn, role, ``tie``, parts): formatted,
    n_turns, loss_mask (which turns' bodies are learned), attachments, attachment_tokens."""
    flat = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.col(tie).alias("tie"), "parts")
    flat = flat.withColumn("files", F.filter("parts", lambda p: ~is_text(p)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    before = F.coalesce(F.sum(F.coalesce(F.size("files"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = flat.withColumns({"place": F.row_number().over(order), "n_before": before})

    def visit(p: Column, k: Column) -> Column:
        number = F.col("n_before") + F.size(F.filter(F.slice("parts", 1, k), lambda q: ~is_text(q))) + 1
        name = F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("other")
        return F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), name, F.lit("_"), number.cast("string"), F.lit("|>")))

    body = F.array_join(F.transform("parts", visit), "")
    segment = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), F.coalesce(body, F.lit("")), F.lit(END))
    refs = F.transform("files", lambda p, k: F.struct((F.col("n_before") + k + 1).alias("number"), (F.col("place") - 1).alias("turn_index"), p["type"].alias("type"), p["uri"].alias("uri"), tokens_of(p).alias("tokens")))
    turn = flat.select("conv_id", F.struct("place", segment.alias("segment"), (F.col("role") == "assistant").alias("learn"), F.coalesce(refs, F.array()).alias("refs")).alias("t"))
    whole = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    out = whole.select("conv_id", F.array_join("t.segment", "").alias("formatted"), F.size("t").cast("long").alias("n_turns"),
                       F.col("t.learn").alias("loss_mask"), F.flatten("t.refs").alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation of text parts."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.length(formatted) + 1)

    def turn(piece: Column) -> Column:
        head = F.instr(piece, "\n")
        body = piece.substr(head + 1, F.length(piece) - head - len(END))
        return F.struct(unescape_role(piece.substr(F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)
