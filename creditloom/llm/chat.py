"""Chat formatting from typed content parts.

A turn is a role and an array of parts: text, image, audio or document. Its parts are
flattened in order; text is escaped, other parts become placeholders. The attachments of a
conversation stand in the order of the placeholders, each with its reference, its turn and
the number of tokens that the placeholder will be expanded to. The template is

    <turn role="ROLE">BODY</turn>

with a newline after each turn. ``&``, ``<`` and ``"`` are escaped inside roles and texts,
so no text holds a control string, and undoing the escapes gives the text back. The loss
mask is a list of spans, in code points, of the formatted conversation: the texts of the
assistant's turns (with their placeholders) without the marks around them.

Turns are ordered by number (null first), then role and text; a null role or text is empty,
a null list of parts has no parts, parts of unknown kinds are placeholders of their own
kind. Turns without a conversation id form one conversation. Repeated rows are turns of
their own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens of attachments: image tiles, audio frames and document pages.
TILE, FRAMES, PAGE_TOKENS = 14, 25, 256
KIND = r"[^A-Za-z0-9_]"


def escape(text: Column) -> Column:
    out = text
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescape(text: Column) -> Column:
    out = text
    for plain, safe in (('"', "&quot;"), ("<", "&lt;"), ("&", "&amp;")):
        out = F.replace(out, F.lit(safe), F.lit(plain))
    return out


def text_parts(text: Column) -> Column:
    """A plain text as an array with one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"))).cast(
        "array<struct<kind:string,text:string>>"
    )


def whole_parts(parts: Column) -> Column:
    """Parts of (kind, text) with the fields of attachments empty."""

    def widen(p: Column) -> Column:
        nothing = F.lit(None)
        return F.struct(
            p["kind"].alias("kind"),
            p["text"].alias("text"),
            nothing.cast("string").alias("ref"),
            nothing.cast("int").alias("width"),
            nothing.cast("int").alias("height"),
            nothing.cast("double").alias("seconds"),
            nothing.cast("int").alias("pages"),
        )

    return F.transform(parts, widen)


def expanded_tokens(part: Column) -> Column:
    """Number of tokens that a part's placeholder stands for."""

    def up(x: Column) -> Column:
        return F.ceil(F.coalesce(x, F.lit(0)).cast("double"))

    return (
        F.when(part["kind"] == "image", up(part["width"] / TILE) * up(part["height"] / TILE))
        .when(part["kind"] == "audio", up(part["seconds"] * FRAMES))
        .when(part["kind"] == "document", up(part["pages"]) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return part["kind"] == "text"


def _visit(part: Column) -> Column:
    """Form of one part in the body of its turn."""
    kind = F.regexp_replace(F.coalesce(part["kind"], F.lit("unknown")), KIND, "_")
    placeholder = F.concat(F.lit("<"), kind, F.lit("/>"))
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(placeholder)


def format_chats(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    trained: str = "assistant",
) -> DataFrame:
    """One row per conversation: id, formatted, ``loss`` (start and length of each span),
    ``attachments`` (kind, ref, turn, tokens), n_turns and expanded_tokens."""
    none = F.array().cast(f"array<{PART}>")
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{parts}`"), none).alias("parts"),
    )
    body = F.array_join(F.transform("parts", _visit), "")
    head = F.concat(F.lit('<turn role="'), escape(F.col("role")), F.lit('">'))
    rows = rows.withColumns({"head": head, "body": body})
    piece = F.concat("head", "body", F.lit("</turn>\n"))
    # Texts last: the order of turns with one number and role.
    order = Window.partitionBy("id").orderBy("turn", "role", "body")
    before = F.coalesce(
        F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    rows = rows.withColumn("piece", piece).withColumns(
        {"place": F.row_number().over(order), "start": (before + F.length("head")).cast("long")}
    )
    others = F.filter("parts", lambda p: p["kind"].isNull() | ~_is_text(p))
    attached = F.transform(
        others,
        lambda p: F.struct(
            p["kind"].alias("kind"),
            p["ref"].alias("ref"),
            F.col("place").alias("turn"),
            expanded_tokens(p).alias("tokens"),
        ),
    )
    span = F.when(
        F.col("role") == trained,
        F.struct(F.col("start"), F.length("body").cast("long").alias("length")),
    )
    # The formatted conversation is one value, so its turns meet in one row.
    listed = rows.groupBy("id").agg(
        F.sort_array(
            F.collect_list(F.struct("place", "piece", span.alias("span"), attached.alias("attached")))
        ).alias("turns")
    )
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return listed.select(
        "id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
        attachments.alias("attachments"),
        F.size("turns").cast("long").alias("n_turns"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias(
            "expanded_tokens"
        ),
    )


def _all(formatted: Column, group: int) -> Column:
    pattern = r'(?s)<turn role="([^"<]*)">(.*?)</turn>\n'
    return F.regexp_extract_all(formatted, F.lit(pattern), F.lit(group))


def read_turns(formatted: Column) -> Column:
    """Roles and texts of a formatted conversation, unescaped."""
    return F.arrays_zip(
        F.transform(_all(formatted, 1), unescape).alias("role"),
        F.transform(_all(formatted, 2), unescape).alias("text"),
    )


def trained_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: unescape(
                F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))
            ),
        ),
        "",
    )
