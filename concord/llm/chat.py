"""Chat formatting (operator 3): typed content parts to one training text.

A turn has a role and an array of parts ``struct<type, text, ref, units>``.
A visitor per type renders a part: text is escaped, an image, audio or
document part becomes an ordered placeholder whose reference and expanded
token count are recorded.  Everything is DataFrame expressions; a
conversation is one output row, so its turns meet in one group by nature.

Template (fixed values)::

    <|turn|>ROLE<|text|>CONTENT<|end|>\\n

Escaping: ``\\`` becomes ``\\\\`` and then ``<|`` becomes ``<\\|``.  Escaped
text never holds ``<|``, and ``<`` + one backslash + ``|`` arises from
``<|`` alone (a backslash of the text is doubled), so reading back is
exact: first ``<\\|`` to ``<|``, then ``\\\\`` to ``\\``.

Defined results: a null role, text or part is empty; turns are ordered by
the order columns, then role, then rendered content (repeated rows stay); a
null conversation id is a conversation of its own; unknown part types are
rendered like text; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"


@dataclass(frozen=True)
class Costs:
    """Tokens a placeholder expands to: per part and per unit (seconds of
    audio, pages of a document)."""

    per_part: dict[str, int] = field(default_factory=lambda: {"image": 576, "audio": 0, "document": 0})
    per_unit: dict[str, float] = field(default_factory=lambda: {"image": 0.0, "audio": 25.0, "document": 768.0})


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A one-part content array of plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _visit(part: Column, kinds: tuple[str, ...]) -> Column:
    """The rendering of one part."""
    out = F.when(part["type"].isin(*kinds), F.concat(F.lit("<|"), part["type"], F.lit("|>")))
    return out.otherwise(F.coalesce(escape(part["text"]), F.lit("")))


def _tokens(part: Column, costs: Costs) -> Column:
    out = F.lit(0).cast("long")
    for kind, base in costs.per_part.items():
        n = F.lit(base) + F.ceil(F.coalesce(part["units"], F.lit(0.0)) * costs.per_unit.get(kind, 0.0))
        out = F.when(part["type"] == kind, n.cast("long")).otherwise(out)
    return out


def format_chats(turns: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn",), role: str = "role",
                 parts: str = "parts", learn_roles: tuple[str, ...] = ("assistant",), costs: Costs = Costs()) -> DataFrame:
    """One row per conversation: ``formatted``; ``loss_spans``, the
    (start, length) code-point spans of learned content; ``attachments``
    in order (turn number, type, ref, tokens); ``expanded_tokens``."""
    kinds = tuple(costs.per_part)
    content = F.array_join(F.transform(F.coalesce(F.col(parts), F.array()), lambda p: _visit(p, kinds)), "")
    found = F.transform(F.filter(F.coalesce(F.col(parts), F.array()), lambda p: p["type"].isin(*kinds)),
                        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p, costs).alias("tokens")))
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.struct(*[F.col(c) for c in order]).alias("o"),
        F.coalesce(F.col(role), F.lit("")).alias("r"), content.alias("c"), found.alias("a"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("r")), F.lit(TEXT)))
    rows = rows.withColumn("n", F.length("head") + F.length("c") + len(END))
    in_order = Window.partitionBy("conv_id").orderBy("o", "r", "c")
    placed = rows.select(
        "conv_id", "r", F.concat("head", "c", F.lit(END)).alias("t"), "a", F.length("c").alias("n_c"),
        F.row_number().over(in_order).alias("i"),
        (F.sum(F.col("n").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        F.length("head").alias("n_h"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "i", "t", "r", "a", "n_c", (F.coalesce("before", F.lit(0)) + F.col("n_h")).alias("at")))).alias("ts"))
    learned = F.filter("ts", lambda t: t["r"].isin(*learn_roles))
    attachments = F.flatten(F.transform("ts", lambda t: F.transform(t["a"], lambda a: F.struct(
        t["i"].alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["t"]), "").alias("formatted"),
        F.transform(learned, lambda t: F.struct(t["at"].cast("long").alias("start"), t["n_c"].cast("long").alias("length"))).alias("loss_spans"),
        attachments.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped;
    placeholders stay in the text as written."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2147483647), TEXT, 1)).alias("role"),
        unescape(F.substring_index(p, TEXT, -1)).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int") + 1, s["length"].cast("int")))), "")
