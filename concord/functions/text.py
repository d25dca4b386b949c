"""Text helpers shared by the structural, diagnosis and outcome operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Remove leading/trailing whitespace (any kind, not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sha16(c: Column) -> Column:
    """First 16 hex digits of SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(c, 256), 1, 16)


def normalize_query_text(c: Column) -> Column:
    """F13 normalisation: trim, CRLF/CR -> LF, trailing blanks of each line
    removed; empty text stays empty."""
    t = strip(c)
    t = F.regexp_replace(t, r"\r\n?", "\n")
    return F.regexp_replace(t, r"[ \t\x0B\f]+(\n|$)", "$1")


def query_hash(c: Column) -> Column:
    """``sha256(normalized)[:16]``."""
    return sha16(normalize_query_text(c))


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


GRAM = 8


def leading_gram(c: Column) -> Column:
    """The first ``GRAM`` characters of a non-empty text (fewer, if it has
    fewer): a text that contains it has this among its ``grams``."""
    return F.when(F.length(c) > 0, F.substring(c, 1, GRAM))


def gram_length(c: Column) -> Column:
    """How long the ``leading_gram`` of a non-empty text is, as one bit; the
    bits of many texts together (``bit_or``) are the ``lengths`` of ``grams``."""
    return F.call_function("shiftleft", F.lit(1), F.least(F.lit(GRAM), F.length(c)))


def grams(c: Column, lengths: Column | None = None) -> Column:
    """Distinct substrings of 1 to ``GRAM`` characters, or of the
    ``gram_length`` bits ``lengths`` only.  Joining these with
    ``leading_gram`` finds every pair of a text and a text within it."""
    sizes = F.array(*[F.lit(n) for n in range(1, GRAM + 1)])
    fits = lambda n: F.length(c) >= n
    if lengths is not None:
        fits = lambda n: (F.length(c) >= n) & (F.call_function("shiftright", lengths, n) % 2 == 1)
    pieces = F.flatten(F.transform(F.filter(sizes, fits), lambda n: F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(c, i, n))))
    return F.when(F.length(c) > 0, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def prefixes(c: Column) -> Column:
    """All non-empty prefixes, the text itself included."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substr(c, F.lit(1), n))
    return F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))
