"""Quality rules as a short-circuit cascade (operator 4).

A document is kept if no rule rejects it.  Rules cost different amounts
(counting signs is cheap, repeated word windows are not) and reject
different shares.  Both are measured on a bounded sample of ``SAMPLE``
documents; rules then run in order of rejections per second, and a rejected
document skips the rest.  The order changes the time only: verdicts are the
same in any order, and the first rejecting rule of the chosen order is
reported.

Defined results: a null or empty text has no words and is rejected by the
word count; repeated rows are judged each; an empty table gives no rows;
columns other than id and text are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, ship_package

SAMPLE = 1000          # documents, about, on which cost and selectivity are measured; twice as many at most
_BLANKS = " \t\n\x0b\x0c\r"
_SIGNS = "#*$%&|<>"


class Text:
    """A text with its counts, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()          # bytes: exactly the blanks \x20, \x09-\x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _BLANKS))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, _SIGNS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def word_numbers(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in three-word windows that occur twice or more."""
        w = self.word_numbers
        if len(w) < 4:
            return 0
        n = int(w.max()) + 1
        pair = w[:-1] * n + w[1:]
        if n > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * n + w[2:]
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(w), bool)
        for k in range(3):
            covered[k:len(key) + k] |= twice
        return int(covered.sum())

    @cached_property
    def top_word(self) -> int:
        return int(np.bincount(self.word_numbers).max()) if self.n_words else 0

    @cached_property
    def upper(self) -> tuple[int, int]:
        """(cased letters, upper-case ones): characters that case folding moves."""
        low, up = self.text.lower(), self.text.upper()
        if len(low) != len(self.text) or len(up) != len(self.text):
            return sum(c.lower() != c.upper() for c in self.text), sum(c != c.lower() for c in self.text)
        a, t, u = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (low, self.text, up))
        return int((a != u).sum()), int((a != t).sum())

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text)) if len(self.text) < 200 else int(_letter_count(self.text))


def _letter_count(text: str) -> int:
    from .langid import _letters

    return np.count_nonzero(_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)])


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


# thresholds are the rules' definition, not fitted to a table
RULES = (
    Rule("few_words", lambda t: t.n_words < 50, base=True),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, base=True),
    Rule("signs", lambda t: 4 * t.n_symbols > t.n_words),
    Rule("shouting", lambda t: t.upper[0] > 0 and 2 * t.upper[1] > t.upper[0]),
    Rule("same_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("one_word", lambda t: 10 * t.top_word > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 16 * t.n_words),
    Rule("few_letters", lambda t: 2 * t.letters < t.word_chars),
)


def order_rules(sample: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds per text, share rejected), most rejections per second
    first.  A rule's cost is its own: counts that it would share with others
    are computed anew for each measurement."""
    measured = []
    for rule in rules:
        began, rejected = time.perf_counter(), 0
        for t in sample:
            rejected += rule.rejects(Text(t))
        cost = (time.perf_counter() - began) / max(1, len(sample))
        measured.append((rule, cost, rejected / max(1, len(sample))))
    return sorted(measured, key=lambda m: -m[2] / max(m[1], 1e-9))


SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(n, T.LongType(), False) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False),
    T.StructField("rejected_by", T.StringType()), T.StructField("rules_run", T.LongType(), False),
])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the base counts, ``kept``, the rule that
    rejected it and how many rules were run."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sample = [r[0] for r in hash_sample(rows, ["doc_id", "text"], SAMPLE, rows.count()).select("text").collect()]
    names = [r.name for r, _, _ in order_rules(sample, rules)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = sorted(rules, key=lambda r: names.index(r.name))
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t, by, ran = Text(raw), None, 0
                for rule in ordered:
                    ran += 1
                    if rule.rejects(t):
                        by = rule.name
                        break
                failed = t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words
                out.append((doc, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by, ran))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string()), ("rules_run", pa.int64())])
