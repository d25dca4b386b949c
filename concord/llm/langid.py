"""Language identification with language-bitmask n-gram filters (operator 6).

Training counts the letter trigrams of every language (centred on each
letter, lower case, word ends as blanks).  A language owns the trigrams that
make up at least ``min_share`` of its trigrams, so it owns at most
1 / min_share of them and the model's size is bounded whatever the corpus.
All languages share one bit-sliced Bloom filter: a row per hash position, a
bit per language, so ANDing a trigram's ``HASHES`` rows gives the mask of
all languages that own it.

A prediction adds up the masks of all trigrams of the whole text: per
language a popcount, from which the expected false positives (share of set
bits to the power of the number of hashes) are taken off.  The largest
corrected share wins, ties go to the first language in order.

Defined results: a null text or one without a letter is ``und`` with score
0 (as is everything if no language could be learned); rows of a null lang
teach nothing; a row with a null doc_id teaches and is not held out;
repeated rows count again; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package
from .tokens import chunks, encoder

HASHES = 4
_BLANK = 0
_TOP = 0x110000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """code point -> itself for letters, blank otherwise."""
    table = np.zeros(_TOP, dtype=np.uint32)
    is_letter = np.fromiter((chr(c).isalpha() for c in range(_TOP)), dtype=bool, count=_TOP)
    table[is_letter] = np.flatnonzero(is_letter)
    return table


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(exact 63-bit key, index of its text) of every letter trigram."""
    low = [(t or "").lower() for t in texts]
    # two blanks around every text keep trigrams from crossing texts
    codes = _letters()[np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
    owner = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    mid = codes[1:-1]
    at = np.flatnonzero(mid)
    return codes[at] << 42 | mid[at] << 21 | codes[at + 2], owner[at]


def _spread(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Hash positions of the keys in a table of 2**bits rows."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(bits)) | np.uint64(1)
    mask = np.uint64((1 << bits) - 1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & mask).astype(np.int64)


@dataclass
class LanguageFilter:
    languages: list[str]
    bits: int
    rows: np.ndarray             # uint8, (2**bits, bytes of languages)
    false_rate: np.ndarray       # per language

    @staticmethod
    def build(owned: dict[str, np.ndarray], bits_per_gram: int = 16) -> "LanguageFilter":
        languages = sorted(owned)
        most = max([len(g) for g in owned.values()], default=1)
        bits = max(10, int(np.ceil(np.log2(max(1, most * bits_per_gram)))))
        rows = np.zeros((1 << bits, max(1, -(-len(languages) // 8))), dtype=np.uint8)
        for n, lang in enumerate(languages):
            for at in _spread(owned[lang], bits):
                rows[at, n >> 3] |= np.uint8(1 << (n & 7))
        fill = np.array([(rows[:, n >> 3] >> (n & 7) & 1).mean() for n in range(len(languages))])
        return LanguageFilter(languages, bits, rows, fill ** HASHES)

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(letters, corrected share per language) of each text."""
        keys, owner = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        masks = None
        for at in _spread(keys, self.bits):
            masks = self.rows[at] if masks is None else masks & self.rows[at]
        hits = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            has = (masks[:, k >> 3] >> (k & 7) & 1).astype(bool)
            hits[:, k] = np.bincount(owner[has], minlength=len(texts))
        all_ = np.maximum(n, 1)[:, None]
        return n, np.clip((hits / all_ - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        n, share = self.shares(texts)
        best = share.argmax(1)
        score = np.where(n > 0, share[np.arange(len(texts)), best], 0.0)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist())], score


def train(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 5e-5) -> LanguageFilter:
    """Learn from every row with a lang; counts cover all of them."""
    spark = docs.sparkSession
    ship_package(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()        # a reused worker may still hold words of a packing task
        for b in batches:
            all_texts, all_langs = b.column(0).to_pylist(), np.array(b.column(1).to_pylist(), dtype=object)
            for lo, hi in chunks(all_texts, 1_000_000):
                keys, owner = trigrams(all_texts[lo:hi])
                names, code = np.unique(all_langs[lo:hi].astype(str), return_inverse=True)
                for k, name in enumerate(names.tolist()):
                    grams, n = np.unique(keys[code[owner] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    taught = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    grams = taught.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Σ share = 1 per language: at most 1 / min_share rows each remain
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    owned = grams.join(totals, "lang").where(F.col("n") >= F.col("total") * min_share).groupBy("lang").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    return LanguageFilter.build({r[0]: np.array(r[1], dtype=np.int64) for r in owned.collect()})


def predict(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; every other column stays."""
    ship_package(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        for b in batches:
            all_texts = b.column(at).to_pylist()
            langs, scores = [], [np.zeros(0)]
            for lo, hi in chunks([t or "" for t in all_texts], 1_000_000):
                ls, ss = model.predict(all_texts[lo:hi])
                langs += ls
                scores.append(ss)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[*kept, "lang_pred", "score"])

    rows = docs.select(*kept)
    schema = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(run, schema)
