"""Round trips between groups of documents and shards of keys.

Some operators need, for every key of a document (an n-gram, a byte string),
a value that depends on all documents.  Sending a row per key would cost
many times the text.  Here Spark deals documents into groups of about
``GROUP_CHARS`` characters; a group sends each shard one row with the
packed, distinct keys of that shard, with their counts already added up in
the group, and gets one packed row back.  A key that a third of all
documents hold therefore reaches its shard once per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

GROUP_CHARS = 12_000_000
MIN_GROUPS = 64


def dealt(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] | None = None, chars: int = GROUP_CHARS) -> tuple[DataFrame, int]:
    """``(grp, doc_id, text)`` of every row, with the columns ``carry`` as
    ``c0``, ``c1``..., and the number of groups of about ``chars`` each."""
    rows = texts(docs, text, key)
    size = rows.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = max(MIN_GROUPS, -(-size // chars))
    more = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), *more)
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("grp"), *rows.columns), n


def fixed_order(table: pa.Table) -> pa.Table:
    """A group's rows in a fixed order, whatever order the shuffle
    delivered: by id (null last), then text."""
    ids, all_texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    return table.take(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, all_texts[i])))


def sorted_documents(table: pa.Table) -> tuple[list[int | None], list[str]]:
    """Ids and texts of a group in that order."""
    table = fixed_order(table)
    return table.column("doc_id").to_pylist(), table.column("text").to_pylist()


def runs(parts: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The distinct values of a sorted array, and where each stands.  Only
    shards that a group has keys for get a row, so the rows never outnumber
    the keys, however many groups and shards there are."""
    values, starts = np.unique(parts, return_index=True)
    return values, [slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)])]


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def joined(column: pa.ChunkedArray, dtype: str) -> tuple[np.ndarray, list[int]]:
    """Packed arrays of a column one after another, and their lengths."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype), [len(r) // np.dtype(dtype).itemsize for r in raw]
