"""A13 — order-independent table checksums and dataset fingerprints.

Each row is rendered as JSON with every field named and NULLs written out,
so that different rows have different texts: strings are escaped, decimals
exact, doubles in their shortest round-trip form, timestamps to the
microsecond.  The text is hashed with SHA-256 and 120 bits of the digest
are added up over all rows as six 20-bit parts (exact as longs for up to
2^43 rows).  Sums and row count do not depend on row order or partitioning
and combine map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sha16

PARTS = 6
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_text(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _JSON) if df.columns else F.lit("{}")


def row_hash_parts(df: DataFrame) -> list[Column]:
    """The first ``5 * PARTS`` hex digits of the row's hash as 20-bit integers."""
    m = F.sha2(row_text(df), 256)
    return [F.conv(F.substring(m, 1 + 5 * i, 5), 16, 10).cast("long") for i in range(PARTS)]


def table_checksum(df: DataFrame, table: str) -> DataFrame:
    """``(table_name, row_count, checksum)``: ``"<rows>:<part sums>"``, independent of row order and partitioning."""
    parts = row_hash_parts(df)
    a = df.agg(F.count(F.lit(1)).alias("row_count"),
               *[F.coalesce(F.sum(p), F.lit(0)).alias(f"_p{i}") for i, p in enumerate(parts)])
    sums = F.concat_ws("-", *[F.hex(F.col(f"_p{i}")) for i in range(PARTS)])
    return a.select(F.lit(table).alias("table_name"), "row_count",
                    F.concat(F.col("row_count").cast("string"), F.lit(":"), sums).alias("checksum"))


def dataset_fingerprint(checksums: DataFrame, key: str | None = None) -> DataFrame:
    """sha256-16 over the sorted ``table:checksum`` lines of a dataset
    (the per-table rows only: one small row per table)."""
    line = F.concat(F.col("table_name"), F.lit(":"), F.col("checksum"))
    g = checksums.groupBy(key) if key else checksums.groupBy()
    return g.agg(sha16(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("dataset_hash"))
