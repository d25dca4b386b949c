"""A3–A6 — ingesting files as tables and exporting tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class TableNameCollision(ValueError):
    pass


def table_name_expr(path_col):
    """A4: table name from a file path: stem, non ``[A-Za-z0-9_]`` -> ``_``,
    runs of ``_`` collapsed, outer ``_`` trimmed, lower-case;
    ``table_data`` when nothing is left."""
    base = F.regexp_extract(path_col, r"([^/\\]+)$", 1)
    stem = F.when(base.rlike(r"^.+\.[^.]*$") & ~base.startswith("."), F.regexp_extract(base, r"^(.*)\.[^.]*$", 1)) \
        .otherwise(base)
    clean = F.regexp_replace(stem, r"[^a-zA-Z0-9_]", "_")
    clean = F.lower(F.regexp_replace(F.regexp_replace(clean, r"_+", "_"), r"^_+|_+$", ""))
    return F.when(clean == "", F.lit("table_data")).otherwise(clean)


def resolve_table_names(listing: DataFrame, path_col: str = "path") -> DataFrame:
    """A4 on a file listing frame: ``(path, table_name, collision)`` where
    ``collision`` marks names that two or more files resolve to."""
    named = listing.select(F.col(path_col).alias("path"), table_name_expr(F.col(path_col)).alias("table_name"))
    counts = named.groupBy("table_name").agg(F.count("*").alias("_n"))
    return named.join(counts, "table_name").select("path", "table_name", (F.col("_n") > 1).alias("collision"))


def ingest_files(spark: SparkSession, paths: list[str], out_dir: str) -> dict[str, str]:
    """A3 + A4: every CSV (header, inferred types) or Parquet file becomes
    ``out_dir/<table>.parquet``; two files resolving to one table name is
    an error raised before anything is written."""
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    resolved = resolve_table_names(listing)
    bad = resolved.filter("collision").select("table_name").distinct().collect()  # names only
    if bad:
        raise TableNameCollision(f"TABLE_NAME_COLLISION: {sorted(r.table_name for r in bad)}")
    out = {}
    for r in resolved.collect():  # one row per input file (a file list, not data)
        dest = os.path.join(out_dir, f"{r.table_name}.parquet")
        ingest_csv(spark, r.path, dest) if r.path.lower().endswith(".csv") else \
            spark.read.parquet(r.path).write.mode("overwrite").parquet(dest)
        out[r.table_name] = dest
    return out


def ingest_csv(spark: SparkSession, path: str, dest: str, schema: StructType | str | None = None) -> DataFrame:
    """A3: CSV with a header rewritten as Parquet.  With a schema the files
    are read once; without one Spark reads them a first time to infer it."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    df.write.mode("overwrite").parquet(dest)
    return spark.read.parquet(dest)


def export_parquet(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """A5: one Parquet directory per table."""
    out = {}
    for name, df in tables.items():
        p = os.path.join(out_dir, name)
        df.write.mode("overwrite").parquet(p)
        out[name] = p
    return out


def export_csv(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """One CSV directory per table with a header line, no index."""
    out = {}
    for name, df in tables.items():
        p = os.path.join(out_dir, name)
        df.write.mode("overwrite").option("header", True).csv(p)
        out[name] = p
    return out
