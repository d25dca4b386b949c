"""D17–D19 — edge-case comparison: NULL counts and boundary key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.types import is_numeric
from ...functions.values import null_like
from ...session import merge_single_rows

# Default boundary values probed on every numeric column.
DEFAULT_BOUNDARIES = (499.99, 500.00, 500.01)


def null_total(df: DataFrame) -> DataFrame:
    """One row ``nulls``: NULL (or float NaN) cells over all columns."""
    terms = [F.sum(null_like(F.col(f.name), f.dataType).cast("long")) for f in df.schema.fields]
    total = reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), terms, F.lit(0).cast("long"))
    return df.agg(total.alias("nulls"))


def null_count_diff(src: DataFrame, tgt: DataFrame, specs=None) -> DataFrame:
    """``(source_nulls, target_nulls, differs)``.  With the aggregate
    ``specs`` of the same validation the totals come from the shared
    per-side profile aggregation (one scan per side for both checks)."""
    if specs is not None:
        from .aggregates import side_profile
        s = side_profile(src, specs).select(F.col("_nulls").alias("source_nulls"))
        t = side_profile(tgt, specs).select(F.col("_nulls").alias("target_nulls"))
        return merge_single_rows(s, t).withColumn("differs", F.col("source_nulls") != F.col("target_nulls"))
    s = null_total(src).withColumnRenamed("nulls", "source_nulls")
    t = null_total(tgt).withColumnRenamed("nulls", "target_nulls")
    return merge_single_rows(s, t).withColumn("differs", F.col("source_nulls") != F.col("target_nulls"))


def _boundary_cells(df: DataFrame, cols: list[str], key: str, values) -> DataFrame:
    """(column, value, key) for every cell equal to one of the boundary values."""
    vals = [float(v) for v in values]
    cells = F.array(*[
        F.when(F.col(c).cast("double").isin(vals),
               F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")))
        for c in cols])
    return (df.select(F.col(key).alias("key"), F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("b"))
            .select("b.column", "b.value", "key"))


def boundary_keyset_diff(src: DataFrame, tgt: DataFrame, keys: list[str] | None = None,
                         values=DEFAULT_BOUNDARIES, cols: list[str] | None = None, rows=None) -> DataFrame:
    """Per (numeric column, boundary value present on both sides, key
    column) whose key sets differ: one row with the counts of keys found on
    one side only.  ``rows``: a row comparison of the two sides that kept
    these boundary cells, so that neither side is read again."""
    keys = keys or [src.columns[0]]
    if cols is None:
        tcols = set(tgt.columns)
        cols = [f.name for f in src.schema.fields if f.name in tcols and is_numeric(f.dataType)]
    outs = []
    for k in keys:
        if k not in src.columns or k not in tgt.columns or not cols:
            continue
        # one pass per side: cells tagged by side, then per (column, value,
        # key) which sides have it, then per (column, value) the one-sided keys
        if rows is not None:
            cells = rows.boundary_cells(k)
        else:
            cells = (_boundary_cells(src, cols, k, values).withColumn("_s", F.lit(1)).withColumn("_t", F.lit(0)).unionByName(
                _boundary_cells(tgt, cols, k, values).withColumn("_s", F.lit(0)).withColumn("_t", F.lit(1))))
        per_key = cells.groupBy("column", "value", "key").agg(F.max("_s").alias("_s"), F.max("_t").alias("_t"))
        d = (per_key.groupBy("column", "value")
             .agg(F.max("_s").alias("_any_s"), F.max("_t").alias("_any_t"),
                  F.count(F.when((F.col("_s") == 1) & (F.col("_t") == 0), 1)).alias("source_only_keys"),
                  F.count(F.when((F.col("_t") == 1) & (F.col("_s") == 0), 1)).alias("target_only_keys"))
             .filter((F.col("_any_s") == 1) & (F.col("_any_t") == 1)
                     & ((F.col("source_only_keys") > 0) | (F.col("target_only_keys") > 0)))
             .withColumn("key_column", F.lit(k)))
        outs.append(d.select("key_column", "column", "value", "source_only_keys", "target_only_keys"))
    if not outs:
        spark = src.sparkSession
        return spark.createDataFrame([], "key_column string, column string, value double, "
                                         "source_only_keys long, target_only_keys long")
    return reduce(DataFrame.unionByName, outs)


def edge_check(src: DataFrame | None, tgt: DataFrame | None, keys: list[str] | None = None,
               values=DEFAULT_BOUNDARIES, scenario: str = "EDGE_CASE", specs=None, rows=None) -> DataFrame:
    """D19 check row: FAIL when NULL totals differ or any boundary key set
    differs; SKIPPED with score 1.0 when a side is missing."""
    if src is None or tgt is None:
        spark = (src or tgt).sparkSession
        from ...session import literal_rows
        return literal_rows(
            spark, [("EdgeCaseValidator", "SKIPPED", "INFO", 1.0, 0, scenario)],
            "check_name string, status string, severity string, score double, mismatch_count long, scenario string")
    n = null_count_diff(src, tgt, specs).select(F.col("differs").cast("long").alias("n"))
    b = boundary_keyset_diff(src, tgt, keys, values, rows=rows).agg(F.count("*").alias("b"))
    mm = F.col("n") + F.col("b")
    return merge_single_rows(n, b).select(
        F.lit("EdgeCaseValidator").alias("check_name"),
        F.when(mm == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.when(mm == 0, F.lit("INFO")).otherwise(F.lit("HIGH")).alias("severity"),
        F.when(mm == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("score"),
        mm.cast("long").alias("mismatch_count"), F.lit(scenario).alias("scenario"))
