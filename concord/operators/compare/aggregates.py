"""D14–D16 — aggregate statistics of each side and their comparison.

Each side is read once: every statistic of every spec is one expression
of a single ``agg`` (one partial/final aggregation pair), then the one
stats row is unpivoted into ``(column, function, value)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.types import is_numeric
from ...functions.values import ABS_TOL, REL_TOL, nan_to_null, values_equal

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COUNT_DISTINCT")

Spec = tuple[str, list[str]]


def default_specs(src: DataFrame, tgt: DataFrame) -> list[Spec]:
    """COUNT(*) plus SUM/AVG/MIN/MAX of every numeric column the two
    sides share (in source order)."""
    specs: list[Spec] = [("*", ["COUNT"])]
    tcols = set(tgt.columns)
    for f in src.schema.fields:
        if f.name in tcols and is_numeric(f.dataType):
            specs.append((f.name, ["SUM", "AVG", "MIN", "MAX"]))
    return specs


def _stat(df: DataFrame, col: str, fn: str):
    fn = fn.upper()
    if fn not in FUNCTIONS:
        raise ValueError(f"unknown aggregate function {fn!r}")
    if fn == "COUNT" and col == "*":
        return F.count(F.lit(1)).cast("double")
    if col not in df.columns:
        if fn == "COUNT":
            raise ValueError(f"COUNT on missing column {col!r}")
        return F.lit(None).cast("double")
    dt = df.schema[col].dataType
    c = nan_to_null(F.col(col), dt)
    if fn == "COUNT":
        return F.count(c).cast("double")
    if fn == "COUNT_DISTINCT":
        return F.count_distinct(c).cast("double")
    if not (is_numeric(dt) or isinstance(dt, T.BooleanType)):
        c = c.try_cast("double")
    else:
        c = c.cast("double")
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[fn](c)


def side_profile(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """One aggregation over a side: every statistic of ``specs`` (``_v<i>``)
    plus the NULL/NaN cell total (``_nulls``, used by the edge check).  The
    aggregate and edge checks of one validation build this same plan, so
    Spark reuses its exchange and each side is scanned once for both."""
    from ...functions.values import null_like
    items = [(col, fn.upper()) for col, fns in specs for fn in fns]
    exprs = [_stat(df, c, f).alias(f"_v{i}") for i, (c, f) in enumerate(items)]
    nulls = [F.coalesce(F.sum(null_like(F.col(f.name), f.dataType).cast("long")), F.lit(0))
             for f in df.schema.fields]
    total = nulls[0] if len(nulls) == 1 else None
    for n in nulls:
        total = n if total is None else total + n
    return df.agg(*exprs, (total if total is not None else F.lit(0).cast("long")).alias("_nulls"))


def aggregate_stats(df: DataFrame, specs: list[Spec]) -> DataFrame:
    """``(ordinal, column, function, value)``; NULL when no non-null
    input (or the column is absent)."""
    items = [(col, fn.upper()) for col, fns in specs for fn in fns]
    row = side_profile(df, specs)
    packed = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"),
                                F.lit(f).alias("function"), F.col(f"_v{i}").alias("value"))
                       for i, (c, f) in enumerate(items)])
    return row.select(F.explode(packed).alias("s")).select("s.*")


def aggregate_diff(src: DataFrame, tgt: DataFrame, specs: list[Spec] | None = None,
                   abs_tol: float = ABS_TOL, rel_tol: float = REL_TOL) -> DataFrame:
    """One row per metric with both values and whether they agree."""
    specs = specs or default_specs(src, tgt)
    s = aggregate_stats(src, specs).withColumnRenamed("value", "source_value")
    t = aggregate_stats(tgt, specs).select("ordinal", F.col("value").alias("target_value"))
    j = s.join(t, "ordinal")  # one row per metric on each side
    eq = values_equal(F.col("source_value"), T.DoubleType(), F.col("target_value"), T.DoubleType(),
                      abs_tol, rel_tol)
    return j.select("ordinal", "column", "function", "source_value", "target_value",
                    eq.alias("matched"))


def aggregate_check(src: DataFrame, tgt: DataFrame, specs: list[Spec] | None = None,
                    abs_tol: float = ABS_TOL, rel_tol: float = REL_TOL) -> DataFrame:
    """Check row: score = matched / total metrics; FAIL is HIGH severity."""
    d = aggregate_diff(src, tgt, specs, abs_tol, rel_tol)
    a = d.agg(F.count("*").alias("total"), F.count(F.when(F.col("matched"), 1)).alias("ok"))
    mm = F.col("total") - F.col("ok")
    return a.select(
        F.lit("AggregateValidator").alias("check_name"),
        F.when(mm == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.when(mm == 0, F.lit("INFO")).otherwise(F.lit("HIGH")).alias("severity"),
        F.round(F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("ok") / F.col("total")), 4)
        .alias("score"),
        mm.cast("long").alias("mismatch_count"))
