"""D2 — schema comparison over column catalogs of many pairs at once.

Input: ``(pair_id, side, name, type, ordinal)`` with side ``SRC``/``TGT``
(see ``functions.types.schema_catalog`` to build one from DataFrames).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.types import normalize_type


def schema_diff(cols: DataFrame, order_matters: bool = True) -> DataFrame:
    """Difference rows ``(pair_id, category, column, source_type, target_type)``.

    COLUMN_MISSING / COLUMN_EXTRA / TYPE_CHANGED per column, and one
    COLUMN_ORDER_CHANGED per pair when the name sets agree but the order
    does not.  Names compare case-sensitively."""
    pos = Window.partitionBy("pair_id", "side").orderBy("ordinal", "name")
    c = cols.withColumn("pos", F.row_number().over(pos))
    s = c.filter(F.col("side") == "SRC").select(
        "pair_id", "name", F.col("type").alias("s_type"), F.col("pos").alias("s_pos"))
    t = c.filter(F.col("side") == "TGT").select(
        "pair_id", "name", F.col("type").alias("t_type"), F.col("pos").alias("t_pos"))
    j = s.join(t, ["pair_id", "name"], "full")
    cat = (F.when(F.col("t_type").isNull() & F.col("t_pos").isNull(), F.lit("COLUMN_MISSING"))
           .when(F.col("s_type").isNull() & F.col("s_pos").isNull(), F.lit("COLUMN_EXTRA"))
           .when(normalize_type(F.col("s_type")) != normalize_type(F.col("t_type")),
                 F.lit("TYPE_CHANGED")))
    per_col = j.select("pair_id", cat.alias("category"), F.col("name").alias("column"),
                       F.col("s_type").alias("source_type"), F.col("t_type").alias("target_type"))
    diffs = per_col.filter(F.col("category").isNotNull())
    if not order_matters:
        return diffs
    order = (j.groupBy("pair_id")
             .agg(F.count(F.when(F.col("s_pos").isNull() | F.col("t_pos").isNull(), 1)).alias("set_diff"),
                  F.count(F.when(F.col("s_pos") != F.col("t_pos"), 1)).alias("moved"))
             .filter((F.col("set_diff") == 0) & (F.col("moved") > 0))
             .select("pair_id", F.lit("COLUMN_ORDER_CHANGED").alias("category"),
                     F.lit(None).cast("string").alias("column"),
                     F.lit(None).cast("string").alias("source_type"),
                     F.lit(None).cast("string").alias("target_type")))
    return diffs.unionByName(order)


def schema_summary(cols: DataFrame, order_matters: bool = True) -> DataFrame:
    """Per pair: mismatch count, score, status, severity.

    score = columns present on both sides with compatible types divided by
    the larger column count (1.0 when both are empty)."""
    d = schema_diff(cols, order_matters).groupBy("pair_id").agg(F.count("*").alias("mismatch_count"))
    s = cols.filter(F.col("side") == "SRC").select("pair_id", "name", F.col("type").alias("s_type"))
    t = cols.filter(F.col("side") == "TGT").select("pair_id", "name", F.col("type").alias("t_type"))
    j = s.join(t, ["pair_id", "name"], "full")
    counts = j.groupBy("pair_id").agg(
        F.count("s_type").alias("src_cols"), F.count("t_type").alias("tgt_cols"),
        F.count(F.when(normalize_type(F.col("s_type")) == normalize_type(F.col("t_type")), 1))
        .alias("compatible"))
    out = counts.join(d, "pair_id", "left").fillna(0, ["mismatch_count"])
    top = F.greatest("src_cols", "tgt_cols")
    score = F.when(top == 0, F.lit(1.0)).otherwise(F.col("compatible") / top)
    return out.select(
        "pair_id", "src_cols", "tgt_cols", "compatible", F.col("mismatch_count").cast("long").alias("mismatch_count"),
        F.round(score, 4).alias("score"),
        F.when(F.col("mismatch_count") == 0, F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
        F.when(F.col("mismatch_count") == 0, F.lit("INFO")).otherwise(F.lit("CRITICAL")).alias("severity"))
