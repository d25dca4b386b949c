"""A15 — append-only audit tables (executions, validations, checks,
diagnoses, discrepancies, evidence, state events, reports).

Records are appended as Parquet partitioned by ``kind`` under a shared
root; lookups are filters (partition pruning on ``kind``, predicate
pushdown on the id) and listings sort newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("execution", "validation", "check", "diagnosis", "discrepancy", "evidence", "event", "report")


def append_audit(rows: DataFrame, root: str, kind: str, id_col: str, ts_col: str = "created_at") -> None:
    """Append records of one kind; each record keeps its own columns as a
    JSON payload so different kinds share one table layout."""
    if kind not in KINDS:
        raise ValueError(f"unknown audit kind {kind}")
    payload = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    out = rows.select(F.col(id_col).cast("string").alias("record_id"),
                      F.col(ts_col).cast("timestamp").alias("created_at"),
                      payload.alias("payload"), F.lit(kind).alias("kind"))
    out.write.mode("append").partitionBy("kind").parquet(root)


def get_audit(spark: SparkSession, root: str, kind: str, record_id: str | None = None) -> DataFrame:
    """Records of ``kind`` (optionally one id), newest first."""
    df = spark.read.parquet(root).filter(F.col("kind") == kind)
    if record_id is not None:
        df = df.filter(F.col("record_id") == str(record_id))
    return df.orderBy(F.desc("created_at"), F.desc("record_id"))
