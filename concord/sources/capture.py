"""A7 — capturing a query result: the full result written once, its exact
row count observed during that write, its schema and a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

SAMPLE_ROWS = 500


@dataclass
class CapturedResult:
    execution_id: str
    path: str
    row_count: int
    columns: list[tuple[str, str]]
    sample: DataFrame
    ordered: bool


def capture_result(df: DataFrame, execution_id: str, out_dir: str, ordered: bool = False,
                   sample_rows: int = SAMPLE_ROWS) -> CapturedResult:
    """Write ``df`` to ``out_dir/<execution_id>`` as Parquet.  The row
    count comes from an ``Observation`` on that write (no second pass);
    the sample is read back from the written files (``limit``), so a
    comparison never has to fall back to it."""
    obs = Observation(f"capture_{execution_id}")
    path = f"{out_dir.rstrip('/')}/{execution_id}"
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    rows = int(obs.get["rows"])
    written = df.sparkSession.read.parquet(path)
    cols = [(f.name, f.dataType.simpleString().upper()) for f in df.schema.fields]
    return CapturedResult(execution_id, path, rows, cols, written.limit(sample_rows), ordered)
