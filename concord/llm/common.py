"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per session), so that
    functions of these modules can be imported there whatever their path."""
    name = os.path.basename(_PACKAGE)
    if any(os.path.basename(f) == f"{name}.zip" for f in spark.sparkContext.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-ship-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(_PACKAGE):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, _PACKAGE)))
    spark.sparkContext.addPyFile(path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back.

    Cuts lineage and fixes the rows: a lost executor cannot change what later
    steps see, because the files survive it.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a ``saved`` frame that no later step reads."""
    spark = df.sparkSession
    home = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(home).toUri().getPath() + "/"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id bigint, text string)`` of ``df``; null texts become empty,
    every other column is left behind (so clashing names cannot matter)."""
    return df.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def fold(key: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (null id: null)."""
    return F.crc32(key.cast("string").cast("binary")) % n


def hash_sample(df: DataFrame, by: list[str], n: int, total: int) -> DataFrame:
    """About n of ``total`` rows, 2 n at most, chosen by a hash of columns
    on the executors: no task sends more than the rows it contributes."""
    grid = 1 << 30
    share = min(grid, grid * n // max(1, total) + 1)
    return df.where(F.pmod(F.xxhash64(*by, F.lit(n)), F.lit(grid)) < share).limit(2 * n)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
