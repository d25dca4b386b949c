"""Session helpers: building a local session for tests/bench, loading the
driver tables, and resolving the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "concord") -> SparkSession:
    """Local session for tests and bench.  On a cluster, build the session
    with the cluster's own settings instead; nothing here is required."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # let AQE size the partitions of persisted intermediates too
        .config("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as named by
    ``spark.checkpoint.dir``.

    Only a single-process local session (tests, bench) may leave it unset
    and gets a private folder; on a cluster that would be a different disk
    on every machine, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="concord-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: several
    results that start from it do not compute it again, and a lost executor
    does not either.  The folder belongs to the session's checkpoints."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_tables(spark: SparkSession, sf_dir: str,
                    names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """Register the driver tables of ``sf_dir`` as temp views (A1 on the
    driver layout) and return them."""
    out = {}
    for n in names:
        df = read_table(spark, sf_dir, n)
        df.createOrReplaceTempView(n)
        out[n] = df
    return out


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table built inside the JVM (an inline generator
    over a one-row range) instead of shipping Python objects through a
    Python worker.  Used for metadata-sized frames only: check rows,
    schema catalogs, dimension lists."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import _parse_datatype_string

    st = _parse_datatype_string(schema)
    if not rows:
        return spark.createDataFrame([], st)
    structs = []
    for r in rows:
        structs.append(F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, st.fields)]))
    return spark.range(1).select(F.inline(F.array(*structs)))


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Combine one-row frames (global aggregates) side by side without a
    join: union them with the other frames' columns as NULL and keep the
    single non-NULL value of every column."""
    from functools import reduce

    from pyspark.sql import functions as F

    cols = [c for f in frames for c in f.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return u.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])
