"""A1, A8, A9, A10, A11 — views, descriptions, previews and the catalog."""

from __future__ import annotations


from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import nan_to_null


class DatasetError(ValueError):
    pass


def register_views(spark: SparkSession, tables: dict[str, str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """A1: every ``table -> path`` entry becomes a temp view.  An empty
    mapping or a missing path is an error (checked before any view is
    created)."""
    if not tables:
        raise DatasetError("dataset has no tables")
    out = {}
    for name, path in tables.items():
        try:  # Spark looks where its readers would, on any file system
            out[name] = spark.read.format(fmt).load(path)
        except AnalysisException as exc:
            raise DatasetError(f"no table {name!r} at {path}") from exc
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def describe_table(df: DataFrame, table: str | None = None) -> DataFrame:
    """A8 schema part: ``(table_name, name, type, nullable, ordinal)`` from
    the schema alone (no data read)."""
    spark = df.sparkSession
    rows = [(table, f.name, f.dataType.simpleString().upper(), bool(f.nullable), i)
            for i, f in enumerate(df.schema.fields, start=1)]
    from ..session import literal_rows
    return literal_rows(spark, rows, "table_name string, name string, type string, nullable boolean, ordinal int")


def describe_with_count(df: DataFrame, table: str) -> DataFrame:
    """The column rows with the table's exact row count attached (one
    aggregation over the table, joined to the schema rows)."""
    items = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(f.name).alias("name"),
                               F.lit(f.dataType.simpleString().upper()).alias("type"),
                               F.lit(bool(f.nullable)).alias("nullable"), F.lit(i).alias("ordinal"))
                      for i, f in enumerate(df.schema.fields, start=1)])
    cnt = df.agg(F.count(F.lit(1)).alias("row_count"))
    return cnt.select(F.explode(items).alias("c"), "row_count").select("c.*", "row_count")


def preview(tables: dict[str, DataFrame], table: str | None = None, limit: int = 100,
            order_by: list[str] | None = None) -> DataFrame:
    """The first ``clamp(limit, 1, 100)`` rows of a table (NaN shown as
    NULL); an unknown or missing table name falls back to the first
    table.  ``order_by`` makes "first" deterministic."""
    if not tables:
        raise DatasetError("dataset has no tables")
    n = min(max(1, int(limit)), 100)
    names = list(tables)
    lookup = {k.lower(): k for k in names}
    key = lookup.get((table or names[0]).lower(), names[0])
    df = tables[key]
    df = df.select(*[nan_to_null(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)


def table_manifest(tables: dict[str, DataFrame], dataset_id: str) -> DataFrame:
    """Per-table manifest rows ``(dataset_id, table_name, row_count)``:
    one count per table (a single aggregation each), unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(dataset_id).alias("dataset_id"), F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catalog_summary(manifest: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """A10: per dataset, total rows, table count, tags and hash; missing
    manifest fields get defaults (0 rows, no tags, empty hash, display
    name = id)."""
    m = manifest
    agg = m.groupBy("dataset_id").agg(F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("total_rows"),
                                      F.count_distinct("table_name").alias("table_count"))
    if datasets is None:
        return agg.select("dataset_id", F.col("dataset_id").alias("display_name"), "total_rows", "table_count",
                          F.array().cast("array<string>").alias("tags"), F.lit("").alias("dataset_hash"))
    d = datasets
    get = lambda c, default: F.coalesce(F.col(c), default) if c in d.columns else default
    return (d.join(agg, "dataset_id", "left")
            .select("dataset_id", get("display_name", F.col("dataset_id")).alias("display_name"),
                    F.coalesce(F.col("total_rows"), F.lit(0)).alias("total_rows"),
                    F.coalesce(F.col("table_count"), F.lit(0)).alias("table_count"),
                    get("tags", F.array().cast("array<string>")).alias("tags"),
                    get("dataset_hash", F.lit("")).alias("dataset_hash")))


def catalog_search(catalog: DataFrame, q: str) -> DataFrame:
    """Case-insensitive substring over display name, id or any tag."""
    s = (q or "").strip().lower()
    if not s:
        return catalog
    cond = (F.lower(F.col("display_name")).contains(s) | F.lower(F.col("dataset_id")).contains(s)
            | F.exists(F.coalesce(F.col("tags"), F.array().cast("array<string>")),
                       lambda t: F.lower(t).contains(s)))
    return catalog.filter(cond)


