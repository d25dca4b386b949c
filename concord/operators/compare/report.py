"""D12, D20, D22, D23 — check rows and their roll-up.

A check row has the columns of ``CHECK_SCHEMA``.  Checks are lazy one-row
DataFrames; ``validate`` unions them, ``run_checks`` evaluates them one by
one so that a failing check becomes an ERROR row and the others go on.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.types import is_numeric
from ...session import literal_rows
from .aggregates import aggregate_check
from .edges import edge_check
from .rows import CompareConfig, ComparisonKeyError, RowComparison, compare_rows

CHECK_SCHEMA = ("check_name string, status string, severity string, score double, "
                "mismatch_count long, summary string")
CHECK_COLUMNS = ["check_name", "status", "severity", "score", "mismatch_count", "summary"]
DEFAULT_CHECKS = ("SchemaValidator", "RowValidator", "AggregateValidator",
                  "BusinessRuleValidator", "EdgeCaseValidator")


def row_check(src: DataFrame, tgt: DataFrame, keys: list[str] | None = None,
              cfg: CompareConfig | None = None, rows: RowComparison | None = None) -> DataFrame:
    """PASS iff no mismatch; FAIL is CRITICAL; a key problem is an
    ERROR row with score 0."""
    spark = src.sparkSession
    try:
        rc = rows or compare_rows(src, tgt, keys, cfg)
    except ComparisonKeyError as exc:
        return literal_rows(
            spark, [("RowValidator", "ERROR", "HIGH", 0.0, 0, f"unusable key: {exc}")], CHECK_SCHEMA)
    s = rc.summary
    return s.select(
        F.lit("RowValidator").alias("check_name"), "status",
        F.when(F.col("status") == "PASS", F.lit("INFO")).otherwise(F.lit("CRITICAL")).alias("severity"),
        "score", "mismatch_count",
        F.when(F.col("status") == "PASS",
               F.format_string("%d rows agree over %d shared keys", "rows_matched", "rows_compared"))
        .otherwise(F.format_string("%d rows or cells differ", "mismatch_count"))
        .alias("summary"))


def _shared_rows(src: DataFrame, tgt: DataFrame, config: "ValidationConfig") -> RowComparison | None:
    """The row comparison that the row and edge checks share: it keeps the
    boundary cells as it reads the sides.  None where it is not wanted or
    fails; each check then works, or fails, for itself."""
    if not {"RowValidator", "EdgeCaseValidator"} <= set(config.enabled):
        return None
    try:
        rows = compare_rows(src, tgt, list(config.keys) if config.keys else None, replace(config.compare, boundaries=config.boundaries))
        if any(is_numeric(src.schema[c].dataType) != is_numeric(tgt.schema[c].dataType) for c in rows.types):
            return None
        rows.distinct_rows
        return rows
    except Exception:
        return None


def schema_check(src: DataFrame, tgt: DataFrame, order_matters: bool = True) -> DataFrame:
    """Schema check of two DataFrames (D2 for one pair).  Schemas are plan
    metadata already on the driver, so the rules are applied to them
    directly and the one check row is a literal; ``schema.schema_diff``
    applies the same rules to catalogs of many pairs in Spark."""
    from ...functions.types import normalize_type_name
    s = [(f.name, f.dataType.simpleString().upper()) for f in src.schema.fields]
    t = [(f.name, f.dataType.simpleString().upper()) for f in tgt.schema.fields]
    sm, tm = dict(s), dict(t)
    missing = set(sm) - set(tm)
    extra = set(tm) - set(sm)
    common = set(sm) & set(tm)
    compatible = sum(1 for c in common if normalize_type_name(sm[c]) == normalize_type_name(tm[c]))
    mismatches = len(missing) + len(extra) + (len(common) - compatible)
    if order_matters and [n for n, _ in s] != [n for n, _ in t] and not missing and not extra:
        mismatches += 1
    total = max(len(s), len(t))
    score = round(compatible / total, 4) if total else 1.0
    status = "PASS" if mismatches == 0 else "FAIL"
    row = ("SchemaValidator", status, "INFO" if status == "PASS" else "CRITICAL", float(score), mismatches,
           f"{compatible} of {total} columns fit")
    return literal_rows(src.sparkSession, [row], CHECK_SCHEMA)


@dataclass(frozen=True)
class ValidationConfig:
    keys: tuple[str, ...] | None = None
    enabled: tuple[str, ...] = DEFAULT_CHECKS
    order_matters: bool = True
    boundaries: tuple[float, ...] = (499.99, 500.00, 500.01)
    compare: CompareConfig = CompareConfig()


def _as_check(df: DataFrame) -> DataFrame:
    cols = {c: F.col(c) for c in df.columns}
    return df.select(*[cols.get(c, F.lit(None)).cast(t).alias(c) for c, t in
                       (x.split() for x in CHECK_SCHEMA.split(", "))])


def check_frames(src: DataFrame, tgt: DataFrame, config: ValidationConfig | None = None,
                 components: DataFrame | None = None) -> dict[str, DataFrame]:
    """The enabled checks as lazy one-row DataFrames (in check order)."""
    config = config or ValidationConfig()
    spark = src.sparkSession
    keys = list(config.keys) if config.keys else None
    from .aggregates import default_specs
    specs = default_specs(src, tgt)  # shared by the aggregate and edge checks
    rows = _shared_rows(src, tgt, config)
    out: dict[str, DataFrame] = {}
    for name in config.enabled:
        try:
            if name == "SchemaValidator":
                df = schema_check(src, tgt, config.order_matters)
            elif name == "RowValidator":
                df = row_check(src, tgt, keys, config.compare, rows)
            elif name == "AggregateValidator":
                df = aggregate_check(src, tgt, specs, config.compare.abs_tol, config.compare.rel_tol) \
                    .withColumn("summary", F.format_string("%d aggregates differ", "mismatch_count"))
            elif name == "BusinessRuleValidator":
                from ..structure import rule_check
                df = rule_check(spark, components)
            elif name == "EdgeCaseValidator":
                df = edge_check(src, tgt, keys, config.boundaries, specs=specs, rows=rows) \
                    .withColumn("summary", F.concat(F.lit("edge cases: "), F.col("scenario")))
            else:
                raise ValueError(f"unknown check {name}")
            out[name] = _as_check(df)
        except Exception as exc:  # a broken check becomes one ERROR row
            out[name] = _error_row(spark, name, exc)
    return out


EVIDENCE_SCHEMA = ("check_name string, type string, key map<string,string>, column string, source_value string, "
                   "target_value string, category string")


def schema_evidence(src: DataFrame, tgt: DataFrame, order_matters: bool = True) -> DataFrame:
    """Evidence of the schema check, from schema metadata alone."""
    from ...functions.types import normalize_type_name
    s = {f.name: f.dataType.simpleString().upper() for f in src.schema.fields}
    t = {f.name: f.dataType.simpleString().upper() for f in tgt.schema.fields}
    rows = [(c, s[c], None, "COLUMN_MISSING") for c in s if c not in t] + [(c, None, t[c], "COLUMN_EXTRA") for c in t if c not in s]
    rows += [(c, s[c], t[c], "TYPE_CHANGED") for c in s if c in t and normalize_type_name(s[c]) != normalize_type_name(t[c])]
    if order_matters and set(s) == set(t) and list(s) != list(t):
        rows.append((None, ",".join(s), ",".join(t), "COLUMN_ORDER_CHANGED"))
    return literal_rows(src.sparkSession, rows, "column string, source_value string, target_value string, category string").withColumns(
        {"check_name": F.lit("SchemaValidator"), "type": F.lit("SCHEMA_MISMATCH")})


def evidence(src: DataFrame, tgt: DataFrame, config: ValidationConfig | None = None) -> DataFrame:
    """All evidence of the schema, row, aggregate and edge checks of a pair
    in one table (``EVIDENCE_SCHEMA``).  Aggregates are written with eleven
    significant digits, as sums depend on the order of adding."""
    from .aggregates import aggregate_diff, default_specs
    from .edges import boundary_keyset_diff, null_count_diff
    config = config or ValidationConfig()
    keys = list(config.keys) if config.keys else None
    specs = default_specs(src, tgt)
    digits = lambda c: F.format_string("%.10e", c)
    rows = _shared_rows(src, tgt, config)
    parts = [
        schema_evidence(src, tgt, config.order_matters),
        (rows or compare_rows(src, tgt, keys, config.compare)).evidence_rows.withColumn("check_name", F.lit("RowValidator")),
        aggregate_diff(src, tgt, specs, config.compare.abs_tol, config.compare.rel_tol).filter(~F.col("matched")).select(
            F.lit("AggregateValidator").alias("check_name"), F.lit("AGGREGATE_MISMATCH").alias("type"), "column",
            digits("source_value").alias("source_value"), digits("target_value").alias("target_value"), F.col("function").alias("category")),
        null_count_diff(src, tgt, specs).filter("differs").select(
            F.lit("EdgeCaseValidator").alias("check_name"), F.lit("EDGE_CASE_FAILURE").alias("type"),
            F.col("source_nulls").cast("string").alias("source_value"), F.col("target_nulls").cast("string").alias("target_value"), F.lit("NULL_SEMANTICS").alias("category")),
        boundary_keyset_diff(src, tgt, keys, config.boundaries, rows=rows).select(
            F.lit("EdgeCaseValidator").alias("check_name"), F.lit("EDGE_CASE_FAILURE").alias("type"),
            F.create_map(F.col("key_column"), F.format_string("%.2f", "value")).alias("key"), "column",
            F.col("source_only_keys").cast("string").alias("source_value"), F.col("target_only_keys").cast("string").alias("target_value"),
            F.lit("BOUNDARY_VALUE").alias("category"))]
    out = None
    for p in parts:
        p = _shaped(p)
        out = p if out is None else out.unionByName(p)
    return out


def _shaped(df: DataFrame) -> DataFrame:
    cols = [x.split() for x in EVIDENCE_SCHEMA.split(", ")]
    empty = {"key": F.create_map().cast("map<string,string>")}
    return df.select(*[(F.col(c) if c in df.columns else empty.get(c, F.lit(None))).cast(t).alias(c) for c, t in cols])


def _error_row(spark: SparkSession, name: str, exc: Exception) -> DataFrame:
    return literal_rows(spark, [(name, "ERROR", "HIGH", 0.0, 0, f"check stopped: {exc}")],
                        CHECK_SCHEMA)


def validate(src: DataFrame, tgt: DataFrame, config: ValidationConfig | None = None,
             components: DataFrame | None = None) -> DataFrame:
    """D23 (lazy): the union of the enabled check rows, with ``check_order``."""
    frames = check_frames(src, tgt, config, components)
    out = None
    for i, df in enumerate(frames.values()):
        df = df.withColumn("check_order", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out


def run_checks(src: DataFrame, tgt: DataFrame, config: ValidationConfig | None = None,
               components: DataFrame | None = None) -> DataFrame:
    """D23 (eager): evaluates check by check; a check failing at run time
    becomes an ERROR row and the rest still run.  Only the one-row check
    results reach the driver."""
    frames = check_frames(src, tgt, config, components)
    spark = src.sparkSession
    rows = []
    for name, df in frames.items():
        try:
            rows += [tuple(r) for r in df.select(*CHECK_COLUMNS).collect()]
        except Exception as exc:
            rows.append((name, "ERROR", "HIGH", 0.0, 0, f"check stopped: {exc}"))
    return literal_rows(spark, rows, CHECK_SCHEMA)


def report_rollup(checks: DataFrame, id_col: str = "validation_id") -> DataFrame:
    """D20 over many validations: counts per status and the overall status
    (FAIL > ERROR > WARN > PASS; SKIPPED counts only in ``checks_run``)."""
    st = F.col("status")
    agg = checks.groupBy(id_col).agg(
        F.count("*").alias("checks_run"),
        F.count(F.when(st == "PASS", 1)).alias("checks_passed"),
        F.count(F.when(st == "WARN", 1)).alias("checks_warned"),
        F.count(F.when(st == "FAIL", 1)).alias("checks_failed"),
        F.count(F.when(st == "ERROR", 1)).alias("checks_errored"))
    overall = (F.when(F.col("checks_failed") > 0, F.lit("FAIL"))
               .when(F.col("checks_errored") > 0, F.lit("ERROR"))
               .when(F.col("checks_warned") > 0, F.lit("WARN")).otherwise(F.lit("PASS")))
    return agg.withColumn("overall_status", overall)


def compare_pair(spark: SparkSession, source_sql: str, target_sql: str,
                 tables: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a source query and its migrated counterpart on the same
    tables (registered as views when ``tables`` maps names to files) and
    return both results as lazy DataFrames for ``validate``."""
    if tables:
        from ...sources.catalog import register_views
        register_views(spark, tables)
    return spark.sql(source_sql), spark.sql(target_sql)
