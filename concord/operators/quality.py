"""E — data quality and profiling.

Checks return small frames (one row per check or per offending value);
profiles are long frames, one row per (table, column[, value]), all of them
from one count of every column's values per table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import is_numeric
from ..functions.values import null_like
from ..session import literal_rows

CHECK_COLS = "check_name string, table_name string, passed boolean, violations long, message string"


def pk_duplicates(df: DataFrame, col: str) -> DataFrame:
    """E1 detail: key values (NULL included) occurring more than once."""
    return df.groupBy(col).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def pk_unique(df: DataFrame, col: str, table: str) -> DataFrame:
    """Passed iff no duplicate value; violations = duplicated values."""
    d = pk_duplicates(df, col).agg(F.count("*").alias("violations"))
    return d.select(F.lit(f"{table}_pk_unique").alias("check_name"), F.lit(table).alias("table_name"),
                    (F.col("violations") == 0).alias("passed"), "violations",
                    F.when(F.col("violations") > 0,
                           F.lit(f"{table}.{col} is not unique")).alias("message"))


def fk_orphan_keys(child: DataFrame, parent: DataFrame, col: str, parent_col: str | None = None,
                   strict: bool = False) -> DataFrame:
    """E2 / E3 detail: distinct child keys without a parent.  Lenient: NULL
    child keys are ignored.  Strict: a NULL child key is an orphan unless
    the parent also has a NULL key."""
    parent_col = parent_col or col
    keys = child.select(F.col(col).alias("k")).distinct()
    pk = parent.select(F.col(parent_col).alias("pk")).distinct()
    if strict:
        return keys.join(pk, keys.k.eqNullSafe(pk.pk), "left_anti")
    return keys.filter(F.col("k").isNotNull()).join(
        pk.filter(F.col("pk").isNotNull()), F.col("k") == F.col("pk"), "left_anti")


def fk_check(child: DataFrame, parent: DataFrame, col: str, name: str, child_table: str,
             parent_col: str | None = None, strict: bool = False) -> DataFrame:
    """E2 (lenient) / E3 (strict) check row."""
    o = fk_orphan_keys(child, parent, col, parent_col, strict).agg(F.count("*").alias("violations"))
    return o.select(F.lit(name).alias("check_name"), F.lit(child_table).alias("table_name"),
                    (F.col("violations") == 0).alias("passed"), "violations",
                    F.when(F.col("violations") > 0, F.format_string(
                        f"{child_table}.{col}: %d keys without a parent", "violations"))
                    .alias("message"))


def consistency_mismatches(child: DataFrame, parent: DataFrame, key: str, attr: str) -> DataFrame:
    """E4 detail: joined rows whose attribute differs (NULL keys/attrs are
    dropped on both sides first)."""
    c = child.select(F.col(key).alias("_k"), F.col(attr).alias("_c")).dropna()
    p = parent.select(F.col(key).alias("_k"), F.col(attr).alias("_p")).dropna()
    return c.join(p, "_k").filter(F.col("_c") != F.col("_p"))


def consistency_check(child: DataFrame, parent: DataFrame, key: str, attr: str, name: str,
                      child_table: str) -> DataFrame:
    """E4 check row."""
    m = consistency_mismatches(child, parent, key, attr).agg(F.count("*").alias("violations"))
    return m.select(F.lit(name).alias("check_name"), F.lit(child_table).alias("table_name"),
                    (F.col("violations") == 0).alias("passed"), "violations",
                    F.when(F.col("violations") > 0, F.format_string(
                        f"{child_table} contain %d {attr} mismatches with parent", "violations"))
                    .alias("message"))


def domain_violations(df: DataFrame, col: str, allowed) -> DataFrame:
    """E5 detail: distinct non-null values outside ``allowed``."""
    return (df.select(F.col(col).alias("value")).filter(F.col("value").isNotNull())
            .filter(~F.col("value").isin(list(allowed))).distinct())


def domain_check(df: DataFrame, col: str, allowed, name: str, table: str) -> DataFrame:
    """E5 check row."""
    v = domain_violations(df, col, allowed).agg(F.count("*").alias("violations"))
    return v.select(F.lit(name).alias("check_name"), F.lit(table).alias("table_name"),
                    (F.col("violations") == 0).alias("passed"), "violations",
                    F.when(F.col("violations") > 0, F.lit(f"Invalid {col} values")).alias("message"))


@dataclass(frozen=True)
class Rule:
    """One integrity rule over named tables.  ``kind`` is pk / fk / fk_strict
    / consistency / domain."""
    name: str
    kind: str
    table: str
    column: str
    other: str | None = None
    other_column: str | None = None
    allowed: tuple = ()


def integrity_report(tables: dict[str, DataFrame], rules: list[Rule]) -> DataFrame:
    """One row per applicable rule; a rule whose table is absent is
    left out.  ``valid`` of the dataset = all rows passed (see
    ``integrity_valid``)."""
    rows = []
    for r in rules:
        if r.table not in tables or (r.other is not None and r.other not in tables):
            continue
        t = tables[r.table]
        if r.kind == "pk":
            rows.append(pk_unique(t, r.column, r.table).withColumn("check_name", F.lit(r.name)))
        elif r.kind in ("fk", "fk_strict"):
            rows.append(fk_check(t, tables[r.other], r.column, r.name, r.table, r.other_column,
                                 r.kind == "fk_strict"))
        elif r.kind == "consistency":
            rows.append(consistency_check(t, tables[r.other], r.column, r.other_column, r.name, r.table))
        elif r.kind == "domain":
            rows.append(domain_check(t, r.column, r.allowed, r.name, r.table))
        else:
            raise ValueError(f"unknown rule kind {r.kind}")
    if not rows:
        spark = SparkSession.getActiveSession()
        return spark.createDataFrame([], CHECK_COLS)
    return reduce(DataFrame.unionByName, rows)


def integrity_valid(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("is_valid"),
                      F.count(F.when(~F.col("passed"), 1)).alias("violations"))


# ------------------------------------------------------------- profiles
SHARE_LIMIT = 20        # distinct values up to which a text column gets shares
LABEL_CHARS = 256       # longer values are told apart by their hash


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)


def value_counts(df: DataFrame, skip: frozenset[str] = frozenset()) -> DataFrame:
    """``(ordinal, place, value, n, bits, min_val, max_val)``: how often the
    values of each column (but ``skip``) occur, in one pass over the table.

    Whole numbers, dates and booleans travel as bitmaps of 64 neighbouring
    values (``place`` is the value divided by 64, ``bits`` the or of their
    bits), so a key column that is nearly unique shuffles a row for 64 values;
    any other value is a row of its own text.  NULL and float NaN are the null
    value (neither place nor value); -0.0 is 0.0; a text longer than
    ``LABEL_CHARS`` is its first characters and its SHA-256.  Map tasks add up
    what they have before the shuffle, which spreads every column over all
    partitions."""
    cells = []
    null = lambda t: F.lit(None).cast(t)
    for i, f in enumerate(df.schema.fields):
        if f.name in skip:
            continue
        c = F.col(f"`{f.name}`")
        place, bits, text, num = null("long"), null("long"), null("string"), null("double")
        if isinstance(f.dataType, _WHOLE):
            x = (F.unix_date(c) if isinstance(f.dataType, T.DateType) else c).cast("long")
            place, bits = F.shiftright(x, 6), F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            text = F.when(c.isNotNull(), F.to_json(F.struct(c)))
        elif isinstance(f.dataType, T.BinaryType):
            text = F.hex(c)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            text = F.when(~null_like(c, f.dataType), (c + F.lit(0.0)).cast("string"))
        else:
            text = c.cast("string")
        text = F.when(F.length(text) > LABEL_CHARS, F.concat(F.substring(text, 1, 64), F.lit("#"), F.sha2(text, 256))).otherwise(text)
        if is_numeric(f.dataType):
            num = F.when(~null_like(c, f.dataType), c.cast("double"))
        cells.append(F.struct(F.lit(i).alias("ordinal"), place.alias("place"), text.alias("value"), bits.alias("bits"), num.alias("num")))
    if not cells:
        return df.sparkSession.createDataFrame([], "ordinal int, place long, value string, n long, bits long, min_val double, max_val double")
    return (df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").groupBy("ordinal", "place", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.bit_or("bits").alias("bits"), F.min("num").alias("min_val"), F.max("num").alias("max_val")))


@dataclass(frozen=True)
class Sketched:
    """Columns of a table that are nearly unique, by ordinal: (rows, nulls,
    estimated distinct values, min, max)."""

    names: frozenset[str]
    figures: dict[int, tuple]


def near_unique(df: DataFrame, share: float = 0.5) -> Sketched:
    """One pass of mergeable sketches over the columns that no bitmap holds:
    those with more distinct values than ``share`` of their rows.  A map task
    sends one sketch a column, whatever its rows."""
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, (T.StringType, T.FloatType, T.DoubleType, T.DecimalType, T.TimestampType, T.BinaryType))]
    if not fields:
        return Sketched(frozenset(), {})
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in fields:
        c = F.col(f"`{f.name}`")
        known = F.when(~null_like(c, f.dataType), c)
        held = known.cast("string") if not isinstance(f.dataType, (T.StringType, T.BinaryType)) else known
        num = known.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        aggs += [F.count(known).alias(f"k{i}"), F.hll_sketch_estimate(F.hll_sketch_agg(held, 14)).alias(f"d{i}"), F.min(num).alias(f"a{i}"), F.max(num).alias(f"b{i}")]
    row = df.agg(*aggs).first()
    found = {i: (row["n"], row["n"] - row[f"k{i}"], row[f"d{i}"] or 0, row[f"a{i}"], row[f"b{i}"])
             for i, _ in fields if (row[f"d{i}"] or 0) > share * max(row["n"], 1)}
    return Sketched(frozenset(df.schema.fields[i].name for i in found), found)


def _columns(df: DataFrame, table: str) -> DataFrame:
    """One row per column, from the schema alone."""
    return literal_rows(df.sparkSession, [(table, f.name, i, isinstance(f.dataType, T.StringType)) for i, f in enumerate(df.schema.fields)],
                        "table_name string, column_name string, ordinal int, is_text boolean")


def _basic(columns: DataFrame, counts: DataFrame, sketched: Sketched | None = None) -> DataFrame:
    null = F.col("value").isNull() & F.col("place").isNull()
    values = F.when(F.col("place").isNotNull(), F.bit_count("bits")).when(F.col("value").isNotNull(), 1).otherwise(0)
    per = counts.groupBy("ordinal").agg(
        F.sum("n").alias("row_count"), F.sum(F.when(null, F.col("n")).otherwise(0)).alias("null_count"),
        F.sum(values).alias("distinct_count"), F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"))
    if sketched is not None and sketched.figures:
        rows = [(i, n, nulls, d, a, b) for i, (n, nulls, d, a, b) in sketched.figures.items()]
        per = per.unionByName(literal_rows(columns.sparkSession, rows, "ordinal int, row_count long, null_count long, distinct_count long, min_val double, max_val double"))
    b = columns.join(per, "ordinal", "left").fillna(0, ["row_count", "null_count", "distinct_count"])
    return b.withColumn("null_rate", F.when(F.col("row_count") > 0, F.round(F.col("null_count") / F.col("row_count"), 4)).otherwise(F.lit(0.0)))


def profile_basic(df: DataFrame, table: str) -> DataFrame:
    """E7 + E8: row count, NULL rate (4 dp), exact distinct non-null count,
    min/max as double for numeric columns; one row per column."""
    return _basic(_columns(df, table), value_counts(df)).select(
        "table_name", "column_name", "ordinal", "row_count", "null_count", "null_rate", "distinct_count", "min_val", "max_val")


def _shares(basic: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    few = basic.filter(F.col("is_text") & (F.col("distinct_count") <= limit) & F.col("min_val").isNull() & F.col("max_val").isNull()).select(
        "ordinal", "table_name", "column_name", (F.col("row_count") - F.col("null_count")).alias("total"))
    # asked of the sums, the filter stays above the shuffle: all readers of the counts share the one shuffle
    text = F.when((F.col("n") > 0) & F.col("min_val").isNull() & F.col("max_val").isNull() & F.col("bits").isNull(), F.col("value"))
    return counts.withColumn("value", text).filter(F.col("value").isNotNull()).join(few, "ordinal").select(
        "table_name", "column_name", "value", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def profile_categorical(df: DataFrame, table: str, limit: int = SHARE_LIMIT) -> DataFrame:
    """Value shares (4 dp, over non-null values) of the string columns
    with at most ``limit`` distinct values; ``dataset_profile`` names the
    columns that have more."""
    counts = value_counts(df)
    return _shares(_basic(_columns(df, table), counts), counts, limit)


def dataset_profile(tables: dict[str, DataFrame], limit: int = SHARE_LIMIT, sketch_near_unique: bool = False) -> DataFrame:
    """Long form ``(table_name, column_name, metric, label, value)``
    over every table: row_count, null_rate, distinct_count, min, max, one
    ``share`` row per value of the text columns with at most ``limit``
    distinct values, and ``shares_omitted`` (their number) for the others.
    Each table is scanned once: its value counts feed all figures.  All
    figures are exact, unless ``sketch_near_unique``: then a first pass of
    sketches names the columns that are nearly unique (no bitmap holds them,
    and their exact count would shuffle every value); their distinct counts
    are estimates, and marked by a row ``distinct_is_estimate``."""
    parts = []
    for name, df in tables.items():
        sketched = near_unique(df) if sketch_near_unique else Sketched(frozenset(), {})
        counts = value_counts(df, sketched.names)
        b = _basic(_columns(df, name), counts, sketched)
        guessed = F.col("ordinal").isin(*sketched.figures) if sketched.figures else F.lit(False)
        metrics = F.array(
            F.struct(F.lit("row_count").alias("metric"), F.col("row_count").cast("double").alias("value")),
            F.struct(F.lit("null_rate").alias("metric"), F.col("null_rate").alias("value")),
            F.struct(F.lit("distinct_count").alias("metric"), F.col("distinct_count").cast("double").alias("value")),
            F.struct(F.lit("distinct_is_estimate").alias("metric"), F.when(guessed, F.lit(1.0)).alias("value")),
            F.struct(F.lit("shares_omitted").alias("metric"), F.when(F.col("is_text") & (F.col("distinct_count") > limit), F.col("distinct_count").cast("double")).alias("value")),
            F.struct(F.lit("min").alias("metric"), F.col("min_val").alias("value")),
            F.struct(F.lit("max").alias("metric"), F.col("max_val").alias("value")))
        parts.append(b.select("table_name", "column_name", F.explode(metrics).alias("m"))
                     .select("table_name", "column_name", "m.metric", F.lit(None).cast("string").alias("label"), "m.value")
                     .filter(F.col("value").isNotNull()))
        parts.append(_shares(b, counts, limit).select(
            "table_name", "column_name", F.lit("share").alias("metric"), F.col("value").alias("label"), F.col("share").alias("value")))
    return reduce(DataFrame.unionByName, parts)
