"""B — the query idioms of the migration corpus, as DataFrame helpers.

These are what a user writes in place of the dialect-specific SQL forms
(QUALIFY, KEEP DENSE_RANK, ARRAY_AGG ... LIMIT 1, TOP n, TO_CHAR, ...).
Each helper is plain DataFrame code that Catalyst plans; none collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier(c: Column, rules: list[tuple[Column, str]], default: str) -> Column:
    """Ordered CASE; the first matching rule wins."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def first_per_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """B13 (``QUALIFY ROW_NUMBER() OVER (...) = 1``): the first row of each
    group.  Planned as a window inside hash partitions of ``by``; Spark
    turns ``rn = 1`` into a per-partition group limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def keep_dense_rank(df: DataFrame, by: list[str], agg: str, value: str, order_col: str,
                    position: str = "FIRST", descending: bool = False, alias: str | None = None) -> DataFrame:
    """``AGG(value) KEEP (DENSE_RANK FIRST|LAST ORDER BY order_col [DESC])``.

    The aggregate runs over the rows tied at the first (or last) value of
    ``order_col``; NULL values are ignored.  When the direction of the
    aggregate and of the rank agree it is one struct min/max; otherwise the
    extreme ``order_col`` per group is aggregated first and joined back
    (two aggregations, no window over a possibly hot group)."""
    alias = alias or f"{agg.lower()}_{value}"
    take_max_order = (position.upper() == "LAST") != descending
    src = df.filter(F.col(value).isNotNull() & F.col(order_col).isNotNull())
    agg = agg.upper()
    if (agg == "MAX") == take_max_order and agg in ("MAX", "MIN"):
        s = F.struct(F.col(order_col).alias("o"), F.col(value).alias("v"))
        red = F.max(s) if take_max_order else F.min(s)
        return src.groupBy(*by).agg(red.getField("v").alias(alias))
    ext = (F.max if take_max_order else F.min)(order_col).alias("_ext")
    tops = src.groupBy(*by).agg(ext)
    fn = {"MAX": F.max, "MIN": F.min, "SUM": F.sum, "AVG": F.avg, "COUNT": F.count}[agg]
    return (src.join(tops, by).filter(F.col(order_col) == F.col("_ext"))
            .groupBy(*by).agg(fn(value).alias(alias)))


def arg_extreme(df: DataFrame, by: list[str], value: str, order_col: str, largest: bool = True,
                alias: str | None = None) -> DataFrame:
    """``ARRAY_AGG(value ORDER BY order_col [DESC] LIMIT 1)[OFFSET(0)]``
    as arg_max / arg_min; ties go to the largest (smallest) value, rows
    with a NULL value are skipped."""
    alias = alias or f"arg_{value}"
    s = F.struct(F.col(order_col).alias("o"), F.col(value).alias("v"))
    red = F.max(s) if largest else F.min(s)
    return (df.filter(F.col(value).isNotNull()).groupBy(*by)
            .agg(red.getField("v").alias(alias)))


def match_cardinality(left: DataFrame, right: DataFrame, key: str, right_key: str,
                      label: str = "match_type") -> DataFrame:
    """Per left key, how many right rows a left join finds."""
    cnt = right.groupBy(F.col(right_key).alias(key)).agg(F.count("*").alias("_n"))
    j = left.select(key).join(cnt, key, "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    return j.select(key, n.alias("match_count"),
                    F.when(n == 0, F.lit("NO_MATCH")).when(n == 1, F.lit("SINGLE_MATCH"))
                    .otherwise(F.lit("MULTI_ENTITY")).alias(label))


def bare_name(c: Column) -> Column:
    """``catalog.schema.table`` -> ``table``."""
    return F.regexp_extract(c, r"([^.]+)$", 1)


def to_char_date(c: Column) -> Column:
    """``TO_CHAR(d, 'YYYY-MM-DD')``."""
    return F.date_format(c, "yyyy-MM-dd")
