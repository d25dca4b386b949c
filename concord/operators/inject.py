"""C — controlled fault injection (table -> table).

Every operator assigns values to the first ``n`` rows (in the order of a
unique ordering key) that satisfy an optional predicate.  The first rows
are found with ``orderBy(key).limit(n)`` (a distributed top-n), numbered
on those ``n`` rows only, and broadcast back by key: the broadcast side
has exactly ``n`` rows whatever the table size.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reference scenarios.
REFUND_TRIPLE = (499.99, 500.00, 500.01)
ORPHAN_IDS = ("ACCT-ORPHAN-99999", "ACCT-ORPHAN-99998")
MONTH_EDGES = ("2023-01-31 23:59:59", "2023-02-28 00:00:00")
LEAP_DAY = ("2024-02-29 12:00:00",)
SIGN_EDGES = (-150.75, 0.00)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def first_rows(df: DataFrame, key, n: int, predicate: Column | None = None) -> DataFrame:
    """``(key..., _pos)`` of the first ``n`` matching rows, ``_pos`` = 1..n."""
    keys = _keys(key)
    sel = df.filter(predicate) if predicate is not None else df
    top = sel.select(*keys).orderBy(*keys).limit(n)
    return top.withColumn("_pos", F.row_number().over(Window.orderBy(*keys)))


def assign_first(df: DataFrame, key, values: dict[str, list], predicate: Column | None = None,
                 n: int | None = None) -> DataFrame:
    """Set ``values[col][i]`` on the i-th first matching row (one list per
    column; a single-element list applies to all n rows)."""
    keys = _keys(key)
    n = n if n is not None else max(len(v) for v in values.values())
    firsts = first_rows(df, keys, n, predicate)
    j = df.join(F.broadcast(firsts), keys, "left")
    dtypes = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in values:
            vals = values[c]
            lits = [F.lit(v) for v in vals]
            arr = F.array(*[x.cast(dtypes[c]) for x in lits])
            pick = F.element_at(arr, F.col("_pos")) if len(vals) > 1 else lits[0].cast(dtypes[c])
            out.append(F.when(F.col("_pos").isNotNull(), pick).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def inject_boundary_triple(df: DataFrame, col: str, key, threshold: float = 500.0, eps: float = 0.01,
                           predicate: Column | None = None) -> DataFrame:
    """First three matching rows get ``t-eps, t, t+eps``."""
    vals = [round(threshold - eps, 10), float(threshold), round(threshold + eps, 10)]
    return assign_first(df, key, {col: vals}, predicate)


def flood_boundary(df: DataFrame, col: str, key, threshold: float, predicate: Column,
                   exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every matching row outside ``exclude`` (a key frame, e.g. the C1
    triple) is set to ``threshold``.  Returns the table and a one-row
    frame with the number of rows changed."""
    keys = _keys(key)
    if exclude is not None:
        ex = exclude.select(*keys).distinct().withColumn("_ex", F.lit(True))
        j = df.join(ex, keys, "left")
        hit = predicate & F.col("_ex").isNull()
    else:
        j, hit = df.withColumn("_ex", F.lit(None)), predicate
    j = j.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    dt = dict(df.dtypes)[col]
    out = j.select(*[F.when(F.col("_hit"), F.lit(threshold).cast(dt)).otherwise(F.col(c)).alias(c)
                     if c == col else F.col(c) for c in df.columns])
    count = j.agg(F.count(F.when(F.col("_hit"), 1)).alias("boundary_rows"))
    return out, count


def null_out(df: DataFrame, col: str, key, n: int = 5, predicate: Column | None = None) -> DataFrame:
    """``col`` set to NULL on the first ``n`` matching rows."""
    return assign_first(df, key, {col: [None]}, predicate, n)


def null_head(df: DataFrame, col: str, key, n: int = 11) -> DataFrame:
    """C4: ``col`` set to NULL on the first ``n`` rows (an inclusive head
    slice ``[:10]`` is 11 rows)."""
    return assign_first(df, key, {col: [None]}, None, n)


def orphan_fk(df: DataFrame, col: str, key, values=ORPHAN_IDS) -> DataFrame:
    """The first rows point at parents that do not exist."""
    return assign_first(df, key, {col: list(values)}, None, len(values))


def null_join_key(df: DataFrame, col: str, key, n: int = 2) -> DataFrame:
    """Join key set to NULL on the first ``n`` rows."""
    return assign_first(df, key, {col: [None]}, None, n)


def duplicate_rows(df: DataFrame, key, n: int = 1) -> DataFrame:
    """Exact copies of the first ``n`` rows appended."""
    keys = _keys(key)
    return df.unionByName(df.orderBy(*keys).limit(n))


def force_group_to_first(df: DataFrame, key, parent: DataFrame, parent_key: str, fk_col: str,
                         fixed: dict[str, object], n: int = 3) -> DataFrame:
    """C8 with the group taken from the data: the first ``n`` rows get the
    parent key of the first parent row (a one-row lookup, cross-joined as a
    broadcast scalar) plus the fixed values."""
    keys = _keys(key)
    # the first parent key as a scalar subquery (one value)
    gk = parent.agg(F.min(parent_key)).scalar()
    firsts = first_rows(df, keys, n).withColumn("_gk", gk)
    j = df.join(F.broadcast(firsts), keys, "left")
    dt = dict(df.dtypes)
    out = []
    for c in df.columns:
        hit = F.col("_pos").isNotNull()
        if c == fk_col:
            out.append(F.when(hit, F.col("_gk").cast(dt[c])).otherwise(F.col(c)).alias(c))
        elif c in fixed:
            out.append(F.when(hit, F.lit(fixed[c]).cast(dt[c])).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def zero_head(df: DataFrame, col: str, key, n: int = 5) -> DataFrame:
    """``col`` set to 0 on the first ``n`` rows (``[:4]`` is 5 rows)."""
    return assign_first(df, key, {col: [0.0]}, None, n)


def date_edges(df: DataFrame, col: str, key, values=MONTH_EDGES) -> DataFrame:
    """Calendar edge timestamps on the first rows."""
    ts = [datetime.fromisoformat(v) for v in values]
    return assign_first(df, key, {col: ts}, None, len(ts))


def sign_edges(df: DataFrame, col: str, key, values=SIGN_EDGES) -> DataFrame:
    """C11: a negative amount and zero on the first rows."""
    return assign_first(df, key, {col: list(values)}, None, len(values))
