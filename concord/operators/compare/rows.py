"""D3, D6, D7, D8, D9, D10, D11, D12, D13 — rows compared as multisets per key.

One algorithm at every size, all of it DataFrame expressions:

1. Both sides are unioned with a side tag and grouped on *all* columns
   (keys + common columns): identical rows pair off as
   ``least(n_src, n_tgt)`` (D7).  Grouping on all columns spreads a hot
   key over many partitions and the partial aggregate collapses exact
   duplicates map-side.  Counts are kept; copies are never written out.
2. The distinct-row table is grouped on the keys alone for key presence
   (D3), duplicate-key warnings (D10) and residual counts.
3. Residual rows of keys present on both sides are paired by most equal
   columns (D8, ``pairing.py``).
4. Cells of paired rows are compared with the D5 expression (D6), which
   alone decides equality; surplus rows are unpaired duplicates (D9).

Columns whose types differ are folded to one type first: numbers to the
wider number, booleans against numbers to that number, anything else to
text, where D5 still compares numeric text as numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...session import merge_single_rows, written
from ...functions.types import is_numeric
from ...functions.values import ABS_TOL, REL_TOL, as_number, as_text, display_value, nan_to_null, values_equal
from .pairing import PAIRS, Pairing

MISSING = "MISSING_FROM_TARGET"
EXTRA = "EXTRA_IN_TARGET"
VALUE = "VALUE_MISMATCH"
WARNING = "NON_UNIQUE_KEY_WARNING"


class ComparisonKeyError(ValueError):
    """A comparison key is absent from one of the schemas."""


@dataclass(frozen=True)
class CompareConfig:
    keys: tuple[str, ...] | None = None
    abs_tol: float = ABS_TOL
    rel_tol: float = REL_TOL
    max_evidence: int = 100
    boundaries: tuple[float, ...] = ()   # values whose cells are kept for the edge check
    max_pairs: int = PAIRS     # possible pairs of a key up to which its residual rows meet in one row
    persist: bool = False      # cache intermediates for several results; then call release()


def _nsafe(left: DataFrame, right: DataFrame, cols: list[str],
           lp: str = "", rp: str = "") -> Column:
    conds = [left[lp + c].eqNullSafe(right[rp + c]) for c in cols]
    return reduce(lambda a, b: a & b, conds)


def key_presence(src: DataFrame, tgt: DataFrame, keys: list[str]) -> DataFrame:
    """D3 alone: distinct keys missing from / extra in the target.

    Columns: keys..., ``presence``.  One aggregation over the union of both
    key projections (NULL keys group together, i.e. NULL matches NULL)."""
    s = src.select(*keys, F.lit(1).alias("_s"), F.lit(0).alias("_t"))
    t = tgt.select(*keys, F.lit(0).alias("_s"), F.lit(1).alias("_t"))
    g = s.unionByName(t).groupBy(*keys).agg(F.max("_s").alias("_s"), F.max("_t").alias("_t"))
    return (g.filter(F.col("_s") != F.col("_t"))
            .select(*keys, F.when(F.col("_s") == 1, F.lit(MISSING)).otherwise(F.lit(EXTRA))
                    .alias("presence")))


@dataclass
class RowComparison:
    src: DataFrame
    tgt: DataFrame
    keys: list[str]
    cols: list[str]
    cfg: CompareConfig
    types: dict[str, T.DataType] = field(default_factory=dict)

    def release(self) -> None:
        """Unpersist the cached intermediates (key stats, pairs) once the
        caller is done with this comparison."""
        for name in ("key_stats", "pairs"):
            df = self.__dict__.pop(name, None)
            if df is not None:
                df.unpersist()

    # ------------------------------------------------------------------ prep
    def _side(self, df: DataFrame, s: int) -> DataFrame:
        exprs = [nan_to_null(F.col(c).cast(self.types[c]), self.types[c]).alias(c)
                 for c in self.keys + self.cols]
        return df.select(*exprs, F.lit(s).alias("_ns"), F.lit(1 - s).alias("_nt"))

    @cached_property
    def distinct_rows(self) -> DataFrame:
        """One row per distinct (keys, columns) with counts per side (D7),
        written once: every result starts from it, so each side is read once.
        Rows that pair off completely keep their keys and counts only; that
        is most of them.  ``_b``: the row's cells that equal one of
        ``cfg.boundaries``."""
        u = self._side(self.src, 1).unionByName(self._side(self.tgt, 0))
        g = (u.groupBy(*self.keys, *self.cols)
             .agg(F.sum("_ns").alias("ns"), F.sum("_nt").alias("nt"))
             .withColumn("matched", F.least("ns", "nt"))
             .withColumn("rs", F.col("ns") - F.col("matched"))
             .withColumn("rt", F.col("nt") - F.col("matched")))
        left = (F.col("rs") > 0) | (F.col("rt") > 0)
        return written(g.select(*self.keys, *[F.when(left, F.col(c)).alias(c) for c in self.cols], "ns", "nt", "matched", "rs", "rt",
                                self._boundary_cells().alias("_b")), "distinct-rows")

    def _boundary_cells(self) -> Column:
        cells = [F.when(F.col(c).cast("double").isin(*map(float, self.cfg.boundaries)),
                        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")))
                 for c in self.src.columns if self.cfg.boundaries and c in self.types and is_numeric(self.types[c])]
        if not cells:
            return F.lit(None).cast("array<struct<column:string,value:double>>")
        found = F.filter(F.array(*cells), lambda x: x.isNotNull())
        return F.when(F.size(found) > 0, found)

    def boundary_cells(self, key: str) -> DataFrame:
        """``(column, value, key, _s, _t)`` of the boundary cells: which
        sides have them."""
        return self.distinct_rows.filter(F.col("_b").isNotNull()).select(
            F.explode("_b").alias("b"), F.col(key).alias("key"), F.when(F.col("ns") > 0, 1).otherwise(0).alias("_s"),
            F.when(F.col("nt") > 0, 1).otherwise(0).alias("_t")).select("b.column", "b.value", "key", "_s", "_t")

    @cached_property
    def key_stats(self) -> DataFrame:
        ks = (self.distinct_rows.groupBy(*self.keys)
              .agg(F.sum("ns").alias("ks"), F.sum("nt").alias("kt"),
                   F.sum("matched").alias("km"),
                   F.sum("rs").alias("krs"), F.sum("rt").alias("krt")))
        return ks.persist(StorageLevel.MEMORY_AND_DISK) if self.cfg.persist else ks

    # ------------------------------------------------------------ D3 / D10
    @cached_property
    def key_presence(self) -> DataFrame:
        ks = self.key_stats
        return (ks.filter((F.col("ks") == 0) | (F.col("kt") == 0))
                .select(*self.keys, F.when(F.col("kt") == 0, F.lit(MISSING))
                        .otherwise(F.lit(EXTRA)).alias("presence")))

    @cached_property
    def duplicate_keys(self) -> DataFrame:
        """Shared keys with more than one row on either side."""
        ks = self.key_stats
        return ks.filter((F.col("ks") > 0) & (F.col("kt") > 0)
                         & ((F.col("ks") > 1) | (F.col("kt") > 1))).select(*self.keys, "ks", "kt")

    # --------------------------------------------------------- residuals
    @cached_property
    def residual(self) -> DataFrame:
        """Distinct residual rows of shared keys: keys, columns, ``side``
        (0 source, 1 target), ``n`` copies."""
        shared = self.key_stats.filter((F.col("ks") > 0) & (F.col("kt") > 0)
                                       & ((F.col("krs") > 0) | (F.col("krt") > 0))).select(*self.keys)
        g = self.distinct_rows.filter((F.col("rs") > 0) | (F.col("rt") > 0))
        return join_nullsafe(g, shared, self.keys, "left_semi").select(
            *self.keys, *self.cols, F.when(F.col("rs") > 0, 0).otherwise(1).alias("_side"),
            (F.col("rs") + F.col("rt")).cast("long").alias("_n"))

    def _canonical(self, c: str) -> Column:
        """Text that tells the cell's value up to about a millionth."""
        t = self.types[c]
        col = F.col(c)
        if is_numeric(t) or isinstance(t, (T.StringType, T.BooleanType)):
            x = as_number(col, t)
            return F.coalesce(six_digits(x), as_text(col), F.lit("\x00"))
        return F.coalesce(as_text(col), F.lit("\x00"))

    def _order(self) -> list[Column]:
        out = []
        for c in self.cols:
            t = self.types[c]
            if isinstance(t, T.StringType):
                out.append(as_number(F.col(c), t).asc_nulls_first())
            out.append(F.col(c).asc_nulls_first())
        return out

    @cached_property
    def pairs(self) -> DataFrame:
        """Paired and unpaired residual rows: keys, ``s_<c>``, ``t_<c>``,
        ``_has_s``, ``_has_t``, ``_n`` copies."""
        rule = Pairing(self.keys, self.cols, self.types, self._equal, self._canonical, self._order(), self.cfg.max_pairs)
        found = rule.pairs(self.residual)
        return found.persist(StorageLevel.MEMORY_AND_DISK) if self.cfg.persist else found

    def _equal(self, c: str, a: Column, b: Column) -> Column:
        return values_equal(a, self.types[c], b, self.types[c], self.cfg.abs_tol, self.cfg.rel_tol)

    # ---------------------------------------------------------- D6 / D9
    @cached_property
    def cells(self) -> DataFrame:
        """One row per differing cell of a paired row."""
        p = self.pairs.filter(F.col("_has_s") & F.col("_has_t"))
        diffs = F.array(*[
            F.when(~self._equal(c, F.col("s_" + c), F.col("t_" + c)),
                   F.struct(F.lit(c).alias("column"),
                            display_value(F.col("s_" + c), self.types[c]).alias("source_value"),
                            display_value(F.col("t_" + c), self.types[c]).alias("target_value")))
            for c in self.cols]) if self.cols else F.array().cast("array<struct<column:string,source_value:string,target_value:string>>")
        cells = p.select(*self.keys, "_n", F.explode(F.filter(diffs, lambda x: x.isNotNull())).alias("d"))
        return each_copy(cells).select(*self.keys, "d.column", "d.source_value", "d.target_value")

    @cached_property
    def pair_stats(self) -> DataFrame:
        """Per residual pair: number of differing cells (0 means matched)
        and ``_n`` copies."""
        p = self.pairs
        n_diff = reduce(lambda a, b: a + b, [
            F.when(self._equal(c, F.col("s_" + c), F.col("t_" + c)), F.lit(0)).otherwise(F.lit(1))
            for c in self.cols], F.lit(0))
        return p.select(*self.keys, "_has_s", "_has_t", n_diff.alias("n_diff"), "_n")

    @cached_property
    def unpaired(self) -> DataFrame:
        """Surplus rows of shared keys."""
        p = self.pairs.filter(~(F.col("_has_s") & F.col("_has_t")))
        return each_copy(p).select(*self.keys, F.when(F.col("_has_s"), F.lit(MISSING)).otherwise(F.lit(EXTRA)).alias("category"))

    # --------------------------------------------------------------- D11
    @cached_property
    def summary(self) -> DataFrame:
        """One row of counts, score and status."""
        ks = self.key_stats.agg(
            F.coalesce(F.sum("ks"), F.lit(0)).alias("src_rows"),
            F.coalesce(F.sum("kt"), F.lit(0)).alias("tgt_rows"),
            F.count(F.when((F.col("ks") > 0) & (F.col("kt") > 0), 1)).alias("rows_compared"),
            F.count(F.when(F.col("kt") == 0, 1)).alias("missing_keys"),
            F.count(F.when(F.col("ks") == 0, 1)).alias("extra_keys"),
            F.count(F.when((F.col("ks") > 0) & (F.col("kt") > 0)
                           & ((F.col("ks") > 1) | (F.col("kt") > 1)), 1)).alias("duplicate_key_warnings"),
            F.coalesce(F.max("ks"), F.lit(0)).alias("max_src_per_key"),
            F.coalesce(F.max("kt"), F.lit(0)).alias("max_tgt_per_key"),
            F.coalesce(F.sum(F.when((F.col("ks") > 0) & (F.col("kt") > 0), F.col("km"))), F.lit(0))
            .alias("exact_pairs"))
        ps = self.pair_stats.agg(
            F.coalesce(F.sum(F.when(~(F.col("_has_s") & F.col("_has_t")), F.col("_n"))), F.lit(0)).alias("unpaired_rows"),
            F.coalesce(F.sum(F.when(F.col("_has_s") & F.col("_has_t"), F.col("n_diff") * F.col("_n"))), F.lit(0))
            .alias("differing_cells"),
            F.coalesce(F.sum(F.when(F.col("_has_s") & F.col("_has_t") & (F.col("n_diff") == 0), F.col("_n"))), F.lit(0))
            .alias("clean_pairs"))
        j = merge_single_rows(ks, ps)  # two single-row aggregates side by side
        mismatch = (F.col("missing_keys") + F.col("extra_keys") + F.col("unpaired_rows")
                    + F.col("differing_cells"))
        one_to_one = ((F.col("missing_keys") == 0) & (F.col("extra_keys") == 0)
                      & (F.col("src_rows") == F.col("tgt_rows"))
                      & (F.col("max_src_per_key") <= 1) & (F.col("max_tgt_per_key") <= 1))
        matched = F.col("exact_pairs") + F.col("clean_pairs")
        score = (F.when(F.col("src_rows") == 0,
                        F.when(F.col("tgt_rows") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
                 .when(F.col("one_to_one"),
                       F.greatest(F.lit(0.0), (F.col("src_rows") - F.col("mismatch_count"))
                                  / F.col("src_rows")))
                 .otherwise(F.col("rows_matched") / F.col("src_rows")))
        out = (j.withColumn("mismatch_count", mismatch)
               .withColumn("one_to_one", one_to_one)
               .withColumn("rows_matched", matched)
               .withColumn("score", F.round(F.least(F.lit(1.0), score.cast("double")), 4))
               .withColumn("status", F.when(F.col("mismatch_count") == 0, F.lit("PASS"))
                           .otherwise(F.lit("FAIL"))))
        return out.select("src_rows", "tgt_rows", "rows_compared", "rows_matched", "missing_keys",
                          "extra_keys", "duplicate_key_warnings", "unpaired_rows",
                          "differing_cells", "mismatch_count", "one_to_one", "score", "status")

    # --------------------------------------------------------------- D13
    @property
    def evidence_rows(self) -> DataFrame:
        """All evidence: ``type``, ``key``, ``column``,
        ``source_value``, ``target_value``, ``category``."""
        return self._ranked_evidence.drop("_cls", "_k", "_ord")

    def evidence(self, n: int | None = None) -> DataFrame:
        """The first n of ``evidence_rows``, with the number of all
        (``total_count``) and whether some are left out (``truncated``).
        The evidence is written once; tasks keep a heap of n rows each.

        Order: missing keys, extra keys, then cells and unpaired rows by
        key, then the duplicate-key warning."""
        n = self.cfg.max_evidence if n is None else n
        ev = written(self._ranked_evidence, "evidence")
        total = ev.count()                                   # from the files' footers
        top = ev.orderBy("_cls", "_k", "_ord", "column", "source_value", "target_value").limit(n)
        return top.drop("_cls", "_k", "_ord").withColumns({"total_count": F.lit(total).cast("long"), "truncated": F.lit(total > n)})

    @cached_property
    def _ranked_evidence(self) -> DataFrame:
        keymap = F.create_map(*[x for k in self.keys for x in (F.lit(k), F.col(k).cast("string"))]) \
            if self.keys else F.create_map().cast("map<string,string>")
        null_s = F.lit(None).cast("string")
        pres = self.key_presence.select(
            F.when(F.col("presence") == MISSING, F.lit(0)).otherwise(F.lit(1)).alias("_cls"),
            F.struct(*self.keys).alias("_k") if self.keys else F.lit(None).alias("_k"),
            F.lit(0).alias("_ord"),
            F.when(F.col("presence") == MISSING, F.lit("MISSING_TARGET_ROW"))
            .otherwise(F.lit("MISSING_SOURCE_ROW")).alias("type"),
            keymap.alias("key"), null_s.alias("column"), null_s.alias("source_value"),
            null_s.alias("target_value"), F.col("presence").alias("category"))
        cells = self.cells.select(
            F.lit(2).alias("_cls"), F.struct(*self.keys).alias("_k") if self.keys else F.lit(None).alias("_k"),
            F.lit(1).alias("_ord"), F.lit("VALUE_MISMATCH").alias("type"), keymap.alias("key"),
            "column", "source_value", "target_value", F.lit(VALUE).alias("category"))
        unp = self.unpaired.select(
            F.lit(2).alias("_cls"), F.struct(*self.keys).alias("_k") if self.keys else F.lit(None).alias("_k"),
            F.lit(0).alias("_ord"),
            F.when(F.col("category") == MISSING, F.lit("MISSING_TARGET_ROW"))
            .otherwise(F.lit("MISSING_SOURCE_ROW")).alias("type"),
            keymap.alias("key"), null_s.alias("column"), null_s.alias("source_value"),
            null_s.alias("target_value"), "category")
        warn = (self.key_stats.agg(F.count(F.when((F.col("ks") > 0) & (F.col("kt") > 0)
                                                  & ((F.col("ks") > 1) | (F.col("kt") > 1)), 1)).alias("_n"))
                .filter(F.col("_n") > 0)
                .select(F.lit(3).alias("_cls"),
                        F.lit(None).cast(pres.schema["_k"].dataType).alias("_k"), F.lit(0).alias("_ord"),
                        F.lit("DUPLICATE_KEY_WARNING").alias("type"),
                        F.create_map().cast("map<string,string>").alias("key"), null_s.alias("column"),
                        F.format_string("key %s repeats in %d groups",
                                        F.lit(str(self.keys)), F.col("_n")).alias("source_value"),
                        null_s.alias("target_value"), F.lit(WARNING).alias("category")))
        return pres.unionByName(cells).unionByName(unp).unionByName(warn)


def each_copy(rows: DataFrame, step: int = 1 << 16) -> DataFrame:
    """A row for each of ``_n`` copies, in two levels, so that no array grows
    with the number of copies beyond a 65,536th of it."""
    whole = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step))))
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(step).cast("long"), F.col("_n") - F.col("_block") * step))))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` where NULL matches NULL (``<=>``); Spark plans
    null-safe keys as ordinary hash / sort-merge join keys.  The result
    keeps one copy of each key column (the left one, or the right one for
    rows only the right side has)."""
    r = right.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r["_r_" + k]) for k in keys])
    j = left.join(r, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return j
    if how in ("full", "outer", "full_outer", "right", "right_outer"):
        j = j.select(*[F.coalesce(left[k], r["_r_" + k]).alias(k) if k in keys else left[k]
                       for k in left.columns],
                     *[r[c] for c in r.columns if not c.startswith("_r_")])
        return j
    return j.drop(*["_r_" + k for k in keys])


def compare_rows(src: DataFrame, tgt: DataFrame, keys: list[str] | None = None,
                 cfg: CompareConfig | None = None) -> RowComparison:
    """Set up the D-row comparison.  Default key is the first source column.

    Raises ComparisonKeyError when a key is absent from either schema."""
    cfg = cfg or CompareConfig()
    keys = list(keys or cfg.keys or [])
    if not keys:
        if not src.columns:
            raise ComparisonKeyError("rows need a key to be compared")
        keys = [src.columns[0]]
    for k in keys:
        if k not in src.columns:
            raise ComparisonKeyError(f"the source has no column {k!r}")
        if k not in tgt.columns:
            raise ComparisonKeyError(f"the target has no column {k!r}")
    cols = [c for c in src.columns if c in tgt.columns and c not in keys]
    types = {c: common_type(src, tgt, c) for c in keys + cols}
    return RowComparison(src, tgt, keys, cols, cfg, types)


def common_type(src: DataFrame, tgt: DataFrame, c: str) -> T.DataType:
    """The type in which a column's two sides are compared; both sides cast
    to it without error."""
    a, b = src.schema[c].dataType, tgt.schema[c].dataType
    if a == b:
        return a
    if isinstance(a, T.BooleanType) and is_numeric(b):
        return b
    if isinstance(b, T.BooleanType) and is_numeric(a):
        return a
    if is_numeric(a) and is_numeric(b):
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(a, whole) and isinstance(b, whole):
            return T.LongType()
        if all(isinstance(t, (*whole, T.DecimalType)) for t in (a, b)):
            return src.select(c).union(tgt.select(c)).schema[0].dataType
        return T.DoubleType()
    return T.StringType()


def six_digits(x: Column) -> Column:
    """A number's decimal exponent and six significant digits (below a
    tenth: millionths), as text; null for null."""
    e = F.floor(F.log10(F.abs(x)))
    return (F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
            .when(F.abs(x) < 0.1, F.concat(F.lit("#"), F.floor(x * 1e6 + 0.5).cast("string")))
            .when(F.abs(x) > 1e300, F.concat(F.lit("#"), x.cast("string")))
            .otherwise(F.concat(F.lit("#"), e.cast("string"), F.lit(":"), F.floor(x / F.pow(F.lit(10.0), e) * 100000 + 0.5).cast("string"))))
